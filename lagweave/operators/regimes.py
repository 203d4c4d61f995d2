"""Regimes: windows of a symbol series grouped by the laws of their transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transitions(symbols: DataFrame, window: int) -> DataFrame:
    """Counts n of (window, process, w, y): symbol y after symbol w, both in the window; a last window that is cut short goes."""
    rows = symbols.withColumn("window", F.floor(F.col("t") / window))
    now, before = rows.alias("a"), rows.select("trial", "process", "window", (F.col("t") + 1).alias("t"), F.col("code").alias("w")).alias("b")
    joined = now.join(before, ["trial", "process", "window", "t"]).groupBy("trial", "window", "process", "w", F.col("code").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    whole = rows.groupBy("trial", "window", "process").agg(F.count(F.lit(1)).alias("size")).groupBy("trial", "window").agg(F.min("size").alias("size")).where(F.col("size") == window).select("trial", "window")
    return joined.join(whole, ["trial", "window"])


def log_likelihood(cells: DataFrame, assigned: DataFrame, regimes: int, levels: int, prior: float = 0.5) -> DataFrame:
    """(trial, window, regime, loglik): how well the counts of each regime, the window's own left out, predict the window."""
    by = ["process", "w", "y"]
    mine = cells.join(assigned, ["trial", "window"])
    pool = mine.groupBy("regime", *by).agg(F.sum("n").alias("pool"))
    context = pool.groupBy("regime", "process", "w").agg(F.sum("pool").alias("pool_w"))
    own = mine.groupBy("trial", "window", "process", "w").agg(F.sum("n").alias("own_w"))
    rows = mine.withColumnRenamed("regime", "home").join(own, ["trial", "window", "process", "w"])
    rows = rows.withColumn("regime", F.explode(F.array(*[F.lit(k) for k in range(regimes)])))
    rows = rows.join(pool, ["regime", *by], "left").join(context, ["regime", "process", "w"], "left")
    here = F.col("home") == F.col("regime")
    top = F.coalesce("pool", F.lit(0)) - F.when(here, F.col("n")).otherwise(0) + prior
    bottom = F.coalesce("pool_w", F.lit(0)) - F.when(here, F.col("own_w")).otherwise(0) + prior * levels
    return rows.groupBy("trial", "window", "regime").agg(F.sum(F.col("n") * F.log(top / bottom)).alias("loglik"))


def infer(symbols: DataFrame, regimes: int = 2, window: int = 72, rounds: int = 4, levels: int = 2) -> DataFrame:
    """(trial, window, regime): windows start ordered by their share of changes and cut into equal runs, then move to the regime that predicts them best.

    The window table is cut from its lineage after each round where a checkpoint
    folder is set; it has one row for a window, not for a step.
    """
    spark = symbols.sparkSession
    keep = (lambda f: f.checkpoint()) if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) else (lambda f: f)
    cells = keep(transitions(symbols, window))
    change = cells.groupBy("trial", "window").agg((F.sum(F.when(F.col("w") != F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))
    marks = change.agg(F.percentile("rate", F.array(*[F.lit(k / regimes) for k in range(1, regimes)])).alias("q"))
    above = reduce(lambda a, b: a + b, [F.when(F.col("rate") > F.col("q")[k], 1).otherwise(0) for k in range(regimes - 1)])
    found = change.join(F.broadcast(marks)).select("trial", "window", above.alias("regime"))  # marks is one row
    for _ in range(rounds):
        scores = log_likelihood(cells, keep(found), regimes, levels)
        found = scores.groupBy("trial", "window").agg(F.max(F.struct(F.round("loglik", 9).alias("v"), (-F.col("regime")).alias("r"))).alias("m")).select("trial", "window", (-F.col("m.r")).cast("int").alias("regime"))
    return found
