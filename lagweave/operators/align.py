"""Alignment of lagged variables within trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(symbols: DataFrame, lags: list[int], own: int = 1) -> DataFrame:
    """Realizations of all ordered pairs: (source, target, lag, trial, t, y, x, w), y the target now, x the source `lag` steps before, w the target `own` steps before. An equi-join on trial and time; windows never cross trials."""
    past = Window.partitionBy("trial", "process").orderBy("t")
    target = symbols.select("trial", "t", F.col("process").alias("target"), F.col("code").alias("y"), F.lag("code", own).over(past).alias("w")).where("w is not null")
    shifted = symbols.select("trial", "t", F.col("process").alias("source"), F.col("code").alias("x"))
    shifted = shifted.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("t", F.col("t") + F.col("lag"))
    return target.join(shifted, ["trial", "t"]).where("source != target").select("source", "target", "lag", "trial", "t", "y", "x", "w")


def common_sample(realizations: DataFrame, largest: int) -> DataFrame:
    """Rows that exist for every lag up to `largest`: the same for all candidates."""
    return realizations.where(F.col("t") >= largest)


def split_time(symbols: DataFrame, fraction: float) -> DataFrame:
    """The first share of each trial's steps and the rest: part 0 or 1, steps counted anew."""
    n = F.count(F.lit(1)).over(Window.partitionBy("trial", "process"))
    cut = F.floor(n * fraction)
    part = (F.col("t") >= cut).cast("int")
    return symbols.select("trial", part.alias("part"), (F.col("t") - F.when(part == 1, cut).otherwise(0)).alias("t"), "process", "code")


def windows(symbols: DataFrame, size: int) -> DataFrame:
    """Whole windows of `size` steps, each a trial of its own."""
    n = F.max("t").over(Window.partitionBy("trial", "process")) + 1
    rows = symbols.withColumn("window", F.floor(F.col("t") / size)).withColumn("n", n).where((F.col("window") + 1) * size <= F.col("n"))
    return rows.select("trial", "window", (F.col("t") % size).alias("t"), "process", "code")


def windowed_pairs(symbols: DataFrame, own: int, source: int, lag: int = 1) -> DataFrame:
    """Realizations of all ordered pairs: y the target now, w its last `own` values, x `source` values of the source, the nearest `lag` steps back. Pasts are arrays, nearest first."""
    past = Window.partitionBy("trial", "process").orderBy("t")
    target = symbols.select("trial", "t", F.col("process").alias("target"), F.col("code").alias("y"), F.array(*[F.lag("code", k).over(past) for k in range(1, own + 1)]).alias("w"), F.lag("code", own).over(past).alias("_whole")).where("_whole is not null").drop("_whole")
    before = symbols.select("trial", (F.col("t") + lag).alias("t"), F.col("process").alias("source"), F.array(*[F.lag("code", k).over(past) if k else F.col("code") for k in range(source)]).alias("x"), (F.lag("code", source - 1).over(past) if source > 1 else F.col("code")).alias("_whole")).where("_whole is not null").drop("_whole")
    return target.join(before, ["trial", "t"]).where("source != target").select("source", "target", "trial", "t", "y", "x", "w")


def add_context(symbols: DataFrame, label: Column, name: str = "context") -> DataFrame:
    """The series with one more process, constant in each trial: the code `label` of its trial."""
    steps = symbols.select("trial", "t").distinct()
    return symbols.select("trial", "t", "process", "code").unionByName(steps.select("trial", "t", F.lit(name).alias("process"), label.alias("code")))


def pooled(units: list[DataFrame], stride: int) -> DataFrame:
    """The trials of several units side by side, numbered anew: unit times `stride` plus trial."""
    out = units[0].select((F.col("trial") + 0 * stride).alias("trial"), "t", "process", "code")
    for k, unit in enumerate(units[1:], 1):
        out = out.unionByName(unit.select((F.col("trial") + k * stride).alias("trial"), "t", "process", "code"))
    return out


def subset_trials(symbols: DataFrame, trials: list[int]) -> DataFrame:
    return symbols.where(F.col("trial").isin(trials))
