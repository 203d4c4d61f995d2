"""Encoders: symbols (trial, t, process, code) from samples (trial, t, process, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def identity(samples: DataFrame) -> DataFrame:
    """Codes 0.. of the distinct values of each process, in their order."""
    codes = samples.select("process", "value").distinct().withColumn("code", F.row_number().over(Window.partitionBy("process").orderBy("value")) - 1)
    return samples.join(codes, ["process", "value"]).select("trial", "t", "process", F.col("code").cast("int").alias("code"))


def _by_edges(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """The number of edges at or below each value; edges are one small row for each process."""
    return samples.join(edges, "process").select("trial", "t", "process", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("code"))


def equal_frequency(samples: DataFrame, bins: int) -> DataFrame:
    """Inner edges at linear quantiles, pooled over trials."""
    at = [k / bins for k in range(1, bins)]
    return _by_edges(samples, samples.groupBy("process").agg(F.percentile("value", F.array(*map(F.lit, at))).alias("edges")))


def equal_width(samples: DataFrame, bins: int) -> DataFrame:
    edges = samples.groupBy("process").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    inner = F.array(*[F.col("a") + (F.col("b") - F.col("a")) * F.lit(k / bins) for k in range(1, bins)])
    return _by_edges(samples, edges.select("process", inner.alias("edges")))


def threshold(samples: DataFrame, quantile: float = 0.9, at: float | None = None) -> DataFrame:
    """1 where a value lies above a level, given or a quantile of its process."""
    if at is not None:
        return samples.select("trial", "t", "process", (F.col("value") > at).cast("int").alias("code"))
    levels = samples.groupBy("process").agg(F.percentile("value", F.lit(quantile)).alias("level"))
    return samples.join(levels, "process").select("trial", "t", "process", (F.col("value") > F.col("level")).cast("int").alias("code"))


def ordinal(samples: DataFrame, order: int = 3, delay: int = 1) -> DataFrame:
    """Bandt-Pompe patterns of `order` values `delay` apart, earlier first among equals, as a number in base `order`; the first steps of a trial have none."""
    w = Window.partitionBy("trial", "process").orderBy("t")
    parts = [F.lag("value", (order - 1 - k) * delay).over(w).alias(f"v{k}") for k in range(order)]
    rows = samples.select("trial", "t", "process", *parts).where("v0 is not null")
    code = F.lit(0)
    for k in range(order):
        rank = sum((F.when((F.col(f"v{j}") < F.col(f"v{k}")) | ((F.col(f"v{j}") == F.col(f"v{k}")) & F.lit(j < k)), 1).otherwise(0) for j in range(order)), F.lit(0))
        code = code * order + rank
    spread = sum((F.col(f"v{k}") for k in range(order)), F.lit(0.0)) / order
    weight = sum(((F.col(f"v{k}") - spread) ** 2 for k in range(order)), F.lit(0.0)) / order
    return rows.select("trial", "t", "process", code.cast("int").alias("code"), weight.alias("weight"))


def average_ranks(samples: DataFrame) -> DataFrame:
    """(average rank - 1/2) / n within a process, pooled over trials."""
    by = Window.partitionBy("process")
    rows = samples.select("*", F.rank().over(by.orderBy("value")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("process", "value")).alias("ties"), F.count(F.lit(1)).over(by).alias("n"))
    return rows.select("trial", "t", "process", ((F.col("r") + (F.col("ties") - 1) / 2 - 0.5) / F.col("n")).alias("rank"))
