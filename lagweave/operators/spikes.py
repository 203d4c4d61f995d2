"""Encoders of spike trains: symbols of the past from a binary series (trial, t, process, value), a spike where value > 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_by = ("trial", "process")


def indicator(samples: DataFrame) -> DataFrame:
    return samples.select("trial", "t", "process", (F.coalesce(F.col("value"), F.lit(0.0)) > 0).cast("int").alias("code"))


def intervals(samples: DataFrame) -> DataFrame:
    """The steps between one spike and the next of a process: (trial, t, process, interval), t that of the later spike."""
    spikes = indicator(samples).where("code = 1")
    past = F.lag("t").over(Window.partitionBy(*_by).orderBy("t"))
    return spikes.select("trial", "t", "process", (F.col("t") - past).alias("interval")).where("interval is not null")


def exponential_bins(samples: DataFrame, edges: list[int]) -> DataFrame:
    """Whether a spike lies in each stretch of the past, the nearest as the lowest bit; stretch j covers the steps edges[j] to edges[j + 1] - 1 back, 0 the step itself. Undefined where the last stretch is not whole."""
    w = Window.partitionBy(*_by).orderBy("t")
    rows = indicator(samples)
    bits = [F.max("code").over(w.rowsBetween(1 - edges[j + 1], -edges[j])) * (1 << j) for j in range(len(edges) - 1)]
    rows = rows.select("trial", "t", "process", sum(bits[1:], bits[0]).cast("int").alias("code"), F.row_number().over(w).alias("k"))
    return rows.where(F.col("k") >= edges[-1]).drop("k")


def growing_edges(window: int, depth: int, growth: float = 0.0) -> list[int]:
    """Ends of `depth` stretches that fill a window, their widths growing as 10^(j growth): rounded, then moved apart from the front, then from the back, so that each is a step wide at least."""
    if window < depth:
        raise ValueError(f"{depth} stretches do not fit in {window} steps")
    widths = [10 ** (j * growth) for j in range(depth)]
    ends = [round(sum(widths[:j]) * window / sum(widths)) for j in range(depth)] + [window]
    for j in range(1, depth):
        ends[j] = max(ends[j], ends[j - 1] + 1)
    for j in range(depth - 1, 0, -1):
        ends[j] = min(ends[j], ends[j + 1] - 1)
    return ends


def _last_spikes(samples: DataFrame, k: int) -> DataFrame:
    """The times of the k last spikes up to each step, the latest first."""
    w = Window.partitionBy(*_by).orderBy("t")
    spikes = F.when(F.col("code") == 1, F.col("t"))
    rows = indicator(samples).withColumn("at", spikes).withColumn("number", F.sum("code").over(w))
    times = rows.where("code = 1").select(*_by, "number", F.array(*[F.lag("t", j).over(w) for j in range(k)]).alias("times"))
    return rows.join(times, [*_by, "number"], "left").select("trial", "t", "process", "times")


def _quantiles(rows: DataFrame, value: Column, bins: int, name: str) -> DataFrame:
    """Discrete quantiles of a process: values that occur, not between them."""
    at = [F.expr(f"percentile_disc({q / bins}D) WITHIN GROUP (ORDER BY v)").alias(f"{name}{q}") for q in range(1, bins)]
    return rows.select("process", value.alias("v")).groupBy("process").agg(*at)


def spike_intervals(samples: DataFrame, k: int = 2, bins: int = 3, longest: int = 50) -> DataFrame:
    """Time since the last spike and the k - 1 intervals before it, either in bins at discrete quantiles of its own kind; one symbol more where the last `longest` steps hold fewer than k spikes. Undefined before that many steps."""
    rows = _last_spikes(samples, k)
    since = F.col("t") - F.get("times", F.lit(0))
    rows = rows.join(_quantiles(rows.where(since < longest), since, bins, "s"), "process", "left").join(_quantiles(intervals(samples), F.col("interval"), bins, "e"), "process", "left")

    def level(span: Column, name: str) -> Column:
        above = [F.when(span >= F.col(f"{name}{q}"), 1).otherwise(0) for q in range(1, bins)]
        return sum(above[1:], above[0])

    code = level(since, "s")
    for j in range(1, k):
        code = code * bins + level(F.get("times", F.lit(j - 1)) - F.get("times", F.lit(j)), "e")
    whole = F.col("t") - F.get("times", F.lit(k - 1)) < longest
    return rows.where(F.col("t") >= longest - 1).select("trial", "t", "process", F.when(whole, code).otherwise(bins**k).cast("int").alias("code"))


def ordinal_intervals(samples: DataFrame, order: int = 3, longest: int = 50) -> DataFrame:
    """The pattern of the `order` last intervals, earlier first among equals, as a number in base `order`; order^order where their spikes do not all lie in the last `longest` steps. Undefined before that many steps."""
    rows = _last_spikes(samples, order + 1).where(F.col("t") >= longest - 1)
    spans = [F.get("times", F.lit(order - 1 - j)) - F.get("times", F.lit(order - j)) for j in range(order)]  # oldest first
    code = F.lit(0)
    for k in range(order):
        below = [F.when((spans[j] < spans[k]) | ((spans[j] == spans[k]) & F.lit(j < k)), 1).otherwise(0) for j in range(order)]
        code = code * order + sum(below[1:], below[0])
    whole = F.col("t") - F.get("times", F.lit(order)) < longest
    return rows.select("trial", "t", "process", F.when(whole, code).otherwise(order**order).cast("int").alias("code"))
