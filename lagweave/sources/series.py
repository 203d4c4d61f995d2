"""Canonical series (trial, t, process, value) from event logs and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(events: DataFrame) -> DataFrame:
    """The events with `s`, their seconds since midnight of the first one's day."""
    first = events.agg(F.date_trunc("day", F.min("ts").cast("timestamp")).alias("first"))
    return events.crossJoin(F.broadcast(first)).withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp("first")).drop("first")


def spine(processes: DataFrame, n: int) -> DataFrame:
    """(process, t) for every step: bins without events exist too."""
    return processes.select("process").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("t").cast("long"))


def binned(events: DataFrame, value: Column, empty: float | None = 0.0) -> DataFrame:
    """An aggregate of the events of each hour and type on the dense spine of all days from the first event to the last; `empty` where there is none."""
    rows = seconds(events).select(F.col("event_type").alias("process"), F.floor(F.col("s") / 3600).alias("t"), "value")
    agg = rows.groupBy("process", "t").agg(value.alias("value"))
    last = agg.agg((F.floor(F.max("t") / 24) * 24 + 23).alias("last"))
    spine_ = agg.select("process").distinct().crossJoin(F.broadcast(last)).select("process", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t"))
    dense = spine_.join(agg, ["process", "t"], "left")
    return dense.select(F.lit(0).cast("long").alias("trial"), "t", "process", F.coalesce("value", F.lit(empty).cast("double")).alias("value") if empty is not None else F.col("value").cast("double"))


def spike_bins(spikes: DataFrame, dt: float, start: float = 0.0, stop: float | None = None) -> DataFrame:
    """Spikes (neuron, ts) counted in bins of width dt; those outside the window are dropped, empty bins kept. Without `stop` the window ends dt after the last spike."""
    neurons = spikes.select(F.col("neuron").alias("process"))
    if stop is None:
        last = spikes.agg(F.ceil((F.max("ts") + dt - start) / dt - 1e-9).alias("n")).select(F.greatest("n", F.lit(1)).alias("n"))
        dense = neurons.distinct().crossJoin(F.broadcast(last)).select("process", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t"))
        inside = F.col("ts") >= start
    else:
        dense = spine(neurons, int(round((stop - start) / dt)))
        inside = (F.col("ts") >= start) & (F.col("ts") < stop)
    k = F.floor((F.col("ts") - start) / dt + 1e-9)
    counts = spikes.where(inside).select(F.col("neuron").alias("process"), k.alias("t")).groupBy("process", "t").agg(F.count(F.lit(1)).alias("n"))
    return dense.join(counts, ["process", "t"], "left").select("process", "t", F.coalesce("n", F.lit(0)).alias("n"))


def split_gaps(samples: DataFrame, least: int) -> DataFrame:
    """Pieces of each trial without a missing value in any process; shorter ones than `least` go. (trial, piece, t) of what is left."""
    rows = samples.groupBy("trial", "t").agg(F.max(F.col("value").isNull().cast("int")).alias("bad"))
    w = Window.partitionBy("trial").orderBy("t")
    rows = rows.withColumn("piece", F.sum("bad").over(w)).where("bad = 0")
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("trial", "piece"))).where(F.col("size") >= least).select("trial", "piece", "t", "size")


def interpolate(samples: DataFrame) -> DataFrame:
    """Missing values on the line between their neighbours in time; none before the first or after the last value."""
    w = Window.partitionBy("trial", "process").orderBy("t")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.col("t"))
    rows = samples.select("*", F.last(known, True).over(back).alias("t0"), F.last("value", True).over(back).alias("v0"), F.first(known, True).over(ahead).alias("t1"), F.first("value", True).over(ahead).alias("v1"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return rows.select("trial", "t", "process", F.coalesce("value", line).alias("value"))


def block_means(samples: DataFrame, block: int) -> DataFrame:
    """Means over blocks of consecutive steps; a block with a missing value is missing, an incomplete last one goes."""
    rows = samples.groupBy("trial", "process", F.floor(F.col("t") / block).alias("t")).agg(F.avg("value").alias("m"), F.count("value").alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") == block).select("trial", "t", "process", F.when(F.col("k") == block, F.col("m")).alias("value"))
