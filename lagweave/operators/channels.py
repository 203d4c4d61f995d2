"""Tables of an edge: contexts merged, degraded by a channel, and split into layers. Rows (keys, y, x, w, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def laws(table: DataFrame, keys: list[str], digits: int = 12) -> DataFrame:
    """(keys, w, cluster): contexts with one conditional law of (y, x), to `digits` digits, are one cluster, numbered in the order of their first context."""
    p = F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "w")), digits)
    law = table.select(*keys, "w", F.struct("y", "x", p.alias("p")).alias("cell")).groupBy(*keys, "w").agg(F.array_sort(F.collect_list("cell")).alias("law"))
    first = law.withColumn("first", F.min("w").over(Window.partitionBy(*keys, "law")))
    return first.select(*keys, "w", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("first")) - 1).alias("cluster"))


def merged(table: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """The table with its contexts summed up by a mapping (keys, w, cluster)."""
    return table.join(mapping, [*keys, "w"]).groupBy(*keys, "y", "x", F.col("cluster").alias("w")).agg(F.sum("n").alias("n"))


def degraded(table: DataFrame, channel: DataFrame) -> DataFrame:
    """The table as seen through a channel (w, z, q): its counts dealt out over z."""
    keys = [c for c in table.columns if c not in ("w", "n")]
    return table.join(channel, "w").groupBy(*keys, "z").agg(F.sum(F.col("n") * F.col("q")).alias("n"))


def hardened(channel: DataFrame) -> DataFrame:
    """A channel that sends every context to its likeliest output, the first of equal ones."""
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("q"), "z"))
    return channel.withColumn("r", rank).where("r = 1").select("w", "z", F.lit(1.0).alias("q"))


def layers(values: DataFrame) -> DataFrame:
    """te, tdmi and intrinsic with 0 <= intrinsic <= min(te, tdmi) enforced, the two remainders, and whether anything was moved."""
    te, tdmi, flow = F.col("te"), F.col("tdmi"), F.col("intrinsic")
    clipped = (flow < 0) | (flow > F.least(te, tdmi)) | (te < 0) | (tdmi < 0)
    zero = F.lit(0.0)
    te, tdmi = F.greatest(te, zero), F.greatest(tdmi, zero)
    flow = F.least(F.greatest(flow, zero), te, tdmi)
    rest = [c for c in values.columns if c not in ("te", "tdmi", "intrinsic")]
    return values.select(*rest, te.alias("te"), tdmi.alias("tdmi"), flow.alias("intrinsic"), (te - flow).alias("synergistic"), (tdmi - flow).alias("shared"), clipped.alias("clipped"))
