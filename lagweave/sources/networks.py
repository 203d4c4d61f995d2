"""Benchmark series with known networks, and files of networks."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.sources.series import interpolate


def matrix_arcs(spark: SparkSession, matrix, lag: int | None = None) -> DataFrame:
    """(source, target, lag) of the nonzero entries off the diagonal."""
    m = np.asarray(matrix)
    found = [(int(i), int(j), lag) for i, j in np.argwhere(m != 0) if i != j]
    return spark.createDataFrame(found, "source int, target int, lag int")


def station(name: Column) -> Column:
    """One spelling of a station's id: 12, '12' and ' 12.0 ' are the same."""
    text = F.trim(name.cast("string"))
    whole = text.try_cast("double")
    return F.coalesce(whole.cast("long").cast("string"), text)


def read_rivers(spark: SparkSession, path: str, step: int = 900) -> DataFrame:
    """The long form of a csv table whose first column is the time and whose others are stations; t counts steps of `step` seconds from the first time. Empty fields are missing values."""
    wide = spark.read.option("header", True).csv(path)
    time, *names = wide.columns
    seconds = F.unix_timestamp(F.to_timestamp(F.col(f"`{time}`")))
    typed = wide.select(seconds.alias("_s"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names])
    first = typed.agg(F.min("_s").alias("_first"))
    rows = typed.crossJoin(F.broadcast(first)).withColumn("t", F.floor((F.col("_s") - F.col("_first")) / step))
    long = rows.unpivot(["t"], [F.col(f"`{c}`") for c in names], "process", "value")
    return long.select(F.lit(0).cast("long").alias("trial"), "t", station(F.col("process")).alias("process"), "value")


def subset(samples: DataFrame, arcs: DataFrame, chosen: list, block: int = 1, gaps: str = "interpolate") -> tuple[DataFrame, DataFrame]:
    """The series of some stations with the arcs among them. Blocks are averaged over what is there; then gaps are filled and the ends trimmed to complete steps (`interpolate`), or incomplete steps go (`drop`)."""
    if gaps not in ("interpolate", "drop"):
        raise ValueError("gaps must be 'interpolate' or 'drop'")
    spark = samples.sparkSession
    keep = spark.createDataFrame([(str(c),) for c in chosen], "process string").select(station(F.col("process")).alias("process"))
    rows = samples.join(F.broadcast(keep), "process").select("trial", "t", "process", "value")
    if block > 1:
        blocks = rows.groupBy("trial", "process", F.floor(F.col("t") / block).alias("t")).agg(F.avg("value").alias("value"), F.max("t").alias("last"))
        end = rows.agg(F.floor((F.max("t") + 1) / block).alias("end"))
        rows = blocks.crossJoin(F.broadcast(end)).where("t < end").select("trial", "t", "process", "value")
    if gaps == "interpolate":
        rows = interpolate(rows)
    full = rows.groupBy("trial", "t").agg(F.count("value").alias("known")).where(F.col("known") == len({str(c) for c in chosen})).select("trial", "t")
    if gaps == "interpolate":
        ends = full.groupBy("trial").agg(F.min("t").alias("a"), F.max("t").alias("b"))
        rows = rows.join(F.broadcast(ends), "trial").where("t >= a and t <= b").drop("a", "b")
    else:
        rows = rows.join(full, ["trial", "t"])
    inside = arcs.join(F.broadcast(keep.select(F.col("process").alias("source"))), "source").join(F.broadcast(keep.select(F.col("process").alias("target"))), "target")
    return rows, inside.select("source", "target")


def grow(arcs: DataFrame, size: int, seed: int = 0) -> list[str]:
    """A connected set of `size` nodes, grown from one node by one neighbour at a time, each drawn by the md5 of seed, step and node; ValueError where no component is that large."""
    both = arcs.select(F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"))
    both = both.union(both.select("b", "a")).where("a != b").distinct()

    def draw(rows: DataFrame, k: int) -> str | None:
        return rows.agg(F.min_by("a", F.md5(F.concat_ws(" ", F.lit(f"{seed} {k}"), "a")))).first()[0]

    out = both.select("a")
    while True:
        chosen = [draw(out, 0)]
        if chosen[0] is None:
            raise ValueError(f"no connected set of {size} nodes")
        while len(chosen) < size:
            more = draw(both.where(F.col("b").isin(chosen) & ~F.col("a").isin(chosen)), len(chosen))
            if more is None:
                break
            chosen.append(more)
        if len(chosen) == size:
            return chosen
        out = out.where(~F.col("a").isin(chosen))  # that component is too small as a whole


def _array(spark: SparkSession, path: str) -> np.ndarray:
    """One npy file, from any store that Spark can read."""
    return np.load(io.BytesIO(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])))


def read_arrays(spark: SparkSession, data: str, graph: str, forward: bool = True, residuals: bool = True) -> tuple[DataFrame, DataFrame]:
    """Series (time, node) or (sample, time, node) and their matrix from npy files. With `residuals` the matrix has rows and columns for residual terms after the nodes, which go; unless `forward`, entry (i, j) means j to i."""
    x, m = _array(spark, data), _array(spark, graph)
    if residuals and len(m) % 2:
        raise ValueError("a matrix with residual terms has an even number of rows")
    n = len(m) // 2 if residuals else len(m)
    m = m[:n, :n] if forward else m[:n, :n].T
    x = np.asarray(x[..., :n], float)
    x = x[None] if x.ndim == 2 else x
    trial, t, p = (v.ravel() for v in np.indices(x.shape))
    frame = pd.DataFrame({"trial": trial.astype("int64"), "t": t.astype("int64"), "process": p.astype(str), "value": x.ravel()})
    return spark.createDataFrame(frame, "trial long, t long, process string, value double"), matrix_arcs(spark, m)


def score_rows(edges: DataFrame, score: str = "score") -> DataFrame:
    """One row for each source: the scores of all targets in the order of their names, none below 0, 0 for itself and for edges without one."""
    names = edges.select(F.col("source").alias("p")).union(edges.select("target")).distinct()
    grid = names.select(F.col("p").alias("source")).join(names.select(F.col("p").alias("target")))
    rows = grid.join(edges.select("source", "target", F.greatest(F.col(score), F.lit(0.0)).alias("v")), ["source", "target"], "left")
    value = F.when(F.col("source") == F.col("target"), 0.0).otherwise(F.coalesce("v", F.lit(0.0)))
    return rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("target", value.alias("v")))).alias("row")).select("source", F.col("row.v").alias("scores"))


def upload(results: list[DataFrame], method: str, **fields) -> str:
    """The json text of a benchmark upload: the score matrix of each result, row after row. A matrix has as many rows as its network has processes."""
    flat = [[v for r in score_rows(e).orderBy("source").collect() for v in r.scores] for e in results]
    return json.dumps({"method_sha": method, **fields, "scores": flat})


def viewer_lines(edges: DataFrame, places: DataFrame, significant: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lines of a brain viewer's node and edge files, in the order of `k`: places (process, x, y, z), tab-separated weights of edges (source, target, weight, significant)."""
    by = Window.orderBy("process")  # a network's processes, not its series
    order = places.withColumn("k", F.row_number().over(by))
    nodes = order.select("k", F.concat_ws("\t", *[F.format_string("%.3f", F.col(c).cast("double")) for c in "xyz"], F.lit("1"), F.lit("1"), F.replace(F.col("process"), F.lit(" "), F.lit("_"))).alias("line"))
    used = edges.where("significant") if significant else edges
    a = order.select("k", F.col("process").alias("source"))
    b = order.select(F.col("k").alias("j"), F.col("process").alias("target"))
    grid = a.join(b).join(used.select("source", "target", "weight"), ["source", "target"], "left")
    cell = F.format_string("%.6f", F.coalesce(F.nanvl(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = grid.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("j", cell.alias("v")))).alias("row"))
    return nodes, rows.select("k", F.concat_ws("\t", F.col("row.v")).alias("line"))
