"""Tables that a stream keeps up to date, one version for each micro-batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; without that setting only a session of one process gets one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="streams")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


class Running:
    """A table that each micro-batch makes anew from its last version and its own rows.

    Version k + 1 is written from version k and batch k, so that a batch run
    twice after a failure gives the same table.
    """

    def __init__(self, spark: SparkSession, schema: str, step: Callable[[DataFrame, DataFrame], DataFrame], home: str | None = None):
        self.spark, self.schema, self.step, self.home = spark, schema, step, home or folder(spark)
        self.batch = -1

    def version(self, batch: int) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if batch < 0 else self.spark.read.schema(self.schema).parquet(f"{self.home}/table/{batch}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        self.step(self.version(batch - 1), rows).write.mode("overwrite").parquet(f"{self.home}/table/{batch}")
        self.batch = batch

    def drain(self, stream: DataFrame) -> DataFrame:
        """Run until all that is there now is taken in; the table after the last batch."""
        q = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.home}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.version(self.batch)


def add_counts(symbols: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The step of a count table: only cells travel, never the rows counted before."""

    def step(table: DataFrame, rows: DataFrame) -> DataFrame:
        new = rows.groupBy(*symbols).agg(F.count(F.lit(1)).alias("n"))
        return table.unionByName(new).groupBy(*symbols).agg(F.sum("n").alias("n"))

    return step


def count_late(delay: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The step of a table (event_type, seen, n, late): rows that lie more than `delay` before the latest one of earlier batches are counted apart as well."""

    def step(table: DataFrame, rows: DataFrame) -> DataFrame:
        before = rows.join(F.broadcast(table.select("event_type", F.col("seen").alias("last"))), "event_type", "left")  # a row for each type
        late = F.count_if(F.col("ts") < F.col("last") - F.expr(f"INTERVAL {delay}"))
        new = before.groupBy("event_type").agg(F.max("ts").alias("seen"), F.count(F.lit(1)).alias("n"), late.alias("late"))
        return table.unionByName(new).groupBy("event_type").agg(F.max("seen").alias("seen"), F.sum("n").alias("n"), F.sum("late").alias("late"))

    return step


def events_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The parquet files that match `path` as a stream, `files` of them to a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
