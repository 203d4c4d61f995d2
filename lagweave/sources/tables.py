"""Parquet tables of a data folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; the path goes to Spark's reader alone, so any store it knows will do. Workers are told where this package lies."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def placed(rows: DataFrame) -> DataFrame:
    """A table as it was read, with `place`, which rises with the names of its files and with the rows of each: one long, as Spark sorts those fastest."""
    named = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.select(F.col("_metadata.file_path").alias("_file")).distinct().withColumn("_n", F.row_number().over(Window.orderBy("_file")))
    return named.join(F.broadcast(files), "_file").withColumn("place", F.shiftleft(F.col("_n").cast("long"), 40) + F.col("_row")).drop("_file", "_row", "_n")
