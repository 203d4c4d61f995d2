"""What the operators share: cutting lineage, folds, words, memory of workers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java, Python and RE2 alike: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts, as the session or its context names it. Only a session of a single process gets one of its own; elsewhere an unset folder is an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lagweave-')}")
        at = context.getCheckpointDir()
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and reread it: later stages don't recompute what stands above, and survive lost executors. The table is deleted by drop_cuts(), or else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lagweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lagweave_cut = path
    return out


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df._lagweave_cut)


def cuts_made() -> frozenset[str]:
    return frozenset(_made)


def drop_cuts(spark: SparkSession, before: frozenset[str] = frozenset(), but: DataFrame | None = None) -> None:
    """Delete all tables made by cut() but those made `before` and `but`: for callers who have written a result that was read from them."""
    for path in list(_made):
        if path not in before and (but is None or path != but._lagweave_cut):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _made:
        at, files = _path(spark, path)
        files.delete(at, True)
        _made.remove(path)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `docs` is called so (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hand what Arrow's pool and the C library have freed back to the system: workers outlive their tasks, and would hold it beside what later stages need."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def lent(batches: Iterator, forget: Callable[[], object] = lambda: None) -> Iterator:
    """The batches of a task, with give_back() around each; `forget` empties the task's memory of earlier values at its end."""
    give_back()
    try:
        for batch in batches:
            yield batch
            give_back()
    finally:
        batch = None
        forget()
        give_back()
