"""A corpus from raw documents to token ids: STAGES in order, each reading what the one before has kept.

Toxic documents go, then all but the least doc_id of every group of near
copies, then documents that hold a benchmark item; personal data is replaced;
what is left is encoded. No stage but the last changes the columns of the
table; rows with null texts, or without an id, pass the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import decontaminate, ngram_join, pii, registry, toxicity, wfst
from lagweave.llm.common import cut, cuts_made, drop_cuts
from lagweave.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, registry.toxicity_model(spark, sf_dir, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = pii.replace(docs, registry.PII_KEY)
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return replaced.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wfst.encode(docs, wfst.Transducer(wfst.read_pieces()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentencepiece", encode),
]

#: No stage can be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), cuts_made()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            drop_cuts(spark, before, but=docs)  # what the stage has read or left behind
    return docs
