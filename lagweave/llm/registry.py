"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import chat, decontaminate, langid, lm, ngram_join, pii, quality, suffix_dedup, toxicity, wfst
from lagweave.llm.common import fold
from lagweave.sources.tables import table as _table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 10) == 0
    found = lm.score(_table(spark, sf_dir, "documents"), ~held_out, wfst.read_pieces())
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, net).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


#: Of the registered queries; a deployment passes its own secret.
PII_KEY = b"lagweave surrogate key"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    replaced = pii.replace(docs, PII_KEY)
    pii.check(replaced)
    return replaced.select("doc_id", F.size("entities").alias("n_entities"), "text", "entities")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = _table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return toxicity.learn(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode(_table(spark, sf_dir, "documents"), wfst.Transducer(wfst.read_pieces()))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_lattice_lm, op3_ngram_jaccard, op4_chat_perspectives, op5_language_id, op6_quality_cascade, op7_pii_surrogates, op8_decontamination, op9_toxicity, op10_sentencepiece)}
ORACLES = {"op4_chat_perspectives": chat.ORACLE, "op6_quality_cascade": quality.ORACLE}
