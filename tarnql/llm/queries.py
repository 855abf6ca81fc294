"""The operators as queries over the supplied tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, common, decontam, exact, langid, lm, pii, quality, simhash, toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(common.table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(common.table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.table(spark, sf_dir, "documents"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(common.table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(common.table(spark, sf_dir, "conversations"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.annotate(docs, common.table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "score", predicted)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_language": op3_language,
    "op4_exact": op4_exact,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_lm": op10_lm,
}
ORACLE_SQL = {"op1_pii": pii.ORACLE, "op4_exact": exact.ORACLE, "op5_decontamination": decontam.ORACLE, "op7_chat": chat.ORACLE}
