"""The corpus pipeline: five stages over documents, each deciding on all that the one before kept.

Every stage decides by row: where rows share a ``doc_id``, or have none, the stages that
drop duplicates tell them apart by text.  A null text counts as an empty one and stays null
where its row stays; an empty table gives an empty result.  Stages return ``COLUMNS``,
others are dropped, so no column's name can clash with one of an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import bpe, common, decontam, exact, quality, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of ``docs``."""
    scored = quality.annotate(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"), "_quality")
    return scored.where(F.col("_quality") >= quality.THRESHOLD).drop("_quality")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the longest, then the one with the smallest id."""
    return exact.distinct_documents(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows without an id come last, rows of one id by text."""
    rows = docs.select(*COLUMNS, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_sha"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_sha")
    found = simhash.near_duplicates(rows.select(key.alias("doc_id"), "text"))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id.doc_id", "doc_id._sha").distinct()
    same = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["_sha"] == gone["_sha"])
    return rows.join(gone, same, "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    A document goes if it holds a whole window of ``decontam.WINDOW`` words, however long it is
    itself, or is contaminated: a twentieth of its words are hit.  Shorter items alone, which
    clean texts may hold by chance, don't make a long document go.
    """
    found = decontam.annotate(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"), prefix="_")
    return found.where(~F.col("_contaminated") & (F.col("_n_longest") < decontam.WINDOW)).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.token_digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]
#: The classifier's stage can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder for the next; what a stage stored on the way goes once it has ended."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = common.scratch(spark)
        with common.temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
