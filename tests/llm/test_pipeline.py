"""The pipeline's stages, each judged on its own input."""

import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnql.llm import decontam, exact, quality, simhash

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


def test_run(spark, docs):
    out = corpus_pipeline.run(spark, TESTDATA).collect()
    assert 0 < len(out) <= docs.count() and len({r.doc_id for r in out}) == len(out)


def test_nothing_is_left_of_a_stage_but_its_result(spark):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*shared.iterdir()}
    corpus_pipeline.run(spark, TESTDATA).count()
    assert len({*shared.iterdir()} - before) == 1  # what the last stage reads


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows: each stage decides on all of them."""
    made = odd.selectExpr("doc_id", "text", "lang", "source", "n_chars", "score AS row", "fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, made, TESTDATA).collect()
        texts = [r.text for r in out]
        assert len(out) <= 12, name
        if name == "exact_dedup":
            assert sorted(map(str, texts)) == sorted(map(str, {r.text for r in odd.collect()} - {odd.first().text, None, " \t\n", ""} | {" \t\n"}))
        if name == "near_dedup":
            assert len({*texts} & {odd.first().text, "no id here", "x" * 30000, "word " * 20000}) == 4
        if name == "decontamination":
            assert len(out) == 12
    tokens = corpus_pipeline.tokens_stage(spark, made, TESTDATA).collect()
    assert len(tokens) == 12 and {r.n_tokens for r in tokens if r.doc_id in (3, 4, 5)} == {0}


def test_stages_keep_the_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TESTDATA)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, docs.limit(0), TESTDATA).count() == 0, name


def test_exact_stage_is_the_oracle(spark, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{TESTDATA}/documents.parquet'")
    wanted = {r[0] for r in con.sql(f"SELECT doc_id FROM ({exact.ORACLE}) WHERE kept").fetchall()}
    assert sorted(r.doc_id for r in corpus_pipeline.exact_stage(spark, docs, TESTDATA).collect()) == sorted(wanted)


def test_exact_stage_keeps_one_of_repeated_rows(spark, docs):
    twice = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 5").selectExpr("doc_id", "text || ' ' AS text", "lang", "source", "n_chars"))
    nulls = docs.where("doc_id < 3").selectExpr("CAST(NULL AS long) AS doc_id", "'same' AS text", "lang", "source", "n_chars")
    out = corpus_pipeline.exact_stage(spark, twice.unionByName(nulls), TESTDATA).collect()
    once = corpus_pipeline.exact_stage(spark, docs.where("doc_id < 20"), TESTDATA).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(r.doc_id for r in once)
    assert sum(r.doc_id is None for r in out) == 1 and all(r.text.endswith(" ") for r in out if r.doc_id is not None and r.doc_id < 5)


def test_decontamination_and_quality_decisions_take_effect(spark, docs):
    clean = corpus_pipeline.decontamination_stage(spark, docs, TESTDATA)
    marks = decontam.contamination(clean, spark.read.parquet(f"{TESTDATA}/benchmark.parquet"))
    assert marks.where("contaminated").count() == 0 and 0 < clean.count() < docs.count()
    good = corpus_pipeline.quality_stage(spark, docs, TESTDATA)
    scored = quality.annotate(docs, spark.read.parquet(f"{TESTDATA}/labels.parquet"), "q").where(f"q >= {quality.THRESHOLD}")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scored.collect())


def test_decontamination_drops_every_document_with_a_passage(spark):
    big = "/root/testdata/sf0.01"
    docs, benchmark = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "benchmark"))
    windows = {tuple(ws[k : k + 13]) for r in benchmark.collect() for ws in [decontam.words(r.text)] for k in range(len(ws) - 12)}
    holds = {r.doc_id: any(tuple(ws[k : k + 13]) in windows for k in range(len(ws) - 12)) for r in docs.collect() for ws in [decontam.words(r.text)]}
    kept = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, big).collect()}
    assert sum(holds.values()) > 20 and kept == {d for d, held in holds.items() if not held}


def test_decontamination_leaves_short_items_in_long_documents(spark, tmp_path):
    spark.createDataFrame([(1, "the cat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = spark.createDataFrame([(1, "the cat " + "word " * 100), (2, "the cat sat"), (3, None), (3, "")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    out = corpus_pipeline.decontamination_stage(spark, made, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text and len(r.text)) for r in out if r.doc_id != 3) == [(1, 508)] and len(out) == 3


def test_near_stage_keeps_the_first_of_each_group(spark, docs):
    copies = docs.where("doc_id = 8").selectExpr("doc_id + 10000 AS doc_id", "text || ' end' AS text", "lang", "source", "n_chars")
    out = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs.unionByName(copies), TESTDATA).collect()}
    assert 8 in out and 10008 not in out


def test_near_stage_tells_rows_without_an_id_or_of_one_id_apart(spark, docs):
    a, b, c, d = (docs.where("doc_id = 8").first().text, *(" ".join(f"{w}{k}" for k in range(200)) for w in "bcd"))
    rows = [(1, a), (None, a + " end"), (None, b), (None, b + " end"), (3, c), (7, c + " end"), (7, d)]
    made = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    out = [(r.doc_id, r.text.removesuffix(" end")) for r in corpus_pipeline.near_stage(spark, made, TESTDATA).collect()]
    assert sorted(out, key=str) == sorted([(1, a), (None, b), (3, c), (7, d)], key=str)


def test_near_stage_broadcasts_no_crowd(spark, monkeypatch):
    """A crowd's 2,081 rows a fingerprint stay on the executors; texts are fingerprints here."""
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    fps = F.expr("xxhash64(id) & ((1L << 38) - 1) | (5L << 38)")
    made = spark.range(simhash.HOT + 50).select(F.col("id").alias("doc_id"), fps.cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    copy = made.where("doc_id = 7").selectExpr("doc_id + 1000 AS doc_id", "CAST(CAST(text AS long) ^ 7 AS string) AS text", "lang", "source", "n_chars")
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "8m")
    try:
        out = {r.doc_id for r in corpus_pipeline.near_stage(spark, made.unionByName(copy), TESTDATA).collect()}
    finally:
        spark.conf.set(limit, before)
    assert out == {*range(simhash.HOT + 50)}
