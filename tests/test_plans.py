"""Plans: what reaches the scan, and which operators do the work."""

from tarnql import Catalog, queries, query

TESTDATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def run(spark, name):
    return plan(queries.QUERIES[name](spark, TESTDATA))


def test_filters_and_columns_reach_the_scan(spark):
    text = run(spark, "tpch_q6")
    for part in ("GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate", "GreaterThanOrEqual(l_discount,0.05)", "LessThan(l_quantity,24.0)"):
        assert part in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text


def test_count_reads_no_column(spark):
    assert "ReadSchema: struct<>" in run(spark, "s1_scan_count")


def test_aggregates_are_partial_first(spark):
    text = run(spark, "tpch_q1")
    assert "partial_sum" in text and "Cartesian" not in text


def test_top_k_is_fused(spark):
    assert "TakeOrderedAndProject" in run(spark, "r17_topk") and "TakeOrderedAndProject" in run(spark, "tpch_q3")


def test_composite_keys_are_join_keys(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = run(spark, "d7_composite_key")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [line for line in text.splitlines() if line.startswith("Left keys")]
    assert keys and "[2]" in keys[0]


def test_no_python_in_any_plan(spark):
    for name in queries.PAIRS:
        text = run(spark, name)
        assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text, name


def test_row_groups_are_skipped(spark, tmp_path):
    """Of a file of many row groups, a range of the sorted column reads only those that may hold it."""
    path = str(tmp_path / "t.parquet")
    rows = spark.range(200_000).selectExpr("id", "id * 3 AS v").coalesce(1)
    rows.write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 16 << 10).option("parquet.enable.dictionary", "false").option("parquet.page.size.row.check.max", 1000).parquet(path)
    import pyarrow.parquet as pq

    (file,) = (tmp_path / "t.parquet").glob("*.parquet")
    groups = pq.ParquetFile(file).metadata.num_row_groups
    df = query(spark, Catalog({"t": path}), "SELECT v FROM t WHERE id >= 100000 AND id < 100010")
    assert groups > 10 and sorted(r.v for r in df.collect()) == [3 * k for k in range(100_000, 100_010)]
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    scan = scan.executedPlan().collectLeaves().head() if "AdaptiveSparkPlan" in scan.nodeName() else scan
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read <= 3 * 200_000 // groups


def test_strings_reach_the_planner_as_they_are(spark):
    catalog = Catalog.folder(TESTDATA)
    for text in ("it's", "back\\slash", "${x} ${env:HOME}$", "--no /* comment */", "`tick` \"quote\"", "\\'", "line\nend", "%_"):
        row = query(spark, catalog, "SELECT '" + text.replace("'", "''") + "' AS s, '" + text.replace("'", "''") + "' LIKE '%' AS l FROM region LIMIT 1").first()
        assert row.s == text and row.l
    least = query(spark, catalog, "SELECT -9223372036854775808 AS a, -0.5 AS b, 1e300 AS c FROM region LIMIT 1").first()
    assert tuple(least) == (-(1 << 63), -0.5, 1e300)
