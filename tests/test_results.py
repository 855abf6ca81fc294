"""Results over seeded tables with NULLs, against another engine; the inventory; defects not to be repeated."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tarnql import Catalog, query, queries

from data import assert_same, duck, orders_and_items

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    orders_and_items(folder)
    return Catalog.folder(str(folder)), duck(folder)


#: (statement, its SQL if other, whether rows come in order)
CORPUS = [
    ("SELECT order_id, customer_id, amount FROM orders", None),
    ("SELECT * FROM items", None),
    ("SELECT order_id, status FROM orders WHERE status = 'alpha' OR status <> 'beta' AND amount > 10", None),
    ("SELECT order_id FROM orders WHERE status <> 'absent'", None),
    ("SELECT order_id FROM orders WHERE NOT (status = 'absent')", None),
    ("SELECT order_id FROM orders WHERE NOT (is_express AND amount < 0)", None),
    ("SELECT order_id FROM orders WHERE NOT (amount < 0 OR is_express)", None),
    ("SELECT order_id FROM orders WHERE is_express", None),
    ("SELECT order_id FROM orders WHERE is_express = TRUE AND NOT is_express IS NULL", None),
    ("SELECT order_id FROM orders WHERE status < 'delta'", None),
    ("SELECT order_id FROM orders WHERE amount IN (1, 2, 3) OR customer_id IN (1.0, 2.5, 7)", None),
    ("SELECT order_id FROM orders WHERE customer_id NOT IN (1, NULL)", None),
    ("SELECT order_id FROM orders WHERE customer_id IN (1, -1, NULL)", None),
    ("SELECT order_id FROM orders WHERE is_express IN (TRUE)", None),
    ("SELECT order_id FROM orders WHERE customer_id < 2.5", None),
    ("SELECT order_id FROM orders WHERE amount BETWEEN 100 AND 200 OR amount NOT BETWEEN 10 AND 9000", None),
    ("SELECT order_id FROM orders WHERE order_date > '2015-06-01' AND order_date <= '2020-01-01'", None),
    ("SELECT order_id FROM orders WHERE order_date >= 18000", "SELECT order_id FROM orders WHERE order_date >= DATE '1970-01-01' + 18000"),
    ("SELECT order_id FROM orders WHERE order_date > 14000 + order_id * 10", "SELECT order_id FROM orders WHERE order_date > DATE '1970-01-01' + CAST(14000 + order_id * 10 AS INTEGER)"),
    ("SELECT order_id FROM orders WHERE order_date BETWEEN 16000 AND '2018-01-01'", "SELECT order_id FROM orders WHERE order_date BETWEEN DATE '1970-01-01' + 16000 AND '2018-01-01'"),
    ("SELECT order_id FROM orders WHERE status LIKE '%a' AND status NOT LIKE '_e%'", None),
    ("SELECT order_id, CASE WHEN amount > 5000 THEN order_date END AS d, CASE WHEN is_express THEN FALSE ELSE TRUE END AS b FROM orders", None),
    ("SELECT order_id, CASE WHEN amount > 5000 THEN 'high' WHEN amount > 1000 THEN 'medium' ELSE 'low' END AS tier FROM orders", None),
    ("SELECT order_id, amount / (customer_id - 5) AS q, order_id / (customer_id - 5) AS i FROM orders", "SELECT order_id, amount / NULLIF(customer_id - 5, 0) AS q, order_id // NULLIF(customer_id - 5, 0) AS i FROM orders"),
    ("SELECT -amount AS a, -customer_id AS b, -(-3) AS c FROM orders", None),
    ("SELECT COUNT(*), COUNT(amount), COUNT(DISTINCT status), SUM(customer_id), AVG(customer_id), MIN(status), MAX(order_date), MIN(is_express), MAX(amount) FROM orders", None),
    ("SELECT COUNT(*), SUM(amount), MIN(status), AVG(customer_id) FROM orders WHERE order_id > 9999", None),
    ("SELECT status, is_express, COUNT(*), SUM(amount), COUNT(DISTINCT customer_id) FROM orders GROUP BY status, is_express", None),
    ("SELECT order_date, MIN(is_express), MAX(is_express) FROM orders GROUP BY order_date", None),
    ("SELECT status FROM orders GROUP BY status", None),
    ("SELECT DISTINCT status, is_express FROM orders", None),
    ("SELECT status, SUM(amount) / 2 AS half, 1 AS one FROM orders GROUP BY status", None),
    ("SELECT status, SUM(amount * 2 - customer_id) AS s FROM orders GROUP BY status HAVING s > 1000 AND COUNT(*) > 3", "SELECT status, SUM(amount * 2 - customer_id) AS s FROM orders GROUP BY status HAVING SUM(amount * 2 - customer_id) > 1000 AND COUNT(*) > 3"),
    ("SELECT status FROM orders GROUP BY status HAVING COUNT(DISTINCT customer_id) < COUNT(customer_id)", None),
    ("SELECT status FROM orders GROUP BY status HAVING COUNT(*) IN (40, 41, 42, 43, 44) OR MIN(status) LIKE 'a%'", None),
    ("SELECT SUM(amount) AS s FROM orders HAVING COUNT(*) > 1000", None),
    ("SELECT o.order_id, i.item_id FROM orders o, items i WHERE o.order_id = i.order_id AND o.amount > 100 AND i.quantity < 10", None),
    ("SELECT o.status, COUNT(*), SUM(i.price) FROM orders o, items i WHERE o.order_id = i.order_id AND o.status = i.category GROUP BY o.status", None),
    ("SELECT o.order_id, i.item_id FROM orders o, items i WHERE o.status = i.category AND o.order_id = i.order_id AND (o.amount > i.price * 50 OR i.quantity = 3)", None),
    ("SELECT COUNT(*) FROM orders o, items i WHERE o.status = i.category", None),
    ("SELECT COUNT(*) FROM orders a, orders b, items i WHERE a.customer_id = b.customer_id AND b.order_id = i.order_id AND a.order_id < b.order_id AND i.category LIKE 'b%'", None),
    ("SELECT COUNT(*) FROM orders, items WHERE orders.order_id = items.order_id AND amount = quantity", None),
    ("SELECT COUNT(*) FROM orders o, items i WHERE o.amount = i.quantity", None),
    ("SELECT COUNT(*) FROM orders WHERE order_date < '1969-12-31' OR amount > -1e10", None),
    ("SELECT status AS customer_id, COUNT(*) AS n FROM orders GROUP BY status HAVING customer_id LIKE 'a%'", "SELECT status AS customer_id, COUNT(*) AS n FROM orders GROUP BY status HAVING status LIKE 'a%'"),
]
ORDERED = [
    ("SELECT order_id, amount - 5000 AS a FROM orders ORDER BY a, order_id", "SELECT order_id, amount - 5000 AS a FROM orders ORDER BY a NULLS FIRST, order_id"),
    ("SELECT status, order_id FROM orders ORDER BY status DESC, order_id LIMIT 90", "SELECT status, order_id FROM orders ORDER BY status DESC NULLS FIRST, order_id LIMIT 90"),
    ("SELECT is_express, order_date, order_id FROM orders ORDER BY is_express, order_date DESC, order_id", "SELECT is_express, order_date, order_id FROM orders ORDER BY is_express NULLS FIRST, order_date DESC NULLS FIRST, order_id"),
    ("SELECT status, SUM(amount) FROM orders GROUP BY status ORDER BY SUM_amount DESC", "SELECT status, SUM(amount) AS s FROM orders GROUP BY status ORDER BY s DESC NULLS FIRST"),
    ("SELECT status FROM orders GROUP BY status ORDER BY COUNT(*) DESC, status LIMIT 3", "SELECT status FROM orders GROUP BY status ORDER BY COUNT(*) DESC, status NULLS FIRST LIMIT 3"),
    ("SELECT order_id FROM orders ORDER BY amount DESC, order_id LIMIT 10", "SELECT order_id FROM orders ORDER BY amount DESC NULLS FIRST, order_id LIMIT 10"),
    ("SELECT DISTINCT status FROM orders ORDER BY status", "SELECT DISTINCT status FROM orders ORDER BY status NULLS FIRST"),
    ("SELECT order_id FROM orders LIMIT 0", None),
]


@pytest.mark.parametrize("text, other", CORPUS)
def test_corpus(spark, tables, text, other):
    catalog, con = tables
    assert_same(query(spark, catalog, text).collect(), con.sql(other or text).fetchall())


@pytest.mark.parametrize("text, other", ORDERED)
def test_ordered(spark, tables, text, other):
    catalog, con = tables
    assert_same(query(spark, catalog, text).collect(), con.sql(other or text).fetchall(), ordered=True)


def test_inventory(spark):
    con = duck(TESTDATA)
    for name, run in queries.QUERIES.items():
        df = run(spark, TESTDATA)
        wanted = con.sql(queries.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(wanted.columns), name
        assert_same(df.select(*wanted.columns).collect(), wanted.fetchall())


def test_encodings_keep_equal_rows_and_nulls(spark, tmp_path):
    con = duck(TESTDATA)
    some = "SELECT * FROM lineitem LIMIT 50"
    nulls = ", ".join(f"CASE WHEN n % 7 <> {k} THEN {c} END AS {c}" for k, c in enumerate(("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_shipdate")))
    con.sql(f"COPY (SELECT {nulls}, l_returnflag FROM (SELECT *, row_number() OVER () AS n FROM ({some})), range(3)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    df, wanted = queries.QUERIES["s7_encodings"](spark, str(tmp_path)), duck(tmp_path).sql(queries.ORACLE_SQL["s7_encodings"])
    assert_same(df.select(*wanted.columns).collect(), wanted.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


SETTINGS = [
    {"spark.sql.shuffle.partitions": "1"}, {"spark.sql.shuffle.partitions": "16"}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}, {"spark.sql.adaptive.enabled": "false"},
]


def test_plans_agree(spark, tables):
    catalog, con = tables
    texts = [CORPUS[k] for k in (27, 32, 37, 40)]
    for settings in SETTINGS:
        before = {k: spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            for text, other in texts:
                df = query(spark, catalog, text)
                assert_same(df.collect(), con.sql(other or text).fetchall())
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_doubled_filter(spark, tables):
    catalog, _ = tables
    one = query(spark, catalog, "SELECT order_id FROM orders WHERE amount > 100 AND status LIKE 'a%'")
    two = query(spark, catalog, "SELECT order_id FROM orders WHERE amount > 100 AND status LIKE 'a%' AND amount > 100 AND status LIKE 'a%'")
    assert_same(one.collect(), two.collect())


def test_like_takes_a_backslash_as_it_is(spark, tmp_path):
    spark.createDataFrame([("a\\b",), ("ab",), ("a%b",), ("é",)], "s string").write.parquet(str(tmp_path / "t.parquet"))
    catalog = Catalog.folder(str(tmp_path))
    assert [r[0] for r in query(spark, catalog, "SELECT s FROM t WHERE s LIKE 'a\\_'").collect()] == ["a\\b"]
    assert [r[0] for r in query(spark, catalog, "SELECT s FROM t WHERE s LIKE '_'").collect()] == ["é"]


def test_infinities_and_small_types(spark, tmp_path):
    rows = [(float("inf"), 1, 1.5, datetime.date(1960, 1, 1)), (None, 2, 2.5, datetime.date(1969, 12, 31))]
    spark.createDataFrame(rows, "f double, i int, g float, d date").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    catalog = Catalog.folder(str(tmp_path))
    df = query(spark, catalog, "SELECT MIN(f) AS lo, MAX(f) AS hi, SUM(i) AS s, AVG(g) AS a, MIN(d) AS d FROM t WHERE d < '1970-01-01' AND d < 0")
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "double", "bigint", "double", "date"]
    assert tuple(df.first()) == (float("inf"), float("inf"), 3, 2.0, datetime.date(1960, 1, 1))


def test_unsupported_types_matter_only_where_used(spark, tmp_path):
    from tarnql import QueryError

    spark.range(3).select("id", F.array("id").alias("xs")).write.parquet(str(tmp_path / "t.parquet"))
    catalog = Catalog.folder(str(tmp_path))
    assert query(spark, catalog, "SELECT COUNT(*) FROM t WHERE id > 0").first()[0] == 2
    with pytest.raises(QueryError, match="array"):
        query(spark, catalog, "SELECT xs FROM t")


def test_sum_overflow_is_an_error(spark, tmp_path):
    spark.createDataFrame([(2**63 - 1,), (1,)], "x long").write.parquet(str(tmp_path / "t.parquet"))
    with pytest.raises(Exception, match="(?i)overflow"):
        query(spark, Catalog.folder(str(tmp_path)), "SELECT SUM(x) FROM t").collect()
