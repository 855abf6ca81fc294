"""A query for every operator of the inventory over the supplied tables, and its SQL for another engine.

Keys start with the operator's number.  The supplied tables have no NULLs and no
booleans, so queries make them with CASE and comparisons.  Sums and means of fractions
are rounded on both sides, since the order of additions isn't fixed.  Every query reads
its whole tables; a LIMIT stands only where the order of rows is what the query shows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .errors import QueryError
from .functions.scalars import name
from .plans.lower import query
from .sources import fsck, ingest, sink
from .sources.catalog import Catalog
from .sources.paths import children, fresh
from .sources.sink import aligned


@dataclass(frozen=True)
class Pair:
    """A statement of the dialect, and the same in SQL (None: the same text)."""

    text: str
    oracle: str | None = None
    #: Decimals that fractions are rounded to, the same as in the oracle.
    digits: int | None = None


NUM = "CASE WHEN l_linenumber <> 3 THEN l_linenumber END"  # NULL for line 3
FLAG = "CASE WHEN l_returnflag <> 'R' THEN l_returnflag END"  # NULL for R

PAIRS: dict[str, Pair] = {
    # scans
    "s1_scan_count": Pair("SELECT COUNT(*) AS n FROM lineitem"),
    "s3_projection": Pair("SELECT o_orderkey, o_orderpriority FROM orders"),
    "s4_pruned_range": Pair(
        "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 1200 AND l_shipdate >= '1996-01-01'"
    ),
    # filter, project, star, alias
    "r1_filter": Pair("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000.0"),
    "r2_project": Pair("SELECT c_custkey, c_acctbal * 2 AS twice, 7 AS seven, 'x' AS letter FROM customer"),
    "r3_star": Pair("SELECT * FROM region"),
    "r18_alias": Pair("SELECT n.n_name AS name, r.r_name AS region FROM nation AS n, region r WHERE n.n_regionkey = r.r_regionkey"),
    # joins
    "r4_inner_join": Pair("SELECT o_orderkey, c_name FROM customer, orders WHERE c_custkey = o_custkey AND c_acctbal > 5000"),
    "r5_three_way": Pair(
        "SELECT c_mktsegment, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM customer, orders, lineitem "
        "WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_mktsegment"
    ),
    "r5_five_way": Pair(
        "SELECT r_name, COUNT(*) AS n FROM region, nation, supplier, lineitem, part WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey "
        "AND s_suppkey = l_suppkey AND l_partkey = p_partkey AND p_size > 10 GROUP BY r_name"
    ),
    "r7_pushdown_join": Pair(
        "SELECT o_orderpriority, COUNT(*) AS n FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_quantity < 10 AND o_totalprice > 100000 GROUP BY o_orderpriority"
    ),
    "d6_string_key": Pair(
        "SELECT COUNT(*) AS n FROM nation a, nation b WHERE a.n_name = b.n_name"
    ),
    "d7_composite_key": Pair(
        "SELECT a.l_orderkey AS okey, COUNT(*) AS n FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey"
    ),
    "d8_residual": Pair(
        "SELECT COUNT(*) AS n FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_extendedprice * 2 > o_totalprice AND (o_orderstatus = 'F' OR l_quantity > 30) AND o_orderpriority LIKE '%H%'"
    ),
    "d17_self_join": Pair(
        "SELECT a.n_name AS one, b.n_name AS other FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"
    ),
    "r4_null_key": Pair(
        "SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers FROM orders, customer WHERE o_custkey = c_custkey AND CASE WHEN c_nationkey <> 3 THEN c_nationkey END = c_nationkey"
    ),
    # aggregates
    "a1_count_star": Pair("SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "a1_count_star_grouped": Pair("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "a2_count": Pair(f"SELECT COUNT({NUM}) AS n, COUNT(l_orderkey) AS m FROM lineitem"),
    "a2_count_grouped": Pair(f"SELECT l_returnflag, COUNT({NUM}) AS n FROM lineitem GROUP BY l_returnflag"),
    "a3_count_distinct": Pair(f"SELECT COUNT(DISTINCT {NUM}) AS n, COUNT(DISTINCT l_partkey) AS parts FROM lineitem"),
    "a3_count_distinct_grouped": Pair("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag"),
    "a3_count_distinct_join": Pair("SELECT c_mktsegment, COUNT(DISTINCT o_orderkey) AS n FROM customer, orders WHERE c_custkey = o_custkey GROUP BY c_mktsegment"),
    "a4_sum": Pair(
        f"SELECT SUM({NUM}) AS lines, SUM(l_quantity) AS quantity, SUM(l_orderkey) AS orderkeys FROM lineitem",
        f"SELECT CAST(SUM({NUM}) AS BIGINT) AS lines, SUM(l_quantity) AS quantity, CAST(SUM(l_orderkey) AS BIGINT) AS orderkeys FROM lineitem",
    ),
    "a4_sum_grouped": Pair(
        "SELECT l_linestatus, SUM(l_linenumber) AS lines, SUM(l_quantity) AS quantity FROM lineitem GROUP BY l_linestatus",
        "SELECT l_linestatus, CAST(SUM(l_linenumber) AS BIGINT) AS lines, SUM(l_quantity) AS quantity FROM lineitem GROUP BY l_linestatus",
    ),
    "a5_avg": Pair(f"SELECT AVG({NUM}) AS lines, AVG(l_discount) AS discount FROM lineitem", f"SELECT ROUND(AVG({NUM}), 4) AS lines, ROUND(AVG(l_discount), 4) AS discount FROM lineitem", 4),
    "a5_avg_grouped": Pair("SELECT l_returnflag, AVG(l_quantity) AS q FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(AVG(l_quantity), 4) AS q FROM lineitem GROUP BY l_returnflag", 4),
    "a6_min": Pair(
        "SELECT MIN(l_orderkey) AS i, MIN(l_extendedprice) AS f, MIN(l_returnflag) AS s, MIN(l_shipdate) AS d, MIN(l_quantity > 25) AS b FROM lineitem",
        "SELECT MIN(l_orderkey) AS i, MIN(l_extendedprice) AS f, MIN(l_returnflag) AS s, CAST(MIN(l_shipdate) AS DATE) AS d, MIN(l_quantity > 25) AS b FROM lineitem",
    ),
    "a6_min_grouped": Pair("SELECT o_orderstatus, MIN(o_orderpriority) AS s, MIN(o_totalprice) AS f FROM orders GROUP BY o_orderstatus"),
    "a7_max": Pair(
        "SELECT MAX(l_orderkey) AS i, MAX(l_extendedprice) AS f, MAX(l_returnflag) AS s, MAX(l_shipdate) AS d, MAX(l_quantity > 25) AS b FROM lineitem",
        "SELECT MAX(l_orderkey) AS i, MAX(l_extendedprice) AS f, MAX(l_returnflag) AS s, CAST(MAX(l_shipdate) AS DATE) AS d, MAX(l_quantity > 25) AS b FROM lineitem",
    ),
    "a7_max_grouped": Pair("SELECT o_orderstatus, MAX(o_orderpriority) AS s, MAX(o_totalprice) AS f FROM orders GROUP BY o_orderstatus"),
    "r8_group_multi": Pair("SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber"),
    "r8_group_null_key": Pair(f"SELECT {FLAG} AS flag, COUNT(*) AS n FROM lineitem GROUP BY {FLAG}"),
    "r8_group_date": Pair(
        "SELECT l_shipdate, COUNT(*) AS n FROM lineitem GROUP BY l_shipdate", "SELECT CAST(l_shipdate AS DATE) AS l_shipdate, COUNT(*) AS n FROM lineitem GROUP BY 1"
    ),
    "r9_global_empty": Pair(
        "SELECT COUNT(*) AS n, COUNT(l_quantity) AS m, SUM(l_linenumber) AS s, AVG(l_quantity) AS a, MIN(l_returnflag) AS lo, MAX(l_quantity) AS hi FROM lineitem WHERE l_quantity < 0",
        "SELECT COUNT(*) AS n, COUNT(l_quantity) AS m, CAST(SUM(l_linenumber) AS BIGINT) AS s, AVG(l_quantity) AS a, MIN(l_returnflag) AS lo, MAX(l_quantity) AS hi FROM lineitem WHERE l_quantity < 0",
    ),
    "r10_group_no_agg": Pair("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "r11_expr_agg": Pair(
        "SELECT l_returnflag, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag",
        2,
    ),
    "r11_agg_expr": Pair(
        "SELECT l_returnflag, SUM(l_quantity) / COUNT(*) AS mean, COUNT(*) + 1 AS more FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(SUM(l_quantity) / COUNT(*), 4) AS mean, COUNT(*) + 1 AS more FROM lineitem GROUP BY l_returnflag",
        4,
    ),
    "r12_having_alias": Pair(
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15"
    ),
    "r12_having_agg": Pair("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) BETWEEN 5 AND 7"),
    "r13_having_hidden": Pair("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 2500000 AND COUNT(DISTINCT o_orderstatus) IN (2, 3)"),
    # distinct, sort, limit
    "r14_distinct": Pair("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "r14_distinct_null": Pair(f"SELECT DISTINCT {NUM} AS line, {FLAG} AS flag FROM lineitem"),
    "r14_distinct_after_group": Pair("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey"),
    "r15_sort_multi": Pair(
        "SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag DESC, l_orderkey, l_linenumber DESC"
    ),
    "r15_nulls_first_asc": Pair(
        f"SELECT l_orderkey, l_linenumber, {NUM} AS line FROM lineitem ORDER BY line, l_orderkey, l_linenumber",
        f"SELECT l_orderkey, l_linenumber, {NUM} AS line FROM lineitem ORDER BY line NULLS FIRST, l_orderkey, l_linenumber",
    ),
    "r15_nulls_first_desc": Pair(
        f"SELECT l_orderkey, l_linenumber, {NUM} AS line FROM lineitem ORDER BY line DESC, l_orderkey, l_linenumber",
        f"SELECT l_orderkey, l_linenumber, {NUM} AS line FROM lineitem ORDER BY line DESC NULLS FIRST, l_orderkey, l_linenumber",
    ),
    "r15_negative_floats": Pair("SELECT c_custkey, c_acctbal - 5000 AS rest FROM customer ORDER BY rest, c_custkey"),
    "r15_sort_hidden": Pair("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey"),
    "r16_limit": Pair("SELECT COUNT(*) AS n FROM lineitem LIMIT 5"),
    "r16_limit0": Pair("SELECT o_orderkey FROM orders LIMIT 0"),
    "r17_topk": Pair("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    # expressions
    "e2_int_literal": Pair("SELECT r_regionkey, 9223372036854775807 AS most, -5 AS less FROM region"),
    "e3_float_literal": Pair("SELECT r_regionkey, 1.5e3 AS a, 0.25 AS b FROM region", "SELECT r_regionkey, CAST(1500.0 AS DOUBLE) AS a, CAST(0.25 AS DOUBLE) AS b FROM region"),
    "e4_string_literal": Pair("SELECT r_regionkey, 'it''s' AS s FROM region"),
    "e5_bool_literal": Pair("SELECT r_regionkey, TRUE AS t, FALSE AS f FROM region WHERE TRUE"),
    "e6_cmp_int": Pair("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 6 AND l_orderkey <> 7"),
    "e6_cmp_float": Pair("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.02 AND l_quantity > 45.5"),
    "e6_cmp_int_float": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber < 2.5"),
    "e6_cmp_date": Pair("SELECT o_orderkey FROM orders WHERE o_orderdate = '1996-05-05' OR o_orderdate > '2001-07-01'"),
    "e6_cmp_string_order": Pair("SELECT o_orderkey FROM orders WHERE o_orderpriority < '2'"),
    "e6_cmp_bool": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE (l_quantity > 25) = TRUE"),
    "e7_str_eq": Pair("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "e7_str_ne_absent": Pair(f"SELECT COUNT(*) AS n FROM lineitem WHERE {FLAG} <> 'absent'"),
    "d3_not_eq_absent": Pair(f"SELECT COUNT(*) AS n FROM lineitem WHERE NOT ({FLAG} = 'absent')"),
    "e8_arith": Pair(
        "SELECT l_orderkey, l_linenumber, l_linenumber * 3 - l_orderkey + 1 AS i, l_quantity + l_linenumber AS f FROM lineitem"
    ),
    "e9_float_div_zero": Pair(
        "SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 3) AS q FROM lineitem",
        "SELECT l_orderkey, l_linenumber, ROUND(l_quantity / NULLIF(l_linenumber - 3, 0), 4) AS q FROM lineitem",
        4,
    ),
    "e9_int_div": Pair(
        "SELECT l_orderkey, l_linenumber, (l_orderkey - 1000) / (l_linenumber - 3) AS q FROM lineitem",
        "SELECT l_orderkey, l_linenumber, (l_orderkey - 1000) // NULLIF(l_linenumber - 3, 0) AS q FROM lineitem",
    ),
    "e10_neg": Pair("SELECT c_custkey, -c_acctbal AS owed, -c_custkey AS k FROM customer WHERE -c_acctbal > 0"),
    "e11_3vl": Pair(
        f"SELECT COUNT(*) AS n FROM lineitem WHERE NOT ({NUM} > 4 AND l_quantity < 0)"
    ),
    "e11_3vl_or": Pair(f"SELECT COUNT(*) AS n FROM lineitem WHERE NOT (l_quantity < 0 OR {NUM} > 4)"),
    "e11_not": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE NOT l_returnflag = 'R' AND NOT l_quantity > 10"),
    "e12_null": Pair(f"SELECT COUNT(*) AS n FROM lineitem WHERE {NUM} IS NULL"),
    "e12_not_null": Pair(f"SELECT COUNT(*) AS n FROM lineitem WHERE {FLAG} IS NOT NULL"),
    "e13_between": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN '1996-01-01' AND '1997-12-31'"),
    "e13_not_between": Pair(f"SELECT COUNT(*) AS n FROM lineitem WHERE {NUM} NOT BETWEEN 2 AND 5"),
    "e14_in_str": Pair("SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW', 'none')"),
    "e14_in_int": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3, -2)"),
    "e14_in_float": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity IN (1, 2, 3.5)"),
    "e14_in_date": Pair("SELECT COUNT(*) AS n FROM orders WHERE o_orderdate IN ('1996-05-05', '1997-01-01')"),
    "e14_not_in": Pair(f"SELECT COUNT(*) AS n FROM lineitem WHERE {NUM} NOT IN (1, 2)"),
    "e14_not_in_null": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber NOT IN (1, NULL)"),
    "e15_like": Pair("SELECT COUNT(*) AS n FROM part WHERE p_type LIKE '%A%'"),
    "e15_like_underscore": Pair("SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority LIKE '_-%O_'"),
    "e15_not_like": Pair("SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '1%'"),
    "e16_case_str": Pair(
        "SELECT CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS tier, COUNT(*) AS n FROM orders "
        "GROUP BY CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END"
    ),
    "e16_case_no_else": Pair("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS k FROM orders"),
    "e16_case_date": Pair(
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS d, CASE WHEN o_orderstatus = 'O' THEN TRUE ELSE FALSE END AS b FROM orders",
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS d, o_orderstatus = 'O' AS b FROM orders",
    ),
    "e17_promotion": Pair(
        "SELECT l_orderkey, l_linenumber, l_linenumber + 0.5 AS h FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_linenumber + CAST(0.5 AS DOUBLE) AS h FROM lineitem",
    ),
    "e18_date_str": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE l_shipdate < '1996-02-29'"),
    "e19_date_int": Pair("SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= 9600 AND o_orderdate < 10000", "SELECT COUNT(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1970-01-01' + 9600 AND CAST(o_orderdate AS DATE) < DATE '1970-01-01' + 10000"),
    "e20_bool_pred": Pair("SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > 25 OR l_returnflag IS NULL"),
    "e1_qualified_column": Pair("SELECT n.n_nationkey, nation.n_name FROM nation n, nation WHERE n.n_nationkey = nation.n_nationkey", "SELECT n_nationkey, n_name FROM nation"),
    "e21_headers": Pair(
        "SELECT l_returnflag, SUM(l_linenumber * (1 - l_linenumber)), COUNT(*), COUNT(DISTINCT l_linenumber), MAX(l_quantity) FROM lineitem GROUP BY l_returnflag",
        'SELECT l_returnflag, CAST(SUM(l_linenumber * (1 - l_linenumber)) AS BIGINT) AS "SUM(l_linenumber * (1 - l_linenumber))", COUNT(*) AS "COUNT_*", '
        'COUNT(DISTINCT l_linenumber) AS "COUNT_l_linenumber", MAX(l_quantity) AS "MAX_l_quantity" FROM lineitem GROUP BY l_returnflag',
    ),
    # shapes that an engine may run in parallel in a way of its own
    "p1_parallel_aggregate": Pair(
        "SELECT l_suppkey, COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_extendedprice) AS lo, MAX(l_shipdate) AS last FROM lineitem WHERE l_quantity > 5 GROUP BY l_suppkey",
        "SELECT l_suppkey, COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_extendedprice) AS lo, CAST(MAX(l_shipdate) AS DATE) AS last FROM lineitem WHERE l_quantity > 5 GROUP BY l_suppkey",
    ),
    "p2_join_aggregate": Pair(
        "SELECT o_orderpriority, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_discount > 0.03 GROUP BY o_orderpriority, l_linestatus"
    ),
    "p3_large_build": Pair(
        "SELECT a.l_orderkey, COUNT(*) AS n, SUM(b.l_linenumber) AS lines FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_orderkey",
        "SELECT a.l_orderkey, COUNT(*) AS n, CAST(SUM(b.l_linenumber) AS BIGINT) AS lines FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey GROUP BY a.l_orderkey",
    ),
    "p5_string_keys": Pair(
        "SELECT o_orderstatus, o_orderpriority, c_mktsegment, COUNT(*) AS n FROM orders, customer WHERE o_custkey = c_custkey GROUP BY o_orderstatus, o_orderpriority, c_mktsegment"
    ),
    "p6_sorted_aggregate": Pair("SELECT l_partkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_partkey ORDER BY q DESC, l_partkey LIMIT 25"),
    # benchmark queries; dates as the supplied tables have them
    "tpch_q1": Pair(
        "SELECT li.l_returnflag, li.l_linestatus, COUNT(*) AS n, AVG(li.l_quantity) AS avg_qty, AVG(li.l_discount) AS avg_disc, SUM(li.l_quantity) AS sum_qty, "
        "SUM(li.l_extendedprice) AS sum_base, SUM(li.l_extendedprice * (1 - li.l_discount)) AS sum_disc, SUM(li.l_extendedprice * (1 - li.l_discount) * (1 + li.l_tax)) AS sum_charge "
        "FROM lineitem li WHERE li.l_shipdate <= '1998-09-02' GROUP BY li.l_linestatus, li.l_returnflag ORDER BY li.l_returnflag, li.l_linestatus",
        "SELECT li.l_returnflag, li.l_linestatus, COUNT(*) AS n, ROUND(AVG(li.l_quantity), 2) AS avg_qty, ROUND(AVG(li.l_discount), 2) AS avg_disc, ROUND(SUM(li.l_quantity), 2) AS sum_qty, "
        "ROUND(SUM(li.l_extendedprice), 2) AS sum_base, ROUND(SUM(li.l_extendedprice * (1 - li.l_discount)), 2) AS sum_disc, ROUND(SUM(li.l_extendedprice * (1 - li.l_discount) * (1 + li.l_tax)), 2) AS sum_charge "
        "FROM lineitem li WHERE li.l_shipdate <= '1998-09-02' GROUP BY li.l_linestatus, li.l_returnflag",
        2,
    ),
    "tpch_q6": Pair(
        "SELECT SUM(li.l_discount * li.l_extendedprice) AS revenue FROM lineitem li WHERE li.l_quantity < 24 AND li.l_discount BETWEEN 0.05 AND 0.07 AND li.l_shipdate >= '1996-01-01' AND li.l_shipdate < '1997-01-01'",
        "SELECT ROUND(SUM(li.l_discount * li.l_extendedprice), 2) AS revenue FROM lineitem li WHERE li.l_quantity < 24 AND li.l_discount BETWEEN 0.05 AND 0.07 AND li.l_shipdate >= '1996-01-01' AND li.l_shipdate < '1997-01-01'",
        2,
    ),
    "tpch_q3": Pair(
        "SELECT li.l_orderkey, o.o_orderdate, SUM(li.l_extendedprice * (1 - li.l_discount)) AS revenue FROM customer c, orders o, lineitem li WHERE o.o_custkey = c.c_custkey AND li.l_orderkey = o.o_orderkey "
        "AND c.c_mktsegment = 'BUILDING' AND li.l_shipdate > '1998-03-15' AND o.o_orderdate < '1998-03-15' GROUP BY o.o_orderdate, li.l_orderkey ORDER BY revenue DESC, o.o_orderdate, li.l_orderkey LIMIT 10",
        "SELECT li.l_orderkey, CAST(o.o_orderdate AS DATE) AS o_orderdate, ROUND(SUM(li.l_extendedprice * (1 - li.l_discount)), 2) AS revenue FROM customer c, orders o, lineitem li WHERE o.o_custkey = c.c_custkey "
        "AND li.l_orderkey = o.o_orderkey AND c.c_mktsegment = 'BUILDING' AND li.l_shipdate >= '1998-03-16' AND o.o_orderdate < '1998-03-15' GROUP BY o.o_orderdate, li.l_orderkey "
        "ORDER BY SUM(li.l_extendedprice * (1 - li.l_discount)) DESC, o.o_orderdate, li.l_orderkey LIMIT 10",
        2,
    ),
    "tpch_q12_shaped": Pair(
        "SELECT li.l_returnflag, SUM(CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, "
        "SUM(CASE WHEN o.o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low FROM orders o, lineitem li "
        "WHERE li.l_orderkey = o.o_orderkey AND li.l_shipdate < '1997-01-01' AND li.l_shipdate >= '1996-01-01' GROUP BY li.l_returnflag ORDER BY li.l_returnflag",
        "SELECT li.l_returnflag, CAST(SUM(CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, "
        "CAST(SUM(CASE WHEN o.o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders o, lineitem li "
        "WHERE li.l_orderkey = o.o_orderkey AND li.l_shipdate < '1997-01-01' AND li.l_shipdate >= '1996-01-01' GROUP BY li.l_returnflag",
    ),
}


@lru_cache(maxsize=8)
def catalog(sf_dir: str) -> Catalog:
    """One catalog a folder: tables are finished files, so they are listed once."""
    return Catalog.folder(sf_dir)


def run(spark: SparkSession, sf_dir: str, pair: Pair) -> DataFrame:
    df = query(spark, catalog(sf_dir), pair.text)
    if pair.digits is None:
        return df
    return df.selectExpr(*[f"round({name(f.name)}, {pair.digits}) AS {name(f.name)}" if isinstance(f.dataType, T.DoubleType) else name(f.name) for f in df.schema])


RANGES = ((0, 10_000), (10_000, 20_000), (20_000, None))


def s2_scan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan in three ranges of rows, each asked for by itself."""
    parts = [catalog(sf_dir).rows(spark, "lineitem", *r).agg(F.lit(k).alias("range"), F.count("*").alias("n"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("s")) for k, r in enumerate(RANGES)]
    each = reduce(DataFrame.unionByName, parts)
    # three rows: of each range its rows, of all ranges the sum of lines
    return each.select("range", "n", F.sum("s").over(Window.partitionBy()).alias("lines"))


def s5_write_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as a table, and read through a catalog."""
    path = fresh(spark)
    sink.write_table(query(spark, catalog(sf_dir), "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"), path)
    return query(spark, Catalog.single(spark, "written", path), "SELECT * FROM written")


def s8_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe-delimited lines of a table to Parquet and back."""
    path = fresh(spark)
    region = catalog(sf_dir).table(spark, "region")
    region.select(F.concat(F.concat_ws("|", "r_regionkey", "r_name", F.lit("no comment")), F.lit("|"))).write.text(f"{path}/region.tbl")
    ingest.ingest(spark, f"{path}/region.tbl", "region", f"{path}/region.parquet")
    return query(spark, Catalog({"region": f"{path}/region.parquet"}), "SELECT * FROM region")


def s6_checked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written with checksums of its pages, and read with all of them compared."""
    path = fresh(spark)
    sink.write_table(catalog(sf_dir).table(spark, "lineitem"), path)
    return query(spark, Catalog.single(spark, "written", path), "SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS lines, MAX(l_shipdate) AS last FROM written GROUP BY l_returnflag")


def s7_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, fractions, booleans, texts, dates and NULLs, written with dictionaries and read back, then written without and read back.

    Every row passes through both files as it is: nothing has to tell equal rows apart, or to compare NULLs.
    """
    path = fresh(spark)
    rows = query(spark, catalog(sf_dir), f"SELECT l_orderkey, l_linenumber, l_discount, l_quantity > 25 AS many, {FLAG} AS flag, l_shipdate FROM lineitem")
    for name, dictionary in (("a", "true"), ("b", "false")):
        file = f"{path}/{name}.parquet"
        rows.write.option("parquet.enable.dictionary", dictionary).option("parquet.writer.version", "v2").parquet(file)
        rows = query(spark, Catalog.single(spark, name, file), f"SELECT l_orderkey, l_linenumber, l_discount, many, flag, l_shipdate FROM {name}")
    return rows


def s9_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a catalog file on the shared storage."""
    path = fresh(spark)
    tables = [{"name": new, "path": catalog(sf_dir).path(old)} for new, old in (("lands", "nation"), ("parts_of_the_world", "region"))]
    spark.range(1).select(F.lit(json.dumps({"tables": tables}))).coalesce(1).write.text(path)
    (file,) = children(path, ".txt").values()
    return query(spark, Catalog.open(file), "SELECT n_name, r_name FROM lands, parts_of_the_world WHERE n_regionkey = r_regionkey")


def s11_aligned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints of a result."""
    df = query(spark, catalog(sf_dir), "SELECT r_regionkey AS k, r_name AS name FROM region ORDER BY r_regionkey")
    return spark.createDataFrame([(line,) for line in aligned(df)], "line string")


REJECTED = (
    "SELECT COUNT(*) FROM nation, region",
    "SELECT COUNT(*) FROM nation, region WHERE n_regionkey < r_regionkey",
    "SELECT SUM(DISTINCT n_regionkey) FROM nation",
    "SELECT AVG(DISTINCT n_regionkey) FROM nation",
)


def r6_a8_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with a cross join, or with DISTINCT in another aggregate than COUNT, are errors."""

    def rejected(text: str) -> bool:
        try:
            query(spark, catalog(sf_dir), text)
        except QueryError:
            return True
        return False

    return spark.createDataFrame([(k, rejected(t)) for k, t in enumerate(REJECTED)], "statement int, rejected boolean")


def s10_fsck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrity check's findings, added up by column."""
    found = fsck.findings(spark, catalog(sf_dir).path("orders"))
    return found.groupBy("column").agg(F.sum("rows").alias("n"), F.sum("nulls").alias("nulls"), F.count("error").alias("errors"))


_FSCK = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, 0 AS errors FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
)
STORED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "s2_scan_ranges": (
        s2_scan_ranges,
        "SELECT k AS \"range\", greatest(0, least(n, hi) - lo) AS n, lines FROM (VALUES (0, 0, 10000), (1, 10000, 20000), (2, 20000, 9000000000000000000)) AS r(k, lo, hi), "
        "(SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem)",
    ),
    "s6_checked_read": (s6_checked_read, "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines, CAST(MAX(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY l_returnflag"),
    "s7_encodings": (s7_encodings, f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount, l_quantity > 25 AS many, {FLAG} AS flag, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem"),
    "s9_catalog": (s9_catalog, "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    "s11_aligned_text": (s11_aligned_text, "SELECT 'k  name' AS line UNION ALL SELECT r_regionkey || '  ' || r_name FROM region"),
    "r6_a8_rejected": (r6_a8_rejected, "SELECT CAST(k AS INTEGER) AS statement, TRUE AS rejected FROM range(4) AS t(k)"),
    "s5_write_and_read": (s5_write_and_read, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"),
    "s8_ingest": (s8_ingest, "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, 'no comment' AS r_comment FROM region"),
    "s10_fsck": (s10_fsck, _FSCK),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run, pair=pair) for name, pair in PAIRS.items()} | {name: f for name, (f, _) in STORED.items()}
ORACLE_SQL: dict[str, str] = {name: pair.oracle or pair.text for name, pair in PAIRS.items()} | {name: text for name, (_, text) in STORED.items()}
