"""Pipe-delimited benchmark files to Parquet: eight tables, all columns non-null."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

_kinds = {"i": T.LongType(), "f": T.DoubleType(), "s": T.StringType(), "d": T.DateType()}


def _schema(columns: str) -> T.StructType:
    pairs = (c.rsplit(":", 1) for c in columns.split())
    return T.StructType([T.StructField(name, _kinds[kind], False) for name, kind in pairs])


SCHEMAS = {
    "region": _schema("r_regionkey:i r_name:s r_comment:s"),
    "nation": _schema("n_nationkey:i n_name:s n_regionkey:i n_comment:s"),
    "supplier": _schema("s_suppkey:i s_name:s s_address:s s_nationkey:i s_phone:s s_acctbal:f s_comment:s"),
    "customer": _schema("c_custkey:i c_name:s c_address:s c_nationkey:i c_phone:s c_acctbal:f c_mktsegment:s c_comment:s"),
    "part": _schema("p_partkey:i p_name:s p_mfgr:s p_brand:s p_type:s p_size:i p_container:s p_retailprice:f p_comment:s"),
    "partsupp": _schema("ps_partkey:i ps_suppkey:i ps_availqty:i ps_supplycost:f ps_comment:s"),
    "orders": _schema(
        "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:d o_orderpriority:s o_clerk:s o_shippriority:i o_comment:s"
    ),
    "lineitem": _schema(
        "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s "
        "l_linestatus:s l_shipdate:d l_commitdate:d l_receiptdate:d l_shipinstruct:s l_shipmode:s l_comment:s"
    ),
}
_END = "_end"


def read_tbl(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a ``.tbl`` file or folder.  A field too many or too few, or one that isn't of its type, ends the job."""
    if table not in SCHEMAS:
        raise QueryError(f"unknown table {table}: expected one of {', '.join(SCHEMAS)}")
    schema = SCHEMAS[table]
    # every line ends with a separator, so there is one more, empty, field
    read = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema] + [T.StructField(_END, T.StringType(), True)])
    rows = (
        spark.read.schema(read)
        .options(sep="|", header="false", quote="", escape="", mode="FAILFAST", dateFormat="yyyy-MM-dd", emptyValue="", nullValue="\u0000")
        .csv(path)
    )

    def checked(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(column, F.lit("")).alias(field.name)
        missing = F.raise_error(F.lit(f"{table}: a line without {field.name}")).cast(field.dataType)
        return F.coalesce(column, missing).alias(field.name)

    return rows.select(*map(checked, schema))


def ingest(spark: SparkSession, path: str, table: str, out: str) -> None:
    """Writes a ``.tbl`` file as Parquet; nothing is visible at ``out`` before all of it is."""
    read_tbl(spark, path, table).write.mode("errorifexists").parquet(out)


def main(args: list[str]) -> int:
    """``python -m tarnql.sources.ingest FOLDER OUT [TABLE...]``"""
    from ..session import session

    if len(args) < 2:
        print(main.__doc__)
        return 2
    spark = session(os.cpu_count())
    for table in args[2:] or [t for t in SCHEMAS if os.path.exists(f"{args[0]}/{t}.tbl")]:
        ingest(spark, f"{args[0]}/{table}.tbl", table, f"{args[1]}/{table}.parquet")
        print(table)
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
