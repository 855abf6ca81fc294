"""The dialect's five types and what Spark's types become of them."""

from __future__ import annotations

from pyspark.sql import types as T

from ..errors import QueryError

INT, FLOAT, BOOL, STRING, DATE, NULL = "INT64", "FLOAT64", "BOOL", "STRING", "DATE", "NULL"
NUMERIC = (INT, FLOAT)
SPARK = {INT: T.LongType(), FLOAT: T.DoubleType(), BOOL: T.BooleanType(), STRING: T.StringType(), DATE: T.DateType()}
_known = {
    T.ByteType: INT, T.ShortType: INT, T.IntegerType: INT, T.LongType: INT, T.FloatType: FLOAT, T.DoubleType: FLOAT,
    T.BooleanType: BOOL, T.StringType: STRING, T.DateType: DATE,
}


def of(spark_type: T.DataType, what: str) -> str:
    """The type of a stored column; smaller numbers widen to the dialect's."""
    if kind := _known.get(type(spark_type)):
        return kind
    raise QueryError(f"{what} has type {spark_type.simpleString()}, which is not supported")


def stored(spark_type: T.DataType) -> str | None:
    return _known.get(type(spark_type))
