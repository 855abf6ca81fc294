"""Names of tables: Parquet files whose schemas are read when they are first needed."""

from __future__ import annotations

import json
import threading
import uuid
import weakref
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .paths import children, read_text


class Catalog:
    """Table names and their paths.

    ``dates`` reads timestamps as dates, which the dialect has instead: of all tables if
    true.  Spark turns comparisons of such a column with a date into comparisons of the
    stored timestamp, so filters still reach the files.
    """

    def __init__(self, tables: Mapping[str, str] | None = None, dates: bool = False):
        self._paths: dict[str, str] = dict(tables or {})
        self._frames: weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = weakref.WeakKeyDictionary()
        self._views: weakref.WeakKeyDictionary[SparkSession, dict[str, str]] = weakref.WeakKeyDictionary()
        self._given: dict[str, T.StructType] = {}
        self._lock = threading.Lock()
        self.dates = dates

    @classmethod
    def open(cls, config: str = "", dates: bool = False) -> Catalog:
        """From a JSON file ``{"tables": [{"name": ..., "path": ...}]}``; an empty path makes an empty catalog."""
        if not config:
            return cls(dates=dates)
        try:
            entries = json.loads(read_text(config)).get("tables", [])
            return cls({t["name"]: t["path"] for t in entries}, dates)
        except OSError as e:
            raise QueryError(f"catalog {config} cannot be read: {e}") from e
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise QueryError(f"catalog {config} is not in the form of a catalog: {e}") from e

    @classmethod
    def single(cls, spark: SparkSession, name: str, path: str) -> Catalog:
        """One table, whose file is looked at now."""
        return cls.several(spark, {name: path})

    @classmethod
    def several(cls, spark: SparkSession, tables: Mapping[str, str]) -> Catalog:
        catalog = cls(tables)
        for name in tables:
            catalog.table(spark, name)
        return catalog

    @classmethod
    def folder(cls, path: str, dates: bool = True) -> Catalog:
        """Every ``name.parquet`` in a folder of any file system."""
        return cls(children(path, ".parquet"), dates)

    def register(self, name: str, path: str, schema: T.StructType | None = None) -> None:
        """Adds or replaces a table; with a schema, no file is read before a query runs."""
        with self._lock:
            self._paths[name] = path
            for known in (*self._frames.values(), *self._views.values()):
                known.pop(name, None)
            self._given.pop(name, None)
            if schema is not None:
                self._given[name] = schema

    @property
    def names(self) -> list[str]:
        return sorted(self._paths)

    def path(self, name: str) -> str:
        if name not in self._paths:
            raise QueryError(f"unknown table {name}")
        return self._paths[name]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The table's rows, with the dialect's dates if asked for."""
        path = self.path(name)
        with self._lock:
            frames = self._frames.setdefault(spark, {})
            if name not in frames:
                # a page that doesn't match its checksum ends a query
                reader = spark.read.option("parquet.page.verify-checksum.enabled", "true")
                reader = reader.schema(self._given[name]) if name in self._given else reader
                try:
                    df = reader.parquet(path)
                except Exception as e:
                    raise QueryError(f"table {name} cannot be opened at {path}: {str(e).splitlines()[0]}") from e
                stamps = {f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))} if self.dates else ()
                if stamps:
                    df = df.select(*[F.to_date(f"`{c}`").alias(c) if c in stamps else F.col(f"`{c}`") for c in df.columns])
                frames[name] = df
            return frames[name]

    def rows(self, spark: SparkSession, name: str, first: int, end: int | None = None) -> DataFrame:
        """A range of a table's scan: in each of its files, the rows numbered from ``first`` up to ``end``, or to the last."""
        df, number = self.table(spark, name), F.col("_metadata.row_index")
        return df.where(number >= first if end is None else (number >= first) & (number < end))

    def view(self, spark: SparkSession, name: str) -> str:
        """The temporary view of a table, under a name of its own that stays as long as the session."""
        df = self.table(spark, name)
        with self._lock:
            views = self._views.setdefault(spark, {})
            if name not in views:
                df.createOrReplaceTempView(view := f"tarnql_{uuid.uuid4().hex}")
                views[name] = view
            return views[name]

    def schema(self, spark: SparkSession, name: str) -> T.StructType:
        return self.table(spark, name).schema

    def register_views(self, spark: SparkSession) -> None:
        """Every table as a temporary view, for plain Spark SQL."""
        for name in self._paths:
            self.table(spark, name).createOrReplaceTempView(name)
