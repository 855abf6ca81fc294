"""Integrity check of a table's files: every column of every row group is decoded, on the executors.

A damaged part is reported and the check goes on.  What reaches the driver is one line
for each column of each row group, fetched one partition at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = "file string, row_group int, column string, type string, rows long, nulls long, low string, high string, error string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths only: contents are never loaded whole, tasks read one column of one row group at a time."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select("path").repartition(spark.sparkContext.defaultParallelism)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _look(batches):
    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = pa.schema(
        [("file", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("type", pa.string()), ("rows", pa.int64()), ("nulls", pa.int64()), ("low", pa.string()), ("high", pa.string()), ("error", pa.string())]
    )
    for batch in batches:
        for name in batch.column("path").to_pylist():
            found = []
            empty = dict.fromkeys(schema.names) | {"file": name}
            try:
                file = pq.ParquetFile(_open(name), page_checksum_verification=True)
                fields = file.schema_arrow
                if file.metadata.num_row_groups == 0:
                    found += [empty | {"column": f.name, "type": str(f.type), "rows": 0} for f in fields]
            except Exception as e:
                found.append(empty | {"error": f"footer: {e}"})
            else:
                for g in range(file.metadata.num_row_groups):
                    group = file.metadata.row_group(g)
                    stats = {group.column(c).path_in_schema.split(".")[0]: group.column(c).statistics for c in range(group.num_columns)}
                    for field in fields:
                        row = empty | {"row_group": g, "column": field.name, "type": str(field.type), "rows": group.num_rows}
                        if (s := stats.get(field.name)) is not None:
                            row["nulls"] = s.null_count
                            try:
                                row |= {"low": str(s.min)[:60], "high": str(s.max)[:60]} if s.has_min_max else {}
                            except Exception as e:
                                row["error"] = f"statistics: {e}"
                        try:
                            column = file.read_row_group(g, columns=[field.name]).column(0)
                            column.validate(full=True)
                            if len(column) != group.num_rows:
                                row["error"] = f"{len(column)} values, {group.num_rows} expected"
                            elif row["nulls"] is not None and column.null_count != row["nulls"]:
                                row["error"] = f"{column.null_count} nulls, {row['nulls']} expected"
                        except Exception as e:
                            row["error"] = f"data: {e}"
                        found.append(row)
            yield pa.RecordBatch.from_pylist(found, schema=schema)


def findings(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column of each row group below ``path``; ``error`` is null where all is well."""
    return _files(spark, path).mapInArrow(_look, FINDINGS)


@dataclass
class Report:
    lines: Iterator[str]
    errors: int = 0


def fsck(spark: SparkSession, path: str) -> Report:
    """Readable lines, and after the last of them the number of errors."""
    report = Report(iter(()))

    def lines():
        rows = findings(spark, path).orderBy("file", F.col("row_group").asc_nulls_first(), "column")
        file = None
        for r in rows.toLocalIterator():
            if r.file != file:
                file = r.file
                yield file
            if r.error:
                report.errors += 1
            where = f"  row group {r.row_group}, {r.column} {r.type}" if r.column else " "
            numbers = f": {r.rows} rows, {r.nulls if r.nulls is not None else '?'} nulls" if r.rows is not None else ""
            bounds = f", {r.low} to {r.high}" if r.low is not None else ""
            yield f"{where}{numbers}{bounds}" + (f" ERROR {r.error}" if r.error else "")
        if file is None:
            report.errors += 1
            yield f"{path}: no Parquet file"

    report.lines = lines()
    return report
