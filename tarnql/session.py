"""Sessions with the dialect's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the dialect needs wherever it runs; sizes of partitions are the cluster's to set.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.ignoreCorruptFiles": "false",
    # pages are written with checksums, and whatever reads them compares
    "spark.hadoop.parquet.page.write-checksum.enabled": "true",
    "spark.hadoop.parquet.page.verify-checksum.enabled": "true",
    "spark.sql.files.ignoreMissingFiles": "false",
}


def session(workers: int | None = None, **settings: str) -> SparkSession:
    """A session; with ``workers``, a local one of so many threads."""
    builder = SparkSession.builder.appName("tarnql")
    if workers:
        builder = builder.master(f"local[{workers}]").config("spark.sql.shuffle.partitions", str(workers))
    return builder.config(map=SETTINGS | settings).getOrCreate()
