"""Paths of any file system that Spark reaches: listing, reading small files, a folder for tables that a job makes."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def children(path: str, suffix: str) -> dict[str, str]:
    """Paths directly below ``path`` that end in ``suffix``, by name without it."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        found = [str(p) for p in Path(path).glob(f"*{suffix}")]
    else:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath().toString() for s in system.listStatus(folder)] if system.exists(folder) else []
    names = {p.rstrip("/").rsplit("/", 1)[-1]: p for p in found}
    return {n.removesuffix(suffix): p for n, p in sorted(names.items()) if n.endswith(suffix)}


def read_text(path: str) -> str:
    """A small file's text; an ``OSError`` where there is none."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return Path(path).read_text(encoding="utf-8")
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(file):
        raise FileNotFoundError(path)
    return spark.read.option("wholetext", "true").text(path).first()[0]


def fresh(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a local one only where all of Spark is in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tarnql-{uuid.uuid4().hex}"
