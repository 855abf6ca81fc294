"""What the operators share: scratch tables, fold rules, labelled samples."""

from __future__ import annotations

import atexit
import contextlib
import io
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labelled rows that a classifier is fitted on, at most (the rows whose hashed ids come first).
SAMPLE_ROWS = 8000
#: Features of these rows together, at most, but for the last row's: the driver holds them.
SAMPLE_FEATURES = 20_000_000
#: Documents per Arrow batch; bounds a Python worker's memory when texts are long.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(here.glob("*.py")):
            z.write(path, f"{here.parent.name}/{here.name}/{path.name}")
        z.writestr(f"{here.parent.name}/__init__.py", "")
    name = Path(tempfile.mkdtemp(prefix="tarnql-"), "tarnql_llm.zip")  # the driver serves it to the executors
    name.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(name))


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``: several of them are held at once, on either side."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; the session's Arrow batches are bounded by bytes from then on."""
    ship(df.sparkSession)
    _small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: _released(function(slices(batches))), schema)


def _released(results):
    """``results``; the worker then gives its memory back, as it may wait long for its next task."""
    try:
        yield from results
    finally:
        del results
        release()


#: Where tables were stored.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Paths made while each ``temporary`` is open.
_open: list[list[str]] = []


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    Only where that setting is absent and all of Spark is in one process, as in tests, a
    local folder takes its place; on a cluster its absence is an error.  What was written
    there is deleted when the driver ends, or the innermost ``temporary``.
    """
    from ..sources.paths import fresh

    path = fresh(spark)
    atexit.register(delete, spark, path)
    if _open:
        _open[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes what is at ``path``, if the session still can."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already; the shared folder is the cluster's to empty
        pass


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Deletes at its end what was stored on the way; what is to last is written to a path made before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def stored(df: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.

    Rows of several MB are written in row groups of ``block_bytes``, as neither side can hold many of them.
    """
    spark = df.sparkSession
    path = scratch(spark)
    large = {"parquet.block.size": block_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
    df.write.options(**large if block_bytes else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing needs any more."""
    for df in tables:
        if path := _stored.pop(df, None):
            delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % k


def held_out(doc_id: Column | str, k: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, k) == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, k: int, remainder: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold.

    Repeated labels of one id count once, the largest; so do repeated documents,
    the smallest text.  The ids are those whose hash comes first, so the choice
    depends on neither order nor partitions.
    """
    ids = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & (fold("doc_id", k) != remainder))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # at most `rows` pairs of a long and an int: small enough to broadcast whatever the table's size
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def within(sample: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows of a sample, which has at most a few thousand, whose sizes add up to ``most`` in order of hashed ids, and the one that goes beyond."""
    sample = stored(sample)
    ids = sample.select("doc_id", size.alias("_n"), F.xxhash64("doc_id").alias("_h"))
    before = Window.orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < most).select("doc_id")
    return sample.join(F.broadcast(ids), "doc_id")  # of as many ids as the sample has


def release() -> None:
    """Gives memory back that Arrow and the C library keep after large results, so that it doesn't add to what comes next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def slices(batches):
    """Arrow batches cut so that no slice holds more than about ``BATCH_BYTES``."""
    for batch in batches:
        step = BATCH_ROWS
        while step > 1 and any(batch.slice(k, step).nbytes > BATCH_BYTES for k in range(0, batch.num_rows, step)):
            step //= 4
        for k in range(0, batch.num_rows, max(step, 1)):
            yield batch.slice(k, max(step, 1))
