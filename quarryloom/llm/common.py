"""What the training-data operators share: the shared folder, written tables, word patterns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a local session leaves it unset (tests) a temporary one is made,
    once for the session; a cluster has to name one, since its executors can't
    read the driver's own folders.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='quarryloom-')}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, read it back.

    An executor lost later costs a re-read, not the work that led here. While it is
    written, batches between the JVM and Python have BATCH_ROWS rows at most, so that neither side holds many texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty tables that :func:`written` gave and that nothing will read again, so that their disk is free at once."""
    for t in tables:
        t.sparkSession.range(0).write.mode("overwrite").parquet(t.written_at)


def returning_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; then the Python worker, which Spark keeps for other tasks, gives back what it no longer uses."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return whole


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of a text column (one row at least), so that long texts are few at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(sizes, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or as many underscores before it as make it a new column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame, name: str, what: str) -> DataFrame:
    """``docs`` with a column ``name``, unique to each row: doc_id, if every row has its own.

    Otherwise the rows are numbered and written, so that those that share an id,
    or have none, stay apart.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return written(docs.withColumn(name, F.monotonically_increasing_id()), what)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def uniform(*of) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / F.lit(float(1 << 52))
