"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where a key must be a number; ordered before every real id.
NULL_ID = -(2**63)
#: Bytes of rows that one batch holds on its way to Python, unless a single row has more.
BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lakeweave-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared one, gone when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Per worker process: what an operator remembers from task to task, by the operator's name, as a function that drops it.
_KEPT: dict[str, Callable[[], None]] = {}
#: glibc's way to give freed memory back to the system; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def keep_only(name: str = "", drop: Callable[[], None] | None = None) -> None:
    """Says at a task's start whose memory this worker keeps: that of other operators, which ran in it before, goes.

    What earlier tasks freed and allocators hold for later goes back to the system.
    """
    others = [n for n in _KEPT if n != name]
    for other in others:
        _KEPT.pop(other)()
    if others:
        gc.collect()  # encoders and what they remember refer to each other
    if drop:
        _KEPT[name] = drop
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def bytes_of(df: DataFrame) -> int:
    """What Spark's plan estimates as the size of ``df``; 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def small_batches(spark: SparkSession) -> None:
    """Lets batches that go to Python hold BATCH bytes, unless the session has a setting of its own: both sides hold a whole batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(key, str(BATCH))


def texts(docs: DataFrame) -> DataFrame:
    """The two columns every text operator needs, null texts as empty ones. Other columns are ignored."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) in runs of about ``limit`` bytes of text, so that memory follows the run and not the batch."""
    for batch in batches:
        column = batch.column("text")
        for start, stop in slices(column, limit):
            yield batch.column("doc_id").slice(start, stop - start).to_pylist(), column.slice(start, stop - start).to_pylist()


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of a string column, each of about ``limit`` bytes or a single longer text. Nulls have none."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    sizes = np.cumsum(np.asarray(lengths, dtype=np.int64))
    start = 0
    while start < len(column):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield start, stop
        start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows; runs that touch are one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.r_[True, spans[1:, 0] > reach[:-1]]
    at = np.flatnonzero(first)
    return np.stack([spans[at, 0], np.r_[reach[at[1:] - 1], reach[-1]]], axis=1)
