"""What the corpus operators share: reading columns, stored tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.session import materialised

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The setting for the most bytes of a batch of rows sent to Python, and its value here.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

__all__ = [
    "byte_slices", "docs_of", "fold", "ids_and_texts", "in_parts", "materialised", "release", "sub_batches", "texts_of",
]


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (null counts as empty), whatever else ``docs`` holds."""
    return in_parts(docs).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def in_parts(rows: DataFrame) -> DataFrame:
    """``rows``, which go to Python in batches of BATCH_BYTES unless the session has a size of its own.

    The JVM holds a batch several times (vectors that grow by doubling, the message, the buffer of
    the socket) and Python once more; by Spark's default a batch may be a whole split of texts.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_BYTES[0], None) is None:
        conf.set(*BATCH_BYTES)
    return rows


def fold(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def sub_batches(
    batches: Iterator[pa.RecordBatch], max_bytes: int = 1 << 20, column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``max_bytes`` of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(byte_slices(batch.column(column))[1])
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
    release()


def release() -> None:
    """Gives freed memory back; workers live on, what a task has held need not."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def byte_slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the offsets of the texts in it."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at * 0
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def texts_of(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.to_pylist()]
