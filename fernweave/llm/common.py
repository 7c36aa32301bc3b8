"""What the operators of this folder share: table reading, the shared folder, byte-level Arrow access."""

from __future__ import annotations

import ctypes
import os
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir, shared_dir

#: Words of the contracts that split on ASCII white space, as a Java, RE2 and Python pattern.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch: long texts go to Python in batches of fewer rows, which bounds the memory of tasks and workers.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (folder, thread) of the tables that this process has written and not deleted, by the folders' names, each of which occurs once.
_folders: dict[str, tuple[str, int]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df, cut off from its lineage: a Parquet table in the shared folder that survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    _folders[os.path.basename(path)] = path, threading.get_ident()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _folders.pop(os.path.basename(path), None)


def folder_names(df: DataFrame) -> set[str]:
    """Names of the folders that df is read from: Spark adds scheme, host and escapes to paths, but a folder's own name stays."""
    return {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}


def drop_written(df: DataFrame) -> None:
    """Deletes the tables that `written` made for df, once nothing reads them any more."""
    for name in folder_names(df) & set(_folders):
        delete(df.sparkSession, _folders[name][0])


def own_folders() -> list[tuple[str, str]]:
    """(name, folder) of the tables of this thread, in order: queries that run beside it in other threads have their own."""
    return [(name, path) for name, (path, thread) in list(_folders.items()) if thread == threading.get_ident()]


def marked() -> int:
    """A mark for drop_since in the same thread."""
    return len(own_folders())


def drop_since(mark: int, kept: DataFrame) -> None:
    """Deletes the tables that this thread has written since the mark, but for kept, once nothing reads them any more."""
    own = folder_names(kept)
    for name, path in own_folders()[mark:]:
        if name not in own:
            delete(kept.sparkSession, path)


def trim() -> None:
    """Gives memory that is free in this process back to the system, where the C library can: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, other characters as they are: by the quick `lower` where it can't change others, else letter by letter."""
    return F.when(text.rlike("[^\\x00-\\x7F\u00df-\u00f6\u00f8-\u00ff]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits from a row's id and text: rows with equal id and text are one document, stored repeatedly."""
    body = F.coalesce(F.col(text_col), F.lit("\0"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))
    return F.struct(F.xxhash64(name, body).alias("a"), F.xxhash64(body, F.lit("+"), name).alias("b"))


def small_enough(df: DataFrame, most_bytes: int = 8 << 20, row_bytes: int = 64) -> bool:
    """Whether df, counted, is small enough to broadcast."""
    return df.limit(most_bytes // row_bytes + 1).count() <= most_bytes // row_bytes


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, the offsets of its rows and its lengths; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1 + col.offset)[col.offset :] if n else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] :], offsets - offsets[0], np.diff(offsets)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of a piece have `most` bytes at most (or it is a single row)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        _, _, sizes = text_bytes(col)
        at, n = 0, batch.num_rows
        ends = np.cumsum(sizes)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, col
    trim()


__all__ = ["BATCH_BYTES", "LOWER", "SPACE_WORDS", "UPPER", "drop_since", "drop_written", "fresh_dir", "lower_ascii", "marked", "pieces", "read", "row_key", "shared_dir", "small_enough", "text_bytes", "trim", "written"]
