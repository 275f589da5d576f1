"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r. bytes.split() uses the same set.
SPACES = b" \t\n\x0b\x0c\r"
#: A word, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir. Only a session on a local master (a test)
    gets a temporary one; on a cluster, where executors don't see it, a missing setting raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="causeway-checkpoint-"))


def free(name: str, columns: list[str]) -> str:
    """A name for a helper column that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession, size: int, most: int) -> int:
    """Partitions for `size` rows or bytes, with about `most` in each at most; no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // most))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: later stages don't
    recompute it, and the loss of an executor doesn't lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unit_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Texts (_u, text), one row per row of docs, and names (_u, doc_id). _u is unique and orders
    rows as (id, nulls last; then the text's digest). Where ids are unique and present, _u is the
    id itself, no row moves and names is None; else rows are sorted once and numbered."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    twice = narrow.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1)
    if twice.isEmpty():
        return narrow.select(F.col("doc_id").alias("_u"), "text"), None
    ordered = narrow.orderBy(F.col("doc_id").asc_nulls_last(), F.md5(F.coalesce("text", F.lit(""))))
    numbered = cut(ordered.select(F.monotonically_increasing_id().alias("_u"), "doc_id", "text"))
    return numbered.select("_u", "text"), numbered.select("_u", "doc_id")


def named(units: DataFrame, names: DataFrame | None) -> DataFrame:
    """doc_id in the place of _u."""
    rest = [c for c in units.columns if c != "_u"]
    return units.select(F.col("_u").alias("doc_id"), *rest) if names is None else units.join(names, "_u").select("doc_id", *rest)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and the n + 1 offsets between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def gathered(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    """A whole shuffle partition as one table; its size is set by the number of partitions."""
    batches = list(batches)
    return (pa.Table.from_batches(batches) if batches else schema.empty_table()).combine_chunks()


def lean(run: Callable) -> Callable:
    """run, after which the worker gives the memory that it needed back to the system: workers outlive their tasks, and
    those of several stages share an executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only glibc has it
            pass

    return wrapped


def array_of(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name)
    if not len(column):
        return np.zeros(0, column.type.to_pandas_dtype())
    return column.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.to_numpy()


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def binaries(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes laid end to end."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(parts))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
