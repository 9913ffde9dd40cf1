"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpick.session import materialize

__all__ = ["apart", "crc_bucket", "documents", "file_text", "holder", "materialize", "named", "released", "released_group", "slices", "small_batches",
           "text_bytes", "texts", "tidy", "together", "words_of"]

# Largest vocabulary file that is shipped to the executors.
FILE_BYTES_LIMIT = 64 * 1024 * 1024
# Most bytes of an Arrow batch of texts (or one longer row).
BATCH_BYTES = 4 * 1024 * 1024


# A-Z to lower case, every other ASCII byte that is no letter or digit to a blank
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words of lower-case letters, digits and non-ASCII characters."""
    return raw.translate(TABLE).split()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def crc_bucket(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit(""))), F.lit(n))


def named(column: str) -> Column:
    """A column by its plain name, which may hold dots and other marks."""
    return F.col("`" + column.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most BATCH_BYTES in this session, on both sides of the pipe to a Python worker.

    Spark's own limits allow 64 MB a batch, which a task holds several times over: as vectors, as bytes and in Python.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def apart(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): all other columns as one struct, so that their names can't clash with those of an operator."""
    small_batches(docs.sparkSession)
    others = [named(c) for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), named(text_col).cast("string").alias("text"))


def together(done: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The columns that ``apart`` put away, with the text as it is now."""
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns])


def file_text(spark: SparkSession, path: str) -> Broadcast:
    """Ship a vocabulary file from the driver to the executors, after checking its size."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if len(text) > FILE_BYTES_LIMIT:
        raise ValueError(f"{path} is larger than {FILE_BYTES_LIMIT} bytes")
    return spark.sparkContext.broadcast(text)


def holder(name: str) -> dict:
    """A dict that lives as long as the Python worker, for caches that several tasks share.

    A worker holds the caches of one operator at a time; those of the one before are let go, and the memory goes back to
    the system. Operators without caches call this too, so as not to work beside those of the one before.
    """
    module = sys.modules.setdefault("labelpick_worker_state", types.ModuleType("labelpick_worker_state"))
    held = module.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        tidy()
    return held.setdefault(name, {})


def tidy(cycles: bool = True) -> None:
    """Give memory that is no longer used back to the system; workers live on between tasks.

    ``cycles``: also look for objects that hold each other, which takes longer than the rest.
    """
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def released(run):
    """``run`` for mapInArrow; at the end of a task, when it holds nothing more, its memory goes back to the system.

    Spark keeps workers for later tasks, some of which may never come, so what a worker holds adds to what others take.
    """

    def task(batches):
        yield from run(batches)
        tidy()

    return task


def released_group(run, *groups):
    """``run(*groups)`` for applyInArrow; what it took goes back to the system after each group."""
    done = run(*groups)
    tidy(cycles=False)
    return done


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null gives the empty text."""
    return [x or "" for x in column.to_pylist()]


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null gives the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows that hold at most ``max_bytes`` of text, or one longer row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


