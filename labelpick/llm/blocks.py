"""Documents packed into blocks, so that a table of facts about their distinct parts can be joined back by position.

A block is a run of rows with at most ``max_bytes`` of text (or one longer row). It is one row of a stored table: a
number, the packed rows, and the distinct parts of their texts (words, line keys) in the order of their local numbers.
Parts can be exploded, shuffled and looked up; the answers come back by (block, local number) and meet the packed rows
again. As the table is stored, a repeated task finds the same blocks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.llm.common import holder, materialize, released, slices
from labelpick.session import scratch_path

BLOCK_BYTES = 8 << 20
# Text per shard of the words of all blocks.
SHARD_BYTES = 24 << 20
LEAST_SHARDS = 16
SEPARATOR = b"\xff"  # no byte of UTF-8 text


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def numbered(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of one task with block numbers that no other task uses."""
    task = TaskContext.get().partitionId() << 32
    for n, batch in enumerate(slices(batches, text_col, max_bytes)):
        yield task + n, batch


def write_blocks(docs: DataFrame, encode: Callable, extra: str, name: str, text_col: str = "text",
                 max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Store (block, pack, extra columns); ``encode(batch)`` gives the batch to pack and the extra values."""
    names = [part.split()[0] for part in extra.split(", ")]
    schema = f"block long, pack binary, {extra}"

    def run(batches):
        holder(name)
        for block, batch in numbered(batches, text_col, max_bytes):
            packed, values = encode(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([pack(packed)], pa.binary()), *values],
                ["block", "pack", *names])

    return materialize(docs.mapInArrow(released(run), schema), name)


def squeeze(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane."""
    import zstandard

    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def expand(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(-1)


def gather(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the entries of the given rows, one after the other."""
    size = starts[rows + 1] - starts[rows]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - ends + size, size)


def word_shards(docs: DataFrame, text_col: str) -> int:
    """Into how many shards the words of the blocks are dealt, so that a shard's size does not grow with the input."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(-(-total // SHARD_BYTES), LEAST_SHARDS)


def send_words(words: list[bytes], shards: int) -> tuple[np.ndarray, list[dict]]:
    """The shard of each word, and one message per shard that holds its words in their order."""
    import zstandard

    shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.int64, len(words))
    squash, out = zstandard.ZstdCompressor(level=6), []
    for s in np.unique(shard).tolist():
        mine = SEPARATOR.join([words[i] for i in np.flatnonzero(shard == s).tolist()])
        out.append({"shard": s, "words": squash.compress(mine)})
    return shard, out


def received_words(message: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(message).split(SEPARATOR)


def store_by_block(blocks: DataFrame, name: str) -> DataFrame:
    """Store a table bucketed by its block numbers, so that it can be grouped by block without a shuffle."""
    spark = blocks.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    (blocks.write.format("parquet").option("path", scratch_path(spark, table)).bucketBy(buckets, "block")
     .saveAsTable(table))
    return spark.table(table)
