"""Incremental, reversible line dedup: sharded cuckoo filters in front of exact reference counts.

State of a ``LineIndex``:

* ``refs`` (key, docs): for every line key, in how many documents it is. Keys are 128-bit blake2b digests of the
  normalised line, so equal digests mean equal lines for any amount of text that can exist.
* ``filters`` (shard, filter): one cuckoo filter per shard of the key space, holding the keys found in at least
  ``min_docs`` documents.

Inserting and deleting documents adds to and takes from the counts; keys that cross the limit are inserted into or
deleted from their shard's filter. Deleting what was inserted gives the former state.

Dropping lines asks the filters first. They have no false negatives, so only their hits are compared with the exact
counts, and almost all lines need no join.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpick.llm.blocks import unpack, write_blocks
from labelpick.llm.common import apart, holder, materialize, released, text_bytes, together

SLOTS = 4
MAX_KICKS = 200
SHARD_KEYS = 500_000
# Filters shipped to the executors at once.
FILTER_BYTES = 64 << 20


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes: ASCII white space and A-Z only


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class Cuckoo:
    """Cuckoo filter with 16-bit fingerprints; what finds no place goes to a stash, so that inserting never fails."""

    def __init__(self, table: np.ndarray, stash: list[tuple[int, int]] | None = None):
        self.table, self.stash = table, list(stash or ())

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.85)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and the two buckets of (n, 16) uint8 digests."""
        halves = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 2)
        mark = (halves[:, 0] & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = (halves[:, 1] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, bucket, mark):
        return bucket ^ (mark * 0x5BD1E995 >> 7 & len(self.table) - 1)

    def insert(self, digests: np.ndarray) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self.places(digests))):
            self._put(mark, a, b)

    def _put(self, mark: int, a: int, b: int) -> None:
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return
        bucket = b
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self.other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return
        self.stash.append((mark, min(bucket, self.other(bucket, mark))))

    def delete(self, digests: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        for mark, a, b in zip(*(x.tolist() for x in self.places(digests))):
            if (mark, min(a, b)) in self.stash:
                self.stash.remove((mark, min(a, b)))
                continue
            bucket = a if (self.table[a] == mark).any() else b
            at = np.flatnonzero(self.table[bucket] == mark)
            if not len(at):
                raise ValueError("a line that was never inserted can't be deleted")
            self.table[bucket, at[0]] = 0

    def holds(self, digests: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(digests)
        found = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        for m, low in self.stash:
            found |= (mark == m) & (np.minimum(a, b) == low)
        return found

    def dump(self) -> bytes:
        stash = np.array(self.stash, np.int64).reshape(-1, 2)
        return np.array([len(self.table), len(stash)], np.int64).tobytes() + self.table.tobytes() + stash.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        buckets, stashed = np.frombuffer(data, np.int64, 2).tolist()
        table = np.frombuffer(data, np.uint16, buckets * SLOTS, 16).reshape(buckets, SLOTS).copy()
        stash = np.frombuffer(data, np.int64, 2 * stashed, 16 + 2 * SLOTS * buckets).reshape(-1, 2)
        return cls(table, [tuple(x) for x in stash.tolist()])


def digest_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


def line_blocks(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """Blocks with their distinct line keys and in how many of their documents each is."""

    def encode(batch):
        local: dict[bytes, int] = {}
        counts: list[int] = []
        numbers = []
        for raw in text_bytes(batch.column(text_col)):
            mine = []
            for line in raw.split(b"\n"):
                key = line_key(line)
                if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                    mine.append(-1)
                    continue
                n = local.setdefault(key, len(local))
                if n == len(counts):
                    counts.append(0)
                mine.append(n)
            for n in set(mine):
                if n >= 0:
                    counts[n] += 1
            numbers.append(mine)
        packed = batch.append_column("line_numbers", pa.array(numbers, pa.list_(pa.int32())))
        return packed, [pa.array([[digest(key) for key in local]], pa.list_(pa.binary())),
                        pa.array([counts], pa.list_(pa.int32()))]

    return write_blocks(docs, encode, "keys array<binary>, counts array<int>", "line_blocks", text_col)


def block_keys(blocks: DataFrame) -> DataFrame:
    """(block, number, key, n): the distinct keys of each block."""
    return blocks.select("block", F.posexplode(F.arrays_zip("keys", "counts")).alias("number", "part")).select(
        "block", "number", F.col("part.keys").alias("key"), F.col("part.counts").alias("n"))


def sum_refs(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").agg(F.sum("n").alias("docs"))


FILTERS = "shard int, filter binary"


@dataclass
class LineIndex:
    """Reference counts and filters of the documents inserted so far. Every change gives a new index."""

    spark: SparkSession
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int, min_chars: int = 1, text_col: str = "text") -> LineIndex:
        return cls.from_blocks(line_blocks(docs.select(text_col), text_col, min_chars), min_docs, min_chars)

    @classmethod
    def from_blocks(cls, blocks: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        spark = blocks.sparkSession
        refs = materialize(sum_refs(block_keys(blocks).select("key", "n")), "line_refs")
        frequent = refs.where(F.col("docs") >= min_docs).count()
        shards = -(-frequent // SHARD_KEYS) or 1
        index = cls(spark, refs, spark.createDataFrame([], FILTERS), shards, min_docs, min_chars)
        index.filters = materialize(index._changed(refs.where(F.col("docs") >= min_docs).select(
            "key", F.lit(1).alias("change"))), "line_filters")
        return index

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _changed(self, crossing: DataFrame) -> DataFrame:
        """Filters after inserting (change 1) and deleting (change -1) keys."""

        def change(key, old, keys):
            into = digest_rows(keys.filter(pa.compute.equal(keys["change"], 1))["key"])
            out = digest_rows(keys.filter(pa.compute.equal(keys["change"], -1))["key"])
            cuckoo = Cuckoo.load(old["filter"][0].as_py()) if old.num_rows else Cuckoo.sized(2 * len(into))
            cuckoo.delete(out)
            cuckoo.insert(into)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()),
                             "filter": pa.array([cuckoo.dump()], pa.binary())})

        rows = crossing.withColumn("shard", self._shard())
        return self.filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(change, FILTERS)

    def _moved(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        blocks = line_blocks(docs.select(text_col), text_col, self.min_chars)
        delta = sum_refs(block_keys(blocks).select("key", (sign * F.col("n")).alias("n"))).withColumnRenamed("docs", "n")
        both = materialize(self.refs.join(delta, "key", "full").select(
            "key", F.coalesce("docs", F.lit(0)).alias("before"),
            (F.coalesce("docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("docs")), "line_moves")
        if both.where(F.col("docs") < 0).limit(1).count():
            raise ValueError("a line that was never inserted can't be deleted")
        over, was = F.col("docs") >= self.min_docs, F.col("before") >= self.min_docs
        crossing = both.where(over != was).select("key", F.when(over, 1).otherwise(-1).alias("change"))
        new = LineIndex(self.spark, both.where("docs > 0").select("key", "docs"), self.filters, self.shards,
                        self.min_docs, self.min_chars)
        new.filters = materialize(self._changed(crossing), "line_filters")
        return new

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._moved(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The index without these documents, which must have been inserted before."""
        return self._moved(docs, text_col, -1)

    def repeated(self, blocks: DataFrame) -> DataFrame:
        """(block, number) of the keys that are found in at least min_docs documents."""
        keys = block_keys(blocks).select("block", "number", "key").withColumn("shard", self._shard())
        sizes = {r.shard: r.n for r in self.filters.select("shard", F.octet_length("filter").alias("n")).collect()}
        groups, held = [[]], 0
        for shard in sorted(sizes):
            if groups[-1] and held + sizes[shard] > FILTER_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(shard)
            held += sizes[shard]
        hits = reduce(DataFrame.unionAll, [self._hits(keys, group) for group in groups])
        frequent = self.refs.where(F.col("docs") >= self.min_docs).select("key")
        return hits.join(frequent, "key").select("block", "number")

    def _hits(self, keys: DataFrame, group: list[int]) -> DataFrame:
        """Keys that the filters of these shards may hold; the filters have at most FILTER_BYTES together."""
        data = {r.shard: bytes(r["filter"]) for r in self.filters.where(F.col("shard").isin(group)).collect()}
        shipped = self.spark.sparkContext.broadcast(data)

        def probe(batches):
            holder("line_blocks")
            filters = {shard: Cuckoo.load(x) for shard, x in shipped.value.items()}
            for batch in batches:
                shard = batch.column("shard").to_numpy()
                rows = digest_rows(batch.column("key"))
                keep = np.zeros(len(shard), bool)
                for s, cuckoo in filters.items():
                    mine = np.flatnonzero(shard == s)
                    if len(mine):
                        keep[mine] = cuckoo.holds(rows[mine])
                yield batch.filter(pa.array(keep))

        part = keys.where(F.col("shard").isin(group))
        return part.mapInArrow(released(probe), part.schema).select("block", "number", "key")


def _apply(blocks: DataFrame, index: LineIndex, text_col: str, finish, schema: str, spare_copies: bool = False) -> DataFrame:
    """Bring the repeated keys back to their blocks and hand on (rows, n_lines, dropped, kept texts)."""

    def apply(key, block, repeated):
        if not block.num_rows:
            return pa.schema(out).empty_table()
        rows = unpack(block["pack"][0].as_py())
        gone = set(repeated["number"].to_pylist())
        total, dropped, kept = [], [], []
        for raw, numbers in zip(text_bytes(rows[text_col].combine_chunks()), rows["line_numbers"].to_pylist()):
            lines = raw.split(b"\n")
            total.append(len(lines))
            stay = [line for line, n in zip(lines, numbers) if n not in gone]
            if spare_copies and all(n < 0 or n in gone for n in numbers):
                stay = lines
            dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        return finish(rows, total, dropped, kept)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    out = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))
    return (blocks.select("block", "pack").groupBy("block").cogroup(index.repeated(blocks).groupBy("block"))
            .applyInArrow(apply, schema))


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the lines that stay.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``min_chars`` code
    points in at least ``min_docs`` rows lose all their lines. Null and empty texts are one empty line, which has no key
    and stays. Every row is a document of its own, also with repeated or null ids. Other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    blocks = line_blocks(rows, "text", min_chars)

    def finish(rows, total, dropped, kept):
        return pa.table({"doc_id": rows["doc_id"], "n_lines": pa.array(total, pa.int64()),
                         "n_dropped": pa.array(dropped, pa.int64()),
                         "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return _apply(blocks, LineIndex.from_blocks(blocks, min_docs, min_chars), "text", finish,
                  "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text",
                        index: LineIndex | None = None, spare_copies: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; all rows stay, texts without a change as they were.

    ``index`` may hold other documents too; by default it is built from ``docs``. With ``spare_copies`` a text of which no
    line with a key would stay is left whole: it is a copy of other documents, of which a document-level step keeps one.
    """
    inner = apart(docs, text_col)
    chars = index.min_chars if index else min_chars
    blocks = line_blocks(inner, "text", chars)

    def finish(rows, total, dropped, kept):
        texts = [k.decode() if d else old for k, d, old in zip(kept, dropped, rows["text"].to_pylist())]
        return pa.table({"row": rows["row"], "text": pa.array(texts, pa.string())})

    done = _apply(blocks, index or LineIndex.from_blocks(blocks, min_docs, chars), "text", finish, inner.schema,
                  spare_copies)
    return together(done, docs.columns, text_col)
