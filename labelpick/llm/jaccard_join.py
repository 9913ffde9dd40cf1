"""Join documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. Copies: documents with equal n-gram sets form a class; only one of each takes part in the search.
2. Candidates: MinHash values in bands; classes that share a band key are candidates. With the default 48 bands of 5
   values a pair at similarity 0.8 shares none with a probability of 5e-9.
3. Work units: the classes connected through shared keys are dealt into tiles by a hash; a unit is a pair of tiles. So a
   pair of candidates meets in one unit only, a unit has a bounded size, and a huge group becomes many units. No pair is
   ever a row.
4. Bayesian pruning in a unit: MinHash values of a candidate pair are compared some at a time. With a uniform prior, after
   n comparisons with m agreements the posterior probability that the similarity reaches the threshold is
   P(Binomial(n + 1, threshold) <= m). A pair is dropped once that is below ``tolerance``.
5. What is left is verified on the n-gram sets themselves.

n-grams are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.llm.blocks import numbered
from labelpick.llm.common import (apart, holder, materialize, released, slices, text_bytes, together,
                                  words_of)
from labelpick.llm.components import components

BANDS, ROWS = 48, 5
STEP = 16  # MinHash values compared at a time
SLICE_BYTES = 4 << 20
TILE = 512
CACHE_WORDS = 100_000
_rng = np.random.default_rng(20240611)
FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """Word to 64-bit hash, remembered while the worker lives."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(raw: bytes, n: int, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; a shorter text has one n-gram of all its words, or none."""
    words = words_of(raw)
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(codes))
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k:len(codes) - n + 1 + k]) * _ODD[k % 16]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def minhash(grams: np.ndarray) -> np.ndarray:
    out = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(x), 1024):
        out = np.minimum(out, (x[start:start + 1024, None] * FACTORS + SHIFTS).min(0))
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """64-bit keys, (n, bands), of (n, bands * rows) MinHash values; the band's number is part of the key."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[7], parts.shape[:2]).copy()
    for k in range(ROWS):
        h = (h ^ parts[:, :, k]) * _ODD[8 + k % 8]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def least_agreements(threshold: float, tolerance: float, total: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """(n, m): after n comparisons a pair needs at least m agreements to stay."""
    out = []
    for n in range(STEP, total + 1, STEP):
        reach, m = 0.0, -1
        while reach < tolerance:  # P(Binomial(n + 1, threshold) <= m)
            m += 1
            reach += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def candidates(keys: np.ndarray, tile: np.ndarray, one_tile: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of a unit that share a band key; of a unit of two tiles only pairs across them."""
    first, second = [], []
    for start in range(0, len(keys), 128):
        some = keys[start:start + 128]
        share = np.zeros((len(some), len(keys)), bool)
        for b in range(BANDS):
            share |= some[:, b, None] == keys[None, :, b]
        share &= np.arange(start, start + len(some))[:, None] < np.arange(len(keys))
        if not one_tile:
            share &= tile[start:start + 128, None] != tile
        i, j = np.nonzero(share)
        first.append(i + start)
        second.append(j)
    return np.concatenate(first), np.concatenate(second)


def prune(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, rule: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose posterior probability of reaching the threshold never falls below the tolerance."""
    agree = np.zeros(len(i), np.int64)
    for n, least in rule:
        if not len(i):
            break
        agree += (sketch[i, n - STEP:n] == sketch[j, n - STEP:n]).sum(1)
        stay = agree >= least
        i, j, agree = i[stay], j[stay], agree[stay]
    return i, j


def verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have intersection / union >= threshold."""
    if not len(i):
        return np.zeros(0, bool)
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    size = np.array([len(sets[u]) for u in used])
    starts = np.concatenate([[0], np.cumsum(size)])
    _, codes = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    mark = np.zeros(codes.max() + 1, np.int32)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    common = np.zeros(len(i), np.int64)
    edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        mine = codes[starts[place[i[a]]]:starts[place[i[a]] + 1]]
        mark[mine] = 1
        for c in range(a, b, 256):
            some = place[j[c:min(c + 256, b)]]
            length = size[some]
            ends = np.cumsum(length)
            at = np.arange(ends[-1]) + np.repeat(starts[some] - ends + length, length)
            common[c:c + len(some)] = np.add.reduceat(mark[codes[at]], ends - length)
        mark[mine] = 0
    both = size[place[i]] + size[place[j]] - common
    out = np.zeros(len(i), bool)
    out[order] = common >= threshold * both - 1e-9
    return out


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member it is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _signatures(rows: DataFrame, n: int) -> DataFrame:
    """Store (uid, row, text, digest, keys); texts without words have no digest."""
    schema = "uid long, digest binary, keys array<bigint>"

    def run(batches):
        known = holder("shingles").setdefault("words", WordHash())
        for block, batch in numbered(batches, "text", SLICE_BYTES):
            sets = [shingles(raw, n, known) for raw in text_bytes(batch.column("text"))]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = band_keys(np.stack([minhash(s) for s in sets]))
            keys = [k.tolist() if d else None for k, d in zip(keys, digests)]
            # 2^20 tasks of 2^20 slices of 2^24 rows
            uid = [(block >> 32 << 44) + ((block & 0xFFFFF) << 24) + r for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(uid, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "uid", "digest", "keys"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    whole = StructType([*rows.schema.fields, *_parse_datatype_string(schema).fields])
    return materialize(rows.mapInArrow(released(run), whole), "signatures")


def _units(members: DataFrame) -> DataFrame:
    """(node, component, tile, a, b): every member in the units of its tile. A component has ceil(n / TILE) tiles."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    dealt = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return dealt.withColumn("other", other).select(
        "node", "component", "tile", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))


def _links(units: DataFrame, n: int, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, reached): partial results of every member in every unit.

    ``units`` has node, size (copies of the class), text, component, tile, a, b and arrives sorted by unit.
    """
    rule = least_agreements(threshold, tolerance)

    def solve(node, size, tile, raws, known):
        sets = [shingles(raw, n, known) for raw in raws]
        sketch = np.stack([minhash(s) for s in sets])
        i, j = candidates(band_keys(sketch), tile, bool((tile == tile[0]).all()))
        i, j = prune(sketch, i, j, rule)
        linked = verify(sets, i, j, threshold)
        i, j = i[linked], j[linked]
        links = np.bincount(i, size[j], len(node)) + np.bincount(j, size[i], len(node))
        return links.astype(np.int64), node[smallest_reached(len(node), i, j)]

    def run(batches):
        known = holder("shingles").setdefault("words", WordHash())
        held: list = []
        unit = None

        def flush():
            node, size, tile, raws = zip(*sorted(held))
            node, size = np.array(node, np.int64), np.array(size, np.int64)
            links, reached = solve(node, size, np.array(tile), raws, known)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(reached)],
                                              ["node", "links", "reached"])

        for batch in slices(batches, "text", SLICE_BYTES):
            keys = zip(*(batch.column(c).to_pylist() for c in ("component", "a", "b")))
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "size", "tile")), text_bytes(batch.column("text")))
            for key, row in zip(keys, rows):
                if key != unit and held:
                    yield flush()
                    held = []
                unit = key
                held.append(row)
        if held:
            yield flush()

    return units.mapInArrow(released(run), "node long, links long, reached long")


def _classes(rows: DataFrame, n: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Signatures, and (uid, copy, size, group, links) of every row with words."""
    signed = _signatures(rows, n)
    sets = signed.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("copy"), F.count("*").alias("size"))
    member = materialize(signed.where("digest is not null").select("uid", "digest").join(sets, "digest").drop("digest"),
                         "copies")
    heads = member.where("uid = copy").select("uid", "size")
    keys = signed.where("digest is not null").select("uid", "keys").join(heads.select("uid"), "uid").select(
        F.col("uid").alias("node"), F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    edges = keys.join(buckets, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = components(edges)
    units = (_units(near).join(heads.withColumnRenamed("uid", "node"), "node")
             .join(signed.select(F.col("uid").alias("node"), "text"), "node"))
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_units = units.repartition(parts, "component", "a", "b").sortWithinPartitions("component", "a", "b")
    found = materialize(_links(sorted_units, n, threshold, tolerance), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("reached").alias("b")))
    joined = (member.join(links.withColumnRenamed("node", "copy"), "copy", "left")
              .join(groups.withColumnRenamed("node", "copy"), "copy", "left")
              .select("uid", "copy", "size", F.coalesce("component", "copy").alias("group"),
                      (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")))
    return signed, joined


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id, n_links, n_copies.

    ``class_id`` is the smallest doc_id among the documents connected by links; ``n_links`` counts the other documents
    whose n-gram sets have a similarity of at least ``threshold``, copies included; ``n_copies`` those (with itself) whose
    set is equal. Texts of fewer than ``n`` words have one n-gram of all words. Null texts and texts without words have no
    links and are classes of their own. Rows are documents: repeated ids are as many documents, and a class of null ids
    only has a null class_id. Other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed, classes = _classes(rows, n, threshold, tolerance)
    ids = materialize(signed.select("uid", "doc_id").join(classes, "uid", "left").select(
        "doc_id", F.coalesce("group", "uid").alias("group"), F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("size", F.lit(1)).alias("n_copies")), "classes")
    names = ids.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    return ids.join(names, "group").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id, of these the first one read."""
    inner = apart(docs, text_col)
    rows = inner.select("row", inner["row"][id_col].cast("long").alias("doc_id"), "text")
    signed, classes = _classes(rows, n, threshold, tolerance)
    best = (signed.select("uid", "doc_id").join(classes.select("uid", "group"), "uid").groupBy("group")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("best"))
            .select(F.col("best.uid").alias("uid")))
    stay = signed.where("digest is null").select("uid").unionAll(best)
    kept = signed.select("uid", "row", "text").join(stay, "uid")
    return together(kept, docs.columns, text_col)
