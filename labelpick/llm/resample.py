"""Importance resampling towards a target distribution of hashed word n-grams.

A 256-byte table lower-cases and blanks separators in UTF-8, so that ``bytes.split`` yields the words. An n-gram's hash is
the crc32 of its words joined by blanks; it grows word by word, each crc seeding the next. Counters hold what a text, a
slice or a task has counted. A feature's bucket has a gain, the log ratio of its smoothed frequencies in the target and
in the source; a document's weight is the mean gain of its features. Gumbel noise drawn from the document id turns the
highest scores into a sample without replacement with probabilities proportional to exp(weight).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.llm.common import apart, materialize, slices, text_bytes, words_of
from labelpick.operators.partials import collect_sums
from labelpick.operators.ranks import positions

BUCKETS = 10_000
SLICE_BYTES = 4 << 20
SCALE = 1000


def features(words: list[bytes], max_n: int) -> Counter:
    """How often each crc32 of a run of 1 to ``max_n`` consecutive words occurs."""
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        counts[zlib.crc32(word)] += n
    if max_n > 1:
        crcs, tails = [zlib.crc32(w) for w in words], [b" " + w for w in words]
        for n in range(1, min(max_n, len(words))):
            crcs = [zlib.crc32(tail, crc) for crc, tail in zip(crcs, tails[n:])]
            counts.update(crcs)
    return counts


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket over all rows; ``buckets`` numbers reach the driver. Null texts have none."""

    def fold(acc, batch):
        seen: Counter = Counter()
        for part in slices([batch], "text", SLICE_BYTES):
            for raw in text_bytes(part.column("text")):
                seen.update(features(words_of(raw), max_n))
        if seen:
            at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
            acc["n"] += np.bincount(at, np.fromiter(seen.values(), float, len(seen)), buckets)

    rows = texts.select(texts[text_col].cast("string").alias("text"))
    return [int(n) for n in collect_sums(rows, {"n": (buckets,)}, fold)["n"]]


def gains(source: list[int], target: list[int]) -> list[int]:
    """Per bucket: the floored, scaled log ratio of the smoothed frequencies in target and source."""
    size = float(len(source))
    all_source, all_target = float(sum(source)), float(sum(target))
    return [math.floor(SCALE * math.log((t + 1.0) * (all_source + size) / ((s + 1.0) * (all_target + size))))
            for s, t in zip(source, target)]


def noise(seed: int, key: str) -> int:
    """Floored, scaled Gumbel noise of a row, from the first 32 bits of a digest of its key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: list[int], max_n: int = 1, seed: int = 2024, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(row, text, n_words, n_features, weight, score): each document with the mean gain of its features, plus noise.

    Other columns are kept in the struct ``row``. The noise is a function of the id; a null id counts as the empty text.
    """
    buckets = len(gain)
    inner = apart(docs, text_col).withColumn("key", F.coalesce(F.col("row")[id_col].cast("string"), F.lit("")))
    names = ["n_words", "n_features", "weight", "score"]

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for key, raw in zip(batch.column("key").to_pylist(), text_bytes(batch.column("text"))):
                words = words_of(raw)
                counts = features(words, max_n)
                n = sum(counts.values())
                weight = sum(gain[crc % buckets] * times for crc, times in counts.items()) // n if n else 0
                out.append((len(words), n, weight, weight + noise(seed, key)))
            values = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *values], ["row", "text", *names])

    wanted = inner.drop("key").select("*", *[F.lit(0).cast("long").alias(c) for c in names]).schema
    return inner.mapInArrow(run, wanted)


def fit_gains(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, text_col: str = "text",
              target_col: str = "text") -> list[int]:
    """Gains of all buckets, counted over all rows of both tables."""
    return gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets))


def _ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` (doc_id, n_words, ..., score) with ``rank``: null for rows that are not drawn.

    Only rows with enough words are put in order, and they are ranked by ranges, so no task sees all of them.
    """
    able = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    drawn = percent * scored.where(able).count() // 100
    order = F.desc("score"), F.col("doc_id").asc_nulls_last()
    placed = positions(scored.where(able), *order, name="rank").withColumn(
        "rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return placed.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample_report(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, min_words: int = 20,
                    percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (1, 2, ... of the drawn ones, else null).

    Drawn are the floor(percent * N / 100) highest scores of the N documents with ``min_words`` words; ties go to the
    smaller doc_id, null ids last. Null and empty texts have no features, weight 0, and are not drawn unless ``min_words``
    is 0. An empty target table still gives gains, by smoothing. Repeated rows are documents of their own. Texts are
    never cut; other columns are ignored.
    """
    gain = fit_gains(docs, target, max_n, buckets, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = weigh(rows, gain, max_n, seed).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_features", "weight", "score")
    return _ranked(materialize(scored, "scored"), percent, min_words).select(
        "doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, min_words: int = 20,
             percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn documents, with the columns of ``docs``; see ``resample_report`` for which they are.

    Scores are ranked without the texts. The drawn rows are then those above the last drawn (score, id), and of several
    rows at exactly that place all are taken, so equal rows stay together.
    """
    columns = docs.columns
    gain = fit_gains(docs, target, max_n, buckets, text_col)
    scored = weigh(docs, gain, max_n, seed, id_col, text_col).withColumn("doc_id", F.col("row")[id_col].cast("long"))
    small = materialize(scored.select("doc_id", "n_words", "n_features", "weight", "score"), "scored")
    last = _ranked(small, percent, min_words).where("rank is not null").agg(
        F.max_by(F.struct("score", "doc_id"), "rank").alias("at")).first()["at"]
    if last is None:
        return docs.limit(0)
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    edge = last["doc_id"] if last["doc_id"] is not None else (1 << 63) - 1
    drawn = (F.col("n_words") >= min_words) & (
        (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (key <= F.lit(edge))))
    return scored.where(drawn).select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c)
                                        for c in columns])
