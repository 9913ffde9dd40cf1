"""Toxicity scores from averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (of UTF-8 bytes, with word boundary marks) and itself, hashed to buckets that
hold an embedding each. A document is the weighted mean of the embeddings of its distinct words' subwords; frequent
subwords weigh less (weight = s / (s + share of training documents)). A linear softmax over that mean gives the
probability. Embeddings and softmax are trained together by Adagrad on mini-batches. A misspelling that was never seen
shares most of its n-grams, and so its vectors, with the word it comes from.

Training reads a bounded sample of labelled rows (``sample_rows``, chosen by a hash of the id); the bound is a parameter
of the model. Scoring reads every whole text. As softmax and mean are linear, each subword is worth one number when
scoring, so the shipped model is one float per bucket (fixed size).
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.llm.common import apart, crc_bucket, holder, released, slices, text_bytes, tidy, together, words_of

BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 4, 5)
SLICE_BYTES = 4 << 20
CACHE_WORDS = 300_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                np.uint64)


def subwords(words: list[bytes], at_once: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all subwords of all words, and where each word's begin (one more than words)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(1 + sum(np.maximum(size - n + 1, 0) for n in NGRAMS))])
    codes = np.empty(starts[-1], np.int32)  # filled part by part, so that no second copy is held
    for i in range(0, len(words), at_once):
        some = words[i:i + at_once]
        codes[starts[i]:starts[i + len(some)]] = _subwords(some)[0]
    return codes, starts


def _subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    left = end[word] - np.arange(len(buffer))  # bytes from here to the end of the word
    mixed = [(buffer + np.uint64(1)) * m for m in _MIX]
    codes, owners = [], []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = (h ^ mixed[k][at + k]) * np.uint64(0x2545F4914F6CDD1D)
                h ^= h >> np.uint64(31)
            codes.append(h % np.uint64(BUCKETS))
            owners.append(word[at])
        place = np.arange(len(buffer)).astype(np.uint64) - np.repeat(end - size, size).astype(np.uint64)
        whole = np.add.reduceat((mixed[0] ^ (place * _MIX[1])) * _MIX[2], end - size)
        whole ^= whole >> np.uint64(29)
        codes.append(whole * _MIX[3] % np.uint64(BUCKETS))
        owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words) + 1))
    return np.concatenate(codes)[order].astype(np.int32), starts


def spread(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of the given CSR rows, and the row number (in ``rows``) of each."""
    size = starts[rows + 1] - starts[rows]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - ends + size, size), np.repeat(
        np.arange(len(rows)), size)


@dataclass
class Model:
    worth: np.ndarray   # weighted log-odds of each bucket
    weight: np.ndarray  # weight of each bucket in the mean
    bias: float

    def log_odds(self, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.where(weight > 0, total / np.maximum(weight, 1e-12), 0.0) + self.bias

    def word_values(self, words: list[bytes]) -> list[tuple[float, float]]:
        codes, starts = subwords(words)
        if not words:
            return []
        return list(zip(np.add.reduceat(self.worth[codes], starts[:-1]).tolist(),
                        np.add.reduceat(self.weight[codes], starts[:-1]).tolist()))


def _runs(n: int, size: int):
    return ((i, min(i + size, n)) for i in range(0, n, size))


def train(doc_words: np.ndarray, doc_starts: np.ndarray, codes: np.ndarray, word_starts: np.ndarray, labels: np.ndarray,
          epochs: int = 5, batch: int = 32, rate: float = 0.5, rare: float = 0.1, seed: int = 0) -> Model:
    """Fit embeddings and softmax together.

    ``doc_words`` holds the numbers of the distinct words of each document, ``codes`` the subwords of each word, both laid
    end to end. What is made of them for all words or documents is made some at a time.
    """
    n_rows, n_words = len(doc_starts) - 1, len(word_starts) - 1
    if n_rows == 0:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0)
    # share of documents of each bucket, from word document counts (an upper bound where words of a document share it)
    seen = np.bincount(doc_words, minlength=n_words)
    share, word_weight, total = np.zeros(BUCKETS), np.empty(n_words), np.empty(n_rows)
    for i, j in _runs(n_words, 20_000):
        some = codes[word_starts[i]:word_starts[j]]
        share += np.bincount(some, np.repeat(seen[i:j], np.diff(word_starts[i:j + 1])), BUCKETS)
    share /= n_rows
    weight = rare / (rare + share)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft = rng.normal(0, 0.5, (DIM, 2))
    prior = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-3, None)
    bias = np.log(prior)
    past, past_soft, past_bias = np.full(BUCKETS, 1e-8), np.full(soft.shape, 1e-8), np.full(2, 1e-8)
    for i, j in _runs(n_words, 20_000):
        word_weight[i:j] = np.add.reduceat(weight[codes[word_starts[i]:word_starts[j]]], word_starts[i:j] - word_starts[i])
    for i, j in _runs(n_rows, 500):
        owner = np.repeat(np.arange(j - i), np.diff(doc_starts[i:j + 1]))
        total[i:j] = np.bincount(owner, word_weight[doc_words[doc_starts[i]:doc_starts[j]]], j - i)
    total = np.maximum(total, 1e-12)
    for epoch in range(epochs):
        order = rng.permutation(n_rows)
        for first in range(0, len(order), batch):
            some = order[first:first + batch]
            at, owner = spread(doc_starts, some)
            words, place = np.unique(doc_words[at], return_inverse=True)
            sub, of = spread(word_starts, words)
            used, where = np.unique(codes[sub], return_inverse=True)
            vectors = (table[used] * weight[used, None])[where]
            word_sum = np.stack([np.bincount(of, vectors[:, j], len(words)) for j in range(DIM)], 1)
            mean = np.stack([np.bincount(owner, word_sum[place, j], len(some)) for j in range(DIM)], 1) / total[some, None]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p /= len(some)
            step = rate * (1 - epoch / epochs)
            back = p @ soft.T / total[some, None]
            grad_soft, grad_bias = mean.T @ p, p.sum(0)
            word_grad = np.stack([np.bincount(place, back[owner, j], len(words)) for j in range(DIM)], 1)
            grad = np.stack([np.bincount(where, word_grad[of, j], len(used)) for j in range(DIM)], 1) * weight[used, None]
            past[used] += (grad ** 2).mean(1)
            table[used] -= step * grad / np.sqrt(past[used])[:, None]
            past_soft += grad_soft ** 2
            soft -= step * grad_soft / np.sqrt(past_soft)
            past_bias += grad_bias ** 2
            bias -= step * 0.1 * grad_bias / np.sqrt(past_bias)
    odds = soft[:, 1] - soft[:, 0]
    return Model((table @ odds * weight).astype(np.float32), weight.astype(np.float32), float(bias[1] - bias[0]))


def score_words(model: Model, known: dict, rows: list[set[bytes]]) -> np.ndarray:
    """Probabilities of documents given by their distinct words."""
    seen = set().union(*rows) if rows else set()
    new = [w for w in seen if w not in known]
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = list(seen)
    known.update(zip(new, model.word_values(new)))
    pairs = [[known[w] for w in sorted(r)] for r in rows]
    total = np.array([sum(x for x, _ in p) for p in pairs])
    weight = np.array([sum(y for _, y in p) for p in pairs])
    return 1 / (1 + np.exp(-model.log_odds(total, weight)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, held_of: int = 4, held: int = 2,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model:
    """Train on at most ``sample_rows`` labelled ids with crc32(id) mod ``held_of`` != ``held``.

    The ids are the first by a hash of the id, so the sample does not depend on how tables are laid out. Null ids, labels
    and texts give no training rows; of several labels of one id the largest counts, of several texts the smallest. The
    sample is bounded, so one task can hold it.
    """
    known = (labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)").where(crc_bucket("doc_id", held_of) != held)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
            .where("text is not null").join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")))

    def learn(batches):
        holder("toxicity")
        seen, of, labels, sizes, found = {}, [], [], [], []
        for batch in slices(batches, "text", SLICE_BYTES):
            for raw in text_bytes(batch.column("text")):
                words = set(words_of(raw))
                found.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
            of += batch.column("doc_id").to_pylist()
            labels += batch.column("label").to_pylist()
        # words and documents in an order that doesn't depend on how rows arrive
        names = sorted(seen)
        number = np.empty(len(names), np.int32)
        number[np.fromiter(map(seen.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        del seen
        codes, word_starts = subwords(names)
        del names
        order = np.argsort(np.array(of, np.int64), kind="stable").tolist()
        sizes = np.array([len(found[i]) for i in order], np.int64)
        doc_starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        doc_words = np.empty(doc_starts[-1], np.int32)
        for at, i in zip(doc_starts.tolist(), order):
            doc_words[at:at + len(found[i])] = np.sort(number[found[i]])
            found[i] = None
        del found, number
        tidy()  # what the texts took
        model = train(doc_words, doc_starts, codes, word_starts, np.array(labels, np.int64)[order], **options)
        sink = io.BytesIO()
        np.savez(sink, worth=model.worth, weight=model.weight, bias=model.bias)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary())], ["model"])

    stored = rows.coalesce(1).mapInArrow(released(learn), "model binary").collect()
    if not stored:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0)
    with np.load(io.BytesIO(bytes(stored[0].model))) as data:
        return Model(data["worth"], data["weight"], float(data["bias"]))


def with_scores(docs: DataFrame, model: Model, text_col: str, score_col: str) -> DataFrame:
    """``docs`` with a probability per row; null and empty texts get that of a text without words."""
    # plain values: executors need not know the class
    shipped = docs.sparkSession.sparkContext.broadcast((model.worth, model.weight, model.bias))
    columns = docs.columns
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema

    def score(batches):
        state = holder("toxicity")
        if state.get("of") is not shipped.value:
            state.clear()
            state.update(of=shipped.value, known={})
        model = Model(*shipped.value)
        for batch in slices(batches, text_col, SLICE_BYTES):
            p = score_words(model, state["known"], [set(words_of(raw)) for raw in text_bytes(batch.column(text_col))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*columns, score_col])

    return docs.mapInArrow(released(score), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
                   text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Scores depend on the text alone. Rows are independent: repeated and null ids give one row each (a null id counts as
    the empty text for held_out). Without usable labels all scores are one half. Other columns are ignored.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       (crc_bucket(docs[id_col].cast("long"), 4) == 2).alias("held_out"),
                       docs[text_col].cast("string").alias("text"))
    done = with_scores(rows, model, "text", "score").select("doc_id", "held_out", "score")
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
               text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that reach ``threshold``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    kept = with_scores(apart(docs, text_col), model, "text", "score").where(F.col("score") < threshold)
    return together(kept, docs.columns, text_col)
