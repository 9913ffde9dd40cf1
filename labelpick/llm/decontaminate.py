"""Find and remove benchmark passages in training documents with a generalised suffix automaton.

The automaton holds every substring, in words, of every test item. Document words stream through it; at each word it
knows the longest substring of any item that ends there. Where that length reaches a window (``window`` words, or a
whole shorter item), the window's words are hit and its items are known.

The automaton of a shard of the items has at most two states per item word, so a shard's size is bounded by
``SHARD_WORDS``; more items make more shards, scanned one after the other with the hits carried along. Long items are
cut into pieces that overlap by ``window - 1`` words, which keeps every window whole.

Words that no item holds, and neighbours that no item has side by side, end a match. Both are found for a whole slice of
documents at once, so the automaton only visits stretches that could hold a window.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.llm.common import apart, holder, materialize, released, slices, text_bytes, together, words_of

WINDOW = 10
SHARD_WORDS = 100_000
PIECE_WORDS = 20_000
SLICE_BYTES = 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


class Automaton:
    """Generalised suffix automaton over the words of (item, words) pieces."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
                 for item, words in pieces]
        for _, ids in coded:
            state = 0
            for w in ids:
                state = self._extend(state, w)
        self.least = min((min(window, len(ids)) for _, ids in coded if ids), default=0)
        size = len(self.vocabulary) + 1
        self.pairs = np.unique(np.array([a * size + b for _, ids in coded for a, b in zip(ids, ids[1:])], np.int64))
        self._mark(coded)

    @classmethod
    def of(cls, parts: dict) -> Automaton:
        """The automaton with the attributes of another one."""
        automaton = cls.__new__(cls)
        automaton.__dict__.update(parts)
        return automaton

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.next, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        step, link, length = self.next, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def _mark(self, coded) -> None:
        """Items of each full window by its state, and of each shorter item by its state and length."""
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for item, ids in coded:
            state, k = 0, min(self.window, len(ids))
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= k:
                    at = state
                    while self.length[self.link[at]] >= k:
                        at = self.link[at]
                    if k == self.window:
                        self.full.setdefault(at, set()).add(item)
                    else:
                        self.short.setdefault(at, {}).setdefault(k, set()).add(item)
        # for every state: where its full window is, and the shorter items along its suffixes
        self.at_full, self.at_short = [0] * len(self.next), [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.at_full[state] = state if self.length[up] < self.window else self.at_full[up]
            own = tuple((k, state) for k in self.short.get(state, {}))
            self.at_short[state] = self.at_short[up] + own if own else self.at_short[up]

    def stretches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of item words whose neighbours are side by side in some item."""
        if len(ids) == 0 or self.least == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = np.zeros(len(ids) + 1, bool)  # joined[i]: word i goes on from word i - 1
        both = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0))
        if len(self.pairs):
            code = ids[both].astype(np.int64) * (len(self.vocabulary) + 1) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[both[self.pairs[at] == code] + 1] = True
        known = np.append(ids > 0, False)
        starts = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known[:-1] & ~joined[1:]) + 1
        keep = ends - starts >= self.least
        return starts[keep], ends[keep]

    def scan(self, ids: list[int], shift: int, hits: list[tuple[int, int]], items: set[str]) -> None:
        """Stream one stretch; append hit word spans (shifted) and collect items."""
        step, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, w in enumerate(ids):
            while state and w not in step[state]:
                state = link[state]
                matched = length[state]
            if w in step[state]:
                state = step[state][w]
                matched += 1
            if matched >= window:
                hits.append((shift + i + 1 - window, shift + i + 1))
                items |= self.full[self.at_full[state]]
            for k, at in self.at_short[state]:
                if k <= matched:
                    hits.append((shift + i + 1 - k, shift + i + 1))
                    items |= self.short[at][k]


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def item_pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, part, n, words): items cut into pieces of at most PIECE_WORDS words."""

    def cut(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for item, raw in zip(batch.column("item").to_pylist(), text_bytes(batch.column("text"))):
                words = words_of(raw)
                for part, start in enumerate(range(0, max(len(words) - window + 1, 1), PIECE_WORDS)):
                    piece = words[start:start + PIECE_WORDS + window - 1]
                    if piece:
                        out.append((item or "", part, len(piece), b" ".join(piece)))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["item", "part", "n", "words"])

    return (items.select(items[id_col].cast("string").alias("item"), items[text_col].cast("string").alias("text"))
            .mapInArrow(cut, "item string, part long, n long, words binary"))


def automata(items: DataFrame, id_col: str, text_col: str, window: int):
    """Automata of the shards, one at a time; each is built from at most about SHARD_WORDS words."""
    pieces = materialize(item_pieces(items, id_col, text_col, window), "item_pieces").distinct()
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // SHARD_WORDS) or 1
    for shard in range(shards):
        part = pieces.where(F.pmod(F.xxhash64("item", "part"), F.lit(shards)) == shard).select("item", "words")
        yield shard == shards - 1, Automaton([(r.item, bytes(r.words).split()) for r in part.toLocalIterator()], window)


def _find(docs: DataFrame, items: DataFrame, window: int, item_id: str, item_text: str, finish, schema: str) -> DataFrame:
    """Scan (doc_id, text, ...) against all shards, then give each slice with its spans and items to ``finish``."""
    spark = docs.sparkSession
    frame = docs.withColumns({"hits": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")})
    columns = frame.columns
    for last, automaton in automata(items, item_id, item_text, window):
        shipped = spark.sparkContext.broadcast(vars(automaton))  # plain values: executors need not know the class

        def scan(batches, shipped=shipped, last=last):
            holder("decontaminate")
            automaton = Automaton.of(shipped.value)
            code = automaton.vocabulary.get
            for batch in slices(batches, "text", SLICE_BYTES):
                rows = [words_of(raw) for raw in text_bytes(batch.column("text"))]
                ends = np.cumsum([len(words) + 1 for words in rows])
                ids = np.zeros(int(ends[-1]) if rows else 0, np.int32)  # a zero after each document
                for words, end in zip(rows, ends):
                    ids[end - 1 - len(words):end - 1] = np.fromiter(map(code, words, repeat(0)), np.int32, len(words))
                spans = [[(s, e) for s, e in zip(h[::2], h[1::2])] if h else [] for h in batch.column("hits").to_pylist()]
                found = [set(x or ()) for x in batch.column("items").to_pylist()]
                starts, stops = automaton.stretches(ids)
                row = np.searchsorted(ends, starts, side="right")
                for start, stop, r in zip(starts.tolist(), stops.tolist(), row.tolist()):
                    first = int(ends[r]) - 1 - len(rows[r])
                    automaton.scan(ids[start:stop].tolist(), start - first, spans[r], found[r])
                spans = [join_spans(s) for s in spans]
                if last:
                    yield finish(batch, [len(words) for words in rows], spans, found)
                else:
                    out = {c: batch.column(c) for c in columns}
                    out["hits"] = pa.array([[x for s in h for x in s] for h in spans], pa.list_(pa.int32()))
                    out["items"] = pa.array([sorted(f) for f in found], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([out[c] for c in columns], columns)

        if last:
            return frame.mapInArrow(released(scan), schema)
        frame = materialize(frame.mapInArrow(released(scan), frame.schema), "scanned")
        shipped.destroy()
    raise AssertionError("there is always a last shard")


def scan_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (item ids sorted as strings), contaminated.

    Null and empty texts have no words; an empty item table hits nothing; items without words have no window. Rows are
    independent: repeated and null doc ids give one row each. Repeated items and several rows of one item id count as one
    item. A null item id is listed as the empty string. Other columns are ignored.
    """

    def finish(batch, n_words, spans, found):
        hit = [sum(end - start for start, end in s) for s in spans]
        digest = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()),
             pa.array([len(f) for f in found], pa.int64()), pa.array(digest, pa.string()),
             pa.array([h > 0 for h in hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return _find(rows, items, window, item_id, item_text, finish,
                 "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each word span."""
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, start = [], 0
    for first, end in spans:
        out.append(text[start:at[first][0]])
        start = at[end - 1][1]
    return "".join(out) + text[start:]


def remove_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_span: int = 1,
                     max_coverage: float = 0.5, text_col: str = "text", item_id: str = "item_id",
                     item_text: str = "text") -> DataFrame:
    """Documents without benchmark passages, with the columns of ``docs``.

    Hit spans of at least ``min_span`` words are cut from the text. A document of which more than ``max_coverage`` of the
    words are hit is dropped as a whole. Others are returned as they are, also those with null or empty texts.
    """
    inner = apart(docs, text_col)

    def finish(batch, n_words, spans, found):
        keep, out = [], []
        for i, (text, n, s) in enumerate(zip(batch.column("text").to_pylist(), n_words, spans)):
            if n and sum(end - start for start, end in s) > max_coverage * n:
                continue
            s = [x for x in s if x[1] - x[0] >= min_span]
            keep.append(i)
            out.append(cut_spans(text, s) if s else text)
        rows = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("row").take(rows), pa.array(out, pa.string())], ["row", "text"])

    schema = inner.schema
    done = _find(inner, items, window, item_id, item_text, finish, schema)
    return together(done, docs.columns, text_col)
