"""Token counts of documents of any length, by overlap resynchronisation.

The library encodes a text of up to ``chunk_chars`` characters as a whole, and a longer one in chunks that overlap, with
the offsets of all tokens. Two neighbouring chunks are compared token by token inside their overlap: from the first offset
at which both have a token that starts behind ASCII white space, up to the last one, ids and offsets must be the same.
Then they are spliced at the last one. Such an offset is proven stable, not guessed: no token of these tokenizers spans
ASCII white space, and neither normaliser nor splitting pattern looks across it, so the tokens to its left are those that
the left chunk shows, and the tokens to its right those of the right chunk, wherever chunks are cut.

If the overlap holds no such offset (a long run without white space), or the tokens differ, the left chunk is encoded anew
with an overlap twice as wide, until they align or the text ends.

Only ASCII white space is used for the proof. Other white space is left to the library.

A normaliser that composes characters, makes white space blanks and lower-cases takes a quarter of the library's time. For
texts in Latin letters that are composed already, lower-casing in Python gives the same, character by character, and the
splitting pattern drops white space of any kind; so these texts go to a copy of the tokenizer without normaliser.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelpick.llm.common import file_text, holder, slices, texts

BLANK = frozenset(" \t\n\v\f\r")
# Text that is given to the library at once; encodings take many times as much memory.
BATCH_BYTES = 1 << 19
SLICE_BYTES = 4 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


# The normaliser that the short way stands for, and the splitting that it needs.
NORMALISER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters outside of Latin letters, or whose lower case is not one character.
ODD = re.compile("[^\x00-\u012f\u0131-\u024f]")


class Tokenizers:
    """The tokenizer of a file, and one without normaliser for texts that need none, where that gives the same."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        told = json.loads(file)
        split = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        same = (told.get("normalizer") == NORMALISER and split.get("pattern") == {"Regex": PATTERN}
                and split.get("behavior") == "Removed" and split.get("invert") is True)
        self.marks = [t["content"] for t in told.get("added_tokens", [])]
        self.light = Tokenizer.from_str(json.dumps(told | {"normalizer": None})) if same else None
        if same:
            self.light.no_truncation()
            self.light.no_padding()

    def of(self, text: str):
        """(tokenizer, text for it): a text whose lower case could hold a special string goes the long way."""
        if self.light is None or ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self.whole, text
        low = text.lower()
        return (self.whole, text) if any(m.lower() in low for m in self.marks) else (self.light, low)


@dataclass
class Chunk:
    """Tokens of text[start:end], with the offsets of their starts in the whole text."""
    start: int
    end: int
    ids: list[int]
    at: list[int]


Encode = Callable[[list[tuple[int, int]]], list[Chunk]]


def splice_point(text: str, left: Chunk, right: Chunk) -> int | None:
    """The last stable offset that both chunks show as the start of a token, if all tokens before it agree too.

    Tokens are compared from the first stable offset in the overlap on; before it, the right chunk may have begun inside a
    word. None if there is no such offset or if the tokens in between differ.
    """
    def stable(chunk: Chunk) -> list[int]:
        first, last = bisect_left(chunk.at, right.start + 1), bisect_left(chunk.at, left.end)
        return [p for p in chunk.at[first:last] if text[p - 1] in BLANK and text[p] not in BLANK]

    both = sorted(set(stable(left)) & set(stable(right)))
    if not both:
        return None
    a, b = (slice(bisect_left(c.at, both[0]), bisect_left(c.at, both[-1])) for c in (left, right))
    same = left.ids[a] == right.ids[b] and left.at[a] == right.at[b]
    return both[-1] if same else None


def spliced(text: str, encode: Encode, chunk_chars: int, overlap: int) -> Iterator[list[int]]:
    """Ids of a text, chunk by chunk: together exactly those of the whole text."""
    step = chunk_chars - overlap
    spans = [(s, min(s + chunk_chars, len(text))) for s in range(0, max(len(text) - overlap, 1), step)]
    ready = dict(zip([s for s, _ in spans], encode(spans)))
    left, done, width = ready.pop(0), 0, overlap
    right = None
    while left.end < len(text):
        if right is None or left.end >= right.end:  # the left chunk has outgrown its neighbour
            start = left.end - overlap
            right = ready.pop(start, None) or encode([(start, min(start + chunk_chars, len(text)))])[0]
        point = splice_point(text, left, right)
        if point is None or point <= done:
            left = encode([(left.start, min(left.end + width, len(text)))])[0]
            width *= 2
            continue
        yield left.ids[bisect_left(left.at, done):bisect_left(left.at, point)]
        left, right, done, width = right, None, point, overlap
    yield left.ids[bisect_left(left.at, done):]


def chunk_encoder(tokenizer, text: str) -> Encode:
    def encode(spans: list[tuple[int, int]]) -> list[Chunk]:
        out = []
        for first in range(0, len(spans), 16):
            some = spans[first:first + 16]
            found = tokenizer.encode_batch([text[s:e] for s, e in some], add_special_tokens=False)
            out += [Chunk(s, e, f.ids, [s + a for a, _ in f.offsets]) for (s, e), f in zip(some, found)]
        return out
    return encode


def token_sizes(tokenizers: Tokenizers, rows: list[str], chunk_chars: int, overlap: int) -> list[int]:
    """How many tokens each text has."""
    sizes, held = [0] * len(rows), {}
    for i, text in enumerate(rows):
        tokenizer, given = tokenizers.of(text)
        if len(text) > chunk_chars:
            sizes[i] = sum(map(len, spliced(given, chunk_encoder(tokenizer, given), chunk_chars, overlap)))
        else:
            held.setdefault(id(tokenizer), (tokenizer, [], []))[1].append(i)
            held[id(tokenizer)][2].append(given)
    for tokenizer, numbers, given in held.values():
        edges = np.concatenate([[0], np.cumsum([len(g) for g in given])]) // BATCH_BYTES
        cuts = np.flatnonzero(np.diff(edges[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(given)]):
            for i, found in zip(numbers[a:b], tokenizer.encode_batch_fast(given[a:b], add_special_tokens=False)):
                sizes[i] = len(found)
    return sizes


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", chunk_chars: int = 32_768, overlap: int = 256) -> DataFrame:
    """Bytes and tokens of every text: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    The tokenizer's default handling of special strings inside texts applies; none is added, nothing is cut or padded.
    Null and empty texts have no bytes and no tokens. Very long texts are encoded chunk by chunk. Rows are independent:
    repeated ids and null ids give one row each. Other columns are ignored.
    """
    if not 0 < overlap < chunk_chars:
        raise ValueError("overlap must be above 0 and below chunk_chars")
    file = file_text(docs.sparkSession, tokenizer_path)

    def count(batches):
        state = holder("token_counts")
        if state.get("of") != hash(file.value):
            state.clear()
            state.update(of=hash(file.value), tokenizers=Tokenizers(file.value))
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = texts(batch.column("text"))
            tokens = token_sizes(state["tokenizers"], rows, chunk_chars, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in rows], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
            .mapInArrow(count, SCHEMA))
