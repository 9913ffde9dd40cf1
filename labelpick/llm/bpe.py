"""Byte-level BPE over a distinct-word table: each distinct word is encoded once, ids come back by position.

1. Texts are split into words at places where the tokenizer's own splitting always has a boundary. A document becomes
   word numbers that count within its block (see ``blocks``), most frequent word first.
2. The words of all blocks meet in shards by a hash of the word. A shard encodes each of its distinct words once with the
   tokenizers library and answers every block with the ids of its words, in the order in which they were sent.
3. Answers and word numbers meet by block; ids are put together by position.

The stored table of word numbers is bucketed by block, so only words and answers are shuffled, never the documents.
Decoding joins ids with the id-to-piece table, whose size is that of the vocabulary, and joins the bytes.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from labelpick.llm.blocks import (expand, gather, numbered, pack, received_words, send_words, squeeze, store_by_block,
                                  unpack, word_shards)
from labelpick.llm.common import apart, file_text, holder, named, released, released_group, slices, texts

BLOCK_BYTES = 4 << 20
CHUNK_UNITS = 100_000

# What the split may rely on. A space-like character that follows another character always starts a new
# word; so does a character that is no letter behind a letter. The second rule is used only for texts all of whose
# characters are ASCII or letters of the Latin blocks, and that hold no special token.
BLANK = " \t-\r"
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
FINE = re.compile(f"[{BLANK}]*(?:[^{BLANK}{LETTER}]+[{LETTER}]*|[{LETTER}]+)|[{BLANK}]+")
OUTSIDE = re.compile(f"[^\x00-\x7f{LETTER}]")
COARSE = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
# Characters that some definition of white space holds besides the ASCII ones.
ODD_BLANK = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff"
HAS_ODD_BLANK = re.compile(f"[{ODD_BLANK}]")
CAREFUL = re.compile(f"(?<=[^{BLANK}{ODD_BLANK}])(?=[{BLANK}])")


def special_tokens(vocabulary: dict) -> list[str]:
    return [token["content"] for token in vocabulary["added_tokens"]]


def split_words(text: str, special: list[str]) -> list[str]:
    """Words that together are the text; encoding them one by one equals encoding the text."""
    if not OUTSIDE.search(text) and not any(s in text for s in special):
        return FINE.findall(text)
    if not HAS_ODD_BLANK.search(text):
        return COARSE.findall(text)
    return [w for w in CAREFUL.split(text) if w]


def _word_blocks(docs: DataFrame, text_col: str, special: list[str], shards: int) -> DataFrame:
    """Store (block, pack, units, shard_of, messages), bucketed by block. The text itself is not kept."""

    def run(batches):
        holder("bpe")
        for block, batch in numbered(batches, text_col, BLOCK_BYTES):
            local: dict[str, int] = {}
            found, sizes = [], []
            for text in texts(batch.column(text_col)):
                words = split_words(text, special)
                found.append(np.fromiter((local.setdefault(w, len(local)) for w in words), np.int32, len(words)))
                sizes.append(len(words))
            numbers = np.concatenate(found) if found else np.zeros(0, np.int32)
            order = np.argsort(-np.bincount(numbers, minlength=len(local)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            words = [w.encode() for w in local]
            words = [words[i] for i in order.tolist()]
            shard, messages = send_words(words, shards)
            rows = batch.drop_columns([text_col]).append_column("n_units", pa.array(sizes, pa.int64()))
            kinds = pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([pack(rows)], pa.binary()),
                 pa.array([squeeze(rank[numbers])], pa.binary()), pa.array([squeeze(shard)], pa.binary()),
                 pa.array([messages], kinds)], ["block", "pack", "units", "shard_of", "messages"])

    blocks = docs.mapInArrow(released(run), "block long, pack binary, units binary, shard_of binary, "
                                  "messages array<struct<shard int, words binary>>")
    return store_by_block(blocks, "word_blocks")


def _answers(messages: DataFrame, file) -> DataFrame:
    """(block, shard, sizes, ids) for (block, shard, words): each distinct word of a shard is encoded once."""

    def answer(key, table):
        from tokenizers import Tokenizer

        state = holder("bpe")
        if state.get("of") != hash(file.value):
            state.update(of=hash(file.value), tokenizer=Tokenizer.from_str(file.value))
        tokenizer = state["tokenizer"]
        sent = [received_words(x) for x in table["words"].to_pylist()]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for words in sent for w in words))}
        names, sizes, parts = list(distinct), [], []
        for start in range(0, len(names), 10_000):
            some = [w.decode() for w in names[start:start + 10_000]]
            found = [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes += map(len, found)
            parts.append(np.array([i for ids in found for i in ids], np.uint32))
        size = np.array(sizes, np.int64)
        starts, flat = np.concatenate([[0], np.cumsum(size)]), np.concatenate(parts or [np.zeros(0, np.uint32)])
        out_sizes, out_ids = [], []
        for words in sent:
            at = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
            out_sizes.append(squeeze(size[at]))
            out_ids.append(squeeze(flat[gather(starts, at)]))
        return pa.table({"block": table["block"], "shard": table["shard"], "sizes": pa.array(out_sizes, pa.binary()),
                         "ids": pa.array(out_ids, pa.binary())})

    return messages.groupBy("shard").applyInArrow(lambda key, table: released_group(answer, key, table),
                                                  "block long, shard int, sizes binary, ids binary")


def _block_ids(block: pa.Table, answers: pa.Table) -> list[bytes]:
    """Ids of each document of a block as little-endian unsigned 32-bit numbers."""
    shard_of = expand(block["shard_of"][0].as_py())
    size = np.zeros(len(shard_of), np.int64)
    held = {}
    for shard, sizes, ids in zip(answers["shard"].to_pylist(), answers["sizes"].to_pylist(), answers["ids"].to_pylist()):
        mine = np.flatnonzero(shard_of == shard)
        size[mine] = expand(sizes)
        held[shard] = (mine, expand(ids))
    starts = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(starts[-1], "<u4")
    for mine, ids in held.values():
        flat[gather(starts, mine)] = ids
    units = expand(block["units"][0].as_py())
    n_units = unpack(block["pack"][0].as_py())["n_units"].to_pylist()
    out, start, at = [], 0, 0
    while at < len(n_units):  # some documents at a time, so that positions stay small
        stop, total = at, 0
        while stop < len(n_units) and (stop == at or total + n_units[stop] <= CHUNK_UNITS):
            total += n_units[stop]
            stop += 1
        some = units[start:start + total]
        ids, ends = flat[gather(starts, some)].tobytes(), np.concatenate([[0], np.cumsum(size[some])])
        edges = np.concatenate([[0], np.cumsum(n_units[at:stop])])
        cuts = (4 * ends[edges]).tolist()
        out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        start, at = start + total, stop
    return out


def _encoded(docs: DataFrame, file, special: list[str], text_col: str, finish, schema) -> DataFrame:
    """Encode all texts; ``finish(rows, ids)`` makes a block's result from its packed rows and the ids of each."""
    inner = apart(docs, text_col)
    blocks = _word_blocks(inner, "text", special, word_shards(inner, "text"))
    messages = blocks.select("block", F.explode("messages").alias("m")).select("block", "m.shard", "m.words")

    def put_together(key, block, answers):
        holder("bpe_ids")  # the tokenizer has done its work
        if not block.num_rows:
            raise ValueError("an answer to no block")
        return finish(unpack(block["pack"][0].as_py()), _block_ids(block, answers))

    return (blocks.select("block", "pack", "units", "shard_of").groupBy("block")
            .cogroup(_answers(messages, file).groupBy("block"))
            .applyInArrow(lambda key, block, answers: released_group(put_together, key, block, answers), schema))


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its ids: binary, little-endian unsigned 32-bit numbers.

    Special strings inside texts are handled as the library does by default, none is added, nothing is cut or padded.
    Null, empty and very long texts are texts like others; the first two have no ids. Rows are independent of each other,
    ids of documents may repeat or be null. A column of ``docs`` that is called ``ids_col`` is replaced. ``decode`` gives
    the text back.
    """
    file = file_text(docs.sparkSession, tokenizer_path)
    schema = StructType([apart(docs, text_col).schema["row"], StructField("ids", BinaryType())])

    def finish(rows, ids):
        return pa.table({"row": rows["row"], "ids": pa.array(ids, pa.binary())})

    done = _encoded(docs, file, special_tokens(json.loads(file.value)), text_col, finish, schema)
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, ids_col)],
                       F.col("ids").alias(ids_col))


def pieces(vocabulary: dict) -> list[bytes]:
    """Bytes of each id. In the vocabulary, a byte that prints stands for itself, others for characters from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    byte_of = {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(others)}
    special = {t["id"]: t["content"] for t in vocabulary["added_tokens"]}
    ids = {i: token for token, i in vocabulary["model"]["vocab"].items()} | special
    return [special[i].encode() if i in special else bytes(byte_of[c] for c in ids[i]) if i in ids else b""
            for i in range(max(ids) + 1)]


def decoded(ids: bytes, table: list[bytes]) -> bytes:
    """UTF-8 of the pieces of some ids."""
    joined = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return joined.decode("utf-8", "replace").encode()


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with a text column of the decoded ids, special tokens included; null ids give the empty text.

    A column of ``encoded`` that is called ``text_col`` is replaced, others stay as they are.
    """
    file = file_text(encoded.sparkSession, tokenizer_path)
    table = encoded.sparkSession.sparkContext.broadcast(pieces(json.loads(file.value)))  # one entry per id
    columns = encoded.columns
    others = F.struct(*[named(c) for c in columns], F.lit(0).alias("_")).alias("row")
    inner = encoded.select(others, named(ids_col).alias("ids"))

    def run(batches):
        for batch in slices(batches, "ids", 4 << 20):
            out = pa.array([decoded(ids or b"", table.value) for ids in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), out.cast(pa.string())], ["row", "text"])

    done = inner.mapInArrow(released(run), StructType([inner.schema["row"], StructField("text", StringType())]))
    text = F.col("text").alias(text_col)
    return done.select(*[text if c == text_col else F.col("row")[c].alias(c) for c in columns],
                       *([] if text_col in columns else [text]))


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Repeated and null ids give one row each.

    Null and empty texts have no tokens; very long texts are encoded whole. Other columns are ignored. The join of ids with
    their pieces is a lookup in a shipped list with one entry per id of the vocabulary.
    """
    file = file_text(docs.sparkSession, tokenizer_path)
    vocabulary = json.loads(file.value)
    table = docs.sparkSession.sparkContext.broadcast(pieces(vocabulary))

    def finish(rows, ids):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.table({"doc_id": pc.struct_field(rows["row"], "doc_id"),
                         "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                         "ids_sha256": pa.array([sha(i) for i in ids], pa.string()),
                         "decoded_sha256": pa.array([sha(decoded(i, table.value)) for i in ids], pa.string())})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return _encoded(rows, file, special_tokens(vocabulary), "text", finish,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by n_tokens, ids and lossless: whether the decoded ids give the text.

    A null text counts as empty: no ids, lossless. Very long texts are encoded whole. Columns of ``docs`` that are called
    n_tokens, ids or lossless are replaced, others stay as they are.
    """
    file = file_text(docs.sparkSession, tokenizer_path)
    vocabulary = json.loads(file.value)
    table = docs.sparkSession.sparkContext.broadcast(pieces(vocabulary))
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids", "lossless")]
    others = [named(c) for c in kept]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), F.sha2(text.cast("binary"), 256).alias("of"),
                       text.alias("text"))
    inner = apart(rows, "text")
    schema = StructType([inner.schema["row"], StructField("n_tokens", LongType()), StructField("ids", BinaryType()),
                         StructField("lossless", BooleanType())])

    def finish(rows, ids):
        of = pc.struct_field(rows["row"], "of").to_pylist()
        same = [hashlib.sha256(decoded(i, table.value)).hexdigest() == x for i, x in zip(ids, of)]
        return pa.table({"row": rows["row"], "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                         "ids": pa.array(ids, pa.binary()), "lossless": pa.array(same, pa.bool_())})

    done = _encoded(rows, file, special_tokens(vocabulary), "text", finish, schema)
    return done.select(*[F.col("row.row")[c].alias(c) for c in kept], "n_tokens", "ids", "lossless")
