"""Language-model scores of documents, next to those of a smoothed word count model.

Texts are lower-cased (A-Z) and cut into words, followed by one end. Word counts come from all training documents: the
distinct words of a block of documents travel to word shards, are summed there, and the sums travel back to the block.

The model is a causal self-attention network over subword ids (``attention``). Ids are byte-pair merges of a public
vocabulary, cut off at its first merges, so every word has ids and the model gives every text a probability. Pair counts
of ids, on which the network builds, come from all training documents. The network itself is trained in numpy on all
windows of all training documents, in rounds that each read other ones. Texts are cut into segments of SEGMENT windows,
sent with the pieces that their first window looks back at; a hash of document id and place gives a segment its round. The
segments of a round are dealt into groups by the same hash; every group is descended from the same weights, and the
weights are averaged. Neither counts nor training depend on how the table is laid out, beyond rounding.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.llm import attention as A
from labelpick.llm.blocks import (expand, gather, numbered, pack, received_words, send_words, squeeze, store_by_block,
                                  unpack, word_shards)
from labelpick.llm.common import crc_bucket, file_text, holder, materialize, text_bytes
from labelpick.operators.partials import CHUNK, add_chunks

BLOCK_BYTES = 6 << 20
CHUNK_PIECES = 1 << 19
WINDOWS_AT_ONCE = 8192
ROUNDS, RATE = 4, 0.03
GROUP_WINDOWS = 16_384  # windows that are descended one after the other
SEGMENT = 64  # windows that travel together
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, n_pieces long")


class Pieces:
    """Subword ids of words, by the merges of a vocabulary file up to A.END."""

    def __init__(self, file: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, file.splitlines())}
        merges = {piece: rank for piece, rank in ranks.items() if rank < A.END}
        self.encoding = tiktoken.Encoding("first_merges", pat_str=r"[^\n]{1,64}|\n", mergeable_ranks=merges,
                                          special_tokens={})
        self.line = merges[b"\n"]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each behind a blank, one after the other, and where each word's start.

        Words hold no line end, so one can part them while many are encoded at once.
        """
        parts, sizes = [np.zeros(0, np.int16)], [np.zeros(1, np.int64)]
        for start in range(0, len(words), 20_000):
            text = b"".join(b" " + w + b"\n" for w in words[start:start + 20_000]).decode()
            ids = np.array(self.encoding.encode_ordinary(text), np.int16)
            ends = np.flatnonzero(ids == self.line)
            parts.append(ids[ids != self.line])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def _shared_pieces(file) -> Pieces:
    state = holder("lm_pieces")
    if state.get("of") != hash(file.value):
        state.clear()
        state.update(of=hash(file.value), pieces=Pieces(file.value))
    return state["pieces"]


def _sequences(words: np.ndarray, sizes: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of texts, each with its end, laid end to end; and their sizes. Texts are word numbers laid end to end."""
    size = starts[words + 1] - starts[words]
    per_text = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)])]
    lengths = np.diff(per_text) + 1
    out = np.empty(len(sizes) + int(per_text[-1]), np.int32)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = flat[gather(starts, words)]
    out[ends] = A.END
    return out, lengths


def window_keys(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of document id and place in the text."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + numbers.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def window_rounds(keys: np.ndarray, share: float) -> np.ndarray:
    """The round that reads a segment: the first bits of its key as a fraction, in units of the share."""
    return np.floor((keys >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 / share).astype(np.int64)


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, start, size) of the segments of texts: where each begins in its text, and its pieces.

    Those behind the first begin two windows early, with pieces that are only looked at.
    """
    width = SEGMENT * A.CONTEXT
    n = -(-lengths // width)
    text = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.maximum(number * width - 2 * A.CONTEXT, 0)
    return text, number, start, np.minimum((number + 1) * width, lengths[text]) - start


def segment_windows(pieces: np.ndarray, sizes: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of all windows of segments laid end to end; ``later``: not the first one of its text."""
    first = 2 * later.astype(np.int64)
    n = -(-sizes // A.CONTEXT) - first
    of = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
    return A.some_windows(pieces, (np.cumsum(sizes) - sizes)[of], sizes[of], number)


def _groups(sizes: np.ndarray):
    """Runs of texts with about CHUNK_PIECES words together, or one longer text."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > CHUNK_PIECES // 4:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


BLOCKS = ("block long, pack binary, numbers binary, shard_of binary, flat binary, piece_sizes binary, "
          "messages array<struct<shard int, words binary, counts binary>>, train_docs long, "
          "pairs binary, pair_counts binary, pieces binary, segment_keys binary, segment_sizes binary, later binary, "
          "windows array<long>")


def _blocks(rows: DataFrame, file, shards: int, share: float, rounds: int) -> DataFrame:
    """Store blocks with their word messages, counts of piece pairs, and the training segments of all rounds."""

    def run(batches):
        coder = _shared_pieces(file)
        for block, batch in numbered(batches, "text", BLOCK_BYTES):
            local: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
            ids = []
            for raw in text_bytes(batch.column("text")):
                words = raw.lower().split()  # bytes: A-Z and ASCII white space only
                ids.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            sizes = np.array([len(i) for i in ids], np.int64)
            numbers = np.concatenate(ids)
            training = np.bincount(numbers[np.repeat(~held, sizes)], minlength=len(local))
            words = list(local)
            shard, messages = send_words(words, shards)
            for m in messages:
                m["counts"] = squeeze(training[shard == m["shard"]])
            flat, starts = coder.of(words)
            names = np.array([0 if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            codes, parts, keys, cut, later = [], [np.zeros(0, np.int16)], [np.zeros(0, np.uint64)], [], []
            for a, b in _groups(sizes):
                pieces, lengths = _sequences(numbers[edges[a]:edges[b]], sizes[a:b], flat, starts)
                learn = ~held[a:b]
                codes.append(A.pair_codes(pieces, lengths)[np.repeat(learn, lengths)])
                text, number, start, size = _segments(np.where(learn, lengths, 0))
                key = window_keys(names[a:b][text], number)
                some = np.flatnonzero(window_rounds(key, share) < rounds)
                start, size = ((np.cumsum(lengths) - lengths)[text] + start)[some], size[some]
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                parts.append(pieces[np.repeat(start, size) + within].astype(np.int16))
                keys.append(key[some])
                cut.append(size)
                later.append(number[some] > 0)
            pairs = np.bincount(np.concatenate(codes), minlength=A.PIECES * A.PIECES)
            found, keys, cut, later = np.flatnonzero(pairs), *map(np.concatenate, (keys, cut, later))
            windows = np.zeros(rounds, np.int64)
            np.add.at(windows, window_rounds(keys, share), -(-cut // A.CONTEXT) - 2 * later)
            table = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(sizes)], ["doc_id", "held_out", "n_words"])
            kinds = pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))
            blob = lambda x: pa.array([x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), blob(pack(table)), blob(squeeze(numbers)), blob(squeeze(shard)),
                 blob(flat.tobytes()), blob(squeeze(np.diff(starts))), pa.array([messages], kinds),
                 pa.array([int((~held).sum())], pa.int64()), blob(squeeze(found)), blob(squeeze(pairs[found])),
                 blob(np.concatenate(parts).tobytes()), blob(keys.tobytes()), blob(cut.astype(np.int16).tobytes()),
                 blob(later.tobytes()), pa.array([windows.tolist()], pa.list_(pa.int64()))],
                ["block", "pack", "numbers", "shard_of", "flat", "piece_sizes", "messages", "train_docs", "pairs",
                 "pair_counts", "pieces", "segment_keys", "segment_sizes", "later", "windows"])

    return store_by_block(rows.mapInArrow(run, BLOCKS), "lm_blocks")


def _word_counts(blocks: DataFrame) -> DataFrame:
    """Store (block, shard, counts, words, tokens): training counts for the words of each message, and shard totals."""

    def total(key, table):
        sent = [received_words(x) for x in table["words"].to_pylist()]
        number: dict[bytes, int] = {}
        at = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in sent]
        counts = np.zeros(len(number), np.int64)
        for where, mine in zip(at, table["counts"].to_pylist()):
            counts[where] += expand(mine)  # a message holds a word once
        n = len(sent)
        # counts of one word may pass 32 bits: low and high half
        return pa.table({"block": table["block"], "shard": table["shard"],
                         "low": pa.array([squeeze(counts[w] & 0xFFFFFFFF) for w in at], pa.binary()),
                         "high": pa.array([squeeze(counts[w] >> 32) for w in at], pa.binary()),
                         "words": pa.array([int((counts > 0).sum())] * n, pa.int64()),
                         "tokens": pa.array([int(counts.sum())] * n, pa.int64())})

    messages = blocks.select("block", F.explode("messages").alias("m")).select("block", "m.shard", "m.words", "m.counts")
    return materialize(messages.groupBy("shard").applyInArrow(
        total, "block long, shard int, low binary, high binary, words long, tokens long"), "word_counts")


def _pair_table(blocks: DataFrame) -> np.ndarray:
    """Counts of piece pairs over all training documents; PIECES squared numbers at most reach the driver."""

    def unfold(batches):
        for batch in batches:
            total = np.zeros(A.PIECES * A.PIECES, np.int64)
            for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("pair_counts").to_pylist()):
                total[expand(pairs)] += expand(counts)
            found = np.flatnonzero(total)
            for start in range(0, len(found), 1 << 16):
                some = found[start:start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some // A.PIECES), pa.array(some % A.PIECES),
                                                  pa.array(total[some])], ["before", "after", "n"])

    def fold(key, table):
        row = np.bincount(table["after"].to_numpy(), table["n"].to_numpy(), A.PIECES)
        return pa.table({"before": pa.array([key[0].as_py()], pa.int64()),
                         "row": pa.array([row.astype(np.float32).tobytes()], pa.binary())})

    pairs = (blocks.select("pairs", "pair_counts").mapInArrow(unfold, "before long, after long, n long")
             .groupBy("before", "after").agg(F.sum("n").alias("n")))
    table = np.zeros((A.PIECES, A.PIECES))
    for row in pairs.groupBy("before").applyInArrow(fold, "before long, row binary").toLocalIterator():
        table[row.before] = np.frombuffer(row["row"], np.float32)
    return table


def _train(blocks: DataFrame, logs, rounds: int, share: float, rate: float, seed: int) -> np.ndarray:
    """Weights after rounds of descent in groups and averaging, weighted by windows."""
    segments = blocks.select("pieces", "segment_keys", "segment_sizes", "later")
    sums = blocks.agg(*[F.sum(F.get("windows", F.lit(r))).alias(str(r)) for r in range(rounds)]).first()
    weights = A.fresh(seed)
    for number in range(rounds):
        n = sums[str(number)] or 0
        if not n:
            continue
        shipped = blocks.sparkSession.sparkContext.broadcast(weights)
        groups, step = max(1, round(n / GROUP_WINDOWS)), rate * (1 - number / (rounds + 1))

        def deal(batches):
            for batch in batches:
                for pieces, keys, sizes, later in zip(*(c.to_pylist() for c in batch.columns)):
                    keys, later = np.frombuffer(keys, np.uint64), np.frombuffer(later, bool)
                    edges = 2 * np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int16), dtype=np.int64)])
                    mine = np.flatnonzero(window_rounds(keys, share) == number)
                    group = (keys[mine] % np.uint64(groups)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group), pa.array(keys[mine].view(np.int64)), pa.array(later[mine]),
                         pa.array([pieces[edges[i]:edges[i + 1]] for i in mine.tolist()], pa.binary())],
                        ["group", "key", "later", "pieces"])

        def descend(table):
            # one order, however the segments arrive; those of one key are told apart by their pieces
            rows = sorted(zip(table["key"].to_pylist(), table["later"].to_pylist(), table["pieces"].to_pylist()))
            sizes = np.array([len(r[2]) // 2 for r in rows])
            x, y = segment_windows(np.frombuffer(b"".join(r[2] for r in rows), np.int16).astype(np.int32), sizes,
                                   np.array([r[1] for r in rows]))
            new = A.descend(shipped.value, logs.value, x, y, step, seed=seed + number).astype(np.float64) * len(x)
            new = np.pad(new, (0, -len(new) % CHUNK)).reshape(-1, CHUNK)
            return pa.table({"chunk": pa.array(np.arange(len(new)), pa.int32()),
                             "v": pa.array(new.tolist(), pa.list_(pa.float64()))})

        parts = (segments.mapInArrow(deal, "group long, key long, later boolean, pieces binary").groupBy("group")
                 .applyInArrow(descend, "chunk int, v array<double>"))
        summed = add_chunks(parts, ["chunk"], "sum").toArrow()
        weights = np.zeros(-(-len(weights) // CHUNK) * CHUNK, np.float64)
        weights[summed["chunk"].to_numpy() * CHUNK + summed["pos"].to_numpy()] = summed["v"].to_numpy() / n
        weights = weights[:len(A.fresh(seed))].astype(np.float32)
        shipped.destroy()
    return weights


def _score_pieces(weights, logs, sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    x, y = A.windows(sequence, lengths)
    per_window = np.concatenate([A.log_probabilities(weights, logs, x[i:i + WINDOWS_AT_ONCE], y[i:i + WINDOWS_AT_ONCE])
                                 .sum(1) for i in range(0, len(x), WINDOWS_AT_ONCE)])
    n = -(-lengths // A.CONTEXT)
    return np.add.reduceat(per_window, np.cumsum(n) - n) / np.log(10)


def score_documents(docs: DataFrame, piece_file: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 10,
                    held_fold: int = 0, share: float | None = None, rounds: int = ROUNDS, rate: float = RATE,
                    seed: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_pieces.

    ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))), with counts from the documents whose
    crc32(id) mod ``folds`` is not ``held_fold``. ``score`` is the model's log10 probability of the text, as the ids of
    its lower-cased words and an end. Null and empty texts have the end as only token. A null id counts as the empty text
    when it is hashed. Every row is a document of its own. Other columns are ignored. Without training documents N and V
    are 0 and the model is untrained. In each of ``rounds`` rounds other training windows train the network, and all of
    them do in one of the rounds. Only a caller who asks for a smaller ``share`` than 1 / rounds leaves windows out;
    ``rounds * share`` is 1 at most.
    """
    share = 1 / rounds if share is None else share
    if not 0 <= share * rounds <= 1 or share <= 0:
        raise ValueError("rounds * share must be 1 at most")
    spark = docs.sparkSession
    file = file_text(spark, piece_file)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       (crc_bucket(docs[id_col].cast("long"), folds) == held_fold).alias("held_out"),
                       docs[text_col].cast("string").alias("text"))
    blocks = _blocks(rows, file, word_shards(rows, "text"), share, rounds)
    counts = _word_counts(blocks)
    totals = (counts.groupBy("shard").agg(F.first("words").alias("words"), F.first("tokens").alias("tokens"))
              .agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first())
    ends = blocks.agg(F.sum("train_docs")).first()[0] or 0
    n_train, distinct = (totals.tokens or 0) + ends, (totals.words or 0) + (ends > 0)
    logs = spark.sparkContext.broadcast(A.pair_logs(_pair_table(blocks)))  # PIECES squared numbers
    weights = spark.sparkContext.broadcast(_train(blocks, logs, rounds, share, rate, seed))
    per_token = np.log10(n_train + 0.1 * (distinct + 1))

    def score(key, block, answers):
        shard_of = expand(block["shard_of"][0].as_py())
        c = np.zeros(len(shard_of), np.int64)
        for shard, low, high in zip(*(answers[x].to_pylist() for x in ("shard", "low", "high"))):
            c[shard_of == shard] = expand(low).astype(np.int64) + (expand(high).astype(np.int64) << 32)
        rows = unpack(block["pack"][0].as_py())
        sizes = rows["n_words"].to_numpy()
        numbers = expand(block["numbers"][0].as_py())
        edges = np.concatenate([[0], np.cumsum(sizes)])
        logged, known = np.log10(c + 0.1), (c > 0).astype(np.int64)
        flat = np.frombuffer(block["flat"][0].as_py(), np.int16)
        starts = np.concatenate([[0], np.cumsum(expand(block["piece_sizes"][0].as_py()), dtype=np.int64)])
        ids = [numbers[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        base = [float(logged[i].sum()) + np.log10(ends + 0.1) - (len(i) + 1) * per_token for i in ids]
        held = [int(known[i].sum()) + (ends > 0) for i in ids]
        scores, pieces, model = [], [], A.tables(A.views(weights.value))
        for a, b in _groups(sizes):
            sequence, lengths = _sequences(numbers[edges[a]:edges[b]], sizes[a:b], flat, starts)
            scores.append(_score_pieces(model, logs.value, sequence, lengths))
            pieces.append(lengths)
        n = len(ids)
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(sizes + 1),
                         "n_known": pa.array(held, pa.int64()), "train_tokens": pa.array([n_train] * n, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(np.concatenate(scores)),
                         "n_pieces": pa.array(np.concatenate(pieces))})

    return (blocks.select("block", "pack", "numbers", "shard_of", "flat", "piece_sizes").groupBy("block")
            .cogroup(counts.select("block", "shard", "low", "high").groupBy("block")).applyInArrow(score, SCHEMA))
