import zlib
from collections import Counter

import numpy as np
import pytest
from llm.helpers import corpus, empty, vocabulary, with_clashes

from labelpick.llm import attention as A
from labelpick.llm import lm_scores


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


@pytest.mark.parametrize("block", [6 << 20, 3_000])
def test_counts_and_base_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm_scores, "BLOCK_BYTES", block)
    rows = corpus()
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    got = lm_scores.score_documents(with_clashes(spark, rows), vocabulary("byte_bpe_multi_50k.tiktoken"), rounds=1).collect()
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n)
                  for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:5]) for r in got) == want
    base = sorted(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)) for _, t in rows)
    assert np.allclose(sorted(r.base_score for r in got), base)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_tables_and_no_training_rows(spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    assert lm_scores.score_documents(empty(spark), path, rounds=1).count() == 0
    alone = next(i for i in range(100) if held(i))
    row = lm_scores.score_documents(spark.createDataFrame([(alone, "a b")], "doc_id long, text string"), path).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_windows_score_each_piece_once_with_its_context():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 16, 17, 5, 64, 100])
    pieces = rng.integers(0, A.END, sizes.sum()).astype(np.int32)
    x, y = A.windows(pieces, sizes)
    assert y[y != A.PAD].tolist() == pieces.tolist()
    at = 0
    for size in sizes:
        text = np.concatenate([[A.END], pieces[at:at + size]])
        alone_x, alone_y = A.windows(pieces[at:at + size], np.array([size]))
        for row in range(len(alone_x)):
            for k in range(A.CONTEXT):
                i = row * A.CONTEXT + k
                if i < size:  # the piece before it and everything else in the window
                    seen = alone_x[row, :A.CONTEXT + k + 1]
                    assert seen[seen != A.PAD].tolist() == text[max(0, i - A.CONTEXT - k):i + 1].tolist()
        at += size


def test_probabilities_sum_to_one_and_ignore_the_future():
    rng = np.random.default_rng(1)
    weights = A.views((A.fresh() + rng.normal(0, 0.2, len(A.fresh()))).astype(np.float32))
    logs = A.pair_logs(rng.random((A.PIECES, A.PIECES)))
    x, y = A.windows(rng.integers(0, A.END, 20).astype(np.int32), np.array([20]))
    total = 0.0
    for piece in range(0, A.PIECES):
        y2 = np.full_like(y[:1], A.PAD)
        y2[0, 3] = piece
        total += np.exp(A.log_probabilities(weights, logs, x[:1], y2)[0, 3])
    assert abs(total - 1) < 1e-3
    later = x.copy()
    later[0, A.CONTEXT + 5:] = 7
    assert np.allclose(A.log_probabilities(weights, logs, x, y)[0, :5], A.log_probabilities(weights, logs, later, y)[0, :5])


def test_gradient_equals_differences_and_training_helps():
    rng = np.random.default_rng(2)
    weights = A.fresh().astype(np.float64) + rng.normal(0, 0.1, len(A.fresh()))
    logs = A.pair_logs(rng.random((A.PIECES, A.PIECES)) * 3)
    pattern = np.tile(rng.integers(0, A.END, 7), 60).astype(np.int32)
    x, y = A.windows(pattern, np.array([len(pattern)]))
    _, gradient = A.gradient(A.views(weights), logs, x[:3], y[:3])
    for i in np.argsort(-np.abs(gradient))[:200:10]:
        step = np.zeros_like(weights)
        step[i] = 1e-4
        slope = (A.gradient(A.views(weights + step), logs, x[:3], y[:3])[0]
                 - A.gradient(A.views(weights - step), logs, x[:3], y[:3])[0]) / 2e-4
        assert abs(slope - gradient[i]) < 2e-3 + 0.03 * abs(slope)
    start = A.fresh()
    many = np.repeat(x, 40, 0), np.repeat(y, 40, 0)
    after = A.descend(start, logs, *many, rate=0.02)
    score = lambda w: A.log_probabilities(A.views(w), logs, x, y).sum()
    assert score(after) > score(start) + 100


def test_single_windows_and_pairs_equal_those_of_all():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 16, 17, 5, 64, 100, 33])
    pieces = rng.integers(0, A.END, sizes.sum()).astype(np.int32)
    x, y = A.windows(pieces, sizes)
    n = -(-sizes // A.CONTEXT)
    text = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x2, y2 = A.some_windows(pieces, (np.cumsum(sizes) - sizes)[text], sizes[text], number)
    assert (x == x2).all() and (y == y2).all()
    at = y != A.PAD
    assert (x[:, A.CONTEXT:][at] * A.PIECES + y[at]).tolist() == A.pair_codes(pieces, sizes).tolist()


def test_rounds_read_other_windows_and_all_of_them_where_shares_add_up():
    keys = lm_scores.window_keys(np.arange(40_000) // 4, np.arange(40_000) % 4)
    assert len(np.unique(keys)) == 40_000
    number = lm_scores.window_rounds(keys, 1 / 4)
    assert set(number) == {0, 1, 2, 3} and np.bincount(number).min() > 9_500
    assert abs((lm_scores.window_rounds(keys, 1 / 48) < 4).mean() - 4 / 48) < 0.01


def test_scores_equal_plain_attention_token_by_token(spark, monkeypatch):
    """The score of a text, one piece at a time, with the weights and pair counts of the run."""
    kept = {}
    train, table = lm_scores._train, lm_scores._pair_table
    monkeypatch.setattr(lm_scores, "_train", lambda *a: kept.setdefault("weights", train(*a)))
    monkeypatch.setattr(lm_scores, "_pair_table", lambda *a: kept.setdefault("pairs", table(*a)))
    path, rows = vocabulary("byte_bpe_multi_50k.tiktoken"), corpus()
    got = lm_scores.score_documents(with_clashes(spark, rows), path, share=0.1)
    scores = {(r.doc_id, r.n_pieces): r.score for r in got.collect()}
    coder = lm_scores.Pieces(open(path, encoding="utf-8").read())
    w = {name: v.astype(np.float64) for name, v in A.views(kept["weights"]).items()}
    of_class, within = (t.astype(np.float64) for t in A.pair_logs(kept["pairs"]))
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for doc, text in [r for r in rows if r[0] in (3, 7, 3000, 3001, 3003, 3007, 1002)]:
        words = (text or "").encode().lower().split()
        pieces = [*coder.of(words)[0].tolist(), A.END]
        seen, total = [A.END, *pieces[:-1]], 0.0
        for i, piece in enumerate(pieces):
            first = max(0, i - i % A.CONTEXT - A.CONTEXT)
            past = seen[first:i + 1]
            own = w["E"][seen[i]]
            back = np.arange(len(past))[::-1]
            a = soft((w["E"][past] @ w["k"]) @ (own @ w["q"]) * A.DIM ** -0.5 + w["r"][back])
            h = own + a @ (w["E"][past] @ w["v"])
            c, inner = divmod(piece, A.CLASS)
            total += np.log(soft(of_class[seen[i]] + h @ w["c"])[c])
            total += np.log(soft(within[c][seen[i]] + w["u"][c * A.CLASS:(c + 1) * A.CLASS] @ h)[inner])
        assert np.isclose(scores[doc, len(pieces)], total / np.log(10), rtol=1e-4, atol=1e-3)


def test_layout_does_not_matter(spark):
    rows = [(i, t) for i, t in corpus(n=120) if i is not None and i < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    found = []
    for table in (docs.coalesce(1), docs.repartition(9)):
        found.append(sorted((r.doc_id, r.score) for r in lm_scores.score_documents(table, path, share=0.2).collect()))
    assert [a for a, _ in found[0]] == [a for a, _ in found[1]]
    assert np.allclose([s for _, s in found[0]], [s for _, s in found[1]], rtol=1e-4)


def test_shares_beyond_all_windows_are_refused(spark):
    with pytest.raises(ValueError):
        lm_scores.score_documents(empty(spark), vocabulary("byte_bpe_multi_50k.tiktoken"), share=0.3, rounds=4)


def test_segments_have_all_windows_of_their_texts():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 1024, 1025, 5, 3000, 1040, 2048, 16])
    pieces = rng.integers(0, A.END, sizes.sum()).astype(np.int32)
    text, number, start, size = lm_scores._segments(sizes)
    first = (np.cumsum(sizes) - sizes)[text] + start
    cut = np.concatenate([pieces[a:a + n] for a, n in zip(first, size)])
    x, y = lm_scores.segment_windows(cut, size, number > 0)
    x2, y2 = A.windows(pieces, sizes)
    assert (x == x2).all() and (y == y2).all()
    assert len(lm_scores._segments(np.zeros(3, np.int64))[0]) == 0


@pytest.mark.parametrize("rounds", [1, 4])
def test_every_training_window_is_read(spark, monkeypatch, rounds):
    """The windows that train the network are all of those of the training documents, each in one round."""
    kept = []
    train = lm_scores._train
    monkeypatch.setattr(lm_scores, "_train", lambda blocks, *a: kept.append(blocks) or train(blocks, *a))
    path, rows = vocabulary("byte_bpe_multi_50k.tiktoken"), corpus()
    lm_scores.score_documents(with_clashes(spark, rows), path, rounds=rounds)
    coder, want = lm_scores.Pieces(open(path, encoding="utf-8").read()), 0
    for i, text in rows:
        if not held(i):
            want -= -(len(coder.of((text or "").encode().lower().split())[0]) + 1) // A.CONTEXT
    per_round = np.sum([r["windows"] for r in kept[0].select("windows").collect()], 0)
    assert len(per_round) == rounds and per_round.sum() == want and (per_round > 0).all()


@pytest.mark.parametrize("sharper", [1, 60])  # 60: exponentials of the scores could overflow
def test_gradients_in_a_used_room_equal_fresh_ones(sharper):
    rng = np.random.default_rng(5)
    sizes = np.array([1, 16, 700, 5, 1900, 100, 33])
    x, y = A.windows(rng.integers(0, A.END, sizes.sum()).astype(np.int32), sizes)
    assert len(x) > 2 * A.RUN and (y != A.PAD).sum() > 2 * A.ROWS
    logs = A.pair_logs(rng.random((A.PIECES, A.PIECES)) * 3)
    some = lambda: A.views((A.fresh() + rng.normal(0, 0.1, len(A.fresh()))).astype(np.float32))
    w, room = some(), A._Room(learns=len(x))
    w["q"] *= sharper
    assert (A.tables(w)["reach"] < 60) == (sharper == 1)
    A.gradient(some(), logs, x, y, room)  # leaves its numbers there
    loss, got = A.gradient(w, logs, x, y, room)
    assert (got == A.gradient(w, logs, x, y)[1]).all()
    n = lambda part: (y[part] != A.PAD).sum()
    assert np.isclose(loss, -A.log_probabilities(w, logs, x, y).sum() / n(slice(None)), rtol=1e-4)
    halves = slice(0, 70), slice(70, None)
    mean = sum(A.gradient(w, logs, x[p], y[p], room)[1] * n(p) for p in halves) / n(slice(None))
    assert np.allclose(got, mean, rtol=1e-3, atol=1e-6)
