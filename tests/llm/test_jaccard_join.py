import random

import numpy as np
import pytest
from llm.helpers import corpus, empty, with_clashes, words

from labelpick.llm import jaccard_join
from labelpick.llm.components import components


def brute(rows, n=5, threshold=0.8):
    """(links, copies, class) of each row by comparing all pairs."""
    known = jaccard_join.WordHash()
    sets = [set(jaccard_join.shingles((t or "").encode(), n, known).tolist()) for _, t in rows]
    group, links, copies = list(range(len(rows))), [0] * len(rows), [1] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i], links[j] = links[i] + 1, links[j] + 1
                if sets[i] == sets[j]:
                    copies[i], copies[j] = copies[i] + 1, copies[j] + 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for g, (i, _) in zip(group, rows):
        ids.setdefault(g, []).append(i)
    small = {g: min((i for i in mine if i is not None), default=None) for g, mine in ids.items()}
    return [(links[k], copies[k], small[group[k]]) for k in range(len(rows))]


def near_rows():
    rng = random.Random(5)
    bases, rows = [words(rng, 60).split() for _ in range(3)], []
    for i in range(120):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = f"x{rng.randint(0, 20)}"
        rows.append((5000 + i, " ".join(text)))
    return corpus() + rows + [(6000, "a b"), (6001, "A, b!"), (6002, "b a")]


@pytest.mark.parametrize("tile", [512, 16])
def test_links_and_classes_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = near_rows()
    want = sorted((-1 if i is None else i, *map(str, w)) for (i, _), w in zip(rows, brute(rows)))
    got = jaccard_join.near_duplicates(with_clashes(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, str(r.n_links), str(r.n_copies), str(r.class_id))
                  for r in got) == want


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    docs = with_clashes(spark, rows)
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    found = brute(rows)
    no_words = [i for i, t in rows if not jaccard_join.words_of((t or "").encode())]
    classes = {w[2] for (i, t), w in zip(rows, found) if jaccard_join.words_of((t or "").encode())}
    assert sorted(str(r.doc_id) for r in got) == sorted([*map(str, no_words), *map(str, classes)])
    assert {(r.doc_id, r.text) for r in got} <= set(rows)
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0
    assert jaccard_join.keep_one_of_each(empty(spark)).count() == 0


def test_posterior_rule_by_simulation():
    """A pair is dropped where the share of uniformly drawn similarities that reach the threshold is below tolerance."""
    rng = np.random.default_rng(0)
    similarity = rng.random(400_000)
    for n, least in jaccard_join.least_agreements(0.8, 0.01, 64):
        agree = rng.binomial(n, similarity)
        posterior = [np.mean(similarity[agree == m] >= 0.8) for m in (least - 2, least + 1)]
        assert posterior[0] < 0.012 and posterior[1] > 0.008
    assert all(m < 0.8 * n for n, m in jaccard_join.least_agreements(0.8, 1e-9))


def test_pruning_keeps_similar_pairs_and_drops_others():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    other = lambda keep: np.unique(np.concatenate(
        [base[:keep], rng.integers(0, 1 << 62, 400 - keep, dtype=np.uint64)]))
    sets = [np.unique(base)] + [other(k) for k in (380, 360, 150, 100)]
    sketch = np.stack([jaccard_join.minhash(s) for s in sets])
    i, j = jaccard_join.prune(sketch, np.zeros(4, int), np.arange(1, 5), jaccard_join.least_agreements(0.8, 1e-9))
    assert j.tolist() == [1, 2]
    assert jaccard_join.verify(sets, np.zeros(4, int), np.arange(1, 5), 0.8).tolist() == [True, True, False, False]


def test_components_of_paths_stars_and_pairs(spark):
    rng = random.Random(4)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1, k) for k in range(2, 30)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in path}, **{k: 1 for k in range(1, 30)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
