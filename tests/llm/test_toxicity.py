import random
import tracemalloc
import weakref
import zlib

import numpy as np
import pytest
from llm.helpers import corpus, empty, with_clashes, words

from labelpick.llm import common, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        text = words(rng, rng.randint(5, 60)).split()
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["worthlessness", "pathetically"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5, None), (6, 7), (8, 1), (8, 1), (9999, 1)]
    return with_clashes(spark, rows + corpus()[-12:]), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_held_out_accuracy_and_misspellings(spark, labelled):
    docs, labels, rows = labelled
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect() if r.doc_id is not None}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i, _ in rows)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    model = toxicity.fit(docs, labels)
    plain, odd, clean = toxicity.score_words(model, {}, [{b"worthlessness"}, {b"worthlessnes5"}, {b"derch"}])
    assert plain > 0.5 and odd > 0.5 > clean


def test_scores_depend_on_the_text_only(spark, labelled):
    docs, labels, rows = labelled
    model = toxicity.fit(docs, labels)
    a = toxicity.score_words(model, {}, [{b"a", b"b"}, set()])
    assert a[0] == toxicity.score_words(model, {}, [{b"b", b"a"}])[0] and 0 < a[1] < 1
    again = toxicity.fit(docs.repartition(7), labels)
    assert np.array_equal(model.worth, again.worth) and model.bias == again.bias


def test_subwords_stay_inside_their_words():
    codes, starts = toxicity.subwords([b"ab", b"cdefg", b"ab"])
    one, _ = toxicity.subwords([b"ab"])
    assert codes[starts[0]:starts[1]].tolist() == codes[starts[2]:starts[3]].tolist() == one.tolist()
    assert np.diff(starts).tolist() == [2 + 1 + 1, 5 + 4 + 3 + 1, 4]
    many = [f"w{i}".encode() for i in range(100)]
    whole, split = toxicity.subwords(many), toxicity.subwords(many, 7)
    assert np.array_equal(whole[0], split[0]) and np.array_equal(whole[1], split[1])


def test_tables_without_labels_or_rows(spark, labelled):
    docs, labels, rows = labelled
    none = toxicity.score_toxicity(docs, empty(spark, "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i, _ in rows if i % 4 and i in ids]) > 0.97 * 1125
    assert toxicity.fit(docs, labels, sample_rows=0).bias == 0


def test_coding_a_vocabulary_takes_little_more_than_its_codes():
    rng = random.Random(3)
    many = [words(rng, 1).encode() + f"{i:09d}".encode() for i in range(150_000)]
    tracemalloc.start()
    codes, starts = toxicity.subwords(many)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(starts) == len(many) + 1 and starts[-1] == len(codes)
    assert peak < 1.5 * (codes.nbytes + starts.nbytes)


def test_training_makes_few_arrays_of_all_subwords():
    rng = np.random.default_rng(4)
    sizes, per_doc = rng.integers(20, 40, 150_000), rng.integers(50, 150, 2_000)
    word_starts, doc_starts = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, per_doc))
    codes = rng.integers(0, toxicity.BUCKETS, word_starts[-1]).astype(np.int32)
    doc_words = rng.integers(0, len(sizes), doc_starts[-1]).astype(np.int32)
    tracemalloc.start()
    model = toxicity.train(doc_words, doc_starts, codes, word_starts, rng.integers(0, 2, len(per_doc)), epochs=0)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    seen = np.bincount(doc_words, minlength=len(sizes))
    share = np.bincount(codes, np.repeat(seen, sizes), toxicity.BUCKETS) / len(per_doc)
    assert np.array_equal(model.weight, (0.1 / (0.1 + share)).astype(np.float32))
    assert peak < 4 * codes.nbytes  # a sum of doubles over all of them would take two, their numbers as many


def test_memory_goes_back_when_a_task_or_group_holds_nothing_more(monkeypatch):
    held, alive = [], []

    def make():
        array = np.zeros(10)
        held.append(weakref.ref(array))
        return array

    def run(batches):
        for _ in batches:
            kept = make()
            yield kept.sum()

    def group(key, table):
        return make().sum()

    monkeypatch.setattr(common, "tidy", lambda cycles=True: alive.append([r() is not None for r in held]))
    assert list(common.released(run)(iter([1, 2]))) == [0, 0]
    assert common.released_group(group, 1, None) == 0
    assert alive == [[False] * 2, [False] * 3]
