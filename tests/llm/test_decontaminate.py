import hashlib
import random

import numpy as np
import pytest
from llm.helpers import corpus, empty, with_clashes

from labelpick.llm import decontaminate
from labelpick.llm.common import words_of


def brute(items, words, window):
    hit, found = set(), set()
    for item, mine in items:
        k = min(window, len(mine))
        windows = {tuple(mine[i:i + k]) for i in range(len(mine) - k + 1)} if mine else set()
        for i in range(len(words) - k + 1 if mine else 0):
            if tuple(words[i:i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(item)
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        window, letters = rng.choice([2, 3, 5]), [b"a", b"b", b"c", b"d"][:rng.choice([2, 3, 4])]
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 6))]
        words = [rng.choice(letters + [b"z"]) for _ in range(rng.randint(0, 40))]
        automaton = decontaminate.Automaton(items, window)
        ids = np.array([automaton.vocabulary.get(w, 0) for w in words], np.int32)
        spans, found = [], set()
        for start, end in zip(*automaton.stretches(ids)):
            automaton.scan(ids[start:end].tolist(), int(start), spans, found)
        assert ({x for a, b in spans for x in range(a, b)}, found) == brute(items, words, window)


def tables(spark):
    rows = corpus()
    text = rows[5][1].split()
    items = [(1, " ".join(text[3:20])), (2, "one"), (2, "One!"), (3, None), (4, ""), (5, " ".join(text[8:30])), (None, "odd")]
    return rows, with_clashes(spark, rows), items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("shard", [100_000, 8])
def test_table_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 100_000 if shard > 8 else 4)
    rows, docs, items, table = tables(spark)
    plain = [("" if i is None else str(i), words_of((t or "").encode())) for i, t in items]
    want = []
    for doc, text in rows:
        words = words_of((text or "").encode())
        hit, found = brute(plain, words, 10)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((-1 if doc is None else doc, len(words), len(hit), len(found), digest, bool(hit)))
    got = decontaminate.scan_benchmark(docs, table).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)


def test_spans_are_cut_and_covered_documents_go(spark):
    rows, docs, items, table = tables(spark)
    got = decontaminate.remove_benchmark(docs, table)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert 3003 not in texts and texts[3001] == "" and texts[3000] is None  # "one" is covered as a whole
    assert decontaminate.scan_benchmark(got, table).where("contaminated").count() == 0
    clean = {i for i, t in rows if i is not None and i < 60 and i != 5}
    assert all(texts[i] == t for i, t in rows if i in clean and "one" not in words_of((t or "").encode()))
    assert decontaminate.cut_spans("Ein Haus, zwei DREI.", [(1, 3)]) == "Ein  DREI."


def test_empty_tables(spark):
    rows, docs, items, table = tables(spark)
    none = empty(spark, "item_id long, text string")
    assert decontaminate.scan_benchmark(docs, none).where("contaminated").count() == 0
    assert decontaminate.remove_benchmark(docs, none).count() == len(rows)
    assert decontaminate.scan_benchmark(empty(spark), table).count() == 0
