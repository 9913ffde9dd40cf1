import hashlib
from collections import Counter

import numpy as np
import pytest
from llm.helpers import corpus, empty, with_clashes

from labelpick.llm import line_dedup


def key(line):
    return line.strip().lower()


def brute(rows, min_docs):
    lines = [(t or "").encode().split(b"\n") for _, t in rows]
    counts = Counter(k for ls in lines for k in {key(line) for line in ls})
    return [(ls, [x for x in ls if not key(x) or counts[key(x)] < min_docs]) for ls in lines]


def test_report_equals_brute_force(spark):
    rows = corpus()
    for min_docs in (2, 10):
        want = sorted((-1 if i is None else i, len(ls), len(ls) - len(stay), hashlib.sha256(b"\n".join(stay)).hexdigest())
                      for (i, _), (ls, stay) in zip(rows, brute(rows, min_docs)))
        got = line_dedup.line_report(with_clashes(spark, rows), min_docs=min_docs).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert line_dedup.line_report(empty(spark)).count() == 0


def test_minimum_length_counts_code_points(spark):
    docs = spark.createDataFrame([(i, "éé\nabc") for i in range(3)], "doc_id long, text string")
    kept = line_dedup.drop_repeated_lines(docs, min_docs=2, min_chars=3)
    assert {r.text for r in kept.collect()} == {"éé"}


def test_texts_and_columns_stay(spark):
    rows = corpus()
    docs = with_clashes(spark, rows)
    got = line_dedup.drop_repeated_lines(docs, min_docs=10)
    assert got.columns == docs.columns and got.count() == len(rows)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[3000] is None and texts[2000] == "" and texts[3002] == " \n\t\n "
    spared = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, min_docs=10, spare_copies=True).collect()}
    assert spared[2000] == dict(rows)[2000] and spared[0] == texts[0]


def test_deleting_gives_the_former_state(spark):
    rows = corpus()
    a, b = with_clashes(spark, rows[::2]), with_clashes(spark, rows[1::2])
    first = line_dedup.LineIndex.build(a, 5)
    both = first.insert(b)
    again = both.delete(b)
    refs = lambda index: {bytes(r.key): r.docs for r in index.refs.collect()}
    assert refs(both) == refs(line_dedup.LineIndex.build(with_clashes(spark, rows), 5)) and refs(again) == refs(first)
    drop = lambda index: sorted((str(r.doc_id), str(r.text)) for r in
                                line_dedup.drop_repeated_lines(with_clashes(spark, rows), index=index).collect())
    assert drop(again) == drop(first)
    assert drop(both) == sorted((str(i), str(None if t is None else b"\n".join(stay).decode()))
                                for (i, t), (_, stay) in zip(rows, brute(rows, 5)))
    with pytest.raises(ValueError):
        first.delete(b)


def test_cuckoo_filter_has_no_false_negatives_also_when_full():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    for size in (3000, 100):
        cuckoo = line_dedup.Cuckoo.sized(size)
        cuckoo.insert(keys)
        cuckoo = line_dedup.Cuckoo.load(cuckoo.dump())
        assert cuckoo.holds(keys).all()
        cuckoo.delete(keys[:1500])
        assert cuckoo.holds(keys[1500:]).all()
        if size == 3000:
            assert cuckoo.holds(rng.integers(0, 256, (5000, 16), dtype=np.uint8)).mean() < 0.01
        cuckoo.delete(keys[1500:])
        assert not cuckoo.table.any() and not cuckoo.stash
