import hashlib
import math
import re
import zlib

import pytest
from llm.helpers import corpus, empty, with_clashes, words

from labelpick.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, max_n):
    found = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(found[i:i + n]) for n in range(1, max_n + 1) for i in range(len(found) - n + 1)]
    return found, [zlib.crc32(g.encode()) for g in grams]


def brute(rows, target, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for crc in plain_features(text, max_n)[1]:
                counts[crc % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets))))
            for a, b in zip(s, t)]
    out = []
    for doc, text in rows:
        found, crcs = plain_features(text, max_n)
        weight = math.floor(sum(gain[c % buckets] for c in crcs) / len(crcs)) if crcs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(crcs), weight, score, None, len(found)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


TARGET = ["the an re ti on le the an on", None, "", "ÉCOLE über 12 x x x", "the the the"]


def target_table(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(TARGET)], "item_id long, text string, rank int")


@pytest.mark.parametrize("max_n, buckets, percent", [(1, 10_000, 10), (3, 500, 37), (2, 7, 100)])
def test_report_equals_brute_force(spark, max_n, buckets, percent):
    rows = corpus(seed=4, n=90)
    got = resample.resample_report(with_clashes(spark, rows), target_table(spark), max_n, buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, TARGET, max_n, buckets, percent=percent)


def test_chained_crcs_are_those_of_joined_words():
    got = resample.features([b"a", b"bc", b"a", b"bc"], 3)
    want = [b"a", b"bc", b"a", b"bc", b"a bc", b"bc a", b"a bc", b"a bc a", b"bc a bc"]
    assert got == {zlib.crc32(w): want.count(w) for w in want}


def test_drawn_documents_are_those_with_a_rank_and_lean_to_the_target(spark):
    import random

    rng = random.Random(3)
    rows = [(i, words(rng, 40) if i % 2 else " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(40)))
            for i in range(400)]
    target = spark.createDataFrame([(" ".join(["alpha", "gamma", "beta"] * 5000),)] * 4, "text string")
    docs = with_clashes(spark, rows)
    drawn = resample.resample(docs, target, percent=20)
    assert drawn.columns == docs.columns
    ranked = resample.resample_report(docs, target, percent=20).where("rank is not null")
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in ranked.collect()} and drawn.count() == 80
    assert drawn.where("doc_id % 2 = 0").count() > 70
    assert {r.text for r in drawn.collect()} <= {t for _, t in rows}


def test_empty_tables(spark):
    rows = corpus()
    none = resample.resample_report(with_clashes(spark, rows), empty(spark, "text string"))
    assert sorted(map(tuple, none.collect()), key=repr) == brute(rows, [])
    assert resample.resample_report(empty(spark), target_table(spark)).count() == 0
    assert resample.resample(empty(spark), target_table(spark)).count() == 0
