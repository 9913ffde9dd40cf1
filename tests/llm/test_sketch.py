import hashlib
import random
import re

import pytest
from llm.helpers import corpus, empty, with_clashes, words
from pyspark.sql import functions as F

from labelpick.llm import sketch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def digests(text, shingle=5):
    found = WORD.findall(text.translate(LOWER))
    runs = [found[i:i + shingle] for i in range(max(len(found) - shingle + 1, 1))] if found else []
    return {hashlib.md5(" ".join(r).encode()).hexdigest()[:16] for r in runs}


def plain(text, shingle=5, fraction=8):
    every = digests(text, shingle)
    low = sorted(h for h in every if int(h, 16) * fraction < 1 << 64)
    return low or sorted(every)[:1]


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def brute(rows, shingle=5, fraction=8):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for n, (doc, text) in enumerate(rows):
        after, third = rows[(n + 1) % len(rows)][1], len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        a, b, c = (plain(x, shingle, fraction) for x in (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b),
                    alike(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shingle, fraction", [(5, 8), (2, 1), (3, 3)])
def test_report_equals_brute_force(spark, shingle, fraction):
    rows = corpus(n=70)
    got = sketch.fingerprint_report(with_clashes(spark, rows), shingle, fraction)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, shingle, fraction)


@pytest.mark.parametrize("rows", [[], [(1, "only one text of a few words here")], [(None, None)], [(1, "a"), (1, "a")]])
def test_small_tables(spark, rows):
    got = sketch.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_neighbours_meet_across_blocks_without_a_shuffle(spark):
    rows = [(i, f"w{i} " * 6) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = sketch.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert table.select("block").distinct().count() > 1
        plan = sketch.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string"))
        shown = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.where(F.col("place") == sketch.GUEST).count() == table.select("block").distinct().count()
    assert "Exchange" not in shown and "Python" not in shown and "Arrow" not in shown
    assert sorted(map(tuple, plan.collect()), key=repr) == brute(rows)


def test_estimates_follow_the_truth(spark):
    rng = random.Random(5)
    base = words(rng, 4000).split()
    texts = [(1, " ".join(base)), (2, " ".join(base[:3000] + words(rng, 1000).split())), (3, " ".join(base[1000:1400]))]
    by = {r.doc_id: r.sketch for r in sketch.sketches(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    pairs = spark.createDataFrame([(by[1], by[2], by[3])], "a array<string>, b array<string>, c array<string>")
    got = pairs.select(sketch.likeness(F.col("a"), F.col("b")).alias("near"),
                       sketch.containment(F.col("c"), F.col("a")).alias("inside")).first()
    true = alike(digests(texts[0][1]), digests(texts[1][1]))
    assert abs(got.near - true) < 0.08 and got.inside > 0.95


def test_merged_sketches_are_those_of_all_texts(spark):
    rows = [(g, t) for g, t in zip("aabbc", [words(random.Random(i), 300) for i in range(4)] + [None])]
    rows += [("d", rows[0][1]), (None, "a b c")]
    docs = spark.createDataFrame(rows, "source string, text string")
    merged = sketch.merged(docs, "source")
    for group in "abcd":
        want = {h for g, t in rows if g == group for h in digests(t or "") if h < sketch.limit()}
        assert {r.digest for r in merged.collect() if r.group == group} == want
    small = merged.where("group = 'd'").select(F.col("group").alias("part"), "digest")
    found = {r.group: r.containment for r in sketch.containment_in(small, merged, "part").collect()}
    assert found["a"] == 1.0 and found["d"] == 1.0 and found.get("b", 0) < 0.1


def test_empty_table_and_wrong_fraction(spark):
    assert sketch.fingerprint_report(empty(spark)).count() == 0
    assert sketch.merged(empty(spark, "source string, text string"), "source").count() == 0
    with pytest.raises(ValueError):
        sketch.limit(0)
