import hashlib
import zlib

import pytest
from llm.helpers import corpus, empty
from pyspark.sql import functions as F

from labelpick.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fanout):
    """Root and, per leaf, its levels of (place in the run, run)."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
    top, above = plain_tree([sha("".join(r)) for r in runs], fanout)
    return top, [[(i % fanout, runs[i // fanout]), *above[i // fanout]] for i in range(len(nodes))]


def brute(rows, fanout=2, every=7):
    groups = {}
    for row in rows:
        groups.setdefault("" if row[2] is None else "=" + row[2], []).append(row)
    names = sorted(groups, key=str.encode)
    trees, out = {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]], fanout)
    root, tops = plain_tree([trees[g][0] for g in names], fanout) if names else (None, [])
    for g, over in zip(names, tops):
        for row, path in zip(groups[g], trees[g][1]):
            levels = [*path, *over]
            proof = "".join(x for at, run in levels for j, x in enumerate(run) if j != at)
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % every == 0 and row[3] is not None:
                now = (*row[:3], row[3] + 1, row[4])
            node = plain_leaf(now)
            for at, run in levels:
                node = sha("".join([*run[:at], node, *run[at + 1:]]))
            out.append((row[0], plain_leaf(row), trees[g][0], root, sha(proof), node, node == root))
    return sorted(out, key=repr)


def rows_of(n=150):
    texts = corpus()
    langs = ["de", "en", "en", "en", None, "", "é", "z"]
    rows = [(i if i is None else i + 10 * n, f"s{n % 3}" if n % 11 else None, langs[n % 8] if n < 40 else "en",
             None if t is None or n % 13 == 0 else len(t), t) for n, (i, t) in enumerate(texts)]
    return rows + [rows[5]] * 9 + [(7, None, None, None, None), (1, "", "", 0, "")]


@pytest.mark.parametrize("fanout, least", [(2, 4), (3, 3), (5, 1 << 11)])
def test_report_equals_brute_force(spark, monkeypatch, fanout, least):
    """Small partitions make many butterfly rounds, with last blocks of all sizes."""
    monkeypatch.setattr(manifest, "LEAST_LEAVES", least)
    rows = rows_of()
    docs = spark.createDataFrame([(*r, n, str(n), 0.5) for n, r in enumerate(rows)],
                                 SCHEMA + ", g long, node string, position double").repartition(5)
    got = manifest.tamper_report(docs, fanout=fanout)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, fanout)


@pytest.mark.parametrize("n", [1, 3, 17])
def test_every_number_of_partitions(spark, monkeypatch, n):
    monkeypatch.setattr(manifest, "LEAST_LEAVES", 2)
    rows = [(i, "s", "l", i, f"text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, manifest.tamper_report(docs).collect()), key=repr) == brute(rows)


def test_proofs_are_found_without_going_down_and_catch_any_change(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    proved = manifest.build(docs)
    assert proved.where(manifest.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    other = F.sha2(F.concat("leaf", F.lit("x")), 256)
    assert proved.where(manifest.fold(other, F.col("path")) == F.col("root")).count() == 0
    assert {r.group for r in proved.select("group").distinct().collect()} == {r[2] for r in rows}
    changed = spark.createDataFrame([*rows[:-1], (1, "", "", 0, "x")], SCHEMA)
    assert manifest.build(changed).first().root != proved.first().root


def test_fields_cannot_run_into_each_other(spark):
    pairs = [("1:a", "b"), ("1", "a1:b"), (None, "-"), ("-", None), ("", None), (None, "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.select(manifest.leaf(F.col("a"), F.col("b"))).distinct().count() == len(pairs)


def test_empty_table_and_wrong_fanout(spark):
    assert manifest.tamper_report(empty(spark, SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        manifest.build(spark.createDataFrame(rows_of(), SCHEMA), fanout=1)
