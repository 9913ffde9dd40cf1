import random

import pytest
from llm.helpers import vocabulary, with_clashes, words
from pyspark.sql import functions as F

import corpus_pipeline
from labelpick.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from labelpick.llm.common import words_of

LINE = "All rights reserved."


def rows_of(seed=1):
    """Clean, toxic, copied, near-copied, contaminated, empty, null and long documents, with a line of many documents."""
    rng = random.Random(seed)
    passage = words(rng, 40)
    rows = [(i, words(rng, rng.randint(25, 90)) + (f"\n{LINE}" if i < 15 else "")) for i in range(60)]
    rows += [(100 + i, "vile hateful scum " * 6 + words(rng, 12)) for i in range(20)]
    base = words(rng, 150)
    rows += [(200 + i, base) for i in range(4)] + [(210, base + " tail")]
    rows += [(300, passage), (301, words(rng, 60) + "\n" + passage + "\n" + words(rng, 60))]
    rows += [(400, None), (401, ""), (402, words(rng, 6000)), (None, words(rng, 30)), (403, "ÉCOLE Größe 日本 zwei drei")]
    return rows, passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (rows, passage) = str(tmp_path_factory.mktemp("pipeline")), rows_of()
    docs = with_clashes(spark, rows).withColumn("n_chars", F.length("text")).withColumn("ids", F.lit("mine"))
    docs.withColumn("odd.name`d", F.lit(3)).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 200)) for i, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_whole_run_equals_the_stages_one_by_one(spark, folder):
    file = vocabulary("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = toxicity.drop_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"), threshold=0.3)
    want = line_dedup.drop_repeated_lines(want, min_docs=10, spare_copies=True)
    want = jaccard_join.keep_one_of_each(want, n=5, threshold=0.8)
    want = decontaminate.remove_benchmark(want, spark.read.parquet(f"{folder}/benchmark.parquet"), window=10, max_coverage=0.5)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [c for c in docs.columns if c not in ("text", "ids")] + ["n_tokens", "ids", "lossless"]
    texts = {tuple(r): t for *r, t in want.select("doc_id", "block", F.coalesce("text", F.lit(""))).collect()}
    back = bpe.decode(got.withColumnRenamed("ids", "sent"), file, ids_col="sent").collect()
    assert {(r.doc_id, r.block): r.text for r in back} == texts and len(back) == len(texts)
    assert all(r.lossless and r["odd.name`d"] == 3 for r in back)


def test_decisions_take_effect(spark, folder):
    rows, passage = rows_of()
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert not any(100 <= i < 200 for i in kept if i is not None)
    assert len([i for i in kept if i is not None and 200 <= i <= 210]) == 1
    assert 300 not in kept and {301, 400, 401, 402, 403, None} <= set(kept)
    assert len([i for i in range(60) if i in kept]) == 60
    assert kept[400].n_tokens == 0 and kept[402].n_tokens > 6000


def test_every_stage_keeps_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_lines_and_passages_are_gone_from_the_texts(spark, folder):
    rows, passage = rows_of()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, folder).collect()
    assert not any(LINE in (r.text or "") for r in lines) and len(lines) == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines)
    clean = {r.doc_id: r.text for r in corpus_pipeline.drop_benchmark(spark, docs, folder).collect()}
    assert b" ".join(words_of(passage.encode())) not in b" ".join(words_of(clean[301].encode()))
