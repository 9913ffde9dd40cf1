from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpick import session
from labelpick.operators import sets
from labelpick.sources import models, selections, tables


@pytest.fixture()
def raw(spark):
    rows = [(i, [float(i), 1.0], i % 2, ("train", "val", "test")[i % 3], i % 5) for i in range(12)]
    return spark.createDataFrame(rows, "id long, vec array<float>, y int, dataset string, guess int")


def test_splits_are_disjoint_and_complete(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    tables.write_splits(raw, path)
    parts = tables.partition_data(tables.read_table(spark, path), "dataset")
    ids = [set(r["id"] for r in df.collect()) for df in parts.values()]
    assert set().union(*ids) == set(range(12)) and sum(map(len, ids)) == 12
    plan = parts["val"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_load_split_reads_only_needed_columns_and_drops_the_train_baseline(raw):
    train = tables.load_split(raw, "train", id_col="id", vec_col="vec", label_col="y", baseline_col="guess")
    val = tables.load_split(raw, "val", id_col="id", vec_col="vec", label_col="y", baseline_col="guess")
    assert train.columns == ["row_id", "embedding", "label"]
    assert val.columns == ["row_id", "embedding", "label", "baseline"]
    assert tables.load_split(raw, "val", id_col="id", vec_col="vec", label_col="y",
                             baseline_col="absent").columns == train.columns


def test_selection_round_trip_by_run_and_method(spark, tmp_path):
    path = str(tmp_path / "s")
    picks = spark.createDataFrame([(5, 0), (7, 1)], "row_id long, cluster int")
    selections.save_selection(picks, path, "a", "density")
    selections.save_selection(picks.filter("row_id = 5"), path, "a", "heads")
    selections.save_selection(picks.filter("row_id = 7"), path, "b", "density")
    assert [r["row_id"] for r in selections.load_selection(spark, path, "a", "density").orderBy("row_id").collect()] == [5, 7]
    assert selections.load_selection(spark, path, "a", "heads").count() == 1


def test_stored_selection_is_reused(spark, tmp_path):
    path, calls = str(tmp_path / "s"), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(5,)], "row_id long")

    for _ in range(3):
        got = selections.select_or_load(spark, path, "a", "density", compute)
    assert [r["row_id"] for r in got.collect()] == [5] and len(calls) == 1
    selections.select_or_load(spark, path, "b", "density", compute, recalculate=True)
    assert len(calls) == 2


def test_recalculated_selection_is_a_new_version(spark, tmp_path):
    path = str(tmp_path / "s")
    for n, wanted in enumerate([[5], [6, 7], [8]]):
        rows = spark.createDataFrame([(i,) for i in wanted], "row_id long")
        got = selections.select_or_load(spark, path, "a", "density", lambda rows=rows: rows, recalculate=n > 0)
        assert sorted(r["row_id"] for r in got.collect()) == wanted
    other = selections.select_or_load(spark, path, "a", "heads", lambda: spark.createDataFrame([(1,)], "row_id long"))
    assert [r["row_id"] for r in other.collect()] == [1]
    assert [r["row_id"] for r in selections.load_selection(spark, path, "a", "density").collect()] == [8]
    assert spark.read.parquet(path).filter("method = 'density'").count() == 4  # older versions stay


def test_newest_model_of_exactly_this_name(spark, tmp_path):
    path, w = str(tmp_path / "m"), np.arange(6.0).reshape(2, 3)
    for hour, name, factor in ((2, "net", 2), (1, "net", 1), (3, "net-t", 3)):
        models.save_model(spark, [w * factor, np.ones(3)], path, name, datetime(2024, 1, 1, hour, tzinfo=timezone.utc))
    loaded = models.load_model(spark, path, "net")
    assert np.allclose(loaded[0], 2 * w) and loaded[1].shape == (3,)
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, path, "other")
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, str(tmp_path / "none"), "net")


def test_scratch_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.scratch_root(spark) == named.rstrip("/")
    else:
        assert session.scratch_root(spark)


def test_model_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(session, "MODEL_BYTES_LIMIT", 64)
    with pytest.raises(ValueError, match="limit"):
        session.ship(spark, np.zeros(9))


def test_labeled_and_unlabeled_are_a_partition(spark, make_points):
    p = make_points(np.arange(20).reshape(10, 2))
    picked = spark.createDataFrame([(3,), (8,), (99,)], "row_id long")
    lab = {r["row_id"] for r in sets.labeled_rows(p, picked).collect()}
    rest = {r["row_id"] for r in sets.unlabeled_rows(p, picked).collect()}
    assert lab == {3, 8} and lab | rest == set(range(10)) and not lab & rest
    assert {r["row_id"] for r in sets.unlabeled_ids(p, picked).collect()} == rest
    assert sets.all_but_last(p).count() == 9


def test_rows_without_label_stay_without_code(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "row_id long, label int")
    assert {r["row_id"]: r["code"] for r in sets.with_label_code(df).collect()} == {1: 0, 2: None, 3: 1}


def test_duplicates_and_codes(spark):
    df = spark.createDataFrame([(1, [1, 0]), (2, [0, 1]), (3, [1, 0])], "row_id long, label array<int>")
    assert [(r["label"], r["n"]) for r in sets.duplicates(df, "label").collect()] == [([1, 0], 2)]
    assert {tuple(r["label"]): r["code"] for r in sets.label_codes(df).collect()} == {(0, 1): 0, (1, 0): 1}
    assert sets.with_label_code(df).filter(F.col("code") == 1).count() == 2
    assert sets.distinct_classes(df).first()["n_classes"] == 2
