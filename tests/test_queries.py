import pytest

import __spark_entry__ as entry
from conftest import SMALLEST
from labelpick.plans import registry
from tools import check_queries

NAMES = list(registry.QUERIES)
TRAINING = {"select_heads", "fit_mixmatch_single", "fit_mixmatch_multi", "fit_supervised", "pca_projection",
            "run_density_single", "run_density_multi", "run_heads_onehot", "kmeans_mllib"}


@pytest.fixture(scope="module")
def tables():
    return check_queries.connect(SMALLEST)


def test_every_query_without_sql_is_iterative_training_or_seeded():
    assert set(NAMES) - set(registry.SQL) == TRAINING
    assert set(registry.SQL) <= set(NAMES)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in TRAINING])
def test_query_equals_sql(spark, tables, name):
    rows, problem = check_queries.compare(spark, tables, SMALLEST, name)
    assert problem == "" and rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 8
