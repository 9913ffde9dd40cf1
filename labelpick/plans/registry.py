"""Registered queries: a Spark function on the given tables and, where SQL can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpick.functions import random as R
from labelpick.operators import cluster
from labelpick.sources.tables import as_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

N_CLUSTERS, N_CLASSES, N_HEADS, SCALE = 8, 10, 3, 100.0


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


# ---- Spark inputs ---------------------------------------------------------------------------------------------------

def points(spark: SparkSession, folder: str) -> DataFrame:
    return as_points(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", "label")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def class_means(p: DataFrame) -> np.ndarray:
    return cluster.means_by_key(p, N_CLASSES, "label")


def fixed_heads(p: DataFrame) -> list[np.ndarray]:
    means = class_means(p).T * SCALE
    return [np.stack([means * (1 + h / 2) for h in range(N_HEADS)]), np.zeros((N_HEADS, N_CLASSES))]


def fixed_layers(p: DataFrame) -> list[np.ndarray]:
    return [class_means(p).T * SCALE, np.zeros(N_CLASSES)]


def first_centers(p: DataFrame) -> np.ndarray:
    return cluster.first_rows(p, N_CLUSTERS)


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long_array(df: DataFrame, column: str, *keep: str, position: str = "j", value: str = "value") -> DataFrame:
    return df.select(*keep, F.posexplode(column).alias(position, value)).withColumn(value, r6(value))


# ---- SQL pieces -----------------------------------------------------------------------------------------------------

E = "e AS MATERIALIZED (SELECT vec_id AS row_id, embedding::DOUBLE[] AS x, label FROM embeddings)"
FLAT = "flat AS MATERIALIZED (SELECT row_id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM e)"


def sround(expression: str) -> str:
    return f"(CASE WHEN round({expression}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expression}, 6) END)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def start_centers(name: str = "c0", n: int = N_CLUSTERS) -> str:
    return (f"{name} AS MATERIALIZED (SELECT (n - 1)::INTEGER AS k, x AS c FROM "
            f"(SELECT row_number() OVER (ORDER BY row_id) AS n, x FROM e) WHERE n <= {n})")


def sql_assign(name: str, centers: str, rows: str = "e") -> str:
    return (f"{name} AS MATERIALIZED (SELECT row_id, arg_min(k, {{'d': d, 'k': k}}) AS k, min(d) AS d FROM "
            f"(SELECT row_id, k, list_distance(x, c) AS d FROM {rows}, {centers}) GROUP BY row_id)")


def sql_move(name: str, assigned: str, centers: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM {centers} o LEFT JOIN "
            f"(SELECT k, list(v ORDER BY j) AS c FROM (SELECT k, j, avg(v) AS v FROM {assigned} JOIN flat USING (row_id) "
            f"GROUP BY k, j) GROUP BY k) m USING (k))")


def sql_lloyd(steps: int) -> list[str]:
    parts = [E, FLAT, start_centers()]
    for i in range(steps):
        parts += [sql_assign(f"a{i}", f"c{i}"), sql_move(f"c{i + 1}", f"a{i}", f"c{i}")]
    return parts + [sql_assign("a", f"c{steps}")]


MU = ("mu AS MATERIALIZED (SELECT k, list(v ORDER BY j) AS c FROM (SELECT label AS k, j, avg(v) AS v FROM flat "
      "GROUP BY label, j) GROUP BY k)")
HEAD_Z = (f"z AS MATERIALIZED (SELECT row_id, head::INTEGER AS head, k::INTEGER AS target, "
          f"list_inner_product(x, c) * {SCALE} * (1 + head / 2.0::DOUBLE) AS z "
          f"FROM e, mu, (SELECT unnest(range({N_HEADS})) AS head))")
LINEAR_Z = f"z AS MATERIALIZED (SELECT row_id, label, k::INTEGER AS j, list_inner_product(x, c) * {SCALE} AS z FROM e, mu)"


def sql_softmax(name: str, source: str, group: str) -> str:
    """Adds p and log_p to long-form logits."""
    return (f"{name} AS MATERIALIZED (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY {group}) AS p, "
            f"z - top - ln(sum(exp(z - top)) OVER (PARTITION BY {group})) AS log_p FROM "
            f"(SELECT *, max(z) OVER (PARTITION BY {group}) AS top FROM {source}))")


def sql_uniform(row_id: str, position: str, draw: int = 0, seed: int = 0) -> str:
    x = (f"((({row_id})::BIGINT % {R.PRIME}) * {R.ID_STEP} + ((({row_id})::BIGINT // {R.PRIME}) % {R.PRIME}) * "
         f"{R.HIGH_STEP} + ({position})::BIGINT * {R.POS_STEP} + {draw * R.DRAW_STEP + seed}) % {R.PRIME}")
    for _ in range(R.ROUNDS):
        x = f"((({x}) * ({x})) % {R.PRIME} + ({x}) * {R.ROUND_FACTOR} + {R.ROUND_STEP}) % {R.PRIME}"
    return f"(({x}) / {float(R.PRIME)}::DOUBLE)"


def sql_noise(name: str, rows: str, dim: int, draw: int, seed: int = 0) -> str:
    """(row_id, j, g): standard normal numbers for rows with a row_id and position j."""
    return (f"{name} AS MATERIALIZED (SELECT row_id, j, sqrt(-2 * ln(greatest(u1, 1.0::DOUBLE / {R.PRIME}))) * "
            f"cos(2 * pi() * u2) AS g FROM (SELECT row_id, j, {sql_uniform('row_id', 'j', draw, seed)} AS u1, "
            f"{sql_uniform('row_id', f'j + {dim}', draw, seed)} AS u2 FROM {rows}))")


def sql_batches(name: str, rows: str, size: int, seed: int = 0) -> str:
    from labelpick.operators.batches import SHUFFLE_DRAW

    return (f"{name} AS MATERIALIZED (SELECT *, (n - 1) // {size} AS batch, ((n - 1) % {size})::INTEGER AS pos FROM "
            f"(SELECT *, row_number() OVER (ORDER BY {sql_uniform('row_id', '0', SHUFFLE_DRAW, seed)}, row_id) AS n "
            f"FROM {rows}))")
