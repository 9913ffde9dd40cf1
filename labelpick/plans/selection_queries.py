"""Tables, clustering and selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelpick.functions import random as R
from labelpick.operators import batches, cluster, density, repulsion, scale, seeding, select, sets
from labelpick.plans.registry import (E, FLAT, MU, N_CLASSES, N_CLUSTERS, _with, class_means, first_centers, long_array, points,
                                      query, r6, sql_assign, sql_batches, sql_lloyd, sql_move, sql_uniform, sround, start_centers,
                                      table)
from labelpick.session import materialize, scratch_path, small_side
from labelpick.sources.selections import load_selection, save_selection, select_or_load
from labelpick.sources.tables import as_points, load_split, partition_data, read_table, write_splits

STEPS, NEIGHBORS, EPSILON, ALPHA, M_REG, LAMBDA, ROUNDS = 3, 10, 1e-5, 0.75, 0.9, 0.5, 10
_SPLIT_SQL = "CASE WHEN label <= 6 THEN 'train' WHEN label <= 8 THEN 'val' ELSE 'test' END"


def _with_split(df):
    """The split column of the input table: a fixed function of the label."""
    part = F.when(F.col("label") <= 6, "train").when(F.col("label") <= 8, "val").otherwise("test")
    return df.withColumn("dataset", part)


def _fit(p):
    return cluster.lloyd(p, first_centers(p), STEPS)


# ---- sources and sinks ----------------------------------------------------------------------------------------------

@query("read_embeddings", _with(E, FLAT) + f"""
SELECT count(DISTINCT row_id) AS n_rows, count(*) AS n_values, {sround('sum(v)')} AS total FROM flat""")
def read_embeddings(spark, folder):
    p = as_points(read_table(spark, f"{folder}/embeddings.parquet"), "vec_id")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return p.agg(F.count("row_id").alias("n_rows"), F.sum(F.size("embedding")).cast("long").alias("n_values"),
                 r6(F.sum(total)).alias("total"))


@query("split_counts", f"SELECT {_SPLIT_SQL} AS dataset, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1")
def split_counts(spark, folder):
    parts = partition_data(_with_split(table(spark, folder, "embeddings")), "dataset")
    counted = [df.groupBy("dataset").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
               for df in parts.values()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("write_splits", f"SELECT {_SPLIT_SQL} AS dataset, count(*) AS n, sum(vec_id)::BIGINT AS id_sum "
                       f"FROM embeddings GROUP BY 1")
def write_and_count(spark, folder):
    path = scratch_path(spark, "splits")
    write_splits(_with_split(table(spark, folder, "embeddings")), path)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count("*").alias("n"), F.sum("vec_id").alias("id_sum"))


@query("load_split", _with(E) + f"""
SELECT {_SPLIT_SQL} AS dataset, row_id, label, CASE WHEN label > 6 THEN (row_id % 10)::INTEGER END AS baseline,
       {sround('list_sum(x)')} AS x_sum FROM e""")
def load_each_split(spark, folder):
    raw = _with_split(table(spark, folder, "embeddings")).withColumn("guess", (F.col("vec_id") % 10).cast("int"))
    out = None
    for part in ("train", "val", "test"):
        rows = load_split(raw, part, id_col="vec_id", baseline_col="guess")
        if "baseline" not in rows.columns:
            rows = rows.withColumn("baseline", F.lit(None).cast("int"))
        total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
        rows = rows.select(F.lit(part).alias("dataset"), "row_id", "label", "baseline", r6(total).alias("x_sum"))
        out = rows if out is None else out.unionByName(rows)
    return out


_FIRST_SQL = _with(*sql_lloyd(STEPS))


@query("selection_round_trip", _FIRST_SQL + """
SELECT 'run-1' AS run_id, 'density' AS method, min(row_id) AS row_id, k AS cluster FROM a GROUP BY k""")
def selection_round_trip(spark, folder):
    p = points(spark, folder)
    picks = select.first_members(cluster.assign_nearest(p, _fit(p).centroids))
    path = scratch_path(spark, "selections")
    for run_id in ("run-1", "run-10"):
        save_selection(picks.withColumnRenamed("k", "cluster"), path, run_id, "density")
    return load_selection(spark, path, "run-1", "density").select("run_id", "method", "row_id", "cluster")


@query("selection_reuse", _FIRST_SQL + "SELECT min(row_id) AS row_id, k AS cluster, 1 AS computed FROM a GROUP BY k")
def selection_reuse(spark, folder):
    p, path, calls = points(spark, folder), scratch_path(spark, "selections"), []

    def compute():
        calls.append(1)
        return select.first_members(cluster.assign_nearest(p, _fit(p).centroids)).withColumnRenamed("k", "cluster")

    for _ in range(2):
        stored = select_or_load(spark, path, "run", "density", compute)
    return stored.select("row_id", "cluster", F.lit(len(calls)).alias("computed"))


# ---- scaling and small sets -----------------------------------------------------------------------------------------

@query("standardize", _with(E, FLAT) + f"""
SELECT row_id, j::INTEGER AS j, {sround('(v - avg(v) OVER (PARTITION BY j)) / nullif(stddev_pop(v) OVER (PARTITION BY j), 0)')}
  AS value FROM flat""")
def standardize(spark, folder):
    return long_array(scale.standardize(points(spark, folder)), "embedding", "row_id")


@query("minmax", _with(E, FLAT) + f"""
SELECT row_id, j::INTEGER AS j, {sround('(v - min(v) OVER (PARTITION BY j)) / nullif(max(v) OVER (PARTITION BY j) - min(v) OVER (PARTITION BY j), 0)')}
  AS value FROM flat""")
def minmax(spark, folder):
    return long_array(scale.min_max_scale(points(spark, folder)), "embedding", "row_id")


@query("center", _with(E, FLAT) + f"""
SELECT row_id, j::INTEGER AS j, {sround('v - avg(v) OVER (PARTITION BY j)')} AS value FROM flat""")
def center(spark, folder):
    return long_array(scale.center(points(spark, folder)), "embedding", "row_id")


@query("just_ssl_rows", "SELECT vec_id AS row_id, label FROM embeddings WHERE vec_id < (SELECT max(vec_id) FROM embeddings)")
def just_ssl_rows(spark, folder):
    return sets.all_but_last(points(spark, folder)).select("row_id", "label")


def _picks(p):
    return select.first_members(cluster.assign_nearest(p, _fit(p).centroids))


@query("labeled_semi", _FIRST_SQL + f"""
SELECT row_id, label, {sround('list_sum(x)')} AS x_sum FROM e WHERE row_id IN (SELECT min(row_id) FROM a GROUP BY k)""")
def labeled_semi(spark, folder):
    p = points(spark, folder)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return sets.labeled_rows(p, _picks(p)).select("row_id", "label", r6(total).alias("x_sum"))


@query("unlabeled_anti", _FIRST_SQL + f"""
SELECT row_id, {sround('list_sum(x)')} AS x_sum FROM e WHERE row_id NOT IN (SELECT min(row_id) FROM a GROUP BY k)""")
def unlabeled_anti(spark, folder):
    p = points(spark, folder)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return sets.unlabeled_rows(p, _picks(p)).select("row_id", r6(total).alias("x_sum"))


@query("unlabeled_ids", _FIRST_SQL + "SELECT row_id FROM e EXCEPT SELECT min(row_id) FROM a GROUP BY k")
def unlabeled_ids(spark, folder):
    p = points(spark, folder)
    return sets.unlabeled_ids(p, _picks(p))


@query("stack_rows", _FIRST_SQL + """, picked AS (SELECT min(row_id) AS row_id FROM a GROUP BY k)
SELECT row_id, 1 AS labeled, label FROM e WHERE row_id IN (SELECT row_id FROM picked)
UNION ALL SELECT row_id, 0, NULL FROM e WHERE row_id NOT IN (SELECT row_id FROM picked)""")
def stack_rows(spark, folder):
    p = points(spark, folder)
    labeled, rest = sets.split_rows(p, _picks(p))
    labeled = labeled.select("row_id", F.lit(1).alias("labeled"), "label")
    rest = rest.select("row_id", F.lit(0).alias("labeled"), F.lit(None).cast("int").alias("label"))
    return sets.stack(labeled, rest)


@query("duplicate_labels", "SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1")
def duplicate_labels(spark, folder):
    return sets.duplicates(points(spark, folder), "label")


@query("duplicate_texts", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, folder):
    return sets.duplicates(table(spark, folder, "documents"), "text")


@query("distinct_classes", "SELECT count(DISTINCT label) AS n_classes FROM embeddings")
def distinct_classes(spark, folder):
    return sets.distinct_classes(points(spark, folder))


@query("label_codes", "SELECT vec_id AS row_id, label, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS code FROM embeddings")
def label_codes(spark, folder):
    return sets.with_label_code(points(spark, folder)).select("row_id", "label", "code")


@query("label_codes_multi", """SELECT doc_id, quality, toxic,
  (dense_rank() OVER (ORDER BY quality, toxic) - 1)::INTEGER AS code FROM labels""")
def label_codes_multi(spark, folder):
    rows = table(spark, folder, "labels").withColumn("label", F.array("quality", "toxic"))
    return sets.with_label_code(rows).select("doc_id", "quality", "toxic", "code")


@query("label_codes_null", """SELECT row_id, label, CASE WHEN label IS NOT NULL THEN
  (dense_rank() OVER (ORDER BY label NULLS LAST) - 1)::INTEGER END AS code
FROM (SELECT vec_id AS row_id, CASE WHEN vec_id % 3 <> 0 THEN label END AS label FROM embeddings)""")
def label_codes_null(spark, folder):
    """Every third row has no label."""
    rows = points(spark, folder).withColumn("label", F.when(F.col("row_id") % 3 != 0, F.col("label")))
    return sets.with_label_code(rows).select("row_id", "label", "code")


# ---- clustering -----------------------------------------------------------------------------------------------------

@query("assign_nearest", _with(E, start_centers(), sql_assign("a", "c0")) + f"SELECT row_id, k, {sround('d')} AS d FROM a")
def assign_nearest(spark, folder):
    p = points(spark, folder)
    return cluster.assign_nearest(p, first_centers(p)).select("row_id", "k", r6("d").alias("d"))


@query("center_distances", _with(E, start_centers()) + f"""
SELECT row_id, k, {sround('list_distance(x, c)')} AS d FROM e, c0""")
def center_distances(spark, folder):
    p = points(spark, folder)
    return cluster.center_distances(p, first_centers(p)).select("row_id", "k", r6("d").alias("d"))


@query("lloyd_3", _FIRST_SQL + f"""
SELECT k, (generate_subscripts(c, 1) - 1)::INTEGER AS j, {sround('unnest(c)')} AS value FROM c{STEPS}""")
def lloyd_3(spark, folder):
    p = points(spark, folder)
    return long_array(cluster.centroid_table(spark, _fit(p).centroids), "c", "k")


@query("lloyd_assignment", _FIRST_SQL + f"SELECT row_id, k, {sround('d')} AS d FROM a")
def lloyd_assignment(spark, folder):
    p = points(spark, folder)
    return cluster.assign_nearest(p, _fit(p).centroids).select("row_id", "k", r6("d").alias("d"))


# more passes than any of the tables needs from these starts; passes behind convergence change nothing
ENOUGH = 60


@query("lloyd_converged", _with(*sql_lloyd(ENOUGH)) + f"""
SELECT k, (generate_subscripts(c, 1) - 1)::INTEGER AS j, {sround('unnest(c)')} AS value, true AS converged FROM c{ENOUGH}""")
def lloyd_converged(spark, folder):
    p = points(spark, folder)
    fit = cluster.fit_clusters(p, N_CLUSTERS, "lloyd", "first", tol=1e-9)
    rows = long_array(cluster.centroid_table(spark, fit.centroids), "c", "k")
    return rows.withColumn("converged", F.lit(fit.converged))


def _sql_fuzzy(steps):
    parts = [E, FLAT, start_centers()]
    for i in range(steps):
        parts += [
            f"d{i} AS MATERIALIZED (SELECT row_id, k, list_distance(x, c) AS d FROM e, c{i})",
            f"u{i} AS MATERIALIZED (SELECT row_id, k, w / sum(w) OVER (PARTITION BY row_id) AS u FROM (SELECT *, "
            f"CASE WHEN low = 0 THEN (d = 0)::INTEGER::DOUBLE ELSE 1 / (d * d) END AS w FROM (SELECT *, "
            f"min(d) OVER (PARTITION BY row_id) AS low FROM d{i})))",
            f"c{i + 1} AS MATERIALIZED (SELECT k, list(v ORDER BY j) AS c FROM (SELECT k, j, "
            f"sum(u * u * v) / sum(u * u) AS v FROM u{i} JOIN flat USING (row_id) GROUP BY k, j) GROUP BY k)",
        ]
    return parts


@query("fcm_2", _with(*_sql_fuzzy(2)) + f"""
SELECT k, (generate_subscripts(c, 1) - 1)::INTEGER AS j, {sround('unnest(c)')} AS value FROM c2""")
def fcm_2(spark, folder):
    p = points(spark, folder)
    return long_array(cluster.centroid_table(spark, cluster.fuzzy_cmeans(p, first_centers(p), 2).centroids), "c", "k")


def _sql_minibatch(steps, size, per_pass=3):
    """``size`` rows make a batch; step i takes batch i modulo ``per_pass``."""
    parts = [E, FLAT, sql_batches("b", "e", size, 42), start_centers("s0"),
             "c0 AS MATERIALIZED (SELECT k, c, 0::BIGINT AS seen FROM s0)"]
    for i in range(steps):
        parts += [
            f"now{i} AS MATERIALIZED (SELECT row_id, x FROM b WHERE batch = {i % per_pass})",
            sql_assign(f"a{i}", f"c{i}", f"now{i}"),
            f"n{i} AS MATERIALIZED (SELECT k, count(*) AS n FROM a{i} GROUP BY k)",
            f"c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c, o.seen + coalesce(n, 0) AS seen FROM c{i} o "
            f"LEFT JOIN n{i} USING (k) LEFT JOIN (SELECT k, list(v ORDER BY j) AS c FROM (SELECT a.k, f.j, "
            f"(any_value(o.c[f.j + 1]) * any_value(o.seen) + sum(f.v)) / (any_value(o.seen) + count(*)) AS v "
            f"FROM a{i} a JOIN flat f USING (row_id) JOIN c{i} o ON o.k = a.k GROUP BY a.k, f.j) GROUP BY k) m USING (k))",
        ]
    return parts


@query("fcm_converged", _with(*_sql_fuzzy(ENOUGH)) + f"""
SELECT k, (generate_subscripts(c, 1) - 1)::INTEGER AS j, {sround('unnest(c)')} AS value, true AS converged FROM c{ENOUGH}""")
def fcm_converged(spark, folder):
    p = points(spark, folder)
    fit = cluster.fit_clusters(p, N_CLUSTERS, "fuzzy", "first", tol=1e-9)
    rows = long_array(cluster.centroid_table(spark, fit.centroids), "c", "k")
    return rows.withColumn("converged", F.lit(fit.converged))


_THIRD = "(SELECT (count(*) + 2) // 3 FROM e)"


@query("minibatch_3", _with(*_sql_minibatch(3, _THIRD)) + f"""
SELECT k, (generate_subscripts(c, 1) - 1)::INTEGER AS j, {sround('unnest(c)')} AS value FROM c3""")
def minibatch_3(spark, folder):
    """One pass over the whole table in three batches."""
    p = points(spark, folder)
    fit = cluster.minibatch_kmeans(p, first_centers(p), -(-p.count() // 3), max_passes=1, tol=0.0)
    return long_array(cluster.centroid_table(spark, fit.centroids), "c", "k")


def _sql_minibatch_restarts(restarts, passes, share):
    """``passes`` over the same three batches, all restarts side by side; starved centers are drawn anew in between."""
    first = sql_uniform("row_id", "0", cluster.INIT_DRAW, 0)
    parts = [E, FLAT, sql_batches("b", "e", _THIRD, 42),
             f"c0 AS MATERIALIZED (SELECT ((n - 1) // {N_CLUSTERS})::INTEGER AS r, ((n - 1) % {N_CLUSTERS})::INTEGER AS k, x AS c, "
             f"0::BIGINT AS seen FROM (SELECT row_number() OVER (ORDER BY {first}, row_id) AS n, x FROM e) "
             f"WHERE n <= {N_CLUSTERS * restarts})"]
    for i in range(3 * passes):
        parts += [
            f"a{i} AS MATERIALIZED (SELECT row_id, r, arg_min(k, {{'d': d, 'k': k}}) AS k FROM (SELECT b.row_id, r, k, "
            f"list_distance(x, c) AS d FROM b, c{i} WHERE batch = {i % 3}) GROUP BY row_id, r)",
            f"n{i} AS MATERIALIZED (SELECT r, k, count(*) AS n FROM a{i} GROUP BY r, k)",
            f"m{i} AS MATERIALIZED (SELECT r, k, list(v ORDER BY j) AS c FROM (SELECT a.r, a.k, f.j, (any_value(o.c[f.j + 1]) * "
            f"any_value(o.seen) + sum(f.v)) / (any_value(o.seen) + count(*)) AS v FROM a{i} a JOIN flat f USING (row_id) JOIN "
            f"c{i} o ON o.k = a.k AND o.r = a.r GROUP BY a.r, a.k, f.j) GROUP BY r, k)",
            f"t{i} AS MATERIALIZED (SELECT o.r, o.k, coalesce(m.c, o.c) AS c, o.seen + coalesce(n, 0) AS seen FROM c{i} o "
            f"LEFT JOIN n{i} USING (r, k) LEFT JOIN m{i} m USING (r, k))"]
        if i % 3 < 2 or i == 3 * passes - 1:
            parts.append(f"c{i + 1} AS (SELECT * FROM t{i})")
            continue
        u = sql_uniform("e.row_id", f"(s.r * {N_CLUSTERS} + s.k)", cluster.REDRAW + i // 3 + 1, 42)
        parts += [
            f"few{i} AS MATERIALIZED (SELECT r, k, seen < {share} * max(seen) OVER (PARTITION BY r) AS few, c, seen FROM t{i})",
            f"drawn{i} AS MATERIALIZED (SELECT s.r, s.k, arg_min(e.x, {{'u': {u}, 'i': e.row_id}}) AS c FROM few{i} s, e "
            f"WHERE few GROUP BY s.r, s.k)",
            f"c{i + 1} AS MATERIALIZED (SELECT f.r, f.k, coalesce(d.c, f.c) AS c, CASE WHEN few THEN (SELECT min(seen) FROM few{i} g "
            f"WHERE g.r = f.r AND NOT few) ELSE seen END AS seen FROM few{i} f LEFT JOIN drawn{i} d USING (r, k))"]
    return parts + [f"best AS (SELECT arg_min(r, cost) AS r FROM (SELECT r, sum(d * d) AS cost FROM (SELECT row_id, r, "
                    f"min(list_distance(x, c)) AS d FROM e, c{3 * passes} GROUP BY row_id, r) GROUP BY r))"]


MINIBATCH_RESTARTS, STARVED = 3, 0.7


@query("minibatch_restarts", _with(*_sql_minibatch_restarts(MINIBATCH_RESTARTS, 2, STARVED)) + f"""
SELECT k, (generate_subscripts(c, 1) - 1)::INTEGER AS j, {sround('unnest(c)')} AS value FROM c6 JOIN best USING (r)""")
def minibatch_restarts(spark, folder):
    """Three starts share the dealt batches over two passes; the share is high, so that some centers are drawn anew."""
    p = points(spark, folder)
    starts = cluster.random_rows(p, N_CLUSTERS, MINIBATCH_RESTARTS)
    fit = cluster.minibatch_kmeans(p, starts, -(-p.count() // 3), max_passes=2, tol=0.0, reassign=STARVED)
    return long_array(cluster.centroid_table(spark, fit.centroids), "c", "k")


SEED_ROUNDS, SEED_FACTOR = 3, 2.0


def _sql_seeds(restart=0, n=N_CLUSTERS, rounds=SEED_ROUNDS, factor=SEED_FACTOR):
    """Parallel seeding with the same draws: seeds (k, c). ``cand`` are the candidates, ``pick`` those drawn of them."""
    parts = [f"cand0 AS MATERIALIZED (SELECT row_id, x FROM e ORDER BY "
             f"{sql_uniform('row_id', restart, seeding.FIRST_DRAW)}, row_id LIMIT 1)"]
    for i in range(rounds):
        u = sql_uniform("row_id", str(restart * seeding.ROUND_STEP + i), seeding.ROUND_DRAW)
        parts += [
            f"far{i} AS MATERIALIZED (SELECT e.row_id, pow(min(list_distance(e.x, c.x)), 2) AS d2 FROM e, cand{i} c GROUP BY e.row_id)",
            f"race{i} AS MATERIALIZED (SELECT row_id, {u} / d2 AS t FROM far{i} WHERE d2 > 0)",
            f"cand{i + 1} AS MATERIALIZED (SELECT row_id, x FROM cand{i} UNION ALL SELECT row_id, x FROM race{i} JOIN e USING "
            f"(row_id) WHERE t < {factor * n} / (SELECT sum(d2) FROM far{i}) OR t = (SELECT min(t) FROM race{i}))"]
    parts.append(f"weight AS MATERIALIZED (SELECT row_id, count(*) AS w FROM (SELECT arg_min(c.row_id, list_distance(e.x, c.x)) "
                 f"AS row_id FROM e, cand{rounds} c GROUP BY e.row_id) GROUP BY row_id)")
    for j in range(n):
        clock = f"-ln(greatest({sql_uniform('c.row_id', str(restart * n + j), seeding.PICK_DRAW)}, 1.0::DOUBLE / {R.PRIME}))"
        rate = "w" if j == 0 else f"w * (SELECT min(pow(list_distance(c.x, p.x), 2)) FROM pick{j - 1} p)"
        earlier = "" if j == 0 else f"SELECT k, row_id, x FROM pick{j - 1} UNION ALL "
        parts.append(f"pick{j} AS MATERIALIZED ({earlier}SELECT {j} AS k, row_id, x FROM (SELECT c.row_id, c.x, {clock} / "
                     f"nullif({rate}, 0) AS t FROM cand{rounds} c JOIN weight USING (row_id)) WHERE t IS NOT NULL "
                     f"QUALIFY row_number() OVER (ORDER BY t, row_id) = 1)")
    return parts


@query("seed_parallel", _with(E, *_sql_seeds(), *[p.replace("cand", "acand").replace("far", "afar").replace("race", "arace")
       .replace("weight", "aweight").replace("pick", "apick") for p in _sql_seeds(1)]) + f"""
SELECT start, k, row_id, (generate_subscripts(x, 1) - 1)::INTEGER AS j, {sround('unnest(x)')} AS value FROM (
  SELECT 0 AS start, * FROM pick{N_CLUSTERS - 1} UNION ALL SELECT 1, * FROM apick{N_CLUSTERS - 1})""")
def seed_parallel(spark, folder):
    """Two starts; every center is a row of the table, found again by its values."""
    p = points(spark, folder)
    starts = seeding.seed_parallel(p, N_CLUSTERS, 2, SEED_ROUNDS, SEED_FACTOR)
    rows = [(s, k, c.tolist()) for s, centers in enumerate(starts) for k, c in enumerate(centers)]
    seeds = spark.createDataFrame(rows, "start int, k int, c array<double>")
    found = seeds.join(p.select("row_id", F.col("embedding").cast("array<double>").alias("c")), "c")
    return long_array(found, "c", "start", "k", "row_id")


RESTARTS, RESTART_STEPS = 5, 4


def _sql_restarts(restarts, steps):
    """All restarts side by side: centers carry the restart number."""
    draw = sql_uniform("row_id", "0", cluster.INIT_DRAW, 0)
    parts = [E, FLAT, f"c0 AS MATERIALIZED (SELECT ((n - 1) // {N_CLUSTERS})::INTEGER AS r, ((n - 1) % {N_CLUSTERS})::INTEGER "
                      f"AS k, x AS c FROM (SELECT row_number() OVER (ORDER BY {draw}, row_id) AS n, x FROM e) "
                      f"WHERE n <= {N_CLUSTERS * restarts})"]
    for i in range(steps + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT row_id, r, arg_min(k, {{'d': d, 'k': k}}) AS k, min(d) AS d FROM "
                     f"(SELECT row_id, r, k, list_distance(x, c) AS d FROM e, c{i}) GROUP BY row_id, r)")
        if i < steps:
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.r, o.k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT r, k, "
                         f"list(v ORDER BY j) AS c FROM (SELECT r, k, j, avg(v) AS v FROM a{i} JOIN flat USING (row_id) "
                         f"GROUP BY r, k, j) GROUP BY r, k) m USING (r, k))")
    return parts + [f"best AS (SELECT arg_min(r, cost) AS r FROM (SELECT r, sum(d * d) AS cost FROM a{steps} GROUP BY r))"]


@query("kmeans_restarts", _with(*_sql_restarts(RESTARTS, RESTART_STEPS)) + f"""
SELECT k, count(*) AS n, {sround('avg(d)')} AS mean_d FROM a{RESTART_STEPS} JOIN best USING (r) GROUP BY k""")
def kmeans_restarts(spark, folder):
    p = points(spark, folder)
    fit = cluster.fit_clusters(p, N_CLUSTERS, "lloyd", "random", n_init=RESTARTS, max_iter=RESTART_STEPS, tol=0.0)
    return cluster.assign_nearest(p, fit.centroids).groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_d"))


@query("kmeans_mllib")
def kmeans_mllib(spark, folder):
    p = points(spark, folder)
    fit = cluster.fit_clusters(p, N_CLUSTERS, "mllib", n_init=2, max_iter=10)
    return cluster.assign_nearest(p, fit.centroids).groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_d"))


@query("class_distance", _with(E, FLAT, MU) + f"""
SELECT row_id, {sround('list_distance(x, c)')} AS d FROM e JOIN mu ON mu.k = e.label""")
def class_distance(spark, folder):
    from labelpick.functions.vectors import doubles, euclidean

    p = points(spark, folder)
    means = cluster.centroid_table(spark, class_means(p))
    return p.join(small_side(means, N_CLASSES), F.col("label") == F.col("k")).select(
        "row_id", r6(euclidean(doubles("embedding"), F.col("c"))).alias("d"))


@query("nearest_to_center", _FIRST_SQL + f"""
SELECT k, arg_min(row_id, {{'d': d, 'r': row_id}}) AS row_id, {sround('min(d)')} AS d
FROM (SELECT row_id, k, list_distance(x, c) AS d FROM e, c{STEPS}) GROUP BY k""")
def nearest_to_center(spark, folder):
    p = points(spark, folder)
    return cluster.nearest_to_center(p, _fit(p).centroids).select("k", "row_id", r6("d").alias("d"))


# ---- selection ------------------------------------------------------------------------------------------------------

_DENSITY = (f"dens AS MATERIALIZED (SELECT k, 1 / (avg(d) + {EPSILON}) AS density FROM (SELECT k, d, row_number() OVER "
            f"(PARTITION BY k ORDER BY d, row_id) AS rn FROM a) WHERE rn <= {NEIGHBORS} GROUP BY k)")
_PICK = "pick AS MATERIALIZED (SELECT k, row_id, x FROM (SELECT k, min(row_id) AS row_id FROM a GROUP BY k) JOIN e USING (row_id))"
_TERM = f"1 / (pow(list_distance(p.x, s.x), {ALPHA}) + {EPSILON})"


def _push(condition):
    return (f"push AS MATERIALIZED (SELECT p.k, p.row_id, coalesce(sum({_TERM}), 0) AS rep FROM pick p LEFT JOIN pick s "
            f"ON {condition} GROUP BY p.k, p.row_id)")


_FACTOR = repulsion.ema_factor(M_REG, ROUNDS)
_CHOICE = (f"SELECT k AS cluster, row_id, {sround('density')} AS density, {sround(f'{_FACTOR} * rep')} AS reg, "
           f"{sround(f'density - {LAMBDA} * {_FACTOR} * rep')} AS score FROM push JOIN dens USING (k)")
_OPTIONS = dict(k=NEIGHBORS, m_reg=M_REG, lambda_=LAMBDA, epsilon=EPSILON, alpha=ALPHA, rounds=ROUNDS)


def _choice(selected):
    return selected.select("cluster", "row_id", r6("density").alias("density"), r6("reg").alias("reg"),
                           r6("score").alias("score"))


@query("cluster_density", _with(*sql_lloyd(STEPS), _DENSITY) + f"SELECT k, {sround('density')} AS density FROM dens")
def cluster_density(spark, folder):
    p = points(spark, folder)
    assigned = cluster.assign_nearest(p, _fit(p).centroids)
    return density.cluster_density(assigned, NEIGHBORS, EPSILON).select("k", r6("density").alias("density"))


MANY_NEIGHBORS = 2_000


@query("cluster_density_large_k", _with(*sql_lloyd(STEPS)) + f"""
SELECT k, {sround(f'1 / (avg(d) + {EPSILON})')} AS density FROM (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) AS rn
  FROM (SELECT k % 2 AS k, d FROM a)) WHERE rn <= {MANY_NEIGHBORS} GROUP BY k""")
def cluster_density_large_k(spark, folder):
    """Two groups of clusters, so that at the larger scales they have more members than neighbors are asked for."""
    p = points(spark, folder)
    assigned = cluster.assign_nearest(p, _fit(p).centroids).withColumn("k", F.col("k") % 2)
    return density.cluster_density(assigned, MANY_NEIGHBORS, EPSILON).select("k", r6("density").alias("density"))


def _pushed(spark, folder, exclude):
    p = points(spark, folder)
    picks = materialize(select.with_embedding(_picks(p).select("k", "row_id"), p), "picks")
    pushed = repulsion.repulsion(picks, picks, ALPHA, EPSILON, exclude)
    return pushed.select("k", "row_id", r6("repulsion").alias("repulsion"))


@query("repulsion", _with(*sql_lloyd(STEPS), _PICK, _push("p.k <> s.k")) + f"""
SELECT k, row_id, {sround('rep')} AS repulsion FROM push""")
def repulsion_sum(spark, folder):
    return _pushed(spark, folder, "cluster")


@query("repulsion_row_vs_cluster", _with(*sql_lloyd(STEPS), _PICK, _push("s.row_id <> p.k")) + f"""
SELECT k, row_id, {sround('rep')} AS repulsion FROM push""")
def repulsion_row_vs_cluster(spark, folder):
    return _pushed(spark, folder, "row_vs_cluster")


@query("select_first_member", _with(*sql_lloyd(STEPS), _DENSITY, _PICK, _push("p.k <> s.k")) + _CHOICE)
def select_first_member(spark, folder):
    return _choice(select.select_density(points(spark, folder), N_CLUSTERS, init="first", max_iter=STEPS, tol=0.0,
                                         **_OPTIONS).selected)


@query("select_fuzzy", _with(*_sql_fuzzy(2), sql_assign("a", "c2"), _DENSITY, _PICK, _push("s.row_id <> p.k")) + _CHOICE)
def select_fuzzy(spark, folder):
    return _choice(select.select_density(points(spark, folder), N_CLUSTERS, init="first", max_iter=2, tol=0.0,
                                         clustering="fuzzy", exclude="row_vs_cluster", **_OPTIONS).selected)


@query("select_minibatch", _with(*_sql_minibatch(3, 10_000, 1), sql_assign("a", "c3"), _DENSITY, _PICK, _push("p.k <> s.k"))
       + _CHOICE)
def select_minibatch(spark, folder):
    return _choice(select.select_density(points(spark, folder), N_CLUSTERS, init="first", max_iter=3, tol=0.0,
                                         clustering="minibatch", seed=42, **_OPTIONS).selected)


@query("select_rows", _with(*sql_lloyd(STEPS), _DENSITY, _PICK, _push("p.k <> s.k")) + f"""
SELECT row_id, k AS cluster, row_number() OVER (ORDER BY k)::INTEGER AS rank,
       {sround(f'density - {LAMBDA} * {_FACTOR} * rep')} AS score FROM push JOIN dens USING (k)""")
def select_rows(spark, folder):
    rows = select.select_rows(points(spark, folder), "density", N_CLUSTERS, init="first", max_iter=STEPS, tol=0.0, **_OPTIONS)
    return rows.withColumn("score", r6("score"))


def _sql_spread(steps):
    """Lloyd from the seeds of ``_sql_seeds``."""
    parts = [E, FLAT, *_sql_seeds(), f"c0 AS MATERIALIZED (SELECT k::INTEGER AS k, x AS c FROM pick{N_CLUSTERS - 1})"]
    for i in range(steps):
        parts += [sql_assign(f"a{i}", f"c{i}"), sql_move(f"c{i + 1}", f"a{i}", f"c{i}")]
    return parts + [sql_assign("a", f"c{steps}")]


@query("select_spread", _with(*_sql_spread(STEPS), _DENSITY, _PICK, _push("p.k <> s.k")) + f"""
SELECT row_id, k AS cluster, row_number() OVER (ORDER BY k)::INTEGER AS rank,
       {sround(f'density - {LAMBDA} * {_FACTOR} * rep')} AS score FROM push JOIN dens USING (k)""")
def select_spread(spark, folder):
    """The default start: parallel seeding."""
    rows = select.select_rows(points(spark, folder), "density", N_CLUSTERS, n_init=1, max_iter=STEPS, tol=0.0, **_OPTIONS)
    return rows.withColumn("score", r6("score"))


def _sql_per_point(rounds):
    parts = [
        "m AS MATERIALIZED (SELECT row_id, k, x FROM a JOIN e USING (row_id))",
        f"near AS MATERIALIZED (SELECT p.row_id, list_distance(p.x, q.x) AS d, row_number() OVER (PARTITION BY p.row_id "
        f"ORDER BY list_distance(p.x, q.x)) AS rn FROM m p JOIN m q ON p.k = q.k AND p.row_id <> q.row_id)",
        f"r0 AS MATERIALIZED (SELECT m.row_id, m.k, m.x, 1 / (coalesce(n.d, 0) + {EPSILON}) AS density, 0.0::DOUBLE AS reg "
        f"FROM m LEFT JOIN (SELECT row_id, avg(d) AS d FROM near WHERE rn <= {NEIGHBORS} GROUP BY row_id) n USING (row_id))",
    ]
    for i in range(rounds):
        if i:
            parts.append(
                f"r{i} AS MATERIALIZED (SELECT p.row_id, p.k, any_value(p.x) AS x, any_value(p.density) AS density, "
                f"{M_REG} * any_value(p.reg) + {1 - M_REG} * coalesce(sum({_TERM}), 0) AS reg "
                f"FROM r{i - 1} p LEFT JOIN s{i - 1} s ON p.k <> s.k GROUP BY p.row_id, p.k)")
        utility = f"density - {LAMBDA} * reg"
        parts.append(
            f"s{i} AS MATERIALIZED (SELECT k, row_id, x, density, reg, {utility} AS u FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY k ORDER BY {utility} DESC, row_id) AS rn FROM r{i}) WHERE rn = 1)")
    return parts


@query("row_density", _with(*sql_lloyd(STEPS), *_sql_per_point(1)) + f"""
SELECT k, row_id, {sround('density')} AS density FROM r0""")
def row_density(spark, folder):
    p = points(spark, folder)
    assigned = cluster.assign_nearest(p, _fit(p).centroids, keep=("embedding",))
    return density.row_density(assigned, NEIGHBORS, EPSILON).select("k", "row_id", r6("density").alias("density"))


@query("row_density_small_blocks", _with(*sql_lloyd(STEPS), *_sql_per_point(1)) + f"""
SELECT k, row_id, {sround('density')} AS density FROM r0""")
def row_density_small_blocks(spark, folder):
    """The same numbers with blocks of 24 rows: several pivots per cluster and visits in waves."""
    p = points(spark, folder)
    assigned = cluster.assign_nearest(p, _fit(p).centroids, keep=("embedding",))
    dense = density.row_density(assigned, NEIGHBORS, EPSILON, block_rows=24)
    return dense.select("k", "row_id", r6("density").alias("density"))


@query("select_per_point", _with(*sql_lloyd(STEPS), *_sql_per_point(ROUNDS)) + f"""
SELECT k AS cluster, row_id, {sround('density')} AS density, {sround('reg')} AS reg, {sround('u')} AS score
FROM s{ROUNDS - 1}""")
def select_per_point(spark, folder):
    return _choice(select.select_density(points(spark, folder), N_CLUSTERS, init="first", max_iter=STEPS, tol=0.0,
                                         mode="per_point", **_OPTIONS).selected)


# ---- batches --------------------------------------------------------------------------------------------------------

@query("batch_numbers", _with(E, sql_batches("b", "e", 64, 7)) + "SELECT row_id, batch, pos FROM b")
def batch_numbers(spark, folder):
    return batches.batches(points(spark, folder).select("row_id"), 64, 7).select("row_id", "batch", "pos")


@query("batch_pairing", _with(*sql_lloyd(STEPS), "picked AS (SELECT min(row_id) AS row_id FROM a GROUP BY k)",
                              "u0 AS (SELECT row_id FROM e WHERE row_id NOT IN (SELECT row_id FROM picked))",
                              sql_batches("l", "picked", 4, 0), sql_batches("u", "u0", 64, 1),
                              "sizes AS (SELECT (SELECT max(batch) + 1 FROM l) AS nl, (SELECT max(batch) + 1 FROM u) AS nu)",
                              "pairs AS (SELECT i // nl AS epoch, i AS batch, i % nl AS lb, i % nu AS ub FROM "
                              "(SELECT unnest(range(5 * nl)) AS i, nl, nu FROM sizes))") + """
SELECT epoch, p.batch, 0 AS is_unlabeled, pos, row_id FROM pairs p JOIN l ON l.batch = lb
UNION ALL SELECT epoch, p.batch, 1, pos, row_id FROM pairs p JOIN u ON u.batch = ub""")
def batch_pairing(spark, folder):
    from labelpick.operators.mixmatch import batch_rows

    p = points(spark, folder)
    cols = ("row_id", "embedding", F.lit(None).cast("array<double>").alias("target"))
    labeled, rest = sets.split_rows(p, _picks(p))
    lab = materialize(batches.batches(labeled.select(*cols), 4, 0), "labeled")
    unl = materialize(batches.batches(rest.select(*cols), 64, 1), "unlabeled")
    n_lab, n_unl = (df.agg(F.max("batch")).first()[0] + 1 for df in (lab, unl))
    pairs = batches.pair_batches(spark, n_lab, n_unl, epochs=5)
    return batch_rows(lab, unl, pairs).select("epoch", "batch", "is_unlabeled", "pos", "row_id")
