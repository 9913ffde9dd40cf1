"""Cluster heads, mixing, gradients, stored models and complete runs."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
from pyspark.sql import functions as F

from labelpick.functions.random import uniform
from labelpick.functions.vectors import one_hot
from labelpick.operators import batches, cluster, heads, mixmatch, nn, project, select, sets, steps
from labelpick.operators.metrics import label_weights
from labelpick.plans.metric_queries import _MLP_SQL, mlp_layers
from labelpick.plans.registry import (E, FLAT, HEAD_Z, LINEAR_Z, MU, N_CLASSES, N_CLUSTERS, N_HEADS, SCALE, _with,
                                      fixed_heads, fixed_layers, long_array, points, query, r6, sql_batches, sql_noise,
                                      sql_softmax, sql_uniform, sround, table)
from labelpick.plans.run import preset, run
from labelpick.session import materialize, scratch_path
from labelpick.sources.models import latest_weights, load_model, save_model
from labelpick.sources.states import Resume

_HEADS = _with(E, FLAT, MU, HEAD_Z, sql_softmax("q", "z", "row_id, head"),
               "best AS MATERIALIZED (SELECT row_id, head, max(p) AS max_prob, arg_min(target, {'p': -p, 't': target}) AS target, "
               "arg_min(log_p, {'p': -p, 't': target}) AS log_p FROM q GROUP BY row_id, head)",
               "sure AS MATERIALIZED (SELECT * FROM best WHERE max_prob > 0.8)")
DIM, STD_DEV, TEMPERATURE, COPIES, SHARE = 64, 0.1, 0.5, 2, 0.75
EMA = np.array([[(1.0 + h + c) for c in range(N_CLASSES)] for h in range(N_HEADS)])
EMA = EMA / EMA.sum(axis=1, keepdims=True)
_EMA_SQL = (f"ema AS (SELECT head, target, (1.0::DOUBLE + head + target) / sum(1.0::DOUBLE + head + target) OVER (PARTITION BY head) AS "
            f"e FROM (SELECT unnest(range({N_HEADS})) AS head), (SELECT unnest(range({N_CLASSES})) AS target))")


def _head_logits(spark, folder):
    p = points(spark, folder)
    return heads.head_logits(p, fixed_heads(p))


# ---- cluster heads --------------------------------------------------------------------------------------------------

@query("head_logits", _HEADS + f"SELECT row_id, head, target AS j, {sround('z')} AS value FROM z")
def head_logits(spark, folder):
    return long_array(_head_logits(spark, folder), "logits", "row_id", "head")


@query("confident_rows", _HEADS + f"SELECT row_id, head, target, {sround('max_prob')} AS max_prob FROM sure")
def confident_rows(spark, folder):
    return heads.confident(_head_logits(spark, folder)).select("row_id", "head", "target", r6("max_prob").alias("max_prob"))


@query("pseudo_class_weights", _HEADS + f"""
SELECT head, target, count(*) AS n, {sround('sum(count(*)) OVER (PARTITION BY head) / count(*)')} AS weight
FROM sure GROUP BY head, target""")
def pseudo_class_weights(spark, folder):
    return heads.pseudo_class_weights(_head_logits(spark, folder)).withColumn("weight", r6("weight"))


@query("pseudo_class_weights_renorm", _HEADS + f"""
SELECT head, target, n, {sround('sum(n) OVER (PARTITION BY head) / n / count(*) OVER (PARTITION BY head)')} AS weight
FROM (SELECT head, target, count(*) AS n FROM sure GROUP BY head, target)""")
def pseudo_class_weights_renorm(spark, folder):
    return heads.pseudo_class_weights(_head_logits(spark, folder), renormalize=True).withColumn("weight", r6("weight"))


@query("count_ema_step", _HEADS + ", " + _EMA_SQL + f"""
SELECT head::INTEGER AS head, target::INTEGER AS target,
  {sround('e * 0.1 + coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY head), 0) * len * 0.9')} AS ema
FROM ema LEFT JOIN (SELECT head, target, count(*) AS n FROM sure GROUP BY head, target) USING (head, target),
     (SELECT count(*) AS len FROM e)""")
def count_ema_step(spark, folder):
    p = points(spark, folder)
    step = heads.count_ema_step(heads.head_logits(p, fixed_heads(p)), EMA, p.count())
    return step.withColumn("ema", r6("ema"))


@query("prob_ema_step", _HEADS + ", " + _EMA_SQL + f""", moved AS (SELECT head, target, any_value(e) * 0.1 + avg(p) * 0.9 AS m
FROM q JOIN ema USING (head, target) GROUP BY head, target)
SELECT head::INTEGER AS head, target::INTEGER AS target, {sround('m / sum(m) OVER (PARTITION BY head)')} AS ema FROM moved""")
def prob_ema_step(spark, folder):
    return heads.prob_ema_step(_head_logits(spark, folder), EMA).withColumn("ema", r6("ema"))


@query("confidence_by_class", _HEADS + f"""
SELECT head, target, count(*) AS n, count(*) FILTER (max_prob > 0.8) AS n_confident, {sround('max(max_prob)')} AS max_confidence
FROM best GROUP BY head, target""")
def confidence_by_class(spark, folder):
    return heads.confidence_by_class(_head_logits(spark, folder)).withColumn("max_confidence", r6("max_confidence"))


@query("mask_rate", _HEADS + f"""
SELECT head, count(*) AS n, count(*) FILTER (max_prob > 0.8) AS n_confident, {sround('avg((max_prob > 0.8)::INTEGER)')} AS rate,
       {sround('avg(max_prob)')} AS mean_max_prob FROM best GROUP BY head""")
def mask_rate(spark, folder):
    return heads.mask_rate(_head_logits(spark, folder)).select(
        "head", "n", "n_confident", r6("rate").alias("rate"), r6("mean_max_prob").alias("mean_max_prob"))


@query("mean_probabilities", _HEADS + f"SELECT head, target, {sround('avg(p)')} AS mean_prob FROM q GROUP BY head, target")
def mean_probabilities(spark, folder):
    return heads.mean_probabilities(_head_logits(spark, folder)).withColumn("mean_prob", r6("mean_prob"))


_LOCAL = ", " + _EMA_SQL + """, lifted AS (SELECT row_id, head, target, log_p, z - 0.1 * ln(e) AS zz FROM q JOIN ema USING (head, target)),
soft AS (SELECT *, exp(2 * (zz - max(zz) OVER (PARTITION BY row_id, head))) AS w FROM lifted),
aim AS MATERIALIZED (SELECT row_id, head, target, log_p, w / sum(w) OVER (PARTITION BY row_id, head) AS t FROM soft),
local_loss AS (SELECT head, avg(kl) AS loss FROM (SELECT row_id, head,
  sum(CASE WHEN t > 0 THEN t * (ln(t) - log_p) ELSE 0 END) AS kl FROM aim GROUP BY row_id, head) GROUP BY head)"""
_GLOBAL = f""", global_loss AS (SELECT head::INTEGER AS head, coalesce(loss, 0) AS loss FROM
  (SELECT unnest(range({N_HEADS})) AS head) LEFT JOIN (SELECT head, avg(ce) AS loss FROM (SELECT head, target, avg(-log_p) AS ce
  FROM sure GROUP BY head, target) GROUP BY head) USING (head))"""


@query("local_loss", _HEADS + _LOCAL + f"SELECT head, {sround('loss')} AS loss FROM local_loss")
def local_loss(spark, folder):
    return heads.local_loss(_head_logits(spark, folder), EMA).withColumn("loss", r6("loss"))


@query("global_loss", _HEADS + _GLOBAL + f"SELECT head, {sround('loss')} AS loss FROM global_loss")
def global_loss(spark, folder):
    return heads.global_loss(_head_logits(spark, folder), N_HEADS).withColumn("loss", r6("loss"))


@query("head_validation_loss", _HEADS + _LOCAL + _GLOBAL + f"""
SELECT {sround('(SELECT sum(loss) FROM local_loss) + (SELECT sum(loss) FROM global_loss)')} AS loss""")
def head_validation_loss(spark, folder):
    p = points(spark, folder)
    loss = heads.head_sums(p, fixed_heads(p), EMA).loss()
    return spark.createDataFrame([(loss,)], "loss double").select(r6("loss").alias("loss"))


@query("head_gradient", _HEADS + _LOCAL + f""", share AS (SELECT head, target, 1.0::DOUBLE / count(*) / count(*) OVER
  (PARTITION BY head) AS s FROM sure GROUP BY head, target),
g AS MATERIALIZED (SELECT row_id, q.head, q.target, (p - t) / (SELECT count(*) FROM e) +
  CASE WHEN s IS NULL THEN 0 ELSE s * (p - (q.target = own)::INTEGER) END AS g
  FROM q JOIN aim USING (row_id, head, target) LEFT JOIN (SELECT row_id, head, target AS own, s FROM sure JOIN share USING (head, target))
  USING (row_id, head))
SELECT head, j::INTEGER AS j, target, {sround('sum(g * v)')} AS value FROM g JOIN flat USING (row_id) GROUP BY head, j, target""")
def head_gradient(spark, folder):
    p = points(spark, folder)
    fixed = fixed_heads(p)
    grad = heads.head_gradient(p, fixed, EMA, heads.head_sums(p, fixed, EMA))[0]
    rows = [(h, j, c, float(v)) for (h, j, c), v in np.ndenumerate(grad)]
    return spark.createDataFrame(rows, "head int, j int, target int, value double").withColumn("value", r6("value"))


@query("head_scores_topn", _HEADS + f""", m AS (SELECT row_id, target, avg(p) AS p FROM q GROUP BY row_id, target),
s AS (SELECT row_id, arg_min(target, {{'p': -p, 't': target}}) AS cluster, max(p) AS score FROM m GROUP BY row_id)
SELECT row_id, cluster, {sround('score')} AS score, row_number() OVER (ORDER BY score DESC, row_id)::INTEGER AS rank
FROM s ORDER BY score DESC, row_id LIMIT 30""")
def head_scores_topn(spark, folder):
    p = points(spark, folder)
    return heads.top_scores(p, fixed_heads(p), 30).withColumn("score", r6("score"))


@query("head_scores", _HEADS + f""", m AS (SELECT row_id, target, avg(p) AS p FROM q GROUP BY row_id, target)
SELECT row_id, arg_min(target, {{'p': -p, 't': target}}) AS cluster, {sround('max(p)')} AS score FROM m GROUP BY row_id""")
def head_scores(spark, folder):
    p = points(spark, folder)
    return heads.head_scores(p, fixed_heads(p)).withColumn("score", r6("score"))


def _sql_head_epoch(n, w, ema, rows="e", flat="flat"):
    """Probabilities, losses and gradient of epoch ``n`` from weights ``w`` (head, target, j, w, b) and ``ema``."""
    return [
        f"z{n} AS MATERIALIZED (SELECT row_id, head, target, sum(v * w) + any_value(b) AS z FROM {flat} JOIN {w} USING (j) "
        f"GROUP BY row_id, head, target)",
        sql_softmax(f"q{n}", f"z{n}", "row_id, head"),
        f"top{n} AS MATERIALIZED (SELECT row_id, head, arg_min(target, {{'p': -p, 't': target}}) AS own, max(p) AS mp, "
        f"arg_min(log_p, {{'p': -p, 't': target}}) AS lp FROM q{n} GROUP BY row_id, head HAVING max(p) > 0.8)",
        f"share{n} AS MATERIALIZED (SELECT head, own, avg(-lp) AS ce, 1.0::DOUBLE / count(*) / count(*) OVER (PARTITION BY head) AS s "
        f"FROM top{n} GROUP BY head, own)",
        f"soft{n} AS MATERIALIZED (SELECT *, exp(2 * (zz - max(zz) OVER (PARTITION BY row_id, head))) AS w FROM (SELECT q.*, "
        f"z - 0.1 * ln(e) AS zz FROM q{n} q JOIN {ema} USING (head, target)))",
        f"aim{n} AS MATERIALIZED (SELECT row_id, head, target, p, log_p, w / sum(w) OVER (PARTITION BY row_id, head) AS t FROM soft{n})",
        f"loss{n} AS MATERIALIZED (SELECT (SELECT sum(CASE WHEN t > 0 THEN t * (ln(t) - log_p) ELSE 0 END) FROM aim{n}) / "
        f"(SELECT count(*) FROM {rows}) + coalesce((SELECT sum(l) FROM (SELECT avg(ce) AS l FROM share{n} GROUP BY head)), 0) AS loss)",
        f"g{n} AS MATERIALIZED (SELECT a.row_id, a.head, a.target, (p - t) / (SELECT count(*) FROM {rows}) + CASE WHEN s IS NULL THEN 0 "
        f"ELSE s * (p - (a.target = o.own)::INTEGER) END AS g FROM aim{n} a LEFT JOIN (SELECT row_id, head, own, s FROM top{n} "
        f"JOIN share{n} USING (head, own)) o USING (row_id, head))",
    ]


_TWO_EPOCHS = _with(
    E, FLAT, MU,
    f"w0 AS MATERIALIZED (SELECT h.head, k AS target, unnest(range({DIM})) AS j, unnest(c) * {SCALE} * (1 + h.head / 2.0::DOUBLE) AS w, "
    f"0.0::DOUBLE AS b FROM mu, (SELECT unnest(range({N_HEADS})) AS head) h)",
    f"ema0 AS (SELECT head, target, 1.0::DOUBLE / {N_CLASSES} AS e FROM (SELECT unnest(range({N_HEADS})) AS head), "
    f"(SELECT unnest(range({N_CLASSES})) AS target))",
    *_sql_head_epoch(0, "w0", "ema0"),
    "gw AS MATERIALIZED (SELECT head, target, j, sum(g * v) AS g FROM g0 JOIN flat USING (row_id) GROUP BY head, target, j)",
    "gb AS MATERIALIZED (SELECT head, target, sum(g) AS g FROM g0 GROUP BY head, target)",
    "w1 AS MATERIALIZED (SELECT head, target, j, w - 0.001 * gw.g / (abs(gw.g) + 1e-8) AS w, b - 0.001 * gb.g / (abs(gb.g) + 1e-8) AS b "
    "FROM w0 JOIN gw USING (head, target, j) JOIN gb USING (head, target))",
    "moved AS (SELECT head, target, 0.1 / 10 + 0.9 * avg(p) AS m FROM q0 GROUP BY head, target)",
    "ema1 AS MATERIALIZED (SELECT head, target, m / sum(m) OVER (PARTITION BY head) AS e FROM moved)",
    *_sql_head_epoch(1, "w1", "ema1"))


@query("fit_heads", _TWO_EPOCHS + f"""
SELECT 0 AS epoch, {sround('(SELECT loss FROM loss0)')} AS loss, {sround('(SELECT loss FROM loss1)')} AS validation""")
def fit_heads(spark, folder):
    """One epoch of head training: its loss, and the loss after the Adam step and the move of the average."""
    p = points(spark, folder)
    fit, _ = heads.fit_heads(p, N_CLASSES, N_HEADS, epochs=1, validation=p, init=fixed_heads(p))
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(fit.losses, fit.validation))]
    return spark.createDataFrame(rows, "epoch int, loss double, validation double").select(
        "epoch", r6("loss").alias("loss"), r6("validation").alias("validation"))


# inputs with a constant 1 behind them, whose weight is the bias
_BIASED = (f"flatb AS MATERIALIZED (SELECT row_id, label, v, j FROM flat UNION ALL SELECT row_id, label, 1.0::DOUBLE, {DIM} "
           f"FROM e)")
_HALF_SIZE = "(SELECT (count(*) + 1) // 2 FROM e)"


def _sql_adam(n, keys):
    """Weights s{n + 1} from s{n} (keys, w, m1, m2) and the gradient d{n} (keys, g)."""
    return (f"s{n + 1} AS MATERIALIZED (SELECT {keys}, m1, m2, 0.0::DOUBLE AS b, w - 0.001 * (m1 / (1 - pow(0.9, {n + 1}))) / "
            f"(sqrt(m2 / (1 - pow(0.999, {n + 1}))) + 1e-8) AS w FROM (SELECT {keys}, w, 0.9 * m1 + 0.1 * g AS m1, "
            f"0.999 * m2 + 0.001 * g * g AS m2 FROM s{n} JOIN d{n} USING ({keys})))")


def _sql_head_steps():
    """One epoch of two steps, each over half of the rows; then the losses of all rows."""
    parts = [E, FLAT, MU, _BIASED, sql_batches("deal", "e", _HALF_SIZE),
             f"s0 AS MATERIALIZED (SELECT h.head, k AS target, unnest(range({DIM + 1})) AS j, unnest(list_append(c, 0)) * "
             f"{SCALE} * (1 + h.head / 2.0::DOUBLE) AS w, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS b FROM mu, "
             f"(SELECT unnest(range({N_HEADS})) AS head) h)",
             f"ema0 AS (SELECT head, target, 1.0::DOUBLE / {N_CLASSES} AS e FROM (SELECT unnest(range({N_HEADS})) AS head), "
             f"(SELECT unnest(range({N_CLASSES})) AS target))"]
    for n in range(2):
        parts += [f"e{n} AS (SELECT row_id FROM deal WHERE batch = {n})",
                  f"flat{n} AS MATERIALIZED (SELECT * FROM flatb WHERE row_id IN (SELECT row_id FROM e{n}))",
                  *_sql_head_epoch(n, f"s{n}", f"ema{n}", f"e{n}", f"flat{n}"),
                  f"d{n} AS MATERIALIZED (SELECT head, target, j, sum(g * v) AS g FROM g{n} JOIN flat{n} USING (row_id) "
                  f"GROUP BY head, target, j)", _sql_adam(n, "head, target, j"),
                  f"ema{n + 1} AS MATERIALIZED (SELECT head, target, m / sum(m) OVER (PARTITION BY head) AS e FROM (SELECT head, "
                  f"target, 0.1 * any_value(e) + 0.9 * avg(p) AS m FROM q{n} JOIN ema{n} USING (head, target) GROUP BY head, target))"]
    return parts + _sql_head_epoch(2, "s2", "ema2", "e", "flatb")


@query("head_steps_2", _with(*_sql_head_steps()) + f"""
SELECT 0 AS epoch, {sround('((SELECT loss FROM loss0) + (SELECT loss FROM loss1)) / 2')} AS loss,
  {sround('(SELECT loss FROM loss2)')} AS validation, {sround('(SELECT sum(w * (j + 1)) FROM s2)')} AS weights,
  {sround('(SELECT sum(e * e) FROM ema2)')} AS average""")
def head_steps_2(spark, folder):
    """One epoch of head training in two batches: losses, a sum over all weights, and the moved average."""
    p = points(spark, folder)
    fit, ema = heads.fit_heads(p, N_CLASSES, N_HEADS, epochs=1, validation=p, init=fixed_heads(p),
                               batch_size=-(-p.count() // 2))
    w, b = fit.params
    total = float((w * (np.arange(DIM) + 1)[None, :, None]).sum() + (DIM + 1) * b.sum())
    rows = [(i, x, y, total, float((ema * ema).sum())) for i, (x, y) in enumerate(zip(fit.losses, fit.validation))]
    return spark.createDataFrame(rows, "epoch int, loss double, validation double, weights double, average double").select(
        "epoch", *[r6(c).alias(c) for c in ("loss", "validation", "weights", "average")])


@query("select_heads")
def select_heads(spark, folder):
    return select.select_rows(points(spark, folder), "heads", N_CLUSTERS, epochs=5)


# ---- augmentation, pseudo-labels, mixing ----------------------------------------------------------------------------



@query("augment", _with(E, FLAT, sql_noise("n", "flat", DIM, 3, 11)) + f"""
SELECT row_id, j::INTEGER AS j, {sround(f'v + {STD_DEV} * g')} AS value FROM flat JOIN n USING (row_id, j)""")
def augment(spark, folder):
    return long_array(mixmatch.augment(points(spark, folder), STD_DEV, 3, 11), "embedding", "row_id")


_NOISES = [sql_noise(f"n{c}", "flat", DIM, c, 0) for c in range(COPIES)]
_PSEUDO = [E, FLAT, MU, *_NOISES,
           "mu_flat AS MATERIALIZED (SELECT k, unnest(c) AS w, generate_subscripts(c, 1) - 1 AS j FROM mu)",
           f"zs AS MATERIALIZED (SELECT row_id, k::INTEGER AS j, {SCALE} * sum(w * (v + {STD_DEV} * (n0.g + n1.g) / 2)) AS z "
           "FROM flat JOIN n0 USING (row_id, j) JOIN n1 USING (row_id, j) JOIN mu_flat USING (j) GROUP BY row_id, k)",
           sql_softmax("qs", "zs", "row_id"),
           "pseudo AS MATERIALIZED (SELECT row_id, j, p * p / sum(p * p) OVER (PARTITION BY row_id) AS t FROM qs)"]


@query("pseudo_labels", _with(*_PSEUDO) + f"SELECT row_id, j, {sround('t')} AS value FROM pseudo")
def pseudo_labels(spark, folder):
    p = points(spark, folder)
    return long_array(mixmatch.pseudo_labels(p, fixed_layers(p), COPIES, STD_DEV, TEMPERATURE), "target", "row_id")


_HALF = "row_id <= (SELECT max(row_id) // 2 FROM e)"
_MIX = [
    *_PSEUDO,
    f"l0 AS (SELECT row_id FROM e WHERE {_HALF})", f"u0 AS (SELECT row_id FROM e WHERE NOT {_HALF})",
    sql_batches("l", "l0", 64, 0), sql_batches("u", "u0", 64, 1),
    "sizes AS (SELECT (SELECT max(batch) + 1 FROM l) AS nl, (SELECT max(batch) + 1 FROM u) AS nu)",
    "pairs AS (SELECT i AS batch, i AS lb, i % nu AS ub FROM (SELECT unnest(range(nl)) AS i, nu FROM sizes))",
    "rows0 AS MATERIALIZED (SELECT p.batch, 0 AS side, pos, row_id FROM pairs p JOIN l ON l.batch = lb "
    "UNION ALL SELECT p.batch, 1, pos, row_id FROM pairs p JOIN u ON u.batch = ub)",
    f"placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY side, pos) AS slot, row_number() OVER "
    f"(PARTITION BY batch ORDER BY {sql_uniform('row_id', 'batch', mixmatch.PARTNER_DRAW, 0)}, row_id) AS til, "
    f"count(*) OVER (PARTITION BY batch) AS size FROM rows0)",
    "duo AS MATERIALIZED (SELECT a.batch, a.slot, a.size, a.row_id, a.side, b.row_id AS partner_id, b.side AS b_side FROM placed a "
    "JOIN placed b ON a.batch = b.batch AND a.slot = b.til)",
    f"target AS MATERIALIZED (SELECT row_id, j, CASE WHEN {_HALF} THEN (label = j)::INTEGER::DOUBLE ELSE t END AS t "
    f"FROM e JOIN pseudo USING (row_id))",
]


def _mix_rows(p):
    """The first half of the rows is labeled, the rest gets pseudo-labels; one epoch of batch pairs."""
    layers = fixed_layers(p)
    labeled = p.filter(F.col("row_id") <= p.agg(F.call_function("div", F.max("row_id"), F.lit(2))).scalar())
    labeled = labeled.select("row_id", "embedding", one_hot(F.col("label"), N_CLASSES).alias("target"))
    rest = sets.unlabeled_rows(p, labeled).select("row_id", "embedding")
    rest = mixmatch.pseudo_labels(rest, layers, COPIES, STD_DEV, TEMPERATURE)
    lab = materialize(batches.batches(labeled, 64, 0), "labeled")
    unl = materialize(batches.batches(rest, 64, 1), "unlabeled")
    n_lab, n_unl = (df.agg(F.max("batch")).first()[0] + 1 for df in (lab, unl))
    pairs = batches.pair_batches(p.sparkSession, n_lab, n_unl)
    return mixmatch.batch_rows(lab, unl, pairs), n_lab


@query("mixup_partners", _with(*_MIX) + 'SELECT batch, slot::INTEGER AS slot, row_id, partner_id FROM duo')
def mixup_partners(spark, folder):
    rows, _ = _mix_rows(points(spark, folder))
    return mixmatch.with_partner(rows).select("batch", "slot", "row_id", F.col("b_row_id").alias("partner_id"))


@query("mixup_inputs", _with(*_MIX) + f"""
SELECT d.batch, d.slot::INTEGER AS slot, a.j::INTEGER AS j, {sround(f'{SHARE} * a.v + {1 - SHARE} * b.v')} AS value
FROM duo d JOIN flat a ON a.row_id = d.row_id JOIN flat b ON b.row_id = d.partner_id AND a.j = b.j""")
def mixup_inputs(spark, folder):
    rows, _ = _mix_rows(points(spark, folder))
    return long_array(mixmatch.mixed_rows(rows, SHARE), "embedding", "batch", "slot")


@query("mixup_targets", _with(*_MIX) + f"""
SELECT d.batch, d.slot::INTEGER AS slot, a.j, {sround(f'{SHARE} * a.t + {1 - SHARE} * b.t')} AS value
FROM duo d JOIN target a ON a.row_id = d.row_id JOIN target b ON b.row_id = d.partner_id AND a.j = b.j""")
def mixup_targets(spark, folder):
    rows, _ = _mix_rows(points(spark, folder))
    return long_array(mixmatch.mixed_rows(rows, SHARE), "target", "batch", "slot")


_MIX_GRAD = _with(
    *_MIX,
    f"mt AS MATERIALIZED (SELECT d.batch, d.slot, d.size, d.row_id, d.partner_id, a.j, {SHARE} * a.t + {1 - SHARE} * b.t AS t "
    f"FROM duo d JOIN target a ON a.row_id = d.row_id JOIN target b ON b.row_id = d.partner_id AND a.j = b.j)",
    f"dot AS MATERIALIZED (SELECT row_id, k::INTEGER AS j, {SCALE} * list_inner_product(x, c) AS z FROM e, mu)",
    f"mz AS MATERIALIZED (SELECT m.*, {SHARE} * a.z + {1 - SHARE} * b.z AS z FROM mt m JOIN dot a ON a.row_id = m.row_id "
    f"AND a.j = m.j JOIN dot b ON b.row_id = m.partner_id AND b.j = m.j)",
    sql_softmax("mq", "mz", "batch, slot"))


@query("mixed_gradient", _MIX_GRAD + f"""
SELECT -1 AS j, {sround("sum(CASE WHEN t > 0 THEN t * (ln(t) - log_p) ELSE 0 END / size) / (SELECT nl FROM sizes)")} AS value FROM mq
UNION ALL SELECT j, {sround("sum((p - t) / size) / (SELECT nl FROM sizes)")} FROM mq GROUP BY j""")
def mixed_gradient(spark, folder):
    """Loss (j = -1) and bias gradient of one step; pseudo-labels are made inside the gradient tasks."""
    p = points(spark, folder)
    rows, n_lab = _mix_rows(p)
    hidden = F.when(F.col("is_unlabeled") == 0, F.col("target"))
    plan = mixmatch.with_partner(rows.withColumn("target", hidden))
    loss, grads = mixmatch.mixed_gradient(plan, fixed_layers(p), n_lab, "kl", share=SHARE, copies=COPIES, std_dev=STD_DEV,
                                          temperature=TEMPERATURE, draw=0, seed=0, pseudo="softmax")
    out = [(-1, loss)] + [(j, float(v)) for j, v in enumerate(grads[1])]
    return spark.createDataFrame(out, "j int, value double").withColumn("value", r6("value"))


_MIX_STEP = _MIX_GRAD.rstrip() + ",\n" + ",\n".join([
    f"gz AS MATERIALIZED (SELECT row_id, partner_id, j, (p - t) / size / (SELECT nl FROM sizes) AS g FROM mq)",
    f"gw AS MATERIALIZED (SELECT gz.j AS k, a.j, sum(g * ({SHARE} * a.v + {1 - SHARE} * b.v)) AS g FROM gz JOIN flat a ON a.row_id = "
    f"gz.row_id JOIN flat b ON b.row_id = gz.partner_id AND b.j = a.j GROUP BY gz.j, a.j)",
    "gb AS MATERIALIZED (SELECT j AS k, sum(g) AS g FROM gz GROUP BY j)",
    f"w1 AS MATERIALIZED (SELECT k, j, {SCALE} * w - 0.001 * g / (abs(g) + 1e-8) AS w FROM mu_flat JOIN gw USING (k, j))",
    "v1 AS MATERIALIZED (SELECT row_id, any_value(label) AS label, k AS j, sum(v * w) - 0.001 * any_value(gb.g / (abs(gb.g) + 1e-8)) "
    "AS z FROM flat JOIN w1 USING (j) JOIN gb USING (k) GROUP BY row_id, k)",
    sql_softmax("vq", "v1", "row_id")])


@query("fit_mixmatch_step", _MIX_STEP + f"""
SELECT 0 AS epoch, {sround("(SELECT sum(CASE WHEN t > 0 THEN t * (ln(t) - log_p) ELSE 0 END / size) / (SELECT nl FROM sizes) FROM mq)")} AS loss,
       {sround("(SELECT avg(-log_p) FROM vq WHERE j = label)")} AS validation""")
def fit_mixmatch_step(spark, folder):
    """One epoch of training with the first half of the rows labeled: its loss and the validation loss after the step."""
    p = points(spark, folder)
    picked = p.filter(F.col("row_id") <= p.agg(F.call_function("div", F.max("row_id"), F.lit(2))).scalar())
    fit = mixmatch.fit_mixmatch(p, picked, N_CLASSES, "single", epochs=1, init=fixed_layers(p), validation=p)
    return _history(spark, fit).select("epoch", r6("loss").alias("loss"), r6("validation").alias("validation"))


# ---- gradients and training -----------------------------------------------------------------------------------------

_LINEAR = _with(E, FLAT, MU, LINEAR_Z, sql_softmax("q", "z", "row_id"))
_ONE_STEP = (f"g AS MATERIALIZED (SELECT f.j AS i, q.j AS j, sum((p - (label = q.j)::INTEGER) * v) / (SELECT count(*) FROM e) AS g "
             f"FROM q JOIN (SELECT row_id, j, v FROM flat) f USING (row_id) GROUP BY f.j, q.j)")


@query("linear_grad_step", _LINEAR.rstrip() + ",\n" + _ONE_STEP + f"""
SELECT i::INTEGER AS i, j, {sround('g')} AS value FROM g""")
def linear_grad_step(spark, folder):
    p = points(spark, folder)
    _, grads = nn.gradient(nn.with_target(p, "single", N_CLASSES), fixed_layers(p), "kl")
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(grads[0])]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", r6("value"))


@query("adam_step", _LINEAR.rstrip() + ",\n" + _ONE_STEP + f"""
SELECT i::INTEGER AS i, g.j, {sround(f'{SCALE} * mu.c[i + 1] - 0.001 * g / (abs(g) + 1e-8)')} AS value FROM g JOIN mu ON mu.k = g.j""")
def adam_step(spark, folder):
    p = points(spark, folder)
    fit = nn.fit_supervised(p, N_CLASSES, "single", epochs=1, init=fixed_layers(p))
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(fit.params[0])]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", r6("value"))


def _sql_steps(rows):
    """Softmax regression, one step over each of the given tables of row ids: weights s{n} and losses l{n}."""
    parts = [_BIASED, f"s0 AS MATERIALIZED (SELECT k, unnest(range({DIM + 1})) AS j, unnest(list_append(c, 0)) * {SCALE} AS w, "
                      f"0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2 FROM mu)"]
    for n, ids in enumerate(rows):
        parts += [f"z{n} AS MATERIALIZED (SELECT row_id, any_value(label) AS label, s.k AS j, sum(f.v * w) AS z FROM flatb f "
                  f"JOIN s{n} s USING (j) WHERE row_id IN (SELECT row_id FROM {ids}) GROUP BY row_id, s.k)",
                  sql_softmax(f"q{n}", f"z{n}", "row_id"),
                  f"d{n} AS MATERIALIZED (SELECT f.j, q.j AS k, sum((p - (q.label = q.j)::INTEGER) * f.v) / (SELECT count(*) "
                  f"FROM {ids}) AS g FROM q{n} q JOIN flatb f USING (row_id) GROUP BY f.j, q.j)",
                  f"l{n} AS MATERIALIZED (SELECT avg(-log_p) AS loss FROM q{n} WHERE j = label)", _sql_adam(n, "k, j")]
    return parts


def _sql_turned(name, epoch):
    """The rows of ``deal`` in the two batches of an epoch."""
    u = [sql_uniform(str(epoch), str(2 * steps.PLACES + i), steps.TURN_DRAW) for i in range(2)]
    return (f"{name}_turn AS MATERIALIZED (SELECT rows, size, (SELECT min(x) FROM (SELECT unnest(range(from_, from_ + 1000)) AS x) "
            f"WHERE gcd(x, rows) = 1) AS a, floor({u[1]} * rows)::BIGINT AS c FROM (SELECT count(*) AS rows, {_HALF_SIZE} AS size, "
            f"1 + floor({u[0]} * (count(*) - 1))::BIGINT AS from_ FROM e)),\n"
            f"{name} AS MATERIALIZED (SELECT row_id, (a * (batch * size + pos) + c) % rows // size AS batch FROM deal, {name}_turn)")


def _weights(fit, *more):
    """Weights and biases (i = DIM) in long form."""
    w, b = fit.params
    return [(i, j, float(v), *more) for (i, j), v in np.ndenumerate(np.vstack([w, b]))]


@query("supervised_steps_2", _with(
    E, FLAT, MU, sql_batches("deal", "e", _HALF_SIZE), _sql_turned("turned", 1),
    *[f"{name}{n} AS (SELECT row_id FROM {name} WHERE batch = {n})" for name in ("deal", "turned") for n in range(2)],
    *_sql_steps(["deal0", "deal1", "turned0", "turned1"])) + f"""
SELECT j::INTEGER AS i, k::INTEGER AS j, {sround('w')} AS value, {sround('((SELECT loss FROM l0) + (SELECT loss FROM l1)) / 2')} AS
  loss_0, {sround('((SELECT loss FROM l2) + (SELECT loss FROM l3)) / 2')} AS loss_1 FROM s4""")
def supervised_steps_2(spark, folder):
    """Two epochs of two steps each; the second epoch deals the rows into other batches."""
    p = points(spark, folder)
    fit = nn.fit_supervised(p, N_CLASSES, "single", epochs=2, init=fixed_layers(p), batch_size=-(-p.count() // 2))
    rows = _weights(fit, *fit.losses)
    return spark.createDataFrame(rows, "i int, j int, value double, loss_0 double, loss_1 double").select(
        "i", "j", *[r6(c).alias(c) for c in ("value", "loss_0", "loss_1")])


@query("training_resumed", _with(E, FLAT, MU, *_sql_steps(["e", "e"])) + f"""
SELECT j::INTEGER AS i, k::INTEGER AS j, {sround('w')} AS value, {sround('(SELECT loss FROM l0)')} AS loss_0,
  {sround('(SELECT loss FROM l1)')} AS loss_1 FROM s2""")
def training_resumed(spark, folder):
    """A training that is broken off after one epoch and goes on from its stored state equals two epochs."""
    p, state = points(spark, folder), Resume(spark, scratch_path(spark, "states"))
    for epochs in (1, 2):
        fit = nn.fit_supervised(p, N_CLASSES, "single", epochs=epochs, init=fixed_layers(p), resume=state)
    rows = _weights(fit, *fit.losses)
    return spark.createDataFrame(rows, "i int, j int, value double, loss_0 double, loss_1 double").select(
        "i", "j", *[r6(c).alias(c) for c in ("value", "loss_0", "loss_1")])


_DROP_KEEP = f"({sql_uniform('row_id', 'k', nn.DROPOUT_DRAW + 2, 5)} >= 0.5)"


@query("dropout_gradient", _with(
    E, FLAT, MU, f"h AS MATERIALIZED (SELECT row_id, label, k, CASE WHEN {_DROP_KEEP} THEN 2 * greatest(10 * "
                 "list_inner_product(x, c), 0) ELSE 0 END AS h FROM e, mu)",
    "w AS MATERIALIZED (SELECT a.k, b.k AS j, list_inner_product(a.c, b.c) AS g FROM mu a, mu b)",
    "z AS MATERIALIZED (SELECT row_id, any_value(label) AS label, j, sum(h * g) AS z FROM h JOIN w USING (k) GROUP BY row_id, j)",
    sql_softmax("q", "z", "row_id")) + f"""
SELECT h.k::INTEGER AS i, q.j::INTEGER AS j, {sround("sum(h.h * (p - (q.label = q.j)::INTEGER)) / (SELECT count(*) FROM e)")} AS value
FROM q JOIN h USING (row_id) GROUP BY h.k, q.j""")
def dropout_gradient(spark, folder):
    """Gradient of the second layer when half of the hidden units are dropped."""
    p = points(spark, folder)
    _, grads = nn.gradient(nn.with_target(p, "single", N_CLASSES), mlp_layers(p), "kl", dropout=0.5, step=2, seed=5)
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(grads[2])]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", r6("value"))


@query("classifier_val_loss", _LINEAR + f"SELECT {sround('avg(-log_p)')} AS loss, count(*) AS n FROM q WHERE j = label")
def classifier_val_loss(spark, folder):
    p = points(spark, folder)
    loss = nn.validation_loss_table(p, fixed_layers(p), "single", N_CLASSES)
    return loss.select(r6("loss").alias("loss"), "n")


@query("classifier_val_loss_multi", _LINEAR + f"""
SELECT {sround("avg((1 - (j = label)::INTEGER) * z + greatest(-z, 0) + ln(1 + exp(-abs(z))))")} AS loss, count(DISTINCT row_id) AS n FROM q""")
def classifier_val_loss_multi(spark, folder):
    p = points(spark, folder)
    arrays = p.withColumn("label", one_hot(F.col("label"), N_CLASSES).cast("array<int>"))
    loss = nn.validation_loss_table(arrays, fixed_layers(p), "multi", N_CLASSES)
    return loss.select(r6("loss").alias("loss"), "n")


def _history(spark, fit):
    rows = [(i, a, fit.validation[i] if fit.validation else None) for i, a in enumerate(fit.losses)]
    return spark.createDataFrame(rows, "epoch int, loss double, validation double")


def _chosen(p):
    return select.first_members(cluster.assign_nearest(p, cluster.first_rows(p, N_CLUSTERS)))


@query("fit_mixmatch_single")
def fit_mixmatch_single(spark, folder):
    p = points(spark, folder)
    return _history(spark, mixmatch.fit_mixmatch(p, _chosen(p), N_CLASSES, "single", epochs=4, validation=p, patience=2))


@query("fit_mixmatch_multi")
def fit_mixmatch_multi(spark, folder):
    p = points(spark, folder)
    arrays = p.withColumn("label", one_hot(F.col("label"), N_CLASSES).cast("array<int>"))
    return _history(spark, mixmatch.fit_mixmatch(arrays, _chosen(p), N_CLASSES, "multi", epochs=3))


@query("fit_supervised")
def fit_supervised(spark, folder):
    p = points(spark, folder)
    arrays = p.withColumn("label", one_hot(F.col("label"), N_CLASSES).cast("array<int>"))
    weights = np.array([r["weight"] for r in label_weights(arrays).orderBy("position").collect()])
    return _history(spark, nn.fit_supervised(arrays, N_CLASSES, "multi", epochs=4, pos_weight=weights, validation=arrays,
                                             patience=3))


# ---- stored models and complete runs --------------------------------------------------------------------------------

@query("latest_model", _with(E, FLAT, MU) + f"""
SELECT 0 AS layer, ((generate_subscripts(c, 1) - 1) * {N_CLASSES} + k)::INTEGER AS i, {sround('2 * unnest(c)')} AS value FROM mu
UNION ALL SELECT 1, unnest(range({N_CLASSES}))::INTEGER, 0.0::DOUBLE""")
def latest_model(spark, folder):
    """Two versions of one name and a longer name saved later; the newest exact match is read back."""
    p, path = points(spark, folder), scratch_path(spark, "models")
    w, b = fixed_layers(p)
    w = w / SCALE
    for hour, name, factor in ((2, "classifier", 2.0), (1, "classifier", 1.0), (3, "classifier-t", 3.0)):
        save_model(spark, [w * factor, b], path, name, datetime(2024, 1, 1, hour, tzinfo=timezone.utc))
    newest = latest_weights(spark.read.parquet(path), "classifier")
    return long_array(newest, "values", "layer", position="i")


@query("saved_model_predicts", _MLP_SQL + "SELECT row_id, arg_min(j, {'z': -z, 'j': j}) AS prediction FROM z GROUP BY row_id")
def saved_model_predicts(spark, folder):
    p, path = points(spark, folder), scratch_path(spark, "models")
    save_model(spark, mlp_layers(p), path, "classifier")
    return nn.predict_class(p, load_model(spark, path, "classifier"))


@query("pca_projection")
def pca_projection(spark, folder):
    p = points(spark, folder)
    return project.project_2d(p, _chosen(p)).select("row_id", r6("x").alias("x"), r6("y").alias("y"), "label", "code", "selected")


def _splits(spark, folder):
    """Seeded random split of the whole table: 70 % train, 20 % val, 10 % test."""
    u = uniform(F.col("vec_id"), 0, 17)
    part = F.when(u < 0.7, "train").when(u < 0.9, "val").otherwise("test")
    return table(spark, folder, "embeddings").withColumn("dataset", part)


_SMALL = dict(n_classes=N_CLASSES, n_clusters=N_CLUSTERS, epochs=3, n_init=2, head_epochs=3, id_col="vec_id", cluster_iterations=5)


@query("run_density_single")
def run_density_single(spark, folder):
    data = _splits(spark, folder).withColumn("guess", (F.col("vec_id") % 10).cast("int"))
    config, store = preset("density", "single", baseline_col="guess", **_SMALL), scratch_path(spark, "run")
    run(spark, data, store, "r1", config, "train")
    found = [run(spark, data, store, "r1", config, mode).withColumn("split", F.lit(mode)) for mode in ("eval", "test")]
    return found[0].unionByName(found[1])


@query("run_density_multi")
def run_density_multi(spark, folder):
    hot = one_hot(F.col("label"), N_CLASSES)
    data = _splits(spark, folder).withColumn("guess", hot).withColumn("label", hot.cast("array<int>"))
    config, store = preset("density", "multi", baseline_col="guess", **_SMALL), scratch_path(spark, "run")
    run(spark, data, store, "r1", config, "train")
    return run(spark, data, store, "r1", config, "eval")


@query("run_heads_onehot")
def run_heads_onehot(spark, folder):
    data = _splits(spark, folder).withColumn("label", one_hot(F.col("label"), N_CLASSES).cast("array<int>"))
    config, store = preset("heads", "onehot", **_SMALL), scratch_path(spark, "run")
    run(spark, data, store, "r1", config, "train")
    return run(spark, data, store, "r1", config, "test")
