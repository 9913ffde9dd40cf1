"""Array functions and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelpick.functions import vectors as V
from labelpick.functions.random import uniform
from labelpick.operators import cluster, metrics, nn
from labelpick.plans.registry import (E, FLAT, LINEAR_Z, MU, N_CLASSES, N_CLUSTERS, _with, class_means, first_centers,
                                      fixed_layers, long_array, points, query, r6, sql_assign, sql_softmax, sql_uniform,
                                      sround, start_centers, table)

_Z = _with(E, FLAT, MU, LINEAR_Z)
_Q = _with(E, FLAT, MU, LINEAR_Z, sql_softmax("q", "z", "row_id"))


def _logits(spark, folder):
    p = points(spark, folder)
    return nn.logits(p, fixed_layers(p))


# ---- array functions ------------------------------------------------------------------------------------------------

@query("linear_forward", _Z + f"SELECT row_id, j, {sround('z')} AS value FROM z")
def linear_forward(spark, folder):
    return long_array(_logits(spark, folder), "logits", "row_id")


_MLP_SQL = _with(
    E, FLAT, MU, f"h AS MATERIALIZED (SELECT row_id, k, greatest(10 * list_inner_product(x, c), 0) AS h FROM e, mu)",
    "g AS MATERIALIZED (SELECT a.k, b.k AS j, list_inner_product(a.c, b.c) AS g FROM mu a, mu b)",
    "z AS MATERIALIZED (SELECT row_id, j::INTEGER AS j, sum(h * g) AS z FROM h JOIN g USING (k) GROUP BY row_id, j)")


def mlp_layers(p):
    """Two layers built from the class means: 64 -> 10 -> 10."""
    import numpy as np

    means = class_means(p)
    return [10 * means.T, np.zeros(N_CLASSES), means @ means.T, np.zeros(N_CLASSES)]


@query("mlp_forward", _MLP_SQL + f"SELECT row_id, j, {sround('z')} AS value FROM z")
def mlp_forward(spark, folder):
    p = points(spark, folder)
    return long_array(nn.logits(p, mlp_layers(p)), "logits", "row_id")


@query("softmax_rows", _Q + f"SELECT row_id, j, {sround('p')} AS value FROM q")
def softmax_rows(spark, folder):
    return long_array(_logits(spark, folder).withColumn("p", V.softmax(F.col("logits"))), "p", "row_id")


@query("log_softmax_rows", _Q + f"SELECT row_id, j, {sround('log_p')} AS value FROM q")
def log_softmax_rows(spark, folder):
    return long_array(_logits(spark, folder).withColumn("p", V.log_softmax(F.col("logits"))), "p", "row_id")


@query("sharpen_rows", _Q + f"""
SELECT row_id, j, {sround('p * p / sum(p * p) OVER (PARTITION BY row_id)')} AS value FROM q""")
def sharpen_rows(spark, folder):
    rows = _logits(spark, folder).withColumn("p", V.sharpen(V.softmax(F.col("logits")), 0.5))
    return long_array(rows, "p", "row_id")


@query("sigmoid_rows", _Z + f"SELECT row_id, j, {sround('1 / (1 + exp(-z))')} AS value FROM z")
def sigmoid_rows(spark, folder):
    return long_array(_logits(spark, folder).withColumn("p", V.sigmoid(F.col("logits"))), "p", "row_id")


@query("sigmoid_threshold", _Z + "SELECT row_id, j, (1 / (1 + exp(-z)) > 0.5)::INTEGER AS value FROM z")
def sigmoid_threshold(spark, folder):
    p = points(spark, folder)
    return nn.predict_labels(p, fixed_layers(p)).select("row_id", F.posexplode("prediction").alias("j", "value"))


@query("one_hot", f"""SELECT vec_id AS row_id, j::INTEGER AS j, (label = j)::INTEGER::DOUBLE AS value
FROM embeddings, (SELECT unnest(range({N_CLASSES})) AS j)""")
def one_hot(spark, folder):
    rows = points(spark, folder).withColumn("t", V.one_hot(F.col("label"), N_CLASSES))
    return rows.select("row_id", F.posexplode("t").alias("j", "value"))


@query("argmax_first", _Z + """, cut AS (SELECT row_id, j, (z > 0)::INTEGER AS b FROM z)
SELECT row_id, arg_min(j, {'n': -b, 'j': j}) AS first_max FROM cut GROUP BY row_id""")
def argmax_first(spark, folder):
    p = points(spark, folder)
    cut = nn.predict_labels(p, fixed_layers(p))
    return cut.select("row_id", V.argmax(F.col("prediction")).alias("first_max"))


@query("predict_class", _Z + "SELECT row_id, arg_min(j, {'z': -z, 'j': j}) AS prediction FROM z GROUP BY row_id")
def predict_class(spark, folder):
    p = points(spark, folder)
    return nn.predict_class(p, fixed_layers(p))


@query("kl_soft", _Q + f"""
SELECT row_id, {sround('sum(CASE WHEN t > 0 THEN t * (ln(t) - log_p) ELSE 0 END)')} AS kl FROM
(SELECT row_id, log_p, CASE WHEN label = j THEN 0.75 WHEN (label + 1) % {N_CLASSES} = j THEN 0.25 ELSE 0 END::DOUBLE AS t
 FROM q) GROUP BY row_id""")
def kl_soft(spark, folder):
    label, after = F.col("label"), F.pmod(F.col("label") + 1, F.lit(N_CLASSES))
    soft = V.mix(V.one_hot(label, N_CLASSES), V.one_hot(after, N_CLASSES), 0.75)
    return _logits(spark, folder).select("row_id", r6(V.kl_rows(F.col("logits"), soft)).alias("kl"))


_BCE_TERM = "greatest(-z, 0) + ln(1 + exp(-abs(z)))"
_LABEL_Z = (f"t AS MATERIALIZED (SELECT doc_id, j, y, 4 * {sql_uniform('doc_id', 'j', 7)} - 2 AS z FROM (SELECT doc_id, "
            f"0 AS j, quality AS y FROM labels UNION ALL SELECT doc_id, 1, toxic FROM labels))")


def _label_rows(spark, folder):
    """Two labels per document, with logits that are a fixed function of the id."""
    def draw(j):
        return uniform(F.col("doc_id"), j, 7) * 4 - 2

    return table(spark, folder, "labels").select("doc_id", F.array("quality", "toxic").alias("label"),
                                                 F.array(draw(0), draw(1)).alias("logits"))


@query("bce", _with(_LABEL_Z) + f"SELECT count(*) AS n, {sround(f'avg((1 - y) * z + {_BCE_TERM})')} AS loss FROM t")
def bce(spark, folder):
    rows = _label_rows(spark, folder)
    per_row = V.bce_rows(F.col("logits"), V.doubles("label"))
    return rows.agg(F.sum(F.size("label")).cast("long").alias("n"), r6(F.sum(per_row) / F.sum(F.size("label"))).alias("loss"))


_WEIGHTS = ("f AS MATERIALIZED (SELECT j, freq, (1 / freq) / sum(1 / freq) OVER () AS w FROM "
            "(SELECT j, avg(y) AS freq FROM t GROUP BY j))")


@query("bce_pos_weight", _with(_LABEL_Z, _WEIGHTS) + f"""
SELECT count(*) AS n, {sround(f'avg((1 - y) * z + (1 + (w - 1) * y) * ({_BCE_TERM}))')} AS loss FROM t JOIN f USING (j)""")
def bce_pos_weight(spark, folder):
    rows = _label_rows(spark, folder)
    weights = [r["weight"] for r in metrics.label_weights(rows).orderBy("position").collect()]  # one per label
    per_row = V.bce_rows(F.col("logits"), V.doubles("label"), V.array_of(weights))
    return rows.agg(F.sum(F.size("label")).cast("long").alias("n"), r6(F.sum(per_row) / F.sum(F.size("label"))).alias("loss"))


# ---- metrics --------------------------------------------------------------------------------------------------------

@query("label_weights", _with(_LABEL_Z, _WEIGHTS) + f"""
SELECT j::INTEGER AS position, {sround('freq')} AS frequency, {sround('w')} AS weight FROM f""")
def label_weights(spark, folder):
    return metrics.label_weights(_label_rows(spark, folder)).select(
        "position", r6("frequency").alias("frequency"), r6("weight").alias("weight"))


_SCORED = _with(E, FLAT, MU, "mc AS (SELECT k, c FROM mu)", sql_assign("m", "mc"), start_centers(),
                sql_assign("b", "c0"),
                "s AS MATERIALIZED (SELECT row_id, label, m.k AS prediction, b.k AS baseline FROM e JOIN m USING (row_id) "
                "JOIN b USING (row_id))")
_CLASSES = """, sides AS (SELECT 'model' AS side, label, prediction AS guess FROM s
  UNION ALL SELECT 'baseline', label, baseline FROM s),
classes AS (SELECT DISTINCT side, label AS class FROM sides UNION SELECT DISTINCT side, guess FROM sides),
counts AS (SELECT c.side, class, count(*) FILTER (label = class AND guess = class) AS tp,
  count(*) FILTER (label <> class AND guess = class) AS fp, count(*) FILTER (label = class AND guess <> class) AS fn
  FROM classes c JOIN sides s ON c.side = s.side GROUP BY c.side, class),
scores AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM counts),
summary AS (SELECT side, sum(tp) / sum(support) AS accuracy, sum(p * support) / sum(support) AS "precision",
  sum(r * support) / sum(support) AS recall, sum(f * support) / sum(support) AS f1, avg(p) AS precision_macro,
  avg(r) AS recall_macro, avg(f) AS f1_macro FROM scores GROUP BY side)"""


def _scored(spark, folder):
    """Nearest class mean as the prediction, nearest of the first rows as the baseline."""
    p = points(spark, folder)
    guess = cluster.assign_nearest(p, class_means(p)).select("row_id", F.col("k").alias("prediction"))
    base = cluster.assign_nearest(p, first_centers(p)).select("row_id", F.col("k").alias("baseline"))
    return metrics.align(p, guess, base)


@query("align_predictions", _SCORED + "SELECT row_id, label, prediction, baseline FROM s")
def align_predictions(spark, folder):
    return _scored(spark, folder)


@query("per_class_scores", _SCORED + _CLASSES + f"""
SELECT class, tp, fp, fn, support, {sround('p')} AS "precision", {sround('r')} AS recall, {sround('f')} AS f1
FROM scores WHERE side = 'model'""")
def per_class_scores(spark, folder):
    table_ = metrics.per_class(metrics.pair_counts(_scored(spark, folder)))
    return table_.select("class", "tp", "fp", "fn", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("accuracy_weighted_prf", _SCORED + _CLASSES + f"""
SELECT {sround('accuracy')} AS accuracy, {sround('"precision"')} AS "precision", {sround('recall')} AS recall,
       {sround('f1')} AS f1 FROM summary WHERE side = 'model'""")
def accuracy_weighted_prf(spark, folder):
    return metrics.summary_single(_scored(spark, folder)).select(*[r6(c).alias(c) for c in metrics.SINGLE_METRICS])


@query("macro_prf", _SCORED + _CLASSES + f"""
SELECT {sround('precision_macro')} AS precision_macro, {sround('recall_macro')} AS recall_macro,
       {sround('f1_macro')} AS f1_macro FROM summary WHERE side = 'model'""")
def macro_prf(spark, folder):
    names = ("precision_macro", "recall_macro", "f1_macro")
    return metrics.summary_single(_scored(spark, folder)).select(*[r6(c).alias(c) for c in names])


@query("confusion_long", _SCORED + f""", classes AS (SELECT label AS c FROM s UNION SELECT prediction FROM s)
SELECT t.c AS label, g.c AS prediction, count(s.row_id) AS n FROM classes t CROSS JOIN classes g
LEFT JOIN s ON s.label = t.c AND s.prediction = g.c GROUP BY t.c, g.c""")
def confusion_long(spark, folder):
    return metrics.confusion(_scored(spark, folder))


@query("confusion_matrix", _SCORED + "SELECT label, " + ", ".join(
    f"count(*) FILTER (prediction = {c}) AS p{c}" for c in range(N_CLASSES)) + " FROM s GROUP BY label")
def confusion_matrix(spark, folder):
    wide = metrics.confusion_matrix(_scored(spark, folder), list(range(N_CLASSES)))
    return wide.select("label", *[F.col(str(c)).alias(f"p{c}") for c in range(N_CLASSES)])


def _report(rows):
    return rows.select("metric", *[r6(c).alias(c) for c in rows.columns if c != "metric"])


def _sql_report(names, loss=()):
    lines = []
    for name in names:
        share = "b.v / nullif(m.v, 0)" if name in loss else "m.v / nullif(b.v, 0)"
        lines.append(f"SELECT '{name}' AS metric, {sround('b.v')} AS baseline, {sround('m.v')} AS model, "
                     f"{sround(f'100 * {share}')} AS percentage FROM (SELECT \"{name}\" AS v FROM summary WHERE side = "
                     f"'model') m, (SELECT \"{name}\" AS v FROM summary WHERE side = 'baseline') b")
    return "\nUNION ALL ".join(lines)


@query("evaluate_single", _SCORED + _CLASSES + _sql_report(metrics.SINGLE_METRICS))
def evaluate_single(spark, folder):
    return _report(metrics.evaluate_single(_scored(spark, folder)))


@query("pct_of_baseline", _SCORED + _CLASSES + f"""
SELECT {sround('100 * m.accuracy / nullif(b.accuracy, 0)')} AS accuracy_pct, {sround('100 * m.f1 / nullif(b.f1, 0)')} AS f1_pct
FROM (SELECT * FROM summary WHERE side = 'model') m, (SELECT * FROM summary WHERE side = 'baseline') b""")
def pct_of_baseline(spark, folder):
    rows = metrics.evaluate_single(_scored(spark, folder))
    return rows.agg(*[r6(F.max(F.when(F.col("metric") == m, F.col("percentage")))).alias(f"{m}_pct")
                      for m in ("accuracy", "f1")])


_MULTI = _with(f"""t AS MATERIALIZED (SELECT doc_id, j, y, ({sql_uniform('doc_id', 'j', 1)} > 0.5)::INTEGER AS m,
  ({sql_uniform('doc_id', 'j', 2)} > 0.5)::INTEGER AS b FROM (SELECT doc_id, 0 AS j, quality AS y FROM labels
  UNION ALL SELECT doc_id, 1, toxic FROM labels))""",
               "sides AS (SELECT 'model' AS side, y, m AS g FROM t UNION ALL SELECT 'baseline', y, b FROM t)",
               """summary AS (SELECT side, avg((y <> g)::INTEGER) AS hamming_loss, tp / (tp + fp) AS "precision",
  tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT *, count(*) FILTER (y = 1 AND g = 1) OVER
  (PARTITION BY side) AS tp, count(*) FILTER (y = 0 AND g = 1) OVER (PARTITION BY side) AS fp,
  count(*) FILTER (y = 1 AND g = 0) OVER (PARTITION BY side) AS fn FROM sides) GROUP BY side, tp, fp, fn)""")


def _multi(spark, folder):
    def draw(n):
        return F.array(uniform(F.col("doc_id"), 0, n), uniform(F.col("doc_id"), 1, n))

    rows = table(spark, folder, "labels")
    return rows.select(F.col("doc_id").alias("row_id"), F.array("quality", "toxic").alias("label"),
                       V.over_threshold(draw(1)).alias("prediction"), draw(2).alias("baseline"))


@query("micro_prf_hamming", _MULTI + f"""
SELECT {sround('hamming_loss')} AS hamming_loss, {sround('"precision"')} AS "precision", {sround('recall')} AS recall,
       {sround('f1')} AS f1 FROM summary WHERE side = 'model'""")
def micro_prf_hamming(spark, folder):
    return metrics.summary_multi(_multi(spark, folder)).select(*[r6(c).alias(c) for c in metrics.MULTI_METRICS])


@query("evaluate_multi", _MULTI + _sql_report(metrics.MULTI_METRICS, ("hamming_loss",)))
def evaluate_multi(spark, folder):
    return _report(metrics.evaluate_multi(_multi(spark, folder)))


_ONE_HOT = (_with(E, FLAT, MU, LINEAR_Z, """s AS MATERIALIZED (SELECT row_id, any_value(label) AS label,
  arg_min(j, {'n': -(z > 0)::INTEGER, 'j': j}) AS prediction, 0 AS baseline FROM z GROUP BY row_id)""") + _CLASSES
            + """, w AS (SELECT precision_macro, recall_macro, f1_macro, "precision" AS precision_weighted,
  recall AS recall_weighted, f1 AS f1_weighted FROM summary WHERE side = 'model')
""" + "\nUNION ALL ".join(f"SELECT '{m}' AS metric, {sround(m)} AS model FROM w" for m in metrics.ONE_HOT_METRICS))


@query("evaluate_one_hot", _ONE_HOT)
def evaluate_one_hot(spark, folder):
    p = points(spark, folder)
    truth = p.select("row_id", V.one_hot(F.col("label"), N_CLASSES).alias("label"))
    return _report(metrics.evaluate_one_hot(metrics.align(truth, nn.predict(p, fixed_layers(p), "onehot"))))
