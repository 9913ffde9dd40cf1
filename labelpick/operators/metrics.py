"""Classification metrics against an optional baseline, from one aggregation over the rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpick.functions.vectors import argmax, over_threshold

SINGLE_METRICS = ("accuracy", "precision", "recall", "f1")
MULTI_METRICS = ("hamming_loss", "precision", "recall", "f1")
ONE_HOT_METRICS = ("precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted",
                   "f1_weighted")


def ratio(a: Column, b: Column) -> Column:
    """a / b with 0 / 0 counted as 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def align(truth: DataFrame, prediction: DataFrame, baseline: DataFrame | None = None,
          missing: str = "error") -> DataFrame:
    """(row_id, label, prediction[, baseline]) of every row of ``truth``.

    A row without a prediction (or baseline) is an error, unless ``missing="null"`` asks for a null there. Two of them for
    one row are always an error.
    """
    out = truth.select("row_id", "label")
    for side, name in ((prediction, "prediction"), (baseline, "baseline")):
        if side is None:
            continue
        # grouped by the key of the join, which needs no further shuffle
        found = side.groupBy("row_id").agg(F.first(name).alias(name), F.count("*").alias("_found"))
        out = out.join(found, "row_id", "left")
        many = F.raise_error(F.concat(F.lit(f"more than one {name} for row "), F.col("row_id").cast("string")))
        out = out.withColumn(name, F.when(F.col("_found") > 1, many).otherwise(F.col(name)))
        if missing == "error":
            absent = F.raise_error(F.concat(F.lit(f"no {name} for row "), F.col("row_id").cast("string")))
            out = out.withColumn(name, F.when(F.col("_found").isNotNull(), F.col(name)).otherwise(absent))
        out = out.drop("_found")
    return out


def pair_counts(scored: DataFrame, sides: tuple[str, ...] = ("prediction",)) -> DataFrame:
    """(side, label, guess, n): one pass over the rows for all sides, then tiny tables."""
    counted = scored.groupBy("label", *sides).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).cast("int").alias("guess")) for s in sides]))
    return (counted.select(F.col("label").cast("int").alias("label"), "n", each.alias("s"))
            .groupBy("s.side", "label", "s.guess").agg(F.sum("n").alias("n")))


def per_class(counts: DataFrame) -> DataFrame:
    """(side, class, tp, fp, fn, support, precision, recall, f1) for classes seen in truth or prediction."""
    hit = F.col("label") == F.col("guess")
    zero = F.lit(0).cast("long")
    rows = F.array(
        F.struct(F.col("label").alias("class"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"),
                 F.when(hit, zero).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("guess").alias("class"), zero.alias("tp"), F.when(hit, zero).otherwise(F.col("n")).alias("fp"),
                 zero.alias("fn")),
    )
    summed = (counts.select("side", F.explode(rows).alias("r")).groupBy("side", "r.class")
              .agg(*[F.sum(f"r.{c}").alias(c) for c in ("tp", "fp", "fn")]))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return summed.select("*", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"),
                         ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def summary_single(scored: DataFrame, sides: tuple[str, ...] = ("prediction",)) -> DataFrame:
    """(side, accuracy, {precision, recall, f1} weighted and macro)."""
    weight = F.col("support")
    aggs = [ratio(F.sum("tp"), F.sum(weight)).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs += [ratio(F.sum(F.col(m) * weight), F.sum(weight)).alias(m), F.avg(m).alias(f"{m}_macro")]
    return per_class(pair_counts(scored, sides)).groupBy("side").agg(*aggs)


def summary_multi(scored: DataFrame, sides: tuple[str, ...] = ("prediction",)) -> DataFrame:
    """(side, hamming_loss, precision, recall, f1), micro averages over all labels; arrays are never exploded."""
    def hits(side, t, g):
        return F.aggregate(F.zip_with("label", F.col(side), lambda y, p: ((y == t) & (p == g)).cast("long")),
                           F.lit(0).cast("long"), lambda acc, v: acc + v)

    aggs = [F.sum(F.size("label")).alias("cells")]
    for s in sides:
        aggs += [F.sum(hits(s, 1, 1)).alias(f"{s}_tp"), F.sum(hits(s, 0, 1)).alias(f"{s}_fp"),
                 F.sum(hits(s, 1, 0)).alias(f"{s}_fn")]
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in
                                                                 ("tp", "fp", "fn")]) for s in sides])).alias("s")
    tp, fp, fn = (F.col(f"s.{c}") for c in ("tp", "fp", "fn"))
    return scored.agg(*aggs).select("cells", side).select(
        "s.side", ratio(fp + fn, F.col("cells")).alias("hamming_loss"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def percent_of_baseline(metric: Column, model: Column, baseline: Column) -> Column:
    """Model in percent of the baseline; a loss is turned round so that more is better. Null for a zero divisor."""
    return F.when(metric == "hamming_loss", F.try_divide(baseline, model)).otherwise(
        F.try_divide(model, baseline)) * 100


def report(summary: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, model[, baseline, percentage]) from a summary with one row per side."""
    long = summary.unpivot(["side"], list(metrics), "metric", "value")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("side") == "prediction", F.col("value"))).alias("model"),
                                      F.max(F.when(F.col("side") == "baseline", F.col("value"))).alias("baseline"))
    return wide.select("metric", "baseline", "model",
                       percent_of_baseline(F.col("metric"), F.col("model"), F.col("baseline")).alias("percentage"))


def evaluate_single(scored: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 of integer classes, next to the baseline if there is one."""
    sides = ("prediction", "baseline") if "baseline" in scored.columns else ("prediction",)
    return report(summary_single(scored, sides), SINGLE_METRICS)


def evaluate_multi(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Hamming loss and micro precision, recall, F1 of 0/1 arrays; the baseline holds probabilities."""
    if "baseline" not in scored.columns:
        return report(summary_multi(scored), MULTI_METRICS)
    cut = scored.withColumn("baseline", over_threshold(F.col("baseline"), threshold))
    return report(summary_multi(cut, ("prediction", "baseline")), MULTI_METRICS)


def evaluate_one_hot(scored: DataFrame) -> DataFrame:
    """Macro and weighted precision, recall, F1 of one-hot arrays; no baseline."""
    classes = scored.select(argmax(F.col("label")).alias("label"), argmax(F.col("prediction")).alias("prediction"))
    summary = summary_single(classes).select(
        "side", "precision_macro", "recall_macro", "f1_macro", F.col("precision").alias("precision_weighted"),
        F.col("recall").alias("recall_weighted"), F.col("f1").alias("f1_weighted"))
    return report(summary, ONE_HOT_METRICS).select("metric", "model")


def confusion(scored: DataFrame) -> DataFrame:
    """(label, prediction, n) over all pairs of classes seen anywhere, zeros included."""
    counts = pair_counts(scored).select("label", F.col("guess").alias("prediction"), "n")
    seen = counts.agg(F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("prediction"))).alias("c"))
    grid = seen.select(F.explode("c").alias("label"), "c").select("label", F.explode("c").alias("prediction"))
    return (grid.join(counts, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def confusion_matrix(scored: DataFrame, classes: list[int]) -> DataFrame:
    return confusion(scored).groupBy("label").pivot("prediction", classes).agg(F.first("n")).fillna(0)


def label_weights(rows: DataFrame) -> DataFrame:
    """(position, frequency, weight): share of ones per label and inverse frequencies scaled to sum 1."""
    mean = rows.agg(Summarizer.mean(array_to_vector(F.col("label").cast("array<double>"))).alias("m"))
    freq = mean.select(F.posexplode(vector_to_array("m")).alias("position", "frequency"))
    inverse = F.try_divide(F.lit(1.0), F.col("frequency"))
    return freq.select("position", "frequency", inverse.alias("inv")).select(
        "position", "frequency", (F.col("inv") / F.sum("inv").over(Window.partitionBy())).alias("weight"))
