"""Semi-supervised training on mixed labeled and pseudo-labeled rows."""

from __future__ import annotations

from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from labelpick.functions import kernels as K
from labelpick.functions.random import normal_array, uniform
from labelpick.functions.vectors import mix
from labelpick.operators.batches import batches, pair_batches
from labelpick.operators.nn import (Adam, Training, add_gradient, gradient_shapes, init_classifier, logit_gradient,
                                    run_layers, task_loss, train, validation_loss, with_target)
from labelpick.operators.partials import collect_sums
from labelpick.operators.sets import split_rows, stack
from labelpick.operators.steps import PLACES, turn
from labelpick.session import scratch_tables, ship
from labelpick.sources.states import Resume

PARTNER_DRAW = 900_004
PLAN_ROWS = 1_000_000


def augment(points: DataFrame, std_dev: float = 0.1, draw: int = 0, seed: int = 0) -> DataFrame:
    """Add seeded Gaussian noise to ``embedding``."""
    @arrow_udf("array<double>")
    def noisy(ids: pa.Array, vec: pa.Array) -> pa.Array:
        x = K.to_matrix(vec)
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        return K.to_lists(x + std_dev * normal_array(K.ints(ids), x.shape[1], draw, seed))

    return points.withColumn("embedding", noisy("row_id", "embedding"))


def guess(x: np.ndarray, ids: np.ndarray, layers, copies: int, std_dev: float, temperature: float, draw: int,
          seed: int, pseudo: str = "softmax") -> np.ndarray:
    """Pseudo-labels of one batch: logits averaged over noisy copies, then softmax (or sigmoid), then sharpened."""
    z = sum(run_layers(x + std_dev * normal_array(ids, x.shape[1], draw + c, seed), layers)[-1]
            for c in range(copies)) / copies
    if pseudo == "sigmoid":
        return K.sigmoid(z)
    return K.sharpen(K.softmax(z), temperature)


def pseudo_labels(points: DataFrame, layers: list[np.ndarray], copies: int = 2, std_dev: float = 0.1,
                  temperature: float = 0.5, draw: int = 0, seed: int = 0, pseudo: str = "softmax") -> DataFrame:
    """Add ``target`` with the pseudo-label of every row."""
    shared = ship(points.sparkSession, layers)

    @arrow_udf("array<double>")
    def label(ids: pa.Array, vec: pa.Array) -> pa.Array:
        x = K.to_matrix(vec)
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        return K.to_lists(guess(x, K.ints(ids), shared.value, copies, std_dev, temperature, draw, seed, pseudo))

    return points.withColumn("target", label("row_id", "embedding"))


def with_partner(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``b_*`` columns with the mixing partner: the row at the same place of a random order of the batch.

    ``rows``: epoch, batch, is_unlabeled, pos, row_id, embedding, target. A batch has a fixed size, so its rows fit into
    one array: sorted both ways and zipped, it yields the pairs after a single shuffle.
    """
    u = uniform(F.col("row_id"), F.pmod("batch", F.lit(1_000_003)), PARTNER_DRAW, seed)
    item = F.struct("is_unlabeled", "pos", "row_id", "embedding", "target", u.alias("u"))
    in_order = F.array_sort("items")  # by is_unlabeled, pos
    shuffled = F.array_sort(F.transform("items", lambda s: F.struct(s["u"], s["row_id"], s["embedding"], s["target"])))
    pairs = F.posexplode(F.arrays_zip(in_order.alias("a"), shuffled.alias("b"))).alias("at", "pair")
    grouped = rows.groupBy("epoch", "batch").agg(F.collect_list(item).alias("items"))
    names = ("row_id", "embedding", "target")
    return grouped.select("epoch", "batch", F.size("items").alias("size"), pairs).select(
        "epoch", "batch", (F.col("at") + 1).alias("slot"), "size", *[F.col(f"pair.a.{c}").alias(c) for c in names],
        *[F.col(f"pair.b.{c}").alias(f"b_{c}") for c in names])


def mixed_rows(rows: DataFrame, share: float = 0.75, seed: int = 0) -> DataFrame:
    """(epoch, batch, slot, row_id, partner_id, embedding, target): inputs and targets mixed with their partners."""
    paired = with_partner(rows, seed)
    return paired.select("epoch", "batch", "slot", "row_id", F.col("b_row_id").alias("partner_id"),
                         mix(F.col("embedding"), F.col("b_embedding"), share).alias("embedding"),
                         mix(F.col("target"), F.col("b_target"), share).alias("target"))


def redealt(labeled: DataFrame, epochs: range, size: int, n_labeled: int, seed: int = 0) -> DataFrame:
    """The labeled rows once per epoch, with ``epoch`` and the batch and place they have in it.

    Places are permuted by numbers alone; the first epoch has the batches as they were dealt.
    """
    turns = F.array(*[F.struct(F.lit(e).cast("long").alias("epoch"), *[F.lit(x).cast("long").alias(name) for name, x in
                               zip("ac", turn(n_labeled, e, PLACES, seed))]) for e in epochs])
    each = labeled.withColumn("_turn", F.explode(turns))
    place = F.pmod((F.col("batch") * size + F.col("pos")) * F.col("_turn.a") + F.col("_turn.c"), F.lit(n_labeled))
    return (each.withColumn("_place", place).withColumn("epoch", F.col("_turn.epoch"))
            .withColumn("batch", F.floor(F.col("_place") / size)).withColumn("pos", F.pmod("_place", F.lit(size)).cast("int"))
            .drop("_turn", "_place"))


def batch_rows(labeled: DataFrame, unlabeled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of every batch pair: the labeled batch followed by its unlabeled batch.

    If ``labeled`` has a column ``epoch``, its batches are those of that epoch only.
    """
    on = ["labeled_batch", "epoch"] if "epoch" in labeled.columns else ["labeled_batch"]
    left = labeled.withColumnRenamed("batch", "labeled_batch").join(pairs, on)
    right = unlabeled.withColumnRenamed("batch", "unlabeled_batch").join(pairs, "unlabeled_batch")
    cols = ["epoch", "batch", "pos", "row_id", "embedding", "target"]
    return stack(left.select(F.lit(0).alias("is_unlabeled"), *cols), right.select(F.lit(1).alias("is_unlabeled"), *cols))


def mixed_gradient(plan: DataFrame, layers: list[np.ndarray], n_batches: int, loss: str, *, share: float, copies: int,
                   std_dev: float, temperature: float, draw: int, seed: int,
                   pseudo: str) -> tuple[float, list[np.ndarray]]:
    """Loss and gradient over the batches of ``plan`` (paired rows), the mean of the batch means.

    Pseudo-labels are made with the current weights in the same task and are not differentiated.
    """
    shared = ship(plan.sparkSession, layers)

    def side(batch, prefix, weights):
        x, ids = K.to_matrix(batch.column(prefix + "embedding")), K.ints(batch.column(prefix + "row_id"))
        known = batch.column(prefix + "target")
        open_rows = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        y = np.zeros((len(x), weights[-1].size))
        done = np.setdiff1d(np.arange(len(x)), open_rows)
        if done.size:
            y[done] = K.to_matrix(known.take(pa.array(done)))
        if open_rows.size:
            y[open_rows] = guess(x[open_rows], ids[open_rows], weights, copies, std_dev, temperature, draw, seed, pseudo)
        return x, y

    def fold(acc, batch):
        weights = shared.value
        (x, y), (x2, y2) = side(batch, "", weights), side(batch, "b_", weights)
        values = run_layers(share * x + (1 - share) * x2, weights)
        row_weight = 1.0 / (K.ints(batch.column("size")) * float(n_batches))
        total, grad = logit_gradient(values[-1], share * y + (1 - share) * y2, row_weight, loss)
        add_gradient(acc, values, weights, grad)
        acc["loss"] += total
        acc["weight"] += row_weight.sum()

    cols = ["row_id", "embedding", "target", "b_row_id", "b_embedding", "b_target", "size"]
    got = collect_sums(plan.select(*cols), gradient_shapes(layers), fold)
    shared.destroy()
    return float(got["loss"][0]), [got[str(i)] for i in range(len(layers))]


def fit_mixmatch(points: DataFrame, selected: DataFrame, n_classes: int, task: str = "single", *, epochs: int = 100,
                 lr: float = 0.001, batch_size: int = 64, copies: int = 2, temperature: float = 0.5,
                 std_dev: float = 0.1, share: float = 0.75, hidden: tuple[int, ...] = (256, 128),
                 validation: DataFrame | None = None, patience: int | None = None, keep: str = "last",
                 pseudo: str = "softmax", batches_per_step: int | None = None, seed: int = 0,
                 init: list[np.ndarray] | None = None, resume: Resume | None = None) -> Training:
    """Train a classifier from the labels of the selected rows and pseudo-labels of the rest.

    Every epoch deals the labeled rows into other batches and pairs each with the next unlabeled batch in a seeded random
    order, so it needs exactly as many unlabeled batches as there are labeled ones. These are drawn once for all epochs and kept in a scratch table
    together with their mixing partners, which do not depend on the weights: a step is one narrow pass over its epoch.
    If the batches of all epochs would be more than ``PLAN_ROWS`` rows, they are laid out a few epochs at a time.
    One optimizer step per epoch, or one per ``batches_per_step`` batches.
    """
    spark, loss = points.sparkSession, task_loss(task)
    mixing = dict(share=share, copies=copies, std_dev=std_dev, temperature=temperature, seed=seed, pseudo=pseudo)
    with scratch_tables(spark) as write, ExitStack() as plans:
        labels, rest = split_rows(points, selected, write)
        labels = with_target(labels, task, n_classes)
        rest = rest.select("row_id", "embedding", F.lit(None).cast("array<double>").alias("target"))
        lab = write(batches(labels, batch_size, seed), "labeled_batches")
        top = lab.agg(F.max("batch").alias("b"), F.count("*").alias("n"), F.first(F.size("embedding")).alias("d")).first()
        if top["b"] is None:
            raise ValueError("none of the selected rows is in the table")
        n_lab, n_labeled, dim = top["b"] + 1, top["n"], top["d"]
        unl = write(batches(rest, batch_size, seed + 1, first=epochs * n_lab), "unlabeled_batches")
        last = unl.agg(F.max("batch")).first()[0]
        if last is None:
            raise ValueError("no unlabeled row is left")
        pairs = pair_batches(spark, n_lab, last + 1, epochs)
        chunk = max(1, min(epochs, PLAN_ROWS // (2 * batch_size * n_lab)))
        step_batches, adam, plan = batches_per_step or n_lab, Adam(lr), None

        def epoch(params, number):
            nonlocal plan
            if plan is None or number % chunk == 0:
                plans.close()  # drops the layout of the epochs before
                until = number - number % chunk + chunk  # a resumed training may begin inside a chunk
                now = pairs.filter((F.col("epoch") >= number) & (F.col("epoch") < until))
                laid_out = with_partner(batch_rows(redealt(lab, range(number, min(until, epochs)), batch_size,
                                                           n_labeled, seed), unl, now), seed)
                if chunk > 1 or step_batches < n_lab:
                    # range order lets a step skip the row groups of other steps; a step that reads all needs none
                    laid_out = laid_out.repartitionByRange("epoch", "batch").sortWithinPartitions("epoch", "batch")
                plan = plans.enter_context(scratch_tables(spark))(laid_out, "mixing_plan")
            losses = []
            for start in range(0, n_lab, step_batches):
                count = min(step_batches, n_lab - start)
                first = number * n_lab + start
                rows = plan.filter((F.col("epoch") == number) & F.col("batch").between(first, first + count - 1))
                value, grads = mixed_gradient(rows, params, count, loss, draw=number * copies, **mixing)
                params = adam.update(params, grads)
                losses.append(value)
            return float(np.mean(losses)), params

        check = None if validation is None else lambda p: validation_loss(validation, p, task, n_classes)
        return train(init or init_classifier(dim, n_classes, hidden, seed), epoch, epochs, check, patience, keep, adam,
                     resume=resume)
