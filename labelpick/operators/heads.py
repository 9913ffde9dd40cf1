"""Linear cluster heads: losses, training and selection of the most confident rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from labelpick.functions import kernels as K
from labelpick.functions.vectors import argmax, array_of, kl_rows, log_softmax, sharpen, softmax
from labelpick.operators.nn import Adam, Training, train
from labelpick.operators.partials import collect_sums
from labelpick.operators.ranks import positions
from labelpick.operators.steps import lay_out, most_rows_of_run, take_steps
from labelpick.session import scratch_tables, ship
from labelpick.sources.states import Resume
from labelpick.sources.tables import dimension

# fixed values of the method
MOMENTUM = 0.1
ADJUSTMENT_WEIGHT = 0.1
SHARPEN_TEMPERATURE = 0.5
CONFIDENCE_THRESHOLD = 0.8


def init_heads(dim: int, n_clusters: int, n_heads: int = 3, seed: int = 0) -> list[np.ndarray]:
    """[W, b] with W of shape (heads, dim, clusters), uniform in +-1/sqrt(dim)."""
    rng, bound = np.random.default_rng(seed), 1.0 / np.sqrt(dim)
    return [rng.uniform(-bound, bound, (n_heads, dim, n_clusters)), rng.uniform(-bound, bound, (n_heads, n_clusters))]


def head_outputs(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, heads, clusters)."""
    n_heads, dim, n_clusters = w.shape
    K.check_dim(x, dim)
    return (x @ w.transpose(1, 0, 2).reshape(dim, -1)).reshape(-1, n_heads, n_clusters) + b


def head_logits(points: DataFrame, heads: list[np.ndarray]) -> DataFrame:
    """(row_id, head, logits)."""
    shared = ship(points.sparkSession, heads)

    @arrow_udf("array<array<double>>")
    def forward(vec: pa.Array) -> pa.Array:
        x = K.to_matrix(vec)
        if not len(x):
            return pa.array([], pa.list_(pa.list_(pa.float64())))
        z = head_outputs(x, *shared.value)
        offsets = np.arange(0, z.shape[0] * z.shape[1] + 1, z.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), K.to_lists(z.reshape(-1, z.shape[2])))

    return points.select("row_id", F.posexplode(forward("embedding")).alias("head", "logits"))


def scored(logits: DataFrame) -> DataFrame:
    """Add probabilities ``p``, the largest one and its class."""
    rows = logits.withColumn("p", softmax(F.col("logits")))
    return rows.withColumn("max_prob", F.array_max("p")).withColumn("target", argmax(F.col("p")))


def confident(logits: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Rows and heads whose largest probability is strictly above the threshold."""
    return scored(logits).filter(F.col("max_prob") > threshold)


def pseudo_class_weights(logits: DataFrame, threshold: float = CONFIDENCE_THRESHOLD,
                         renormalize: bool = False) -> DataFrame:
    """(head, target, n, weight): confident rows per pseudo class and the weight that balances the classes."""
    counts = confident(logits, threshold).groupBy("head", "target").agg(F.count("*").alias("n"))
    head = Window.partitionBy("head")  # one row per class
    weight = F.sum("n").over(head) / F.col("n")
    if renormalize:
        weight = weight / F.count("*").over(head)
    return counts.select("head", "target", "n", weight.alias("weight"))


def _per_head(values: np.ndarray) -> Column:
    """Row ``head`` of a (heads, clusters) array as an array literal."""
    return F.element_at(F.array(*[array_of(row) for row in values]), F.col("head") + 1)


def _heads_table(logits: DataFrame, values: np.ndarray, name: str) -> DataFrame:
    rows = [(h, c, float(v)) for h, row in enumerate(values) for c, v in enumerate(row)]
    return logits.sparkSession.createDataFrame(rows, f"head int, target int, {name} double")


def count_ema_step(logits: DataFrame, ema: np.ndarray, data_len: int, momentum: float = MOMENTUM,
                   threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """(head, target, ema): moving average of the pseudo class counts scaled to ``data_len`` rows."""
    counts = pseudo_class_weights(logits, threshold).select("head", "target", "n")
    joined = _heads_table(logits, ema, "old").join(counts, ["head", "target"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    share = F.try_divide(n, F.sum(n).over(Window.partitionBy("head")))
    return joined.select("head", "target", (F.col("old") * momentum + share * data_len * (1 - momentum)).alias("ema"))


def prob_ema_step(logits: DataFrame, ema: np.ndarray, momentum: float = MOMENTUM) -> DataFrame:
    """(head, target, ema): moving average of the mean probability, scaled to sum 1 per head."""
    mean = (logits.groupBy("head").agg(Summarizer.mean(array_to_vector(softmax(F.col("logits")))).alias("m"))
            .select("head", F.posexplode(vector_to_array("m")).alias("target", "mean")))
    moved = _heads_table(logits, ema, "old").join(mean, ["head", "target"]).select(
        "head", "target", (F.col("old") * momentum + F.col("mean") * (1 - momentum)).alias("e"))
    return moved.select("head", "target", (F.col("e") / F.sum("e").over(Window.partitionBy("head"))).alias("ema"))


def confidence_by_class(logits: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """(head, target, n, n_confident, max_confidence): diagnostics over all rows."""
    return scored(logits).groupBy("head", "target").agg(
        F.count("*").alias("n"), F.count_if(F.col("max_prob") > threshold).alias("n_confident"),
        F.max("max_prob").alias("max_confidence"))


def mask_rate(logits: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """(head, n, n_confident, rate, mean_max_prob)."""
    return scored(logits).groupBy("head").agg(
        F.count("*").alias("n"), F.count_if(F.col("max_prob") > threshold).alias("n_confident"),
        F.avg((F.col("max_prob") > threshold).cast("double")).alias("rate"),
        F.avg("max_prob").alias("mean_max_prob"))


def mean_probabilities(logits: DataFrame) -> DataFrame:
    """(head, target, mean_prob)."""
    return (logits.groupBy("head").agg(Summarizer.mean(array_to_vector(softmax(F.col("logits")))).alias("m"))
            .select("head", F.posexplode(vector_to_array("m")).alias("target", "mean_prob")))


def local_loss(logits: DataFrame, ema: np.ndarray, adjustment_weight: float = ADJUSTMENT_WEIGHT,
               temperature: float = SHARPEN_TEMPERATURE) -> DataFrame:
    """(head, loss): divergence of the probabilities from their own adjusted and sharpened form, mean over rows."""
    lift = _per_head(adjustment_weight * np.log(ema))
    adjusted = F.zip_with("logits", lift, lambda z, a: z - a)
    rows = logits.withColumn("aim", sharpen(softmax(adjusted), temperature))
    return rows.groupBy("head").agg(F.avg(kl_rows(F.col("logits"), F.col("aim"))).alias("loss"))


def global_loss(logits: DataFrame, n_heads: int, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """(head, loss): class-balanced cross-entropy of confident rows with their own class; 0 where no row is confident.

    Class balancing makes it the mean over the present classes of the mean loss within the class.
    """
    rows = confident(logits, threshold)
    ce = -F.element_at(log_softmax(F.col("logits")), F.col("target") + 1)
    by_class = rows.groupBy("head", "target").agg(F.avg(ce).alias("ce"))
    found = by_class.groupBy("head").agg(F.avg("ce").alias("loss"))
    every = logits.sparkSession.range(n_heads).select(F.col("id").cast("int").alias("head"))
    return every.join(found, "head", "left").select("head", F.coalesce("loss", F.lit(0.0)).alias("loss"))


@dataclass
class HeadSums:
    """Sums over all rows, per head and class, that give both losses and the next moving average."""
    n: float
    prob: np.ndarray
    local: np.ndarray
    confident: np.ndarray
    ce: np.ndarray

    def loss(self) -> float:
        with np.errstate(divide="ignore", invalid="ignore"):
            class_mean = np.where(self.confident > 0, self.ce / self.confident, 0.0)
        present = np.maximum((self.confident > 0).sum(axis=1), 1)
        return float(self.local.sum() / self.n + (class_mean.sum(axis=1) / present).sum())

    def next_ema(self, ema: np.ndarray, momentum: float) -> np.ndarray:
        moved = ema * momentum + self.prob / self.n * (1 - momentum)
        return moved / moved.sum(axis=1, keepdims=True)


def _aims(z: np.ndarray, ema: np.ndarray) -> np.ndarray:
    return K.sharpen(K.softmax(z - ADJUSTMENT_WEIGHT * np.log(ema)), SHARPEN_TEMPERATURE)


def _sum_shapes(b: np.ndarray) -> dict[str, tuple[int, ...]]:
    return {"n": (1,), "local": b.shape[:1], "prob": b.shape, "confident": b.shape, "ce": b.shape}


def _add_sums(acc: dict[str, np.ndarray], vectors: np.ndarray, w: np.ndarray, b: np.ndarray, ema: np.ndarray,
              threshold: float) -> None:
    for x in K.row_tiles(vectors, b.size):
        z = head_outputs(x, w, b)
        log_p, aim = K.log_softmax(z), _aims(z, ema)
        p = np.exp(log_p)
        target, top = p.argmax(axis=2), p.max(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            acc["local"] += np.where(aim > 0, aim * (np.log(aim) - log_p), 0.0).sum(axis=(0, 2))
        acc["n"] += len(z)
        acc["prob"] += p.sum(axis=0)
        rows, head = np.nonzero(top > threshold)
        at = (head, target[rows, head])
        np.add.at(acc["confident"], at, 1.0)
        np.add.at(acc["ce"], at, -log_p[rows, head, at[1]])


def _as_sums(acc: dict[str, np.ndarray]) -> HeadSums:
    if acc["n"][0] == 0:
        raise ValueError("no rows to train on")
    return HeadSums(float(acc["n"][0]), acc["prob"], acc["local"], acc["confident"], acc["ce"])


def head_sums(points: DataFrame, heads: list[np.ndarray], ema: np.ndarray,
              threshold: float = CONFIDENCE_THRESHOLD) -> HeadSums:
    shared = ship(points.sparkSession, [*heads, ema])

    def fold(acc, batch):
        _add_sums(acc, K.to_matrix(batch.column(0)), *shared.value, threshold)

    got = collect_sums(points.select("embedding"), _sum_shapes(heads[1]), fold)
    shared.destroy()
    return _as_sums(got)


def _class_share(sums: HeadSums) -> np.ndarray:
    """Weight of a confident row of each class."""
    present = np.maximum((sums.confident > 0).sum(axis=1, keepdims=True), 1)
    return 1.0 / (np.maximum(sums.confident, 1.0) * present)


def _add_gradient(acc: dict[str, np.ndarray], vectors: np.ndarray, w: np.ndarray, b: np.ndarray, ema: np.ndarray,
                  class_share: np.ndarray, n: float, threshold: float) -> None:
    for x in K.row_tiles(vectors, b.size):
        z = head_outputs(x, w, b)
        p = K.softmax(z)
        grad = (p - _aims(z, ema)) / n
        target, top = p.argmax(axis=2), p.max(axis=2)
        rows, head = np.nonzero(top > threshold)
        cls = target[rows, head]
        share = class_share[head, cls]
        grad[rows, head] += p[rows, head] * share[:, None]
        grad[rows, head, cls] -= share
        acc["b"] += grad.sum(axis=0)
        acc["w"] += (x.T @ grad.reshape(len(x), -1)).reshape(x.shape[1], *b.shape).transpose(1, 0, 2)


def head_gradient(points: DataFrame, heads: list[np.ndarray], ema: np.ndarray, sums: HeadSums,
                  threshold: float = CONFIDENCE_THRESHOLD) -> list[np.ndarray]:
    """Gradient of local plus global loss over all rows; ``sums`` supplies the class counts of the same weights."""
    shared, n = ship(points.sparkSession, [*heads, ema, _class_share(sums)]), sums.n

    def fold(acc, batch):
        _add_gradient(acc, K.to_matrix(batch.column(0)), *shared.value, n, threshold)

    got = collect_sums(points.select("embedding"), {"w": heads[0].shape, "b": heads[1].shape}, fold)
    shared.destroy()
    return [got["w"], got["b"]]


def _vectors(rows: pa.Table) -> list[np.ndarray]:
    return [K.to_matrix(rows["embedding"].combine_chunks())]


def _step(now: list[np.ndarray], x: np.ndarray, adam: Adam, momentum: float) -> tuple[list[np.ndarray], float]:
    """One optimizer step on the rows of an array; the state is the moving average and what ``adam`` packs."""
    ema, (w, b) = now[0], adam.unpacked(now[1:])
    acc = {name: np.zeros(shape) for name, shape in _sum_shapes(b).items()}
    _add_sums(acc, x, w, b, ema, CONFIDENCE_THRESHOLD)
    sums, grads = _as_sums(acc), {"w": np.zeros(w.shape), "b": np.zeros(b.shape)}
    _add_gradient(grads, x, w, b, ema, _class_share(sums), sums.n, CONFIDENCE_THRESHOLD)
    return [sums.next_ema(ema, momentum), *adam.packed(adam.update([w, b], [grads["w"], grads["b"]]))], sums.loss()


def fit_heads(points: DataFrame, n_clusters: int, n_heads: int = 3, epochs: int = 100, lr: float = 0.001,
              validation: DataFrame | None = None, patience: int | None = None, keep: str = "last", seed: int = 0,
              momentum: float = MOMENTUM, init: list[np.ndarray] | None = None, batch_size: int | None = None,
              batches_per_step: int = 1, resume: Resume | None = None) -> tuple[Training, np.ndarray]:
    """Train the heads; also returns the moving average of the probabilities.

    With a ``batch_size`` there is one step per ``batches_per_step`` batches, in an order of its own every epoch; the
    moving average moves at every step, and the loss of an epoch is the mean over its steps. Without one, every epoch is
    one step over all rows. The validation loss reads the moving average but never changes it.
    """
    dim = dimension(points)
    state, adam = {"ema": np.full((n_heads, n_clusters), 1.0 / n_clusters)}, Adam(lr)
    with scratch_tables(points.sparkSession) as write:
        layout = None if batch_size is None else lay_out(points.select("row_id", "embedding"), batch_size,
                                                         batches_per_step, seed, write)

        most = 0 if layout is None else most_rows_of_run(layout, dim)

        def epoch(params, number):
            losses = []
            if most:
                kind = (adam.lr, adam.beta1, adam.beta2, adam.epsilon)
                now, losses = take_steps(layout, number, most, [state["ema"], *adam.packed(params)], _vectors,
                                         lambda now, arrays, at: _step(now, *arrays, Adam(*kind), momentum))
                state["ema"] = now[0]
                return float(np.mean(losses)), adam.unpacked(now[1:])
            for step in [points] if layout is None else layout.steps(number):
                sums = head_sums(step, params, state["ema"])
                grads = head_gradient(step, params, state["ema"], sums)
                state["ema"] = sums.next_ema(state["ema"], momentum)
                params = adam.update(params, grads)
                losses.append(sums.loss())
            return float(np.mean(losses)), params

        check = None if validation is None else lambda p: head_sums(validation, p, state["ema"]).loss()
        fit = train(init or init_heads(dim, n_clusters, n_heads, seed), epoch, epochs, check, patience, keep, adam,
                    state, resume)
    return fit, state["ema"]


def head_scores(points: DataFrame, heads: list[np.ndarray]) -> DataFrame:
    """(row_id, cluster, score): largest class probability after averaging over the heads."""
    shared = ship(points.sparkSession, heads)

    @arrow_udf("struct<cluster:int,score:double>")
    def score(vec: pa.Array) -> pa.Array:
        x = K.to_matrix(vec)
        if not len(x):
            return pa.array([], pa.struct([("cluster", pa.int32()), ("score", pa.float64())]))
        p = K.softmax(head_outputs(x, *shared.value)).mean(axis=1)
        return pa.StructArray.from_arrays([pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.max(axis=1))],
                                          names=["cluster", "score"])

    return points.select("row_id", score("embedding").alias("_s")).select("row_id", "_s.cluster", "_s.score")


def top_scores(points: DataFrame, heads: list[np.ndarray], n: int) -> DataFrame:
    """(row_id, cluster, score, rank): the n rows with the highest score, smallest row id first on ties."""
    placed = positions(head_scores(points, heads), F.desc("score"), "row_id", name="rank")
    return placed.where(F.col("rank") < n).withColumn("rank", (F.col("rank") + 1).cast("int"))


def select_heads(points: DataFrame, n_clusters: int, n_heads: int = 3, epochs: int = 100, lr: float = 0.001,
                 validation: DataFrame | None = None, patience: int | None = None, keep: str = "last",
                 seed: int = 0, batch_size: int | None = None, batches_per_step: int = 1) -> DataFrame:
    """Train heads on all points and pick the ``n_clusters`` rows they are most confident about."""
    fit, _ = fit_heads(points, n_clusters, n_heads, epochs, lr, validation, patience, keep, seed, batch_size=batch_size,
                       batches_per_step=batches_per_step)
    return top_scores(points, fit.params, n_clusters).select("row_id", "cluster", "rank", "score")
