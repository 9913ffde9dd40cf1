"""Small networks trained by distributed gradients.

The weights are broadcast once per step, every task returns the gradient of its rows, Spark adds the gradients up and
the driver applies Adam. The data never moves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from labelpick.functions import kernels as K
from labelpick.functions.random import uniform_array
from labelpick.functions.vectors import argmax, bce_rows, doubles, kl_rows, one_hot, over_threshold, sigmoid
from labelpick.operators.partials import collect_sums
from labelpick.operators.steps import lay_out, most_rows_of_run, take_steps
from labelpick.session import scratch_tables, ship
from labelpick.sources.states import Resume
from labelpick.sources.tables import dimension

HIDDEN = (256, 128)
DROPOUT_DRAW = 900_003


def init_layers(dims: list[int], seed: int = 0) -> list[np.ndarray]:
    """[W0, b0, W1, b1, ...] with W of shape (in, out), uniform in +-1/sqrt(in)."""
    rng = np.random.default_rng(seed)
    layers = []
    for n_in, n_out in zip(dims[:-1], dims[1:]):
        bound = 1.0 / np.sqrt(n_in)
        layers += [rng.uniform(-bound, bound, (n_in, n_out)), rng.uniform(-bound, bound, n_out)]
    return layers


def init_classifier(dim: int, n_classes: int, hidden: tuple[int, ...] = HIDDEN, seed: int = 0) -> list[np.ndarray]:
    return init_layers([dim, *hidden, n_classes], seed)


def run_layers(x: np.ndarray, layers: list[np.ndarray], masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Inputs of every layer followed by the logits; ReLU between layers, then the dropout mask if given."""
    K.check_dim(x, layers[0].shape[0])
    values = [x]
    last = len(layers) // 2 - 1
    for i in range(last + 1):
        z = values[-1] @ layers[2 * i] + layers[2 * i + 1]
        if i < last:
            z = np.maximum(z, 0.0)
            if masks is not None:
                z = z * masks[i]
        values.append(z)
    return values


def dropout_masks(ids: np.ndarray, layers: list[np.ndarray], rate: float, step: int, seed: int) -> list[np.ndarray]:
    """Inverted dropout: kept units are scaled by 1 / (1 - rate). Depends only on row, unit, layer and step."""
    return [(uniform_array(ids, np.arange(layers[i].shape[1]), DROPOUT_DRAW + step, seed + i) >= rate) / (1.0 - rate)
            for i in range(0, len(layers) - 2, 2)]


def logit_gradient(z: np.ndarray, target: np.ndarray, weight: np.ndarray, loss: str,
                   pos_weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Weighted loss sum and its gradient with respect to the logits. ``kl``: soft targets; ``bce``: mean over labels."""
    if loss == "kl":
        log_p = K.log_softmax(z)
        with np.errstate(divide="ignore", invalid="ignore"):
            rows = np.where(target > 0, target * (np.log(target) - log_p), 0.0).sum(axis=1)
        grad = np.exp(log_p) * target.sum(axis=1, keepdims=True) - target
    elif loss == "bce":
        pw = 1.0 if pos_weight is None else pos_weight
        factor = 1.0 + (pw - 1.0) * target
        soft = np.maximum(-z, 0.0) + np.log1p(np.exp(-np.abs(z)))
        rows = ((1.0 - target) * z + factor * soft).mean(axis=1)
        grad = ((1.0 - target) - factor * K.sigmoid(-z)) / z.shape[1]
    else:
        raise ValueError(f"unknown loss {loss}")
    return float((weight * rows).sum()), grad * weight[:, None]


def add_gradient(acc: dict[str, np.ndarray], values: list[np.ndarray], layers: list[np.ndarray], grad: np.ndarray,
                 masks: list[np.ndarray] | None = None) -> None:
    """Back-propagate ``grad`` at the logits and add the layer gradients to acc["0"], acc["1"], ..."""
    for i in range(len(layers) // 2 - 1, -1, -1):
        acc[str(2 * i)] += values[i].T @ grad
        acc[str(2 * i + 1)] += grad.sum(axis=0)
        if i:
            grad = (grad @ layers[2 * i].T) * (values[i] > 0)
            if masks is not None:
                grad = grad * masks[i - 1]


def gradient_shapes(layers: list[np.ndarray]) -> dict[str, tuple[int, ...]]:
    return {str(i): a.shape for i, a in enumerate(layers)} | {"loss": (1,), "weight": (1,)}


def _arrays(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """Ids, vectors and targets."""
    columns = (rows.column(c) for c in ("row_id", "embedding", "target"))
    ids, x, y = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)
    return [K.ints(ids), K.to_matrix(x), K.to_matrix(y)]


def add_loss_gradient(acc: dict[str, np.ndarray], ids: np.ndarray, x: np.ndarray, y: np.ndarray, layers: list[np.ndarray],
                      loss: str, pos_weight: np.ndarray | None, dropout: float, step: int, seed: int) -> None:
    """Add loss, weight and gradient sums of some rows."""
    masks = dropout_masks(ids, layers, dropout, step, seed) if dropout else None
    values = run_layers(x, layers, masks)
    total, grad = logit_gradient(values[-1], y, np.ones(len(x)), loss, pos_weight)
    add_gradient(acc, values, layers, grad, masks)
    acc["loss"] += total
    acc["weight"] += len(x)


def gradient(rows: DataFrame, layers: list[np.ndarray], loss: str = "kl", pos_weight: np.ndarray | None = None,
             dropout: float = 0.0, step: int = 0, seed: int = 0) -> tuple[float, list[np.ndarray]]:
    """Mean loss and gradient over rows (row_id, embedding, target array)."""
    shared = ship(rows.sparkSession, layers)

    def fold(acc, batch):
        add_loss_gradient(acc, *_arrays(batch), shared.value, loss, pos_weight, dropout, step, seed)

    got = collect_sums(rows.select("row_id", "embedding", "target"), gradient_shapes(layers), fold)
    shared.destroy()
    n = got["weight"][0]
    if n == 0:
        raise ValueError("no rows to train on")
    return float(got["loss"][0] / n), [got[str(i)] / n for i in range(len(layers))]


@dataclass
class Adam:
    lr: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    steps: int = 0
    mean: list[np.ndarray] = field(default_factory=list)
    square: list[np.ndarray] = field(default_factory=list)

    def update(self, params: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        if not self.mean:
            self.mean = [np.zeros_like(p) for p in params]
            self.square = [np.zeros_like(p) for p in params]
        self.steps += 1
        out = []
        for i, (p, g) in enumerate(zip(params, grads)):
            self.mean[i] = self.beta1 * self.mean[i] + (1 - self.beta1) * g
            self.square[i] = self.beta2 * self.square[i] + (1 - self.beta2) * g * g
            m = self.mean[i] / (1 - self.beta1 ** self.steps)
            v = self.square[i] / (1 - self.beta2 ** self.steps)
            out.append(p - self.lr * m / (np.sqrt(v) + self.epsilon))
        return out

    def packed(self, params: list[np.ndarray]) -> list[np.ndarray]:
        """The parameters with the state of the optimizer, for ``unpacked``."""
        none = [np.zeros_like(p) for p in params]
        return [np.array([float(self.steps)]), *params, *(self.mean or none), *(self.square or none)]

    def unpacked(self, arrays: list[np.ndarray]) -> list[np.ndarray]:
        """Take over a state of the optimizer; returns the parameters."""
        n = len(arrays) // 3
        self.steps, self.mean, self.square = int(arrays[0][0]), list(arrays[1 + n:1 + 2 * n]), list(arrays[1 + 2 * n:])
        return list(arrays[1:1 + n])


@dataclass
class Training:
    params: list[np.ndarray]
    losses: list[float]
    validation: list[float]
    stopped_early: bool


def train(params: list[np.ndarray], epoch: Callable[[list[np.ndarray], int], tuple[float, list[np.ndarray]]],
          epochs: int, validate: Callable[[list[np.ndarray]], float] | None = None, patience: int | None = None,
          keep: str = "last", adam: Adam | None = None, extra: dict[str, np.ndarray] | None = None,
          resume: Resume | None = None) -> Training:
    """Run ``epoch(params, number) -> (loss, params)`` until the validation loss has not improved ``patience`` times.

    ``keep="last"`` returns the weights of the last epoch, ``"best"`` those with the lowest validation loss. With
    ``resume``, the state of the last finished epoch is stored after each one, and a training that was broken off goes on
    from it; ``adam`` and the arrays in ``extra`` belong to that state and are changed in place.
    """
    losses, checks, best, best_params, waited = [], [], np.inf, params, 0
    state = resume.load() if resume is not None else None
    if state is not None:
        params, best_params = state["params"], state["best"]
        losses, checks = state["losses"].tolist(), state["checks"].tolist()
        best, waited = min(checks, default=np.inf), int(state["counters"][0])
        if adam is not None:
            adam.steps, adam.mean, adam.square = int(state["counters"][1]), state["mean"], state["square"]
        for name in extra or {}:
            extra[name] = state["extra"][name]

    def over() -> bool:
        return patience is not None and validate is not None and waited >= patience

    for number in range(len(losses), epochs):
        if over():
            break
        loss, params = epoch(params, number)
        losses.append(loss)
        if validate is not None:
            checks.append(validate(params))
            if checks[-1] < best:
                best, best_params, waited = checks[-1], params, 0
            else:
                waited += 1
        if resume is not None:
            resume.save({"params": params, "best": best_params, "losses": np.array(losses), "checks": np.array(checks),
                         "counters": np.array([waited, adam.steps if adam else 0], float),
                         "mean": adam.mean if adam else [], "square": adam.square if adam else [], "extra": extra or {}})
    return Training(best_params if keep == "best" and checks else params, losses, checks, over())


def with_target(rows: DataFrame, task: str, n_classes: int) -> DataFrame:
    """(row_id, embedding, target): integer labels become one-hot, label arrays are cast."""
    target = one_hot(F.col("label"), n_classes) if task == "single" else doubles("label")
    return rows.select("row_id", "embedding", target.alias("target"))


def task_loss(task: str) -> str:
    if task not in ("single", "multi", "onehot"):
        raise ValueError(f"unknown task {task}")
    return "bce" if task == "multi" else "kl"


def fit_supervised(rows: DataFrame, n_classes: int, task: str = "multi", epochs: int = 50, lr: float = 0.001,
                   hidden: tuple[int, ...] = HIDDEN, pos_weight: np.ndarray | None = None, dropout: float = 0.0,
                   seed: int = 0, validation: DataFrame | None = None, patience: int | None = None,
                   keep: str = "last", init: list[np.ndarray] | None = None, batch_size: int | None = None,
                   batches_per_step: int = 1, resume: Resume | None = None) -> Training:
    """Train on all labels (row_id, embedding, label).

    With a ``batch_size`` there is one step per ``batches_per_step`` batches, in an order of its own every epoch; the loss
    of an epoch is the mean over its steps. Without one, every epoch is one step over all rows.
    """
    data, loss, adam = with_target(rows, task, n_classes), task_loss(task), Adam(lr)
    dim = dimension(rows)
    with scratch_tables(rows.sparkSession) as write:
        layout = None if batch_size is None else lay_out(data, batch_size, batches_per_step, seed, write)

        most = 0 if layout is None else most_rows_of_run(layout, dim + n_classes)

        def epoch(params, number):
            losses = []
            if most:
                kind, base = (adam.lr, adam.beta1, adam.beta2, adam.epsilon), number * layout.n_batches

                def one(now, arrays, at):
                    own = Adam(*kind)
                    now = own.unpacked(now)
                    acc = {name: np.zeros(shape) for name, shape in gradient_shapes(now).items()}
                    add_loss_gradient(acc, *arrays, now, loss, pos_weight, dropout, base + at, seed)
                    n = acc["weight"][0]
                    now = own.update(now, [acc[str(i)] / n for i in range(len(now))])
                    return own.packed(now), float(acc["loss"][0] / n)

                state, losses = take_steps(layout, number, most, adam.packed(params), _arrays, one)
                return float(np.mean(losses)), adam.unpacked(state)
            for at, step in enumerate([data] if layout is None else layout.steps(number)):
                draw = number if layout is None else number * layout.n_batches + at
                value, grads = gradient(step, params, loss, pos_weight, dropout, draw, seed)
                params = adam.update(params, grads)
                losses.append(value)
            return float(np.mean(losses)), params

        check = None if validation is None else lambda p: validation_loss(validation, p, task, n_classes)
        return train(init or init_classifier(dim, n_classes, hidden, seed), epoch, epochs, check, patience, keep,
                     adam, resume=resume)


def logits(points: DataFrame, layers: list[np.ndarray]) -> DataFrame:
    """Add ``logits`` to the rows; each task multiplies its Arrow batches with the broadcast weights."""
    shared = ship(points.sparkSession, [np.asarray(a, float) for a in layers])

    @arrow_udf("array<double>")
    def forward(vec: pa.Array) -> pa.Array:
        x = K.to_matrix(vec)
        return K.to_lists(run_layers(x, shared.value)[-1]) if len(x) else pa.array([], pa.list_(pa.float64()))

    return points.withColumn("logits", forward("embedding"))


def validation_loss_table(rows: DataFrame, layers: list[np.ndarray], task: str, n_classes: int) -> DataFrame:
    """(loss, n): mean loss over all rows."""
    scored = logits(with_target(rows, task, n_classes), layers)
    per_row = (bce_rows(F.col("logits"), F.col("target")) / n_classes if task_loss(task) == "bce"
               else kl_rows(F.col("logits"), F.col("target")))
    return scored.agg(F.avg(per_row).alias("loss"), F.count("*").alias("n"))


def validation_loss(rows: DataFrame, layers: list[np.ndarray], task: str, n_classes: int) -> float:
    """The same number for the training loop: forward pass and loss in one task, only sums leave it."""
    shared, loss = ship(rows.sparkSession, layers), task_loss(task)

    def fold(acc, batch):
        z = run_layers(K.to_matrix(batch.column(0)), shared.value)[-1]
        acc["loss"] += logit_gradient(z, K.to_matrix(batch.column(1)), np.ones(len(z)), loss)[0]
        acc["n"] += len(z)

    got = collect_sums(with_target(rows, task, n_classes).select("embedding", "target"), {"loss": (1,), "n": (1,)}, fold)
    shared.destroy()
    return float(got["loss"][0] / max(got["n"][0], 1.0))


def predict_class(points: DataFrame, layers: list[np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, prediction): the class with the largest logit."""
    return logits(points, layers).select("row_id", *keep, argmax(F.col("logits")).alias("prediction"))


def predict_labels(points: DataFrame, layers: list[np.ndarray], threshold: float = 0.5,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, prediction): 1 for every label whose sigmoid exceeds the threshold."""
    return logits(points, layers).select(
        "row_id", *keep, over_threshold(sigmoid(F.col("logits")), threshold).alias("prediction"))


def predict(points: DataFrame, layers: list[np.ndarray], task: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Class for ``single``; label array for ``multi`` and ``onehot``. Columns in ``keep`` stay, which saves a join."""
    task_loss(task)
    return predict_class(points, layers, keep) if task == "single" else predict_labels(points, layers, keep=keep)
