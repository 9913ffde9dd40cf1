"""Train, evaluate and test a labeled-by-selection classifier on one table of splits."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np

from pyspark.sql import DataFrame, SparkSession

from labelpick.operators import metrics
from labelpick.operators.heads import fit_heads, top_scores
from labelpick.operators.mixmatch import fit_mixmatch
from labelpick.operators.nn import Training, fit_supervised, predict
from labelpick.operators.project import project_2d
from labelpick.operators.select import select_density
from labelpick.operators.sets import all_but_last, labeled_rows
from labelpick.session import delete_path
from labelpick.sources.models import load_model, save_model
from labelpick.sources.selections import load_selection, select_or_load
from labelpick.sources.states import Resume
from labelpick.sources.tables import load_split


@dataclass(frozen=True)
class RunConfig:
    """Parameters of one run. ``task``: ``single`` (integer label), ``multi`` (0/1 array) or ``onehot`` (one-hot array).

    ``classifier`` is ``mixmatch``, or ``supervised`` for the selected rows alone; of multi-label tasks the latter weights
    the labels by their inverse frequency.
    """
    task: str
    n_classes: int
    n_clusters: int
    method: str = "density"
    classifier: str = "mixmatch"
    clustering: str = "lloyd"
    mode: str = "first_member"
    init: str = "spread"
    n_init: int = 10
    cluster_iterations: int = 300
    m_reg: float = 0.9
    k: int = 10
    lambda_: float = 0.5
    epsilon: float = 1e-5
    alpha: float = 0.75
    exclude: str = "cluster"
    n_heads: int = 3
    head_epochs: int = 1000
    head_patience: int | None = 5
    epochs: int = 100
    patience: int | None = 5
    learning_rate: float = 0.001
    batch_size: int = 64
    batches_per_step: int = 1
    copies: int = 2
    temperature: float = 0.5
    std_dev: float = 0.1
    share: float = 0.75
    hidden: tuple[int, ...] = (256, 128)
    keep: str = "last"
    just_ssl: bool = False
    recalculate: bool = False
    seed: int = 0
    split_col: str = "dataset"
    id_col: str = "row_id"
    vec_col: str = "embedding"
    label_col: str = "label"
    baseline_col: str | None = None


# fixed values: the run parameters of the three tasks for both selection methods
PRESETS = {
    ("density", "single"): RunConfig("single", 2, 60, n_init=10, alpha=0.5, epochs=100, patience=5),
    ("density", "multi"): RunConfig("multi", 14, 30, clustering="fuzzy", exclude="row_vs_cluster", n_init=1, alpha=0.5,
                                    epochs=1000, patience=5),
    ("density", "onehot"): RunConfig("onehot", 6, 1, n_init=30, alpha=0.5, epochs=1000, patience=20),
    ("heads", "single"): RunConfig("single", 2, 30, method="heads", temperature=0.75, epochs=1000, patience=5),
    ("heads", "multi"): RunConfig("multi", 14, 10, method="heads", temperature=0.75, epochs=1000, patience=5),
    ("heads", "onehot"): RunConfig("onehot", 6, 1, method="heads", temperature=0.75, epochs=1000, patience=5),
}


def preset(method: str, task: str, **changes) -> RunConfig:
    return replace(PRESETS[method, task], **changes)


def _points(table: DataFrame, part: str, config: RunConfig) -> DataFrame:
    return load_split(table, part, config.split_col, config.id_col, config.vec_col, config.label_col, config.baseline_col)


def choose(points: DataFrame, validation: DataFrame, store: str, run_id: str, config: RunConfig) -> DataFrame:
    """The rows to label: (row_id, cluster, rank, score), before anything is stored."""
    spark = points.sparkSession
    if config.just_ssl:
        return all_but_last(points).select("row_id")
    if config.method == "heads":
        fit, _ = fit_heads(points, config.n_clusters, config.n_heads, config.head_epochs, config.learning_rate,
                           validation, config.head_patience, config.keep, config.seed, batch_size=config.batch_size,
                           batches_per_step=config.batches_per_step, resume=_resume(spark, store, run_id, "heads", config))
        save_model(spark, fit.params, f"{store}/models", _name("heads", config, run_id))
        return top_scores(points, fit.params, config.n_clusters)
    return select_density(
        points, config.n_clusters, config.n_init, config.m_reg, config.k, config.lambda_, config.epsilon, config.alpha,
        mode=config.mode, clustering=config.clustering, init=config.init, max_iter=config.cluster_iterations,
        exclude=config.exclude, seed=config.seed).selected


def _method(config: RunConfig) -> str:
    return "all_but_last" if config.just_ssl else config.method


def _name(kind: str, config: RunConfig, run_id: str) -> str:
    return f"{kind}-{config.method}-{config.task}-{run_id}"


def _states(store: str, run_id: str) -> str:
    return f"{store}/states/{run_id}"


def _resume(spark: SparkSession, store: str, run_id: str, kind: str, config: RunConfig) -> Resume:
    """States belong to one run and its parameters; only the number of epochs may grow."""
    same = replace(config, epochs=0, head_epochs=0, recalculate=False)
    return Resume(spark, f"{_states(store, run_id)}/{_name(kind, config, run_id)}-{zlib.crc32(repr(same).encode()):08x}")


def fit_classifier(points: DataFrame, selected: DataFrame, validation: DataFrame, config: RunConfig,
                   resume: Resume | None = None) -> Training:
    """Train the classifier that the configuration names from the labels of the selected rows."""
    common = dict(epochs=config.epochs, lr=config.learning_rate, batch_size=config.batch_size, hidden=config.hidden,
                  validation=validation, patience=config.patience, keep=config.keep, seed=config.seed,
                  batches_per_step=config.batches_per_step, resume=resume)
    if config.classifier == "mixmatch":
        return fit_mixmatch(points, selected, config.n_classes, config.task, copies=config.copies,
                            temperature=config.temperature, std_dev=config.std_dev, share=config.share, **common)
    if config.classifier != "supervised":
        raise ValueError(f"unknown classifier {config.classifier}")
    rows, weights = labeled_rows(points, selected), None
    if config.task == "multi":
        found = metrics.label_weights(rows).orderBy("position").collect()  # one row per label
        if any(r["weight"] is None for r in found):
            raise ValueError("a label that none of the selected rows has can't be weighted")
        weights = np.array([r["weight"] for r in found])
    return fit_supervised(rows, config.n_classes, config.task, pos_weight=weights, **common)


def run_train(spark: SparkSession, table: DataFrame, store: str, run_id: str, config: RunConfig) -> DataFrame:
    """Select rows (or reuse the stored selection of this run), train and store the classifier; returns the selection.

    A run that was broken off goes on from its last finished epoch. ``recalculate`` selects and trains anew.
    """
    points, validation = _points(table, "train", config), _points(table, "val", config)
    if config.recalculate:
        delete_path(spark, _states(store, run_id))
    selected = select_or_load(spark, f"{store}/selections", run_id, _method(config),
                              lambda: choose(points, validation, store, run_id, config), config.recalculate)
    fit = fit_classifier(points, selected, validation, config, _resume(spark, store, run_id, "classifier", config))
    save_model(spark, fit.params, f"{store}/models", _name("classifier", config, run_id))
    return selected


def run_project(spark: SparkSession, table: DataFrame, store: str, run_id: str, config: RunConfig) -> DataFrame:
    """The training split on its two principal axes, with the rows that this run has selected."""
    selected = load_selection(spark, f"{store}/selections", run_id, _method(config))
    return project_2d(_points(table, "train", config), selected)


def run_evaluate(spark: SparkSession, table: DataFrame, store: str, run_id: str, config: RunConfig,
                 part: str = "val") -> DataFrame:
    """Metric table of the newest classifier of this run on the ``val`` or ``test`` split."""
    points = _points(table, part, config)
    keep = tuple(c for c in ("label", "baseline") if c in points.columns)
    weights = load_model(spark, f"{store}/models", _name("classifier", config, run_id))
    scored = predict(points, weights, config.task, keep)
    score = {"single": metrics.evaluate_single, "multi": metrics.evaluate_multi, "onehot": metrics.evaluate_one_hot}
    return score[config.task](scored)


def run(spark: SparkSession, table: DataFrame, store: str, run_id: str, config: RunConfig,
        mode: str = "train") -> DataFrame:
    """``train`` returns the selection, ``project`` its picture as a table, ``eval`` and ``test`` the metrics."""
    if mode == "train":
        return run_train(spark, table, store, run_id, config)
    if mode == "project":
        return run_project(spark, table, store, run_id, config)
    if mode in ("eval", "test"):
        return run_evaluate(spark, table, store, run_id, config, "val" if mode == "eval" else "test")
    raise ValueError(f"unknown mode {mode}")
