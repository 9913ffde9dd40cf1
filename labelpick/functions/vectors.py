"""Column expressions on short arrays (logits, probabilities, labels), kept inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def array_of(values) -> Column:
    """Short fixed array as a literal."""
    return F.array(*[F.lit(float(v)) for v in values])


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))


def bind(value: Column, body) -> Column:
    """body(value) with ``value`` computed once: inside a lambda, Spark would compute it again for every entry."""
    return F.transform(F.array(value), body)[0]


def _divided_by_total(v: Column) -> Column:
    return bind(v, lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s)))


def _shifted(z: Column) -> Column:
    return bind(z, lambda a: bind(F.array_max(a), lambda top: F.transform(a, lambda v: v - top)))


def softmax(z: Column) -> Column:
    return _divided_by_total(F.transform(_shifted(z), lambda v: F.exp(v)))


def log_softmax(z: Column) -> Column:
    return bind(_shifted(z), lambda s: bind(F.ln(total(F.transform(s, lambda v: F.exp(v)))),
                                            lambda norm: F.transform(s, lambda v: v - norm)))


def sigmoid(z: Column) -> Column:
    return F.transform(z, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))


def sharpen(p: Column, temperature: float) -> Column:
    return _divided_by_total(F.transform(p, lambda v: F.pow(v, F.lit(1.0 / temperature))))


def over_threshold(p: Column, threshold: float = 0.5) -> Column:
    """Strictly greater -> 1, else 0."""
    return F.transform(p, lambda v: (v > F.lit(threshold)).cast("int"))


def one_hot(label: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == label.cast("int")).cast("double"))


def argmax(v: Column) -> Column:
    """Position of the largest entry; the first one wins, so an all-zero array gives 0."""
    return bind(v, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def kl_rows(logits: Column, target: Column) -> Column:
    """KL divergence of a soft target from softmax(logits) for one row, with 0 log 0 = 0."""
    return total(F.zip_with(
        target, log_softmax(logits),
        lambda t, lp: F.when(t > 0, t * (F.ln(t) - lp)).otherwise(F.lit(0.0)),
    ))


def bce_rows(logits: Column, target: Column, pos_weight: Column | None = None) -> Column:
    """Sum over labels of the binary cross-entropy with logits for one row."""
    def soft_minus(z):
        """ln(1 + exp(-z)) without overflow."""
        return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))

    if pos_weight is None:
        return total(F.zip_with(logits, target, lambda z, y: (F.lit(1.0) - y) * z + soft_minus(z)))
    terms = F.zip_with(logits, target, lambda z, y: F.struct(z.alias("z"), y.alias("y")))
    return total(F.zip_with(terms, pos_weight, lambda t, w: (
        (F.lit(1.0) - t["y"]) * t["z"] + (F.lit(1.0) + (w - 1.0) * t["y"]) * soft_minus(t["z"])
    )))


def mix(a: Column, b: Column, share: float) -> Column:
    return F.zip_with(a, b, lambda p, q: p * F.lit(share) + q * F.lit(1.0 - share))
