"""Splitting a table by a selection, and small set operations.

A selection is stored before it is joined: a stored table has a known size, so Spark broadcasts a small one and shuffles
a large one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from labelpick.operators.ranks import positions
from labelpick.session import materialize


def split_rows(points: DataFrame, selected: DataFrame, write=materialize) -> tuple[DataFrame, DataFrame]:
    """(labeled, unlabeled): the rows whose id is selected, and the rest."""
    ids = write(selected.select("row_id"), "selected_ids")
    return points.join(ids, "row_id", "left_semi"), points.join(ids, "row_id", "left_anti")


def labeled_rows(points: DataFrame, selected: DataFrame) -> DataFrame:
    return split_rows(points, selected)[0]


def unlabeled_rows(points: DataFrame, selected: DataFrame) -> DataFrame:
    return split_rows(points, selected)[1]


def unlabeled_ids(points: DataFrame, selected: DataFrame) -> DataFrame:
    return unlabeled_rows(points.select("row_id"), selected)


def all_but_last(points: DataFrame) -> DataFrame:
    """Everything counts as labeled except the row with the largest id, so that one unlabeled row is left."""
    return points.filter(F.col("row_id") < points.agg(F.max("row_id")).scalar())


def duplicates(df: DataFrame, column: str, write=materialize) -> DataFrame:
    """(column, n): values seen more than once, with their count; null counts as a value.

    Of texts, only 128-bit digests are shuffled at first, counted on the map side. The texts themselves are compared
    where their digests are seen more than once, and only those are sent.
    """
    if not isinstance(df.schema[column].dataType, (StringType, BinaryType)):
        return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
    digest = F.coalesce(F.md5(F.col(column).cast("binary")), F.lit("null"))
    rows = df.select(F.col(column).alias("value"), digest.alias("digest"))
    often = write(rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "seen_again")
    again = rows.join(often, "digest", "left_semi")
    return again.groupBy("digest", "value").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("value").alias(column), "n")


def distinct_classes(df: DataFrame, column: str = "label") -> DataFrame:
    return df.select(column).distinct().agg(F.count(column).alias("n_classes"))


def stack(labeled: DataFrame, unlabeled: DataFrame) -> DataFrame:
    return labeled.unionByName(unlabeled)


def label_codes(df: DataFrame, column: str = "label") -> DataFrame:
    """(label, code): distinct labels numbered from 0 in label order; array labels count as whole values, null is none."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return positions(labels, column, name="code").withColumn("code", F.col("code").cast("int"))


def with_label_code(df: DataFrame, column: str = "label") -> DataFrame:
    """Every row with the code of its label; rows without a label have none."""
    codes = materialize(label_codes(df, column), "label_codes")
    return df.join(codes, column, "left")
