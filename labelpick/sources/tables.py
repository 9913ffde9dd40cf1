"""Reading, splitting and writing tables of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_points(df: DataFrame, id_col: str = "row_id", vec_col: str = "embedding", label_col: str | None = None,
              baseline_col: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns every operator expects: ``row_id``, ``embedding`` and, when named, ``label`` and ``baseline``."""
    cols: list[Column] = [F.col(id_col).cast("long").alias("row_id"), F.col(vec_col).alias("embedding")]
    if label_col is not None:
        cols.append(F.col(label_col).alias("label"))
    if baseline_col is not None and baseline_col in df.columns:
        cols.append(F.col(baseline_col).alias("baseline"))
    return df.select(*cols, *extra)


def dimension(points: DataFrame) -> int:
    """Length of the embeddings, read from one row; longer or shorter ones fail where they are used."""
    row = points.select(F.size("embedding").alias("d"), F.col("embedding").isNull().alias("missing")).first()
    if row is None:
        raise ValueError("no rows")
    if row["missing"]:
        raise ValueError("embedding is null")
    return row["d"]


def partition_data(df: DataFrame, split_col: str, parts: tuple[str, ...] = SPLITS) -> dict[str, DataFrame]:
    """One lazy DataFrame per split; on a table written by ``write_splits`` each reads only its own folder."""
    return {part: df.filter(F.col(split_col) == part) for part in parts}


def write_splits(df: DataFrame, path: str, split_col: str = "dataset", mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def load_split(df: DataFrame, part: str, split_col: str = "dataset", id_col: str = "row_id",
               vec_col: str = "embedding", label_col: str = "label", baseline_col: str | None = None) -> DataFrame:
    """Rows of one split as points. The baseline is left out for the training split, as nobody scores that one."""
    rows = df.filter(F.col(split_col) == part)
    return as_points(rows, id_col, vec_col, label_col, None if part == "train" else baseline_col)
