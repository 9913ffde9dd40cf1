"""Places of rows in an order, without a task that sees all rows.

Rows are dealt into ranges and sorted inside each; a place is the row's number in its range plus the rows of the ranges
before. Rows that are equal in the whole order are told apart by where they were read, so even those spread over ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelpick.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def sorted_ranges(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in ranges of ``order``, sorted inside, with ``_part`` and ``_row``: the range and the place in it.

    Nulls come first in ascending order. ``_part`` and ``_row`` must be stored before they are used.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tie.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    place = F.monotonically_increasing_id()
    return placed.withColumn("_place", place).select(
        *rows.columns, F.shiftright("_place", _ROW_BITS).alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"))


def positions(rows: DataFrame, *order: Column | str, name: str = "position", write=materialize) -> DataFrame:
    """All rows with their place in ``order`` from 0, as column ``name``. One row per range reaches the driver."""
    stored = write(sorted_ranges(rows, *order), "ranges")
    sizes = stored.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, seen = [], 0
    for r in sizes:
        starts.append((r["_part"], seen))
        seen += r["n"]
    table = rows.sparkSession.createDataFrame(starts, "_part long, _start long")  # one row per range
    return (stored.join(F.broadcast(table), "_part")
            .withColumn(name, F.col("_start") + F.col("_row")).select(*rows.columns, name))


def positions_within(rows: DataFrame, group: str, *order: Column | str, name: str = "position", total: str = "total",
                     write=materialize) -> DataFrame:
    """All rows with their place from 0 among those of the same ``group``, and the size of the group.

    Null is a group too. A group spreads over as many ranges as it fills, whatever share of the rows it holds.
    """
    stored = write(sorted_ranges(rows, F.col(group).asc_nulls_first(), *order), "ranges")
    runs = stored.groupBy("_part", group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(group)  # one row per range and group
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = write(runs.select(
        F.col("_part").alias("_in"), F.col(group).alias("_of"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(of_group).alias("_total")), "runs")
    same = reduce(lambda a, b: a & b, [F.col("_part") == F.col("_in"), F.col(group).eqNullSafe(F.col("_of"))])
    return stored.join(runs, same).select(
        *rows.columns, (F.col("_start") + F.col("_row") - F.col("_first")).alias(name), F.col("_total").alias(total))
