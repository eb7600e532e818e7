"""What most operators share: the latest row of a key, the first failing rule, interval predicates, overlap joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order. Ranks in one shuffle by the key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The code of the first rule that fails (its condition is true), or null; a null condition does not fail."""
    return F.coalesce(*[F.when(bad, F.lit(code)) for bad, code in rules])


def overlaps(start_a, end_a, start_b, end_b) -> Column:
    """Half-open intervals with a common millisecond; touching edges have none."""
    return (F.col(start_a) < F.col(end_b)) & (F.col(end_a) > F.col(start_b))


def contains(outer_start, outer_end, start, end) -> Column:
    return (F.col(outer_start) <= F.col(start)) & (F.col(end) <= F.col(outer_end))


def buckets(start: Column, end: Column, grid_ms: int) -> Column:
    """The grid cells that [start, end) touches."""
    return F.sequence(F.floor(start / grid_ms), F.floor((F.greatest(end, start + 1) - 1) / grid_ms))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], grid_ms: int, left_on: tuple[str, str] = ("start_ms", "end_ms"), right_on: tuple[str, str] = ("other_start_ms", "other_end_ms")) -> DataFrame:
    """Rows of equal keys whose half-open intervals overlap: an equi-join on keys and grid cells.

    A pair meets in every cell that both touch and is kept only in the later of their first cells, so no
    distinct is needed and long intervals give no repeated rows. Column names of the sides differ but for keys.
    """
    a = left.withColumn("_first_a", F.floor(F.col(left_on[0]) / grid_ms)).withColumn("_cell", F.explode(buckets(F.col(left_on[0]), F.col(left_on[1]), grid_ms)))
    b = right.withColumn("_first_b", F.floor(F.col(right_on[0]) / grid_ms)).withColumn("_cell", F.explode(buckets(F.col(right_on[0]), F.col(right_on[1]), grid_ms)))
    pairs = a.join(b, [*keys, "_cell"]).where(overlaps(*left_on, *right_on) & (F.col("_cell") == F.greatest("_first_a", "_first_b")))
    return pairs.drop("_cell", "_first_a", "_first_b")


def every(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))
