"""The most frequent groups, exactly, without moving every group.

A count of all groups moves each distinct one.  Here rows are first counted by the cell that their
key's hash falls in: a sketch of ``CELLS`` numbers, which tasks add up and merge, and whose error is
one-sided, since a group has at most its cell's rows.  Counting the groups of the heaviest cells gives a
number of rows that the last group of the answer has at least; only groups in cells with that many rows
can be in the answer, and they are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.operators.frequencies import check_top
from verbaloom.session import checkpoint

CELLS = 1 << 16


def _cell(keys: list[str], cells: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(cells))


def _counted_in(rows: DataFrame, keys: list[str], chosen: DataFrame, cells: int) -> DataFrame:
    inside = rows.withColumn("cell", _cell(keys, cells)).join(F.broadcast(chosen.select("cell")), "cell", "left_semi")  # CELLS rows at most
    return inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def candidate_counts(rows: DataFrame, keys: list[str], top: int, cells: int = CELLS) -> DataFrame:
    """``keys, count`` of all groups that can be among the ``top`` most frequent."""
    sketch = checkpoint(rows.groupBy(_cell(keys, cells).alias("cell")).agg(F.count(F.lit(1)).alias("n")))
    first = sketch.orderBy(F.desc("n"), "cell").limit(top)
    best = _counted_in(rows, keys, first, cells).orderBy(F.desc("count")).limit(top)
    bound = best.agg(F.when(F.count(F.lit(1)) == top, F.min("count")).otherwise(F.lit(1)).alias("bound")).first()["bound"]  # one row
    return _counted_in(rows, keys, sketch.filter(F.col("n") >= bound), cells)


def heaviest(rows: DataFrame, keys: list[str], top: int, cells: int = CELLS) -> DataFrame:
    """``keys, count`` of the ``top`` most frequent groups, ties by key.  Null keys are groups of their own.

    The rows are formed three times; the sketch is written to the shared folder.
    """
    check_top(top)
    counted = candidate_counts(rows, keys, top, cells)
    return counted.orderBy(F.desc("count"), *[F.col(k).asc_nulls_first() for k in keys]).limit(top)
