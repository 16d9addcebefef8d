"""Values from a large table for every element of an array column, without moving hot words.

A lexicon, a list of names or a trained model is a table ``key, value`` of any size; it is
never part of a plan.  Each distinct key of the corpus is looked up once, by a join of the
corpus' vocabulary with the table.  Then the answers go back to the rows by two ways:

* Up to ``ENTRIES`` answers, and of more answers the keys in at least one of ``SHARE`` rows, go as one
  value, an array of small maps that is found by a scalar subquery.  A row with w different keys adds
  w / ``rows`` to all shares, so there are at most ``SHARE`` times the mean number of different keys of a
  row of frequent ones, whatever the corpus' size and the table's.  They are the words that a join by
  word would send to one task.
* The other keys are joined; none has more than a ``SHARE``-th of the rows.  Only they leave their rows.
  What is found for a row comes back as one map, joined by the row's key.  Where nothing is left, nothing
  moves.  The maps of the first way are looked into after that join, so no row carries them through it.

The answers are written to the shared folder in between, so building the lookup runs a job.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions.arrays import let
from verbaloom.session import checkpoint

#: A key in this part of the rows counts as frequent.
SHARE = 2_000
#: So many answers go as one value, however rare their keys are.
ENTRIES = 50_000
#: Maps that the keys of that value are dealt out to.
MAPS = 4_096
#: Between the parts of a key; no token contains it.
JOINT = "\t"


def lang_key(lang: Column, form: Column) -> Column:
    """The key of a form in a language; a null language is one of its own."""
    return F.concat(F.coalesce(lang, F.lit("")), F.lit(JOINT), form)


def distinct_keys(rows: DataFrame, keys: str | Column) -> DataFrame:
    """``key, n`` for the keys of an array, with the number of rows that have them."""
    return rows.select(F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def looked_up(
    rows: DataFrame, keys: str | Column, table: DataFrame, into: str, row_key: list[str], counted: DataFrame | None = None
) -> DataFrame:
    """``rows`` with the column ``into``: the table's value, or null, for each element of ``keys``.

    ``keys`` is an array of ``rows`` or an expression for one, which then is not moved with the row.
    ``table`` has ``key, value``, each key once; null elements of ``keys`` find nothing.  ``row_key`` names
    rows; rows that share it may differ in their keys.  ``counted`` gives ``distinct_keys`` that are there already;
    numbers that are larger, as those of places instead of rows, only count more keys as frequent.
    """
    keys = F.col(keys) if isinstance(keys, str) else keys
    counted = distinct_keys(rows, keys) if counted is None else counted
    answers = checkpoint(counted.join(table.select("key", "value"), "key"))

    maps = F.col("answer_maps")
    if answers.count() <= ENTRIES:
        whole = rows.withColumn("answer_maps", _maps(answers))
        return whole.withColumn(into, F.transform(keys, lambda k: value_of(maps, k))).drop("answer_maps")
    total = rows.count()
    frequent = answers.filter(F.col("n") * SHARE >= total)
    rare = answers.filter(F.col("n") * SHARE < total).select("key", "value")
    named = [F.col(c).alias(f"found_{i}") for i, c in enumerate(row_key)]
    names = [f"found_{i}" for i in range(len(row_key))]
    left = rows.withColumn("answer_maps", _maps(frequent)).select(
        *named, F.explode(F.filter(F.array_distinct(keys), lambda k: value_of(maps, k).isNull())).alias("key"))
    found = left.join(rare, "key").groupBy(*names).agg(F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias("found_map"))
    same = functools.reduce(Column.__and__, [rows[c].eqNullSafe(found[n]) for c, n in zip(row_key, names, strict=True)])
    joined = rows.join(found, same, "left").withColumn("answer_maps", _maps(frequent))
    return joined.withColumn(into, F.transform(
        keys, lambda k: F.coalesce(value_of(maps, k), F.try_element_at(F.col("found_map"), k)))).drop(*names, "found_map", "answer_maps")


def one_value(table: DataFrame) -> Column:
    """A table ``key, value`` of up to ``ENTRIES`` rows, each key once, as one value; see ``value_of``."""
    return _maps(table)


def value_of(maps: Column, key: Column) -> Column:
    return F.try_element_at(F.get(maps, _map_of(key)), key)


def _map_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(MAPS)).cast("int")


def _maps(answers: DataFrame) -> Column:
    """All rows ``key, value`` as one array of ``MAPS`` maps."""
    maps = answers.groupBy(_map_of(F.col("key")).alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("map"))
    every = answers.sparkSession.range(MAPS).select(F.col("id").cast("int").alias("id")).join(maps, "id", "left")
    pairs = F.array_sort(F.collect_list(F.struct("id", "map")), lambda a, b: a["id"] - b["id"])
    return every.agg(F.transform(pairs, lambda p: p["map"])).scalar()


def one_value_each(table: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """``key, value``: for each key the struct of ``values`` in the first row by ``order``."""
    first = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*values).alias("value")))
    return table.groupBy(F.col(key).alias("key")).agg(first.alias("first")).select("key", "first.value")


def filled(values: Column, others: Column) -> Column:
    """``values`` with nulls taken from ``others``, an array of the same length."""
    return let(others, lambda o: F.transform(values, lambda v, i: F.coalesce(v, F.get(o, i))))
