"""Row filters and column choices shared by the statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions.text import value_or


def without_outside(tokens: DataFrame) -> DataFrame:
    """Drop the tokens that belong to no entity."""
    return tokens.where(F.col("NER") != "O")


def with_upos(tokens: DataFrame, upos: str) -> DataFrame:
    return tokens.where(F.col("UPOS") == upos)


def with_min_length(tokens: DataFrame, column: str, length: int) -> DataFrame:
    """Keep values of at least ``length`` characters; 1 or less keeps everything."""
    return tokens.where(F.length(column) >= length) if length > 1 else tokens


def term(use_lemma: bool = True, lowercase: bool = True) -> Column:
    """The string a statistic is about: lemma or form, ``_`` if missing, lower-cased on request."""
    column = value_or(F.col("LEMMA" if use_lemma else "FORM"))
    return F.lower(column) if lowercase else column


def without_terms(
    df: DataFrame, column: Column, words: Iterable[str] | DataFrame | None, lowercase: bool = True
) -> DataFrame:
    """Drop the rows whose ``column`` is among ``words``; a null value stays.

    ``words`` is an iterable, which becomes a constant set of the plan whatever its length,
    or a one-column table, which becomes an anti join: Spark measures the table before it
    decides to broadcast it and splits a frequent word's rows when it does not.
    """
    if words is None:
        return df
    if not isinstance(words, DataFrame):
        listed = sorted({word.lower() if lowercase else word for word in words})
        return df.where(column.isNull() | ~column.isin(listed)) if listed else df
    excluded = F.lower(F.col(words.columns[0])) if lowercase else F.col(words.columns[0])
    listed = words.select(excluded.alias("__excluded")).distinct()
    return df.join(listed, column == F.col("__excluded"), "left_anti")
