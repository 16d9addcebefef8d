"""Scalar functions, all of them built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ``clean_field`` replaces.
BREAKING_PATTERN = r"[\t\r\n\x00]"


def value_or(column: Column, default: str = "_") -> Column:
    """``default`` where the value is null or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def half_even_2(column: Column) -> Column:
    """Round a double to two places, scaling first and rounding halves to even.

    ``rint(x * 100) / 100`` rounds the scaled double, as array libraries do; ``bround``
    rounds the decimal text of the double instead and differs on values such as 2.675.
    """
    return F.rint(column * F.lit(100.0)) / F.lit(100.0)


def pad_left(column: Column, width: int) -> Column:
    """Right-align in ``width`` characters.  Unlike ``lpad`` it never cuts."""
    return F.when(F.length(column) < width, F.lpad(column, width, " " * width)).otherwise(column)


def clean_field(column: Column) -> Column:
    """Replace the characters that would break an unquoted tab-separated line."""
    return F.translate(column, "\t\r\n\x00", "    ")


def slug(column: Column, lower: bool = True) -> Column:
    """A name that is safe as a file, partition or table name."""
    out = F.btrim(F.regexp_replace(column, "[^a-zA-Z0-9._]+", "-"), F.lit("-"))
    return F.lower(out) if lower else out


def time_stamp(column: Column, pattern: str = "yyyyMMdd-HHmmss") -> Column:
    """A timestamp as text for file names, in the session's time zone."""
    return F.date_format(column, pattern)


def sheet_name(column: Column) -> Column:
    """A table name of at most 31 characters; an empty one becomes ``sheet``."""
    return value_or(F.substring(column, 1, 31), "sheet")
