"""Help for expressions over one row's arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that a lambda reads may be inlined into it by the optimizer and then runs
    once per array element.  A lambda variable cannot be inlined, so binding the value to
    one keeps work over an array linear.  The result is copied: keep it small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(array: Column, index: Column | int) -> Column:
    """Element at a 0-based index, null outside the array."""
    return F.get(array, index if isinstance(index, Column) else F.lit(index))
