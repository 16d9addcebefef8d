"""The relation by part-of-speech matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbaloom.operators.frequencies import share
from verbaloom.operators.views import tokens_of

OTHER_TAGS = "other"


def dependency_role_cells(df: DataFrame, weight: str | None = None) -> DataFrame:
    """``DEPREL, UPOS, count, percent``: the cells that occur, as shares of their row."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    cells = tokens_of(df, "DEPREL", "UPOS").groupBy("DEPREL", "UPOS").agg(amount.alias("count"))
    # The window runs over one row per cell, after the aggregate has shrunk the tokens.
    row_total = F.sum("count").over(W.partitionBy("DEPREL"))
    return cells.withColumn("percent", share(F.col("count"), row_total))


def dependency_role_matrix(
    df: DataFrame, upos_values: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    """One row per relation, one column of row percentages per part of speech.

    Without ``upos_values`` the columns are the tags that occur, in order, which costs a
    job to find them.  With a list the plan is fixed, and the tags that are not in it share
    the column ``other``.
    """
    if upos_values is None:
        cells = dependency_role_cells(df, weight)
        wide = cells.groupBy("DEPREL").pivot("UPOS").agg(F.first("percent"))
        return wide.na.fill(0.0).orderBy("DEPREL")
    tokens = tokens_of(df, "DEPREL", "UPOS")
    named = F.when(F.col("UPOS").isin(upos_values), F.col("UPOS")).otherwise(OTHER_TAGS)
    cells = dependency_role_cells(tokens.withColumn("UPOS", named), weight)
    wide = cells.groupBy("DEPREL").pivot("UPOS", [*upos_values, OTHER_TAGS]).agg(F.first("percent"))
    return wide.na.fill(0.0).orderBy("DEPREL")
