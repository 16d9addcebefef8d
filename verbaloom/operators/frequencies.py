"""Counts of tags, lemmas and relations, and sentence lengths.

Every function takes a flat token table or the sentences table.  Counts are partial and
final hash aggregates, so a tag or lemma that holds a third of all tokens is one row per
task before anything moves.  Ties are ordered by key, which makes each result unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbaloom.functions.text import half_even_2
from verbaloom.operators.filters import with_upos, without_outside
from verbaloom.operators.views import tokens_of
from verbaloom.schemas import is_nested, key_columns, require_columns


def tally(df: DataFrame, key: str, name: str | None = None, weight: str | None = None) -> DataFrame:
    """Rows per value of ``key``, or the sum of ``weight`` over them."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(F.col(key).alias(name or key)).agg(amount.alias("count"))


def by_count(counts: DataFrame, ascending: bool = False) -> DataFrame:
    """Most frequent first (or last), then by the other columns."""
    first = F.asc("count") if ascending else F.desc("count")
    return counts.orderBy(first, *[name for name in counts.columns if name != "count"])


def share(count: Column, total: Column) -> Column:
    """Percentage with two places, computed as the counts' quotient times 100."""
    return half_even_2(count / total * F.lit(100))


def check_top(top: int | None) -> None:
    if top is not None and top < 0:
        raise ValueError("a limit must not be negative")


def pos_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    """``UPOS, count, percent``: tokens per part of speech and their share of all."""
    counts = tally(tokens_of(df, "UPOS"), "UPOS", weight=weight)
    # The total is a scalar subquery over the same aggregate, whose shuffle is reused.
    total = counts.agg(F.sum("count")).scalar()
    percent = share(F.col("count"), total)
    return by_count(counts.withColumn("percent", percent)).select("UPOS", "count", "percent")


def lemma_freqs(df: DataFrame, top: int | None = 100) -> DataFrame:
    """``LEMMA, count``: the ``top`` most frequent lemmas, or all for ``None``."""
    check_top(top)
    ordered = by_count(tally(tokens_of(df, "LEMMA"), "LEMMA"))
    return ordered if top is None else ordered.limit(top)


def ner_counts(df: DataFrame, drop_o: bool = True, weight: str | None = None) -> DataFrame:
    """``NER_tag, count``: tokens per BIO tag."""
    tokens = tokens_of(df, "NER")
    if drop_o:
        tokens = without_outside(tokens)
    return by_count(tally(tokens, "NER", "NER_tag", weight))


def deprel_counts(df: DataFrame, top: int | None = None, weight: str | None = None) -> DataFrame:
    """``DEPREL, count``; no ``top``, or 0, means all."""
    check_top(top)
    ordered = by_count(tally(tokens_of(df, "DEPREL"), "DEPREL", weight=weight))
    return ordered.limit(top) if top else ordered


def top_lemmas_by_upos(df: DataFrame, upos: str, top: int = 20) -> DataFrame:
    """``LEMMA, count`` within one part of speech."""
    check_top(top)
    return by_count(tally(with_upos(tokens_of(df, "UPOS", "LEMMA"), upos), "LEMMA")).limit(top)


def top_lemmas_each_upos(df: DataFrame, top: int = 20) -> DataFrame:
    """``UPOS, LEMMA, count``: the ``top`` lemmas of every part of speech.

    A tag may hold most of the distinct lemmas.  Spark keeps only each task's first ``top``
    rows of a tag before they move, so the final ranking of a tag is a small one.
    """
    check_top(top)
    counts = tokens_of(df, "UPOS", "LEMMA").groupBy("UPOS", "LEMMA").agg(
        F.count(F.lit(1)).alias("count")
    )
    best = W.partitionBy("UPOS").orderBy(F.desc("count"), F.asc("LEMMA"))
    ranked = counts.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select("UPOS", "LEMMA", "count")


def sentence_lengths(df: DataFrame, ordered: bool = False) -> DataFrame:
    """``doc_id, sent_ix, length``: tokens per sentence.

    The sentences table knows the answer row by row.  The result is as long as the corpus
    has sentences, so it is only sorted on request.
    """
    if is_nested(df):
        tokens = F.size(F.filter(F.col("words.part"), lambda part: part == 1)).cast("long")
        lengths = df.where(F.size("words.part") > 0).select(
            "doc_id", "sent_ix", tokens.alias("length")
        )
    else:
        require_columns(df, "sent_ix", "FORM")
        keys = [*key_columns(df), "sent_ix"]
        lengths = df.where(F.col("sent_ix").isNotNull()).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("length")
        )
    return lengths.orderBy(*lengths.columns[:-1]) if ordered else lengths


# --- the summary pack's counts: nulls are left out, the outside tag stays in -------------

def _without_nulls(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.where(F.col(column).isNotNull())


def summary_pos_counts(tokens: DataFrame) -> DataFrame:
    return by_count(tally(_without_nulls(tokens, "UPOS"), "UPOS"))


def summary_lemma_freqs(tokens: DataFrame) -> DataFrame:
    return by_count(tally(_without_nulls(tokens, "LEMMA"), "LEMMA"))


def summary_ner_counts(tokens: DataFrame) -> DataFrame:
    """Empty, not an error, when the table has no ``NER`` column."""
    if "NER" not in tokens.columns:
        return empty_counts(tokens, "NER_tag")
    return by_count(tally(_without_nulls(tokens, "NER"), "NER", "NER_tag"))


def empty_counts(df: DataFrame, key: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"{key} string, count long")
