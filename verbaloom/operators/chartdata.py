"""The tables behind the charts: what would be drawn, without the drawing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbaloom.operators.filters import with_min_length, without_terms
from verbaloom.operators.frequencies import (
    by_count,
    check_top,
    deprel_counts,
    lemma_freqs,
    ner_counts,
    sentence_lengths,
    tally,
)
from verbaloom.operators.views import tokens_of

# Fixed value: how many words a word cloud shows unless told otherwise.
CLOUD_WORDS = 200


def pos_bars(df: DataFrame, sort_desc: bool = True) -> DataFrame:
    return by_count(tally(tokens_of(df, "UPOS"), "UPOS"), ascending=not sort_desc)


def lemma_bars(df: DataFrame, topk: int = 20) -> DataFrame:
    return lemma_freqs(df, topk)


def ner_bars(df: DataFrame, drop_o: bool = True) -> DataFrame:
    """No rows when the corpus has no entity: the caller shows a note instead."""
    return ner_counts(df, drop_o)


def deprel_bars(df: DataFrame, topk: int | None = None) -> DataFrame:
    return deprel_counts(df, topk)


def sentence_length_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, low, high, count`` for ``bins`` equal-width bins over the range of lengths.

    The last bin includes its upper edge.  When all lengths are equal the range is half a
    token to either side.  The lengths are counted by value first, so what is binned is
    one row per distinct length.
    """
    if bins < 1:
        raise ValueError("a histogram needs at least one bin")
    lengths = tally(sentence_lengths(df), "length")
    # The total is not used: it keeps the counted lengths as this subquery's input, whose
    # shuffle is then shared, where a bare minimum would read the corpus again.
    ends = lengths.agg(F.struct(
        F.min("length").cast("double").alias("least"), F.max("length").cast("double").alias("most"),
        F.sum("count").alias("total"),
    ).alias("ends")).scalar()

    def with_range(table: DataFrame) -> DataFrame:
        least, most = F.col("ends.least"), F.col("ends.most")
        slack = F.when(least == most, 0.5).otherwise(0.0)
        return table.withColumn("ends", ends).where(least.isNotNull()).select(
            *table.columns, (least - slack).alias("low"), (most - least + slack * 2).alias("width")
        )

    def edge(index: Column) -> Column:
        """Left edge of a 0-based bin, as evenly spaced points are computed."""
        last = F.col("low") + F.col("width")
        return F.when(index == bins, last).otherwise(index * (F.col("width") / bins) + F.col("low"))

    value, guess = F.col("length").cast("double"), F.col("guess")
    binned = with_range(lengths).withColumn("guess", F.least(
        F.floor((value - F.col("low")) / F.col("width") * bins), F.lit(bins - 1)
    ))
    # A quotient can fall just beside an edge: compare with the edges themselves.
    index = (
        F.when(value < edge(guess), guess - 1)
        .when((value >= edge(guess + 1)) & (guess != bins - 1), guess + 1)
        .otherwise(guess)
    )
    counts = binned.groupBy((index + 1).alias("bin")).agg(F.sum("count").alias("count"))
    every = with_range(df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")))
    return every.join(counts, "bin", "left").select(
        "bin", edge(F.col("bin") - 1).alias("low"), edge(F.col("bin")).alias("high"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    ).orderBy("bin")


def wordcloud_weights(
    df: DataFrame,
    min_length: int = 2,
    stopwords: Iterable[str] | DataFrame | None = None,
    top: int | None = CLOUD_WORDS,
) -> DataFrame:
    """``LEMMA, count, weight``: lemma counts relative to the most frequent one.

    Lemmas are counted before they are chosen, so conditions are met once for each distinct one, and Spark cannot
    move them below the annotation, where each would work the lemma out again.  Of a limited table the
    first row has the most frequent one; there is no second look at the corpus for it.
    """
    check_top(top)
    counts = tally(tokens_of(df, "LEMMA"), "LEMMA")
    sealed = counts.select(F.explode(F.array(F.struct("LEMMA", "count"))).alias("counted")).select("counted.*")
    kept = with_min_length(without_terms(sealed, F.lower("LEMMA"), stopwords), "LEMMA", min_length)
    if top is None:
        return by_count(kept.withColumn("weight", F.col("count") / kept.agg(F.max("count")).scalar())).select("LEMMA", "count", "weight")
    first = by_count(kept).limit(top)
    most = F.max("count").over(W.partitionBy(F.lit(0)))  # ``top`` rows at most
    return by_count(first.withColumn("weight", F.col("count") / most)).select("LEMMA", "count", "weight")
