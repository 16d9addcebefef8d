"""Abbreviations found in the corpus, and sentences that they do not end.

A word is an abbreviation if it is bound to the full stop behind it: the log-likelihood of its
occurrences with and without one under a share of ``BOUND``, against that under the share of
all words of its language, is weighed down by its length and by each occurrence without a stop,
and compared with ``LEAST`` (Kiss and Strunk, *Unsupervised Multilingual Sentence Boundary
Detection*, 2006).  Words are runs of letters in lower case; counts are partial sums over all texts.

``split_by_abbreviations`` splits as ``segment`` does, but a full stop does not end a sentence behind an
abbreviation, or between two digits, on one line.  The words before full stops are looked up in the
corpus' vocabulary, so the list may have any length.

Null and empty texts have no sentences; a null language is one of its own.  The character U+FFFF, which
no text should hold, ends a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions.arrays import let
from verbaloom.operators.segment import INK_PATTERN, SENTENCE_PATTERN, SPACES
from verbaloom.operators.vocabulary import lang_key, looked_up

BOUND = 0.99
LEAST = 0.3
WORD_PATTERN = r"\p{L}+\.?"
LAST_WORD = r"(\p{L}+)\.$"
BORDER = "\uffff"


def stop_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n, stops``: occurrences of each word, and those with a full stop."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), F.lit(0))
    words = docs.select("lang", F.explode(found).alias("hit"))
    return words.groupBy("lang", F.rtrim("hit", F.lit(".")).alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.endswith("hit", F.lit(".")).cast("long")).alias("stops"))


def abbreviations(docs: DataFrame) -> DataFrame:
    """``lang, word, score`` of the abbreviations in ``docs`` (``lang, text``), scores with six digits."""
    counts = stop_counts(docs)
    totals = counts.groupBy(F.col("lang").alias("of_lang")).agg((F.sum("stops") / F.sum("n")).alias("share"))
    joined = counts.filter("stops > 0").join(totals, F.col("lang").eqNullSafe(F.col("of_lang")))
    stops, others = F.col("stops"), F.col("n") - F.col("stops")
    # Where every word has a stop, nothing tells abbreviations from others.
    bound = stops * F.log(F.lit(BOUND)) + others * F.log(F.lit(1 - BOUND))
    usual = stops * F.log("share") + others * F.log(1 - F.col("share"))
    size = F.length("word")
    score = 2 * (bound - usual) / F.exp(size) / F.pow(size, others)
    return joined.filter("share < 1").select("lang", "word", F.round(score, 6).alias("score")).filter(F.col("score") >= LEAST)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE_PATTERN + r"|\n"), F.lit(0))


def split_by_abbreviations(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``(doc_id, lang, text)`` to one row per sentence, as ``segment.split_sentences`` does it otherwise.
    ``listed`` has ``lang, word``."""
    rows = docs.select("doc_id", "lang", _pieces(F.col("text")).alias("pieces"))
    words = F.transform("pieces", lambda p: F.nullif(F.lower(F.regexp_extract(p, LAST_WORD, 1)), F.lit("")))
    rows = rows.withColumn("stop_words", F.transform(words, lambda w: F.when(w.isNotNull(), lang_key(F.col("lang"), w))))
    table = listed.select(lang_key(F.col("lang"), F.col("word")).alias("key")).distinct().select("key", F.struct(F.lit(True).alias("is")).alias("value"))
    rows = looked_up(rows, "stop_words", table, "short", ["doc_id"])
    zipped = F.arrays_zip(F.col("pieces").alias("piece"), F.col("short").alias("short"))

    def joined(all_: Column) -> Column:
        def with_border(p: Column, i: Column) -> Column:
            following = F.get(all_, i + 1)["piece"]
            number = F.rlike(p["piece"], F.lit(r"\d\.$")) & F.rlike(following, F.lit(r"^\d"))
            goes_on = (p["short"].isNotNull() | number) & following.isNotNull() & (following != "\n")
            return F.concat(p["piece"], F.when(goes_on, "").otherwise(BORDER))
        return F.array_join(F.transform(all_, with_border), "")
    sentences = F.split(let(zipped, joined), BORDER)
    inked = F.filter(sentences, lambda s: F.rlike(s, F.lit(INK_PATTERN)))
    trimmed = F.transform(inked, lambda s: F.btrim(s, F.lit(SPACES)))
    out = rows.select("doc_id", "lang", F.posexplode(trimmed).alias("pos", "text"))
    return out.select("doc_id", "lang", (F.col("pos") + 1).cast("long").alias("sent_ix"), "text")
