"""Text to sentences and tokens: regular expressions, no shuffle, no window.

A sentence keeps its place in the array the expression returns, so the running indices
come from ``posexplode`` instead of a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A run of text up to and including its end marks; a line break ends a sentence as well.
# Every character that is not a line break belongs to exactly one match.
SENTENCE_PATTERN = r"[^.!?…\n]+[.!?…]*|[.!?…]+"
# A word, or one symbol that is neither space nor control character.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{Z}\p{Cc}\p{L}\p{M}\p{N}_]"
INK_PATTERN = r"[^\p{Z}\p{Cc}]"
# What is stripped from both ends of a sentence.
SPACES = (
    " \t\r\f\x0b\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def sentence_array(text: Column) -> Column:
    """The sentences of a text in order, without the blank ones."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))
    inked = F.filter(pieces, lambda s: F.rlike(s, F.lit(INK_PATTERN)))
    return F.transform(inked, lambda s: F.btrim(s, F.lit(SPACES)))


def token_array(sentence: Column) -> Column:
    """The surface tokens of a sentence in order."""
    return F.regexp_extract_all(sentence, F.lit(TOKEN_PATTERN), F.lit(0))


def split_sentences(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, text)`` to one row per sentence, ``sent_ix`` counting from 1."""
    exploded = docs.select(
        "doc_id", "lang", F.posexplode(sentence_array(F.col("text"))).alias("pos", "text")
    )
    return exploded.select(
        "doc_id", "lang", (F.col("pos") + 1).cast("long").alias("sent_ix"), "text"
    )


def split_tokens(sentences: DataFrame) -> DataFrame:
    """One row per surface token, ``tok_ix`` counting from 1 in each sentence."""
    exploded = sentences.select(
        "doc_id", "lang", "sent_ix", F.posexplode(token_array(F.col("text"))).alias("pos", "FORM")
    )
    return exploded.select(
        "doc_id", "lang", "sent_ix", (F.col("pos") + 1).cast("long").alias("tok_ix"), "FORM"
    )
