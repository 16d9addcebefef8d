"""Column layout of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

WORD = T.StructType([
    T.StructField("word_id", T.IntegerType()),    # 1.. in the sentence; HEAD points at it
    T.StructField("tok_ix", T.LongType()),        # 1.. in the sentence; the surface token
    T.StructField("part", T.IntegerType()),       # 1.. in the token; >1 only in multi-word tokens
    T.StructField("tok_form", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("lemma", T.StringType()),
    T.StructField("upos", T.StringType()),
    T.StructField("xpos", T.StringType()),
    T.StructField("feats", T.StringType()),
    T.StructField("head", T.IntegerType()),
    T.StructField("deprel", T.StringType()),
])

ENTITY = T.StructType([
    T.StructField("ent_ix", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("tok_start", T.LongType()),
    T.StructField("tok_end", T.LongType()),
])

# What an annotator yields for one document: its sentences, in order.
DOCUMENT_LAYERS = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("words", T.ArrayType(WORD)),
    T.StructField("entities", T.ArrayType(ENTITY)),
]))

# The nine columns of the token table, in file order.
TOKEN_COLUMNS = ["sent_ix", "tok_ix", "FORM", "LEMMA", "UPOS", "XPOS", "HEAD", "DEPREL", "NER"]

# The universal part-of-speech tags, plus the mark for a missing one.
UPOS_TAGS = [
    "ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON",
    "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X", "_",
]


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` when ``df`` lacks one of the columns an operator needs."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")


def is_nested(df: DataFrame) -> bool:
    """True for a sentences table (words as an array), False for a flat token table."""
    return "words" in df.columns and isinstance(df.schema["words"].dataType, T.ArrayType)


def key_columns(df: DataFrame) -> list[str]:
    """Columns that name a document.  A bare nine-column token table is one document."""
    return [name for name in ("doc_id",) if name in df.columns]
