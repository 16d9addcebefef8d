"""Token tables as tab-separated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Quoting is off on both sides, so a quote mark is a token like any other, and only the
# empty field is null: words such as "NA" or "null" stay words and "007" stays text.
TSV_OPTIONS = {
    "sep": "\t", "header": "true", "quote": "", "escape": "", "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "inferSchema": "false",
}
# What a missing field of the token table becomes.
FILLS = {"UPOS": "_", "LEMMA": "_", "NER": "O", "DEPREL": "_", "FORM": "_"}


def _whole(name: str, kind: str) -> Column:
    """A number without its fraction, null for anything else or out of range."""
    column = F.col(name)
    return F.coalesce(column.try_cast(kind), column.try_cast("double").try_cast(kind))


def fill_tokens(tokens: DataFrame) -> DataFrame:
    """Fill missing fields and turn the index columns into numbers.

    An index that is not a number becomes null, a head that is not a number becomes 0.
    Columns that the table lacks stay missing; the operators that need one say so.
    """
    filled = tokens.na.fill({name: v for name, v in FILLS.items() if name in tokens.columns})
    numbers = {
        "sent_ix": _whole("sent_ix", "long"),
        "tok_ix": _whole("tok_ix", "long"),
        "HEAD": F.coalesce(_whole("HEAD", "int"), F.lit(0)),
    }
    return filled.withColumns({name: c for name, c in numbers.items() if name in tokens.columns})


def read_tokens(
    spark: SparkSession, path: str | list[str], fill: bool = True, columns: list[str] | None = None
) -> DataFrame:
    """Read token tables; a table without ``doc_id`` takes its file's path as the id.

    ``columns`` is the header of the files; without it, it is read off the first one.  A file
    whose header differs, in names or in order, is refused instead of being read by place.
    """
    names = list(columns) if columns else spark.read.options(**TSV_OPTIONS).csv(path).columns
    schema = ", ".join(f"`{name}` string" for name in names)
    # A column is only compared with the header if it is read, so all of them are.
    raw = spark.read.options(**TSV_OPTIONS, enforceSchema="false").schema(schema).csv(path)
    if "doc_id" not in names:
        raw = raw.select(F.col("_metadata.file_path").alias("doc_id"), *names)
    return fill_tokens(raw) if fill else raw
