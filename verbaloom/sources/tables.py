"""Tables and strings as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.schemas import require_columns


def corpus_from_text(spark: SparkSession, text: str, lang: str) -> DataFrame:
    """A corpus of one document given as a string."""
    return spark.createDataFrame([(0, lang, text)], "doc_id long, lang string, text string")


def without_markup(html: Column) -> Column:
    """The text of a page: every tag becomes a space."""
    return F.regexp_replace(html, "<[^>]+>", " ")


def corpus_from_table(
    table: DataFrame,
    id_columns: str | list[str],
    text: str | Column = "text",
    lang: str | Column = "lang",
    repartition_to: int | None = None,
) -> DataFrame:
    """``doc_id, lang, text`` from any table with an id and a text.

    ``lang`` is a column, or a name that is no column and then means that language for
    all rows.  A single id column is kept as it is; several become one string, each part
    escaped so that different keys never give the same id.  ``repartition_to`` deals a table
    out to that many tasks; it is for corpora in a few small files, as texts are moved for it.
    """
    ids = [id_columns] if isinstance(id_columns, str) else list(id_columns)
    require_columns(table, *ids)
    if len(ids) == 1:
        doc_id = F.col(ids[0])
    else:
        def part(name: str) -> Column:
            escaped = F.replace(F.col(name).cast("string"), F.lit("~"), F.lit("~0"))
            escaped = F.replace(escaped, F.lit("/"), F.lit("~1"))
            return F.coalesce(escaped, F.lit("~"))
        doc_id = F.concat_ws("/", *[part(name) for name in ids])
    if isinstance(lang, str):
        lang = F.col(lang) if lang in table.columns else F.lit(lang)
    text = F.col(text) if isinstance(text, str) else text
    docs = table.select(doc_id.alias("doc_id"), lang.alias("lang"), text.alias("text"))
    return docs.repartition(repartition_to) if repartition_to else docs
