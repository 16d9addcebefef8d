"""Plain-text files as a corpus: one file is one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_text(content: Column) -> Column:
    """Bytes as text: UTF-8 when they are valid UTF-8, else Latin-1; line ends become ``\\n``."""
    as_utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def read_text_files(
    spark: SparkSession, path: str | list[str], lang: str, pattern: str = "*.txt",
    repartition_to: int | None = None,
) -> DataFrame:
    """``doc_id, lang, text`` with the file's path as the id, which no two files share.

    ``repartition_to`` deals the files out to that many tasks.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(path)
    )
    files = files.select("path", "content")
    files = files.repartition(repartition_to) if repartition_to else files
    return files.select(
        F.col("path").alias("doc_id"), F.lit(lang).alias("lang"),
        decode_text(F.col("content")).alias("text"),
    )
