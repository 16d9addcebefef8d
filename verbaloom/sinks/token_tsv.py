"""Token tables as tab-separated files, one token per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbaloom.functions.text import BREAKING_PATTERN, clean_field
from verbaloom.operators.views import token_view
from verbaloom.schemas import TOKEN_COLUMNS, is_nested, require_columns
from verbaloom.sinks.packing import packed
from verbaloom.sources.token_tsv import TSV_OPTIONS


def tsv_rows(df: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The lines' fields: ``keys`` that exist, then the nine token columns."""
    tokens = token_view(df) if is_nested(df) else df
    require_columns(tokens, *TOKEN_COLUMNS)
    names = [name for name in keys if name in tokens.columns] + TOKEN_COLUMNS
    texts = [name for name in names if isinstance(tokens.schema[name].dataType, T.StringType)]
    # One look at a line's fields together; only those of a line that would break are rewritten.
    line = tokens.select(*names, F.concat_ws("", *texts).rlike(BREAKING_PATTERN).alias(" breaks"))
    return line.select(*[
        F.when(F.col(" breaks"), clean_field(F.col(name))).otherwise(F.col(name)).alias(name) if name in texts else F.col(name)
        for name in names
    ])


def write_tokens(
    df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id", "lang"), mode: str = "errorifexists",
    compression: str = "none",
) -> None:
    """Write one tab-separated file per task.

    Sentences keep the order of the input.  ``keys=()`` writes the nine columns alone,
    for a corpus of one document.
    """
    tsv_rows(df, keys).write.mode(mode).options(**TSV_OPTIONS, **packed(compression)).csv(path)
