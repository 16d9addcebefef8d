"""Text to annotation, with the rules or with a plug-in."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from verbaloom.functions.layers import LAYER_ORDER, normalise_layers
from verbaloom.operators.lexicon import Lexicon
from verbaloom.operators.plugin import Annotator, annotate_with_plugin
from verbaloom.operators.rules import annotate_with_rules
from verbaloom.schemas import require_columns


def annotate(
    docs: DataFrame,
    layers: str = ",".join(LAYER_ORDER),
    annotator: Annotator | None = None,
    lexicon: Lexicon | None = None,
) -> DataFrame:
    """``(doc_id, lang, text)`` to the sentences table; lazy, and without a shuffle."""
    require_columns(docs, "doc_id", "lang", "text")
    ordered, notes = normalise_layers(layers)
    for note in notes:
        warnings.warn(note, stacklevel=2)
    if annotator is not None:
        return annotate_with_plugin(docs, annotator, ordered)
    return annotate_with_rules(docs, ordered, lexicon)


def store_annotation(sentences: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write the sentences table as Parquet and return it read back.

    Annotate once, then run exports and statistics from the file: each of them reads only
    the word properties it needs, and a lost executor costs a read, not a new annotation.
    """
    sentences.write.mode(mode).option("compression", "zstd").parquet(path)
    return sentences.sparkSession.read.schema(sentences.schema).parquet(path)
