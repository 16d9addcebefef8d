"""Plug-in annotators: a model of your choice, run inside Spark tasks.

The model sees batches of texts; Spark partitions the documents and nothing passes
through the driver.  A task opens a model once per language it meets.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbaloom.functions.layers import normalise_layers
from verbaloom.schemas import DOCUMENT_LAYERS, ENTITY, WORD

# Send this package's code along with a task, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["verbaloom"])

# Documents per call of the model, and per table handed back to Spark: bounds the memory
# that annotated documents take, which is many times that of their text.
TEXTS_PER_CALL = 16


class Model(Protocol):
    def annotate(self, texts: list[str]) -> list[list[dict[str, Any]]]:
        """Per text its sentences: ``{"text", "words", "entities"}`` as in ``schemas``.

        Word ids are places in the sentence, from 1, and are filled in when left out.
        """


class Annotator(Protocol):
    def open(self, lang: str, layers: str) -> Model:
        """Load the model from disk.  Called in the tasks; the annotator must pickle."""


def annotate_with_plugin(
    docs: DataFrame, annotator: Annotator, layers: str = "tokenize,mwt,pos,lemma,depparse,ner"
) -> DataFrame:
    """``(doc_id, lang, text)`` to the sentences table, by a plug-in."""
    layers = normalise_layers(layers)[0]
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("lang", T.StringType()),
        T.StructField("sents", DOCUMENT_LAYERS),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: dict[str, Model] = {}
        for batch in batches:
            for lang, same in batch.groupby("lang", dropna=False, sort=False):
                lang = None if pd.isna(lang) else lang
                if lang not in models:
                    models[lang] = annotator.open(lang, layers)
                for start in range(0, len(same), TEXTS_PER_CALL):
                    some = same.iloc[start:start + TEXTS_PER_CALL]
                    results = models[lang].annotate(some["text"].tolist())
                    yield pd.DataFrame({
                        "doc_id": some["doc_id"].to_numpy(),
                        "lang": lang,
                        "sents": [[_sentence_row(s) for s in sents] for sents in results],
                    })

    given = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull())
    annotated = given.mapInPandas(run, schema)
    exploded = annotated.select("doc_id", "lang", F.posexplode("sents").alias("pos", "s"))
    return exploded.select(
        "doc_id", "lang", (F.col("pos") + 1).cast("long").alias("sent_ix"), "s.*"
    )


def _sentence_row(sentence: dict[str, Any]) -> dict[str, Any]:
    words = sentence.get("words") or []
    entities = sentence.get("entities") or []
    return {
        "text": sentence["text"],
        "words": [_row(WORD, {**w, "word_id": i}) for i, w in enumerate(words, start=1)],
        "entities": [_row(ENTITY, {**e, "ent_ix": i}) for i, e in enumerate(entities, start=1)],
    }


def _row(struct: T.StructType, values: dict[str, Any]) -> dict[str, Any]:
    return {name: values.get(name) for name in struct.fieldNames()}


class DocumentTreeAnnotator:
    """Adapter for pipelines that return a tree of sentences, tokens, words and entities.

    ``load(lang, layers)`` returns a callable from text to a document whose ``sentences``
    have ``text``, ``tokens`` (each with ``text`` and ``words``) and, optionally, ``ents``
    (each with ``type``, ``text`` and ``tokens``).
    """

    def __init__(self, load: Callable[[str, str], Callable[[str], Any]]):
        self.load = load

    def open(self, lang: str, layers: str) -> Model:
        return _TreeModel(self.load(lang, layers))


class _TreeModel:
    def __init__(self, pipeline: Callable[[str], Any]):
        self.pipeline = pipeline

    def annotate(self, texts: list[str]) -> list[list[dict[str, Any]]]:
        return [[tree_sentence(s) for s in self.pipeline(text).sentences] for text in texts]


def tree_sentence(sentence: Any) -> dict[str, Any]:
    """One sentence of a document tree in the layout of ``schemas``."""
    words = [
        {
            "tok_ix": tok_ix, "part": part, "tok_form": token.text, "form": word.text,
            **{name: getattr(word, name, None) or None
               for name in ("lemma", "upos", "xpos", "feats", "head", "deprel")},
        }
        for tok_ix, token in enumerate(sentence.tokens, start=1)
        for part, word in enumerate(token.words, start=1)
    ]
    places = {id(token): tok_ix for tok_ix, token in enumerate(sentence.tokens, start=1)}
    entities = []
    for entity in getattr(sentence, "ents", None) or []:
        tokens = getattr(entity, "tokens", None) or []
        covered = [places[id(token)] for token in tokens if id(token) in places]
        entities.append({
            "type": entity.type, "text": entity.text,
            "tok_start": min(covered, default=None), "tok_end": max(covered, default=None),
        })
    return {"text": sentence.text, "words": words, "entities": entities}
