"""Sentences as JSON objects, one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions.arrays import let
from verbaloom.functions.text import value_or
from verbaloom.operators.views import first_words, head_form
from verbaloom.sinks.packing import packed


def sentence_objects(sentences: DataFrame) -> DataFrame:
    """``doc_id, lang, index, text, tokens, entities, dependencies`` per sentence."""
    def token(w: Column) -> Column:
        return F.struct(
            w["tok_ix"].alias("tok_ix"), w["tok_form"].alias("form"),
            value_or(w["lemma"]).alias("lemma"), value_or(w["upos"]).alias("upos"),
            value_or(w["xpos"]).alias("xpos"), F.coalesce(w["head"], F.lit(0)).alias("head"),
            value_or(w["deprel"]).alias("deprel"),
        )

    def dependency(words: Column, w: Column) -> Column:
        return F.struct(
            head_form(words, w["head"]).alias("head_form"), w["form"].alias("dep_form"),
            w["deprel"].alias("deprel"), F.coalesce(w["head"], F.lit(0)).alias("head"),
            w["word_id"].alias("dep"),
        )

    words = F.col("words")
    entities = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["text"].alias("text")))
    return sentences.select(
        "doc_id", "lang", F.col("sent_ix").alias("index"), "text",
        F.transform(first_words(words), token).alias("tokens"),
        entities.alias("entities"),
        let(words, lambda ws: F.transform(ws, lambda w: dependency(ws, w))).alias("dependencies"),
    )


def write_json(
    sentences: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none"
) -> None:
    writer = sentence_objects(sentences).write.mode(mode).options(**packed(compression))
    writer.option("ignoreNullFields", "false").json(path)
