"""The smallest useful plug-in: lines are sentences, spaces separate tokens."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = "X"  # fixed value: the universal tag for words of no known class


class WhitespaceAnnotator:
    """Needs no model, so it also shows what a plug-in has to return."""

    def open(self, lang: str, layers: str) -> WhitespaceAnnotator:
        return self

    def annotate(self, texts: list[str]) -> list[list[dict[str, Any]]]:
        return [
            [self._sentence(line) for line in text.split("\n") if line.strip()] for text in texts
        ]

    def _sentence(self, line: str) -> dict[str, Any]:
        words = [
            {"tok_ix": place, "part": 1, "tok_form": form, "form": form, "lemma": form.lower(),
             "upos": TAG, "head": 0 if place == 1 else 1, "deprel": "root" if place == 1 else "dep"}
            for place, form in enumerate(line.split(), start=1)
        ]
        return {"text": line.strip(), "words": words, "entities": []}


def whitespace_tokens(docs: DataFrame) -> DataFrame:
    """What the annotator above comes to, as a token view made of column expressions alone."""
    lines = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\p{Z}\p{Cc}]")))
    placed = docs.select("doc_id", "lang", F.posexplode(lines).alias("line_ix", "line"))
    tokens = F.regexp_extract_all("line", F.lit(r"[^\p{Z}\t\n\r\f\x0b\x1c-\x1f\x85]+"), F.lit(0))
    words = placed.select("doc_id", "lang", "line_ix", F.posexplode(tokens).alias("ix", "FORM"))
    first = F.col("ix") == 0
    return words.select(
        "doc_id", "lang", (F.col("line_ix") + 1).cast("long").alias("sent_ix"), (F.col("ix") + 1).cast("long").alias("tok_ix"),
        "FORM", F.lower("FORM").alias("LEMMA"), F.lit("X").alias("UPOS"), F.lit("_").alias("XPOS"),
        F.when(first, 0).otherwise(1).alias("HEAD"), F.when(first, "root").otherwise("dep").alias("DEPREL"), F.lit("O").alias("NER"))
