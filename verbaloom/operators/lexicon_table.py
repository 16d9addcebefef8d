"""Lemmas and tags from a lexicon that is a table, of any size.

``lexicon`` has ``lang, form, lemma, upos`` with forms in lower case; a null lemma or tag leaves
what is there.  Each distinct form of the corpus is joined with it once (``vocabulary``), so the
plan is the same for ten entries and ten million, and no word gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.operators.vocabulary import lang_key, looked_up, one_value_each
from verbaloom.schemas import WORD, require_columns


def with_word_values(sentences: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``sentences`` with fields of their words replaced; ``values`` are arrays with one value per word.

    The words are unpacked from an array of one, so that a condition on them, such as that there are any, stays
    above what they are made of instead of making them twice.
    """
    zipped = F.arrays_zip(F.col("words").alias("word"), *[v.alias(f"new_{name}") for name, v in values.items()])
    words = F.transform(zipped, lambda z: F.struct(*[
        (z[f"new_{name}"] if name in values else z["word"][name]).alias(name) for name in WORD.fieldNames()]))
    sealed = sentences.withColumn("sealed", F.explode(F.array(F.struct(words.alias("words")))))
    return sealed.withColumn("words", F.col("sealed.words")).drop("sealed")


def form_keys() -> Column:
    """The keys of a sentence's lower-case forms."""
    return F.transform("words.form", lambda form: lang_key(F.col("lang"), F.lower(form)))


def apply_lexicon(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``sentences`` with the lexicon's lemmas and tags.  Of several entries of a form the one whose tag,
    then lemma, is first counts."""
    require_columns(lexicon, "lang", "form", "lemma", "upos")
    keyed = lexicon.withColumn("key", lang_key(F.col("lang"), F.col("form")))
    table = one_value_each(keyed, "key", [F.col("upos"), F.col("lemma")], ["lemma", "upos"])
    found = looked_up(sentences, form_keys(), table, "entries", ["doc_id", "sent_ix"])

    def chosen(name: str) -> Column:
        pairs = F.arrays_zip(F.col("entries").alias("entry"), F.col(f"words.{name}").alias("old"))
        return F.transform(pairs, lambda p: F.coalesce(p["entry"][name], p["old"]))
    return with_word_values(found, {"lemma": chosen("lemma"), "upos": chosen("upos")}).drop("entries")
