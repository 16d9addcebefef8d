"""Lemmas by suffix rewriting that is learned from forms and their lemmas.

A pair of form and lemma is an edit script: cut so many letters off the end, add these.  For each
ending of a form, up to ``ENDING`` letters, the most frequent script is a rule if it has
``SUPPORT`` different forms.  A known form has its most frequent lemma; of an unknown one the longest
ending with a rule is rewritten; without any the form in lower case is its lemma.

All of it is counted by language and tag.  Rules and known forms are tables.  Words are solved in their rows
if these are small; else each distinct word of the corpus is solved once and the answers go back to the
words (``vocabulary``).

Ties: fewer letters cut, then the added letters, then the lemma, in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions.arrays import let
from verbaloom.operators import vocabulary
from verbaloom.operators.lexicon_table import with_word_values
from verbaloom.operators.vocabulary import JOINT, distinct_keys, looked_up, one_value, one_value_each, value_of
from verbaloom.schemas import require_columns
from verbaloom.session import checkpoint

ENDING = 6
SUPPORT = 2


@dataclass(frozen=True)
class Lemmatizer:
    """``key, value``: language, tag and form with ``lemma``, or language, tag and ending with ``cut, added``."""

    forms: DataFrame
    rules: DataFrame


def word_key(lang: Column, tag: Column, form: Column) -> Column:
    return F.concat(F.coalesce(lang, F.lit("")), F.lit(JOINT), F.coalesce(tag, F.lit("_")), F.lit(JOINT), form)


def _shared(a: Column, b: Column) -> Column:
    """How many letters two words have in common at their beginnings."""
    sizes = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(sizes, lambda k: F.left(a, k) == F.left(b, k)))


def train_lemmatizer(words: DataFrame) -> Lemmatizer:
    """A lemmatizer from rows ``lang, FORM, LEMMA, UPOS``; rows without form or lemma are left out."""
    require_columns(words, "lang", "FORM", "LEMMA", "UPOS")
    low = words.filter("FORM <> '' AND LEMMA <> ''").select("lang", F.coalesce("UPOS", F.lit("_")).alias("tag"), F.lower("FORM").alias("form"), F.col("LEMMA").alias("lemma"))
    counts = checkpoint(low.groupBy("lang", "tag", "form", "lemma").agg(F.count(F.lit(1)).alias("n")))
    keyed = counts.withColumn("key", word_key(F.col("lang"), F.col("tag"), F.col("form")))
    forms = checkpoint(one_value_each(keyed, "key", [-F.col("n"), F.col("lemma")], ["lemma"]))
    scripts = counts.withColumn("shared", _shared(F.col("form"), F.col("lemma"))).select(
        "lang", "tag", "form", (F.length("form") - F.col("shared")).alias("cut"), F.substr("lemma", F.col("shared") + 1).alias("added"))
    sizes = F.sequence(F.col("cut"), F.least(F.length("form"), F.lit(ENDING)))
    endings = scripts.filter(F.col("cut") <= ENDING).select(
        "lang", "tag", "cut", "added", F.explode(F.transform(sizes, lambda k: F.right("form", k))).alias("ending"))
    rules = endings.groupBy("lang", "tag", "ending", "cut", "added").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT)
    rules = rules.withColumn("key", word_key(F.col("lang"), F.col("tag"), F.col("ending")))
    return Lemmatizer(forms, checkpoint(one_value_each(rules, "key", [-F.col("n"), F.col("cut"), F.col("added")], ["cut", "added"])))


def lemmas_of(rows: DataFrame, keys: Column, lemmatizer: Lemmatizer) -> DataFrame:
    """``key, value`` (``lemma``) for every distinct element of ``keys``."""
    parts = [F.split_part("key", F.lit(JOINT), F.lit(i)) for i in (1, 2, 3)]
    vocabulary = checkpoint(distinct_keys(rows, keys).select("key"))
    known = vocabulary.join(lemmatizer.forms, "key")
    unknown = vocabulary.join(lemmatizer.forms.select("key"), "key", "left_anti").select(
        "key", parts[2].alias("form"), F.concat(parts[0], F.lit(JOINT), parts[1], F.lit(JOINT)).alias("front"))
    sizes = F.sequence(F.least(F.length("form"), F.lit(ENDING)), F.lit(0), F.lit(-1))
    unknown = unknown.withColumn("ends", F.transform(sizes, lambda k: F.concat(F.col("front"), F.right("form", k))))
    found = looked_up(unknown, "ends", lemmatizer.rules, "scripts", ["key"])
    script = F.get(F.filter("scripts", lambda s: s.isNotNull()), F.lit(0))
    found = found.select("key", "form", script.alias("script"))
    lemma = F.concat(F.left("form", F.length("form") - F.col("script.cut")), F.col("script.added"))
    return known.unionByName(found.select("key", F.struct(F.coalesce(lemma, F.col("form")).alias("lemma")).alias("value")))


def _lemmas_in_rows(sentences: DataFrame, lemmatizer: Lemmatizer) -> DataFrame:
    """``sentences`` with ``lemmas``, those of ``lemmas_of``, from a model that goes as two values."""
    rows = sentences.withColumns({"form_maps": one_value(lemmatizer.forms), "rule_maps": one_value(lemmatizer.rules)})
    lang, words, forms, rules = (F.col(name) for name in ("lang", "words", "form_maps", "rule_maps"))

    def rewritten(form: Column, front: Column) -> Column:
        longest = F.least(F.length(form), F.lit(ENDING))
        scripts = [F.when(longest >= size, value_of(rules, F.concat(front, F.right(form, F.lit(size))))) for size in range(ENDING, -1, -1)]
        return let(F.coalesce(*scripts), lambda s: F.coalesce(F.concat(F.left(form, F.length(form) - s["cut"]), s["added"]), form))

    fronts = F.transform(words["upos"], lambda tag: word_key(lang, tag, F.lit("")))
    pairs = F.arrays_zip(F.transform(words["form"], F.lower).alias("form"), fronts.alias("front"))
    lemmas = F.transform(pairs, lambda w: F.coalesce(
        value_of(forms, F.concat(w["front"], w["form"]))["lemma"], rewritten(w["form"], w["front"])))
    return rows.withColumn("lemmas", lemmas).drop("form_maps", "rule_maps")


def apply_lemmas(sentences: DataFrame, lemmatizer: Lemmatizer) -> DataFrame:
    """``sentences`` with the lemmatizer's lemmas, by the words' forms and tags.

    A model of up to ``ENTRIES`` entries goes to the rows as one value and nothing moves; with a larger
    one each distinct word is solved once and the answers go back to the rows.
    """
    if lemmatizer.forms.count() + lemmatizer.rules.count() <= vocabulary.ENTRIES:
        return with_word_values(_lemmas_in_rows(sentences, lemmatizer), {"lemma": F.col("lemmas")}).drop("lemmas")
    keys = F.transform("words", lambda w: word_key(F.col("lang"), w["upos"], F.lower(w["form"])))
    found = looked_up(sentences, keys, lemmas_of(sentences, keys, lemmatizer), "lemmas", ["doc_id", "sent_ix"])
    return with_word_values(found, {"lemma": F.transform("lemmas", lambda v: v["lemma"])}).drop("lemmas")
