"""The rule annotator: all layers as column expressions over one sentence row.

Nothing here shuffles.  The words of a sentence are an array, so the index of a word, the
head of a sentence and the edges of a name are found inside the row.

The rules are a deterministic baseline (see ``lexicon``); for model-quality layers run a
plug-in through ``operators.plugin``, which yields the same table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbaloom.functions.arrays import let
from verbaloom.functions.layers import normalise_layers
from verbaloom.operators.lexicon import Lexicon
from verbaloom.operators.segment import split_sentences, token_array
from verbaloom.schemas import ENTITY

# Entries of a constant map that is searched in full.
BUCKET_ENTRIES = 2

NUMBER_PATTERN = r"^\p{N}+$"
SYMBOL_PATTERN = r"^[^\p{L}\p{N}]+$"
CAPITAL_PATTERN = r"^\p{Lu}"
LETTER_PATTERN = r"\p{L}"
OPENING_PATTERN = r"^[^\p{L}\p{M}\p{N}_]*"
BLANK_PATTERN = r"[\p{Z}\p{Cc}]"
# German writes every noun with a capital, so a capital says nothing about names there.
NO_CAPITAL_RULE = ["de"]

# The relation of a word to the root of its sentence, by tag.
RELATION_BY_TAG = {
    "DET": "det", "ADP": "case", "ADJ": "amod", "ADV": "advmod", "AUX": "aux",
    "CCONJ": "cc", "SCONJ": "mark", "NUM": "nummod", "PRON": "nsubj", "PROPN": "nmod",
    "NOUN": "obl", "PART": "advmod", "PUNCT": "punct", "VERB": "conj",
}
OTHER_RELATION = "dep"
OTHER_NAME_TYPE = "MISC"
# Tags that a word's shape gives.
SHAPE_TAGS = {"NOUN", "NUM", "PROPN", "PUNCT"}


def _text(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _lookup(table: dict[tuple[str, str], str], form: str) -> str:
    """SQL for the value of ``(lang, form)`` in a constant table, null when it is not there.

    ``form`` and the table's values are SQL.  The membership test is a hash lookup.  What it
    lets pass is looked up in one of many small maps, chosen by the form's checksum, because
    a map is searched entry by entry.
    """
    if not table:
        return "NULL"
    by_lang: dict[str, dict[str, str]] = {}
    for (code, key), value in table.items():
        by_lang.setdefault(code, {})[key] = value
    cases = " ".join(f"WHEN {_text(code)} THEN {_in_buckets(entries, form)}" for code, entries in by_lang.items())
    known = ", ".join(_text(key) for key in sorted({key for _, key in table}))
    return f"CASE WHEN {form} IN ({known}) THEN CASE lang {cases} END END"


def _in_buckets(entries: dict[str, str], form: str) -> str:
    size = 1 + len(entries) // BUCKET_ENTRIES
    # No form is empty; the empty key gives a bucket without entries its type.
    buckets = [[f"'', {next(iter(entries.values()))}"] for _ in range(size)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % size].append(f"{_text(key)}, {value}")
    maps = ", ".join(f"map({', '.join(bucket)})" for bucket in buckets)
    return f"try_element_at(element_at(array({maps}), CAST(crc32(CAST({form} AS BINARY)) % {size} AS INT) + 1), {form})"


def annotate_with_rules(
    docs: DataFrame,
    layers: str = "tokenize,mwt,pos,lemma,depparse,ner",
    lexicon: Lexicon | None = None,
) -> DataFrame:
    """``(doc_id, lang, text)`` to the sentences table.

    Layers left out of ``layers`` come back as nulls (or no entities); ``tokenize`` is
    always done because every other layer stands on it.

    Words are kept as one array per property and zipped at the end: a string array is
    cheap to build and to pass on, an array of structs is copied field by field.  Tags are
    numbers until then, so that what follows from a tag is an element of a constant array.
    """
    wanted = set(normalise_layers(layers)[0].split(","))
    lexicon = lexicon or Lexicon()
    tagged = bool(wanted & {"pos", "depparse", "ner"})

    step = split_sentences(docs).withColumn("toks", token_array(F.col("text")))
    step = step.withColumn("tok_low", F.transform("toks", F.lower))
    step = _with_words(step, lexicon.contractions if "mwt" in wanted else {})
    if tagged:
        names = _tag_names(lexicon)
        step = step.withColumn("opening", _opening()).withColumn("shaped", _tag_numbers(lexicon, names))
        step = step.withColumn("numbers", _without_opening(names))
    if "depparse" in wanted:
        step = step.withColumn("root", _root(F.col("numbers"), names))
    if "ner" in wanted:
        tags, capital = _named(F.col("numbers"), names), len(names) - 1
        named = F.array_contains("numbers", capital) | F.array_contains("numbers", names.index("PROPN"))
        step = step.withColumn("tok_tags", F.when(named, F.when(F.size("form") == F.size("toks"), tags)
                                                  .otherwise(_first_parts(tags))))
    entities = F.array().cast(T.ArrayType(ENTITY))
    if "ner" in wanted:
        entities = F.when(F.array_contains("tok_tags", "PROPN"), _entities(lexicon)).otherwise(entities)

    tokens = step.select("*", entities.alias("entities"), *_places())
    relations = [RELATION_BY_TAG.get(tag, OTHER_RELATION) for tag in names] if tagged else []
    lemmas = {key: _text(value) for key, (value, _) in lexicon.tags.items()}
    n = F.size("form")
    strings, ints = F.lit(None).cast("string"), F.lit(None).cast("int")
    missing = F.array_repeat(strings, n)
    lemma, upos, head, deprel = missing, missing, F.array_repeat(ints, n), missing
    if "lemma" in wanted:
        lemma = F.expr(f"transform(low, l -> coalesce({_lookup(lemmas, 'l')}, l))")
    if "pos" in wanted:
        upos = _named(F.col("numbers"), names)
    if "depparse" in wanted:
        root = F.col("root")
        head = F.concat(F.array_repeat(root, root - 1), F.array(F.lit(0)),
                        F.array_repeat(root, n - root))
        relation = _named(F.col("numbers"), relations)
        deprel = F.concat(F.slice(relation, F.lit(1), root - 1), F.array(F.lit("root")),
                          F.slice(relation, root + 1, n - root))
    words = F.arrays_zip(
        F.sequence(F.lit(1), n).alias("word_id"), F.col("tok_ix"), F.col("part"),
        F.col("tok_form"), F.col("form"), lemma.alias("lemma"), upos.alias("upos"),
        missing.alias("xpos"), missing.alias("feats"), head.alias("head"),
        deprel.alias("deprel"),
    )
    # Unpacking a one-element array changes nothing but stops the optimizer from moving a
    # later condition on words below the steps above, where it would repeat all of them.
    # Conditions on the keys still reach the scan.
    step = tokens.select("doc_id", "lang", "sent_ix", "text", words.alias("words"), "entities")
    layers = F.array(F.struct("words", "entities"))
    sealed = step.select("doc_id", "lang", "sent_ix", "text", F.explode(layers).alias("layers"))
    sentences = sealed.select("doc_id", "lang", "sent_ix", "text", "layers.words", "layers.entities")

    # What a word's row says, told from the arrays of its sentence when the words are unpacked.
    nothing = F.lit(None).cast("string")
    number, is_root = F.col("w.numbers"), F.col("w.word_id") == F.col("root")
    told = {"tok_ix": F.col("w.tok_ix"), "tok_form": F.col("w.tok_form"), "lemma": nothing, "upos": nothing,
            "xpos": nothing, "head": F.lit(None).cast("int"), "deprel": nothing}
    read = {"tok_ix": {"tok_ix"}, "tok_form": {"tok_form"}}
    if "lemma" in wanted:
        told["lemma"] = F.expr(f"coalesce({_lookup(lemmas, 'w.low')}, w.low)")
        read["lemma"] = {"low"}
    if "pos" in wanted:
        told["upos"] = F.get(_entries(names), number)
        read["upos"] = {"numbers"}
    if "depparse" in wanted:
        told["head"] = F.when(is_root, 0).otherwise(F.col("root"))
        told["deprel"] = F.when(is_root, "root").otherwise(F.get(_entries(relations), number))
        read |= {"head": {"word_id"}, "deprel": {"word_id", "numbers"}}
    sentences.unpacked = Unpacked(tokens, told, read, ["root"] if "depparse" in wanted else [])
    return sentences


@dataclass(frozen=True)
class Unpacked:
    """The annotation before its words are put together, for views that would take them apart again.

    ``tokens`` has a sentence's arrays, ``told`` the columns of a word in terms of its entries ``w``, 
    ``read`` the arrays behind each, and ``kept`` the sentence's columns they mention.  It holds for the annotation itself, not for what is selected from it.
    """

    tokens: DataFrame
    told: dict[str, Column]
    read: dict[str, set[str]]
    kept: list[str]


def _places() -> list[Column]:
    """Where the words of a sentence stand: counted, if no token is a contraction."""
    n = F.size("toks")
    plain = {
        "tok_ix": F.sequence(F.lit(1).cast("long"), n.cast("long")),
        "part": F.array_repeat(F.lit(1), n),
        "tok_form": F.col("toks"),
    }
    return [F.when(F.col("split").isNull(), c).otherwise(F.col(f"split.{name}")).alias(name) for name, c in plain.items()]


def _with_words(step: DataFrame, contractions: dict[tuple[str, str], list[str]]) -> DataFrame:
    """Add the words' forms, as they are and in small letters; a contraction becomes several words.

    ``split`` has all of a word's places; it is null where no token is a contraction.
    """
    if not contractions:
        split = F.lit(None).cast("array<struct<tok_ix:bigint,part:int,tok_form:string,form:string,low:string>>")
        return step.withColumns({"split": split, "form": F.col("toks"), "low": F.col("tok_low")})
    table = {
        key: f"array({', '.join(_text(part) for part in parts)})" for key, parts in contractions.items()
    }
    known = ", ".join(_text(token) for token in sorted({token for _, token in contractions}))
    # One struct per word; only sentences with a contraction pay for it.
    split = F.expr(f"""
        CASE WHEN arrays_overlap(tok_low, array({known})) THEN flatten(transform(
            arrays_zip(toks, tok_low),
            (t, i) -> coalesce(
                transform({_lookup(table, "t.tok_low")},
                    (f, j) -> struct(CAST(i + 1 AS BIGINT) AS tok_ix, j + 1 AS part,
                                     t.toks AS tok_form, f AS form, lower(f) AS low)),
                array(struct(CAST(i + 1 AS BIGINT) AS tok_ix, 1 AS part,
                             t.toks AS tok_form, t.toks AS form, t.tok_low AS low))))) END
    """)
    step = step.withColumn("split", split)
    unsplit = F.col("split").isNull()
    return step.withColumns({name: F.when(unsplit, F.col(plain)).otherwise(F.col(f"split.{name}"))
                             for name, plain in {"form": "toks", "low": "tok_low"}.items()})


def _first_parts(values: Column) -> Column:
    """Values of the words that stand for their token."""
    pairs = F.arrays_zip(F.col("split.part").alias("part"), values.alias("value"))
    return F.filter(pairs, lambda pair: pair["part"] == 1)["value"]


def _opening() -> Column:
    """Token index of the opening word: the first token that is not a lone symbol."""
    symbols = F.regexp_extract("text", OPENING_PATTERN, 0)
    text = F.col("text")
    letter = ((text >= "a") & (text < "{")) | ((text >= "A") & (text < "["))
    return F.when(letter, 1).otherwise(F.length(F.regexp_replace(symbols, BLANK_PATTERN, "")) + 1)


def _tag_names(lexicon: Lexicon) -> list[str]:
    """The tags by number; the last one is that of a capital, which the opening word does not keep."""
    return [*sorted(SHAPE_TAGS | {tag for _, tag in lexicon.tags.values()}), "PROPN"]


def _entries(names: list[str]) -> Column:
    return F.array(*[F.lit(name) for name in names])


def _named(numbers: Column, names: list[str]) -> Column:
    """The entry of a constant list for every number."""
    entries = _entries(names)
    return F.transform(numbers, lambda number: F.get(entries, number))


def _tag_numbers(lexicon: Lexicon, names: list[str]) -> Column:
    """Part of speech: the lexicon first, then the shape of the word.

    Whether a word begins with one of 26 letters is told by its first byte; others are matched.
    """
    table = {key: str(names.index(tag)) for key, (_, tag) in lexicon.tags.items()}
    no_names = ", ".join(_text(code) for code in NO_CAPITAL_RULE)
    noun, capital = names.index("NOUN"), len(names) - 1
    return F.expr(f"""
        zip_with(form, low,
            (f, l) -> coalesce({_lookup(table, "l")}, CASE
                WHEN (l >= 'a' AND l < '{{') OR f rlike r'{LETTER_PATTERN}' THEN CASE
                    WHEN f <> l AND ((f >= 'A' AND f < '[') OR f rlike r'{CAPITAL_PATTERN}')
                        AND coalesce(lang NOT IN ({no_names}), true) THEN {capital}
                    ELSE {noun} END
                WHEN f rlike r'{NUMBER_PATTERN}' THEN {names.index("NUM")}
                WHEN f rlike r'{SYMBOL_PATTERN}' THEN {names.index("PUNCT")}
                ELSE {noun} END))
    """)


def _without_opening(names: list[str]) -> Column:
    """The numbers in ``shaped``, with a capital at the opening of the sentence taken for that of a noun."""
    shaped, opening, n = F.col("shaped"), F.col("opening"), F.size("shaped")
    noun, capital = F.lit(names.index("NOUN")), F.lit(len(names) - 1)
    one_each = F.concat(F.slice(shaped, F.lit(1), opening - 1), F.array(noun), F.slice(shaped, opening + 1, n - opening))
    opens = F.arrays_zip(shaped.alias("number"), F.col("split.tok_ix").alias("tok_ix"), F.array_repeat(opening, n).alias("opening"))
    parts = F.transform(opens, lambda w: F.when((w["number"] == capital) & (w["tok_ix"] == w["opening"]), noun).otherwise(w["number"]))
    return F.when(n != F.size("toks"), parts).when(F.get(shaped, opening - 1) == capital, one_each).otherwise(shaped)


def _root(numbers: Column, names: list[str]) -> Column:
    """The first verb, else the first word that is not punctuation, else the first."""
    solid = F.transform(numbers, lambda number: number != names.index("PUNCT"))
    verb = names.index("VERB") if "VERB" in names else -1
    return F.coalesce(
        F.nullif(F.array_position(numbers, F.lit(verb)), F.lit(0).cast("long")),
        F.nullif(F.array_position(solid, F.lit(True)), F.lit(0).cast("long")),
        F.lit(1).cast("long"),
    ).cast("int")


def _entities(lexicon: Lexicon) -> Column:
    """Runs of proper nouns among the tokens, typed by the name list."""
    tags = F.col("tok_tags")
    n = F.size(tags)
    nothing = F.array(F.lit(""))
    before = F.concat(nothing, F.slice(tags, F.lit(1), n - 1))
    after = F.concat(F.slice(tags, F.lit(2), n - 1), nothing)

    def edges(neighbours: Column) -> Column:
        places = F.transform(
            F.arrays_zip(tags.alias("tag"), neighbours.alias("next")),
            lambda t, i: F.when((t["tag"] == "PROPN") & (t["next"] != "PROPN"),
                                (i + 1).cast("long")),
        )
        return F.array_compact(places)

    names = ", ".join(f"{_text(name)}, {_text(kind)}" for name, kind in lexicon.names.items())

    def entity(span: Column, index: Column, toks: Column) -> Column:
        length = (span["end"] - span["start"] + 1).cast("int")
        text = F.array_join(F.slice(toks, span["start"].cast("int"), length), " ")
        kind = F.lit(OTHER_NAME_TYPE)
        if names:
            kind = F.coalesce(F.try_element_at(F.expr(f"map({names})"), F.lower(text)), kind)
        return F.struct(
            (index + 1).alias("ent_ix"), kind.alias("type"), text.alias("text"),
            span["start"].alias("tok_start"), span["end"].alias("tok_end"),
        )

    spans = F.arrays_zip(edges(before).alias("start"), edges(after).alias("end"))
    return let(F.col("toks"), lambda toks: F.transform(spans, lambda s, i: entity(s, i, toks)))
