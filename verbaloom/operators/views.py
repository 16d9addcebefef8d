"""Flat views of the sentences table, and the same layers over flat tables.

The views never shuffle: an ``explode`` keeps a sentence's rows next to each other.  The
joins at the end serve tables that only exist in flat form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions.arrays import at, let
from verbaloom.functions.text import value_or
from verbaloom.schemas import TOKEN_COLUMNS, WORD, is_nested, key_columns, require_columns

ROOT_FORM = "ROOT"  # fixed value: shown as the head of a word that has none
OUTSIDE = "O"  # fixed value: the tag of a token outside every entity
MISSING_TAGS = {"FORM", "LEMMA", "UPOS", "DEPREL", "NER"}


def bio_tags(n_tokens: Column, entities: Column) -> Column:
    """One BIO tag per token, as an array of ``n_tokens`` strings.

    Spans are painted in order, so a later entity overwrites an earlier one.  Sorting the
    covered places and filling the gaps between them keeps this n log n in one sentence.
    """
    def paint(entity: Column, order: Column) -> Column:
        start, end = entity["tok_start"], entity["tok_end"]
        return F.transform(F.sequence(start, end), lambda place: F.struct(
            place.alias("place"), order.alias("order"),
            F.concat(F.when(place == start, "B-").otherwise("I-"), entity["type"]).alias("tag"),
        ))

    placed = F.filter(entities, lambda e: e["tok_start"].isNotNull() & e["tok_end"].isNotNull())
    strokes = F.sort_array(F.flatten(F.transform(placed, paint)))
    painted = let(strokes, lambda s: _fill_gaps(s, n_tokens))
    return F.when(F.size(placed) > 0, painted).otherwise(
        F.array_repeat(F.lit(OUTSIDE), n_tokens)
    )


def _fill_gaps(strokes: Column, n_tokens: Column) -> Column:
    def with_gap(stroke: Column, index: Column) -> Column:
        before = F.coalesce(at(strokes, index - 1)["place"], F.lit(0).cast("long"))
        gap = F.array_repeat(F.lit(OUTSIDE), (stroke["place"] - before - 1).cast("int"))
        on_top = F.coalesce(at(strokes, index + 1)["place"] != stroke["place"], F.lit(True))
        own = F.when(on_top, F.array(stroke["tag"])).otherwise(F.array().cast("array<string>"))
        return F.concat(gap, own)

    rest = (n_tokens - F.element_at(strokes, -1)["place"]).cast("int")
    return F.concat(
        F.flatten(F.transform(strokes, with_gap)), F.array_repeat(F.lit(OUTSIDE), rest)
    )


def sentence_view(sentences: DataFrame) -> DataFrame:
    return sentences.select("doc_id", "lang", "sent_ix", "text")


def word_view(sentences: DataFrame) -> DataFrame:
    """One row per syntactic word; contractions are expanded."""
    exploded = sentences.select("doc_id", "lang", "sent_ix", F.explode("words").alias("w"))
    return exploded.select(
        "doc_id", "lang", "sent_ix",
        F.col("w.word_id").alias("word_id"), F.col("w.tok_ix").alias("tok_ix"),
        F.col("w.tok_form").alias("TOK_FORM"), F.col("w.form").alias("FORM"),
        F.col("w.lemma").alias("LEMMA"), F.col("w.upos").alias("UPOS"),
        F.col("w.xpos").alias("XPOS"), F.col("w.feats").alias("FEATS"),
        F.col("w.head").alias("HEAD"), F.col("w.deprel").alias("DEPREL"),
    )


def entity_view(sentences: DataFrame) -> DataFrame:
    held = _unpacked(sentences)
    if held is None:
        exploded = sentences.select("doc_id", "lang", "sent_ix", F.explode("entities").alias("e"))
    else:  # an expression: of a bare column Spark would ask the size, from the text on, before it is made
        exploded = held.tokens.select("doc_id", "lang", "sent_ix", F.explode(F.concat("entities")).alias("e"))
    return exploded.select("doc_id", "lang", "sent_ix", "e.*")


def token_view(sentences: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per surface token: the token's form with the tags of its first word.

    ``columns`` picks from ``TOKEN_COLUMNS``; only the word properties behind the picked
    ones are read from the file and unpacked, or worked out if nothing is stored yet.
    """
    columns = columns or TOKEN_COLUMNS
    properties = {"tok_ix": "tok_ix", "FORM": "tok_form", "LEMMA": "lemma", "UPOS": "upos", "XPOS": "xpos",
                  "HEAD": "head", "DEPREL": "deprel"}
    picked = [name for name in columns if name in properties]
    held = _unpacked(sentences)
    if held is None:
        tok_ix, arrays = F.col("words.tok_ix"), {name: F.col(f"words.{properties[name]}") for name in picked}
        arrays["part"], told, kept = F.col("words.part"), {name: F.col(f"w.{name}") for name in picked}, []
    else:
        sentences, tok_ix = held.tokens, F.col("tok_ix")
        read = {"part"}.union(*[held.read.get(properties[name], ()) for name in picked])
        arrays = {name: F.sequence(F.lit(1), F.size("part")) if name == "word_id" else F.col(name) for name in sorted(read)}
        told, kept = {name: held.told[properties[name]] for name in picked}, held.kept
    if "NER" in columns:  # a step of its own, so that the rest is unpacked by generated code
        sentences = sentences.withColumn("ner_tags", _word_tags(tok_ix))
        arrays["NER"], told["NER"] = F.col("ner_tags"), F.col("w.NER")
    zipped = F.arrays_zip(*[values.alias(name) for name, values in arrays.items()])
    exploded = sentences.select("doc_id", "lang", "sent_ix", *kept, F.explode(zipped).alias("w"))
    defaults = {name: value_or(told[name]) for name in picked if name in MISSING_TAGS | {"XPOS"}}
    if "HEAD" in told:
        defaults["HEAD"] = F.coalesce(told["HEAD"], F.lit(0))
    return exploded.where(F.col("w.part") == 1).select(
        "doc_id", "lang",
        *["sent_ix" if c == "sent_ix" else defaults.get(c, told.get(c)).alias(c) for c in columns],
    )


def _unpacked(sentences: DataFrame):
    """The arrays of an annotation that is not kept anywhere (``rules.Unpacked``)."""
    return None if sentences.is_cached else getattr(sentences, "unpacked", None)


def tokens_of(df: DataFrame, *columns: str) -> DataFrame:
    """Token rows with ``columns``, from the sentences table or from a flat token table.

    What a flat table lacks counts as ``_``, or as outside every entity, as in a table that
    is read from a file.
    """
    if is_nested(df):
        return token_view(df, list(columns))
    require_columns(df, *columns)
    return df.withColumns({
        name: value_or(F.col(name), OUTSIDE if name == "NER" else "_")
        for name in columns if name in MISSING_TAGS
    })


def first_words(words: Column) -> Column:
    """The word that stands for its token: the first one."""
    return F.filter(words, lambda w: w["part"] == 1)


def _word_tags(tok_ix: Column) -> Column:
    """The BIO tag of every word: that of the token it belongs to."""
    n_tokens = F.coalesce(F.element_at(tok_ix, -1), F.lit(0).cast("long")).cast("int")
    entities = F.col("entities")
    spread = let(bio_tags(n_tokens, entities),
                 lambda tags: F.transform(tok_ix, lambda ix: at(tags, (ix - 1).cast("int"))))
    nothing = F.array_repeat(F.lit(OUTSIDE), F.size(tok_ix))
    return F.when(F.size(entities) > 0, spread).otherwise(nothing)


def head_form(words: Column, head: Column) -> Column:
    """Form of the word that ``head`` names; word ids are places in ``words``."""
    return F.coalesce(at(words, F.coalesce(head, F.lit(0)) - 1)["form"], F.lit(ROOT_FORM))


def head_forms(sentences: DataFrame) -> DataFrame:
    """One row per word with the form of its head, found inside the sentence row."""
    pairs = let(F.col("words"), lambda words: F.transform(words, lambda w: F.struct(
        w["word_id"].alias("word_id"), w["form"].alias("dep_form"),
        F.coalesce(w["head"], F.lit(0)).alias("head"), w["deprel"].alias("deprel"),
        head_form(words, w["head"]).alias("head_form"),
    )))
    return sentences.select("doc_id", "lang", "sent_ix", F.explode(pairs).alias("p")).select(
        "doc_id", "lang", "sent_ix", "p.*"
    )


def join_head_forms(words: DataFrame) -> DataFrame:
    """``head_forms`` for a flat word table.

    The key names the head, so the words of a huge sentence spread over the cluster by
    head.  Should most of them share one head, adaptive execution splits that key: the
    heads' side has one row for it and the words' side of a left join may be split.
    """
    require_columns(words, "sent_ix", "word_id", "FORM", "HEAD")
    sentence = [*key_columns(words), "sent_ix"]
    heads = words.select(*sentence, F.col("word_id").alias("HEAD"), F.col("FORM").alias("head_form"))
    joined = words.join(heads, [*sentence, "HEAD"], "left")
    return joined.withColumn("head_form", F.coalesce("head_form", F.lit(ROOT_FORM))).select(
        *words.columns, "head_form"
    )


def join_bio_tags(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Add the ``NER`` column to a flat token table from a flat entity table."""
    require_columns(tokens, "sent_ix", "tok_ix")
    require_columns(entities, "sent_ix", "ent_ix", "type", "tok_start", "tok_end")
    place = [*key_columns(tokens), "sent_ix", "tok_ix"]
    covered = entities.withColumn("tok_ix", F.explode(F.sequence("tok_start", "tok_end")))
    tag = F.concat(F.when(F.col("tok_ix") == F.col("tok_start"), "B-").otherwise("I-"),
                   F.col("type"))
    tags = covered.groupBy(*place).agg(F.max_by(tag, F.col("ent_ix")).alias("NER"))
    bare = tokens.drop("NER")
    return bare.join(tags, place, "left").withColumn("NER", F.coalesce("NER", F.lit(OUTSIDE))).select(
        *bare.columns, "NER"
    )
