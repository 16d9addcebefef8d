"""Dependency trees by shift and reduce, inside a sentence's row; the sentences of a batch take steps together.

Words are put on a stack one by one.  Before each, three things compete by score: the word on top
becomes a dependent of the next word (*left*), or of the word below it on the stack (*right*), or
the next word is put on the stack (*shift*), which counts as much as the next word being a dependent of
the top, or as the top being the root, whichever is more.  When no word is left the stack is reduced from
the top, and what remains is the root.  Every word is put
on the stack once and taken off once, with its head; so there is one root, no cycle, and no two
arcs cross.

The score of an arc is that of the head's tag, the dependent's tag, the side and the distance
(1, 2 to 3, more).  It is learned from a word table with heads (``train_parser``) by counts, as
whole thousandths of a log probability, or given as points (``BASELINE``).  The model has a bounded
number of entries, whatever it is learned from, and is part of the plan; nothing is moved.

Ties: left before right before shift.  Tags that are not in ``UPOS_TAGS`` count as ``X``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions.arrays import let
from verbaloom.operators.lexicon_table import with_word_values
from verbaloom.operators.rules import OTHER_RELATION, RELATION_BY_TAG
from verbaloom.operators.tagger import PARTS, log_parts, tag_number
from verbaloom.schemas import UPOS_TAGS, is_nested, require_columns
from verbaloom.session import checkpoint

TAGS = len(UPOS_TAGS)
SIDES, DISTANCES = 2, 3
ROOT = "root"

# Points of the baseline (fixed values): dependent: head and side of the dependent (< before, > behind).
# An adjacent head has one point more, one that is further than three words one point less; other arcs
# have UNLIKELY points, and those from the tags of NO_HEADS have NEVER.
UNLIKELY, NEVER = -20, -60
BASELINE_ROOTS = {"VERB": 62, "AUX": 45, "NOUN": 25, "PROPN": 20}
NO_HEADS = ["ADP", "CCONJ", "DET", "PART", "PUNCT", "SCONJ"]
BASELINE = {
    "DET": "NOUN< 90, PROPN< 80, ADJ< 20, NUM< 20, PRON< 15, VERB< 10",
    "ADJ": "NOUN< 80, PROPN< 60, NOUN> 50, AUX> 40, VERB> 30, ADJ> 20",
    "NUM": "NOUN< 80, PROPN< 50, NOUN> 45, VERB> 30, NUM> 20",
    "ADP": "NOUN< 85, PROPN< 80, PRON< 60, NUM< 50, VERB> 25, VERB< 20",
    "AUX": "VERB< 80, ADJ< 60, NOUN< 45, PROPN< 40, VERB> 30",
    "PART": "VERB< 80, AUX> 50, VERB> 45, ADJ< 40, NOUN< 30",
    "ADV": "VERB< 60, VERB> 55, ADJ< 50, ADV< 40, AUX> 40, NOUN< 20",
    "PRON": "VERB< 75, AUX< 70, VERB> 60, AUX> 40, NOUN< 30",
    "NOUN": "VERB> 65, VERB< 60, AUX> 55, AUX< 50, NOUN> 45, PROPN> 35, ADP> 15",
    "PROPN": "VERB> 65, VERB< 60, AUX> 55, AUX< 50, NOUN> 50, PROPN> 60, ADP> 15",
    "CCONJ": "VERB< 60, NOUN< 65, PROPN< 60, ADJ< 55, VERB> 20, NOUN> 15",
    "SCONJ": "VERB< 80, AUX< 60, NOUN< 30, VERB> 20",
    "VERB": "VERB> 50, AUX> 40, NOUN> 35, SCONJ> 10, VERB< 5",
    "PUNCT": "VERB> 50, NOUN> 45, PROPN> 40, AUX> 40, ADJ> 30, VERB< 30, NOUN< 25, PROPN< 20",
    "SYM": "NOUN> 40, NOUN< 40, NUM< 50, VERB> 30",
    "INTJ": "VERB< 50, VERB> 40, NOUN< 20",
    "X": "NOUN> 40, VERB> 30, X> 35, NOUN< 20",
}


@dataclass(frozen=True)
class Parser:
    """``scores[arc_number]``, ``roots[tag]`` and ``relations[(head * TAGS + dependent) * SIDES + side]``."""

    scores: list[int]
    roots: list[int]
    relations: list[str]


def arc_number(head: Column | int, dependent: Column | int, side: Column | int, distance: Column | int) -> Column | int:
    """Place of an arc's score: ``side`` is 1 if the dependent is behind the head, ``distance`` 0 to 2."""
    return ((head * TAGS + dependent) * SIDES + side) * DISTANCES + distance


def distance_class(words: Column) -> Column:
    return F.when(words <= 1, 0).when(words <= 3, 1).otherwise(2)


def baseline_parser() -> Parser:
    """The given points, with the relations of the rule annotator."""
    scores = [UNLIKELY] * (TAGS * TAGS * SIDES * DISTANCES)
    of_head = TAGS * SIDES * DISTANCES
    for head in map(UPOS_TAGS.index, NO_HEADS):
        scores[head * of_head : (head + 1) * of_head] = [NEVER] * of_head
    for dependent, heads in BASELINE.items():
        for entry in heads.split(", "):
            head, points = entry.split()
            side = int(head.endswith(">"))
            for distance in range(DISTANCES):
                number = arc_number(UPOS_TAGS.index(head[:-1]), UPOS_TAGS.index(dependent), side, distance)
                scores[number] = int(points) + 1 - distance
    names = [RELATION_BY_TAG.get(UPOS_TAGS[d], OTHER_RELATION) for _ in range(TAGS) for d in range(TAGS) for _ in range(SIDES)]
    return Parser(scores, [BASELINE_ROOTS.get(tag, UNLIKELY) for tag in UPOS_TAGS], names)


def _training_words(words: DataFrame) -> DataFrame:
    if is_nested(words):
        return words.select("words")
    require_columns(words, "sent_ix", "word_id", "UPOS", "HEAD", "DEPREL")
    key = [c for c in ("doc_id", "lang") if c in words.columns]
    item = F.struct(F.col("word_id").cast("int").alias("word_id"), tag_number(F.col("UPOS")).alias("tag"), F.col("HEAD").cast("int").alias("head"), F.col("DEPREL").alias("deprel"))
    return words.groupBy(*key, "sent_ix").agg(F.collect_list(item).alias("words"))


def train_parser(words: DataFrame) -> Parser:
    """A parser from a sentences table or a flat word table (``sent_ix, word_id, UPOS, HEAD, DEPREL``).

    Arcs whose head is not a word of the sentence, or the word itself, are left out; of words with one
    number the one whose tag is first counts as head.  The counts come
    to the driver: at most one row for each arc number and relation of one, of which the most frequent, by
    name if equal, is kept.
    """
    rows = _training_words(words)

    def tag(word: Column) -> Column:
        return tag_number(word["upos"]) if is_nested(words) else word["tag"]

    entries = F.sort_array(F.transform(F.filter("words", lambda w: w["word_id"].isNotNull()), lambda w: F.named_struct(
        F.lit("word"), w["word_id"], F.lit("tag"), tag(w))))
    tags = F.map_from_entries(let(entries, lambda e: F.filter(e, lambda w, i: (i == 0) | (F.get(e, i - 1)["word"] != w["word"]))))
    arcs = rows.select(tags.alias("tag_of"), F.explode("words").alias("w")).select(
        F.try_element_at("tag_of", F.col("w.head")).alias("head"), tag(F.col("w")).alias("dependent"),
        (F.col("w.word_id") > F.col("w.head")).cast("int").alias("side"), F.abs(F.col("w.word_id") - F.col("w.head")).alias("words"),
        F.coalesce("w.deprel", F.lit("_")).alias("relation")).filter("head IS NOT NULL AND words > 0")
    arcs = arcs.withColumn("distance", distance_class(F.col("words")))
    # Written to the shared folder, as sentences are put together for them.
    counts = checkpoint(arcs.groupBy("head", "dependent", "side", "distance", "relation").agg(F.count(F.lit(1)).alias("n")))
    names = counts.groupBy("head", "dependent", "side", "relation").agg(F.sum("n").alias("n"))
    best = names.groupBy("head", "dependent", "side").agg(F.min(F.struct((-F.col("n")).alias("n"), "relation")).alias("best"))
    kinds = SIDES * DISTANCES * TAGS + 1
    # Words without a head in the sentence count as well, so that tags of roots are rarely dependents.
    single = rows.select(F.explode("words").alias("w")).select("w.upos", "w.head") if is_nested(words) else words.select(
        F.col("UPOS").alias("upos"), F.col("HEAD").cast("int").alias("head"))
    of = checkpoint(single.groupBy(tag_number(F.col("upos")).alias("dependent")).agg(
        F.count(F.lit(1)).alias("of"), F.count_if(F.col("head") == 0).alias("n")))
    seen = counts.groupBy("head", "dependent", "side", "distance").agg(F.sum("n").alias("n")).join(F.broadcast(of.select("dependent", "of")), "dependent")  # one row for each tag
    scores, unseen = [0] * (TAGS * TAGS * SIDES * DISTANCES), dict.fromkeys(range(TAGS), math.floor(math.log(1 / kinds) * PARTS + 0.5))
    for row in of.select("dependent", log_parts(1 / (F.col("of") + kinds)).alias("score")).collect():  # one row for each tag
        unseen[row["dependent"]] = row["score"]
    for head in range(TAGS):
        for dependent in range(TAGS):
            for kind in range(SIDES * DISTANCES):
                scores[(head * TAGS + dependent) * SIDES * DISTANCES + kind] = unseen[dependent]
    for row in seen.withColumn("score", log_parts((F.col("n") + 1) / (F.col("of") + kinds))).collect():  # one row for each arc number
        scores[arc_number(row["head"], row["dependent"], row["side"], row["distance"])] = row["score"]
    roots = [unseen[tag] for tag in range(TAGS)]
    for row in of.filter("n > 0").withColumn("score", log_parts((F.col("n") + 1) / (F.col("of") + kinds))).collect():  # one row for each tag
        roots[row["dependent"]] = row["score"]
    relations = [OTHER_RELATION] * (TAGS * TAGS * SIDES)
    for row in best.collect():
        relations[(row["head"] * TAGS + row["dependent"]) * SIDES + row["side"]] = row["best"]["relation"]
    return Parser(scores, roots, relations)


def arcs(tags: Column, parser: Parser) -> Column:
    """``head, kind`` of every word from the words' tag numbers: 0 and -1 for the root, else the place of the relation."""
    scores, roots = parser.scores, parser.roots

    @F.arrow_udf("array<struct<head:int,kind:int>>")
    def found(numbers: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(numbers), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = numbers.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        heads = _heads_of(words, sizes, np.array(scores, np.int64), np.array(roots, np.int64))
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(words)) - starts + 1
        kinds = np.where(heads > 0, (words[starts + np.maximum(heads - 1, 0)] * TAGS + words) * SIDES + (place > heads), -1)
        told = pa.StructArray.from_arrays([pa.array(heads, pa.int32()), pa.array(kinds, pa.int32())], names=["head", "kind"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), told)

    return found(tags)


def heads(tags: Column, parser: Parser) -> Column:
    """The head of every word, 0 for the root, from the words' tag numbers."""
    return arcs(tags, parser)["head"]


def _heads_of(tags: np.ndarray, sizes: np.ndarray, scores: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The heads of the words of many sentences, which take their steps at the same time.

    A sentence's stack has the places of its own words, so memory is that of the words.
    """
    start = np.cumsum(sizes) - sizes
    stack, found = np.zeros(len(tags) + 1, np.int64), np.zeros(len(tags), np.int64)
    height, following = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    of_length = np.argsort(-sizes, kind="stable")
    # Of the longest sentence first: those that still have steps to take are the first ones.
    lengths = -sizes[of_length]
    never = np.iinfo(np.int64).min

    def points(head: np.ndarray, dependent: np.ndarray, side: int) -> np.ndarray:
        far = np.abs(head - dependent)
        kind = np.where(far <= 1, 0, np.where(far <= 3, 1, 2))
        return scores[arc_number(tags[head], tags[dependent], side, kind)]

    for step in range(2 * int(sizes.max(initial=0))):
        s = of_length[: np.searchsorted(lengths, -(step // 2))]
        at, size, word = start[s], height[s], start[s] + following[s]
        more = following[s] < sizes[s]
        word = np.where(more, word, at)  # any word, where there is none
        top, below = stack[at + np.maximum(size - 1, 0)], stack[at + np.maximum(size - 2, 0)]
        top, below = np.where(size > 0, top, at), np.where(size > 1, below, at)
        left, ahead = points(word, top, 0), np.maximum(points(top, word, 1), roots[tags[top]])
        right = np.where(size > 1, points(below, top, 1), never)
        to_left = more & (left >= ahead) & (left >= right)
        to_right = (size > 1) & (~more | (right >= ahead))
        shift = (size == 0) | (more & ~to_left & ~to_right)
        stack[(at + size)[shift]] = word[shift]
        following[s] += shift
        height[s] += np.where(shift, 1, -1)
        head = np.where(to_left, word - at + 1, np.where(to_right, below - at + 1, 0))
        found[top[~shift]] = head[~shift]
    return found


def relation(kind: Column, parser: Parser) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(r) for r in parser.relations]), F.when(kind >= 0, kind)), F.lit(ROOT))


def parse_sentences(sentences: DataFrame, parser: Parser | None = None) -> DataFrame:
    """``sentences`` with heads and relations from their tags."""
    parser = parser or baseline_parser()
    rows = sentences.withColumn("tag_numbers", F.transform("words.upos", tag_number))
    # Unpacked from a one-element array, so that heads are found once and not in every place that reads them.
    rows = rows.select("*", F.explode(F.array(arcs(F.col("tag_numbers"), parser))).alias("found_arcs"))
    rows = with_word_values(rows, {"head": F.col("found_arcs.head"), "deprel": F.transform("found_arcs.kind", lambda kind: relation(kind, parser))})
    return rows.drop("tag_numbers", "found_arcs")


def parse_words(words: DataFrame, parser: Parser) -> DataFrame:
    """A flat word table's ``doc_id, sent_ix, word_id`` with the parser's ``HEAD`` and ``DEPREL``.  Words are
    numbered from 1 by their ``word_id``."""
    require_columns(words, "doc_id", "sent_ix", "word_id", "UPOS")
    items = F.sort_array(F.collect_list(F.struct(F.col("word_id"), tag_number(F.col("UPOS")).alias("tag"))))
    rows = words.groupBy("doc_id", "sent_ix").agg(items.alias("items"))
    zipped = F.arrays_zip(F.col("items.word_id").alias("word_id"), arcs(F.col("items.tag"), parser).alias("arc"))
    found = rows.select("doc_id", "sent_ix", F.explode(zipped).alias("z"))
    return found.select("doc_id", "sent_ix", "z.word_id", F.col("z.arc.head").alias("HEAD"), relation(F.col("z.arc.kind"), parser).alias("DEPREL"))
