"""Part-of-speech tags by a hidden Markov model.

*Training* counts tag pairs, tags of forms and tags of word endings in any token table, with
partial sums; log probabilities become whole thousandths, so that sums are exact.

*Decoding* is the Viterbi recurrence inside a sentence's row: for each word the best path to each of its
candidate tags; the sentences of a batch go from word to word together.  Candidates come from the forms table or, for forms it lacks, from
the longest ending that is known; they are found once for each distinct form and brought back to the
words (``vocabulary``).  Decoding itself moves nothing.  A sentence is one row.

Ties: of equal scores the path whose previous (at the end, last) tag is first in ``UPOS_TAGS`` wins.
Tags that are not in that list count as ``X``.  In a language without training every word is ``X``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbaloom.operators.lexicon_table import form_keys, with_word_values
from verbaloom.operators.vocabulary import JOINT, distinct_keys, lang_key, looked_up
from verbaloom.schemas import UPOS_TAGS, is_nested, require_columns
from verbaloom.session import checkpoint

#: Letters of the longest ending that is counted; the empty one is counted as well.
ENDING = 4
#: Scores are log probabilities in these parts, rounded.
PARTS = 1000
BORDER = len(UPOS_TAGS)  # the tag before the first word and after the last
STATES = BORDER + 1
CANDIDATES = "array<struct<tag:int,score:bigint>>"


@dataclass(frozen=True)
class Tagger:
    """``forms`` and ``endings`` have ``key, value``: a language and a form or ending, and its
    candidate tags by number.  ``steps`` is the score of tag b after tag a at a * STATES + b."""

    forms: DataFrame
    endings: DataFrame
    steps: list[int]


def sentence_rows(tokens: DataFrame) -> DataFrame:
    """``doc_id, lang, sent_ix, items``: a flat table's tokens in order, one sentence a row.

    A missing ``lang`` is null; a table without ``doc_id`` is one document.
    """
    require_columns(tokens, "sent_ix", "tok_ix", "FORM")
    fill = {"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "UPOS": F.lit(None).cast("string")}
    tokens = tokens.withColumns({c: v for c, v in fill.items() if c not in tokens.columns})
    items = F.sort_array(F.collect_list(F.struct("tok_ix", "FORM", "UPOS")))
    return tokens.groupBy("doc_id", "lang", "sent_ix").agg(items.alias("items"))


def _training_rows(tokens: DataFrame) -> DataFrame:
    if is_nested(tokens):
        return tokens.select("lang", F.col("words.form").alias("forms"), F.col("words.upos").alias("tags"))
    return sentence_rows(tokens).select("lang", F.col("items.FORM").alias("forms"), F.col("items.UPOS").alias("tags"))


def tag_number(tag: Column) -> Column:
    """Place of a tag in ``UPOS_TAGS``, of other tags that of ``X``."""
    names = F.array(*[F.lit(t) for t in UPOS_TAGS])
    at = F.array_position(names, F.coalesce(tag, F.lit("_"))) - 1
    return F.when(at >= 0, at).otherwise(F.lit(UPOS_TAGS.index("X"))).cast("int")


def log_parts(share: Column) -> Column:
    return F.floor(F.log(share) * PARTS + 0.5).cast("long")


def endings_of(form: Column) -> Column:
    """The endings of a form, the longest first, the empty one last."""
    return F.transform(F.sequence(F.least(F.length(form), F.lit(ENDING)), F.lit(0), F.lit(-1)), lambda k: F.right(form, k))


def train_tagger(tokens: DataFrame) -> Tagger:
    """A tagger from a sentences table or a flat token table (``sent_ix, tok_ix, FORM, UPOS``; ``doc_id``
    and ``lang`` if there are any).  The counts are written to the shared folder."""
    rows = _training_rows(tokens).select("lang", "forms", F.transform("tags", tag_number).alias("tags"))
    single = rows.select("lang", F.explode(F.arrays_zip(F.col("forms").alias("form"), F.col("tags").alias("tag"))).alias("w")).select("lang", "w.*")
    if not is_nested(tokens):  # forms are counted where their tokens are
        lang = F.col("lang") if "lang" in tokens.columns else F.lit(None).cast("string")
        upos = F.col("UPOS") if "UPOS" in tokens.columns else F.lit(None).cast("string")
        single = tokens.select(lang.alias("lang"), F.col("FORM").alias("form"), tag_number(upos).alias("tag"))
    border = F.array(F.lit(BORDER))
    pairs = F.arrays_zip(F.concat(border, "tags").alias("a"), F.concat("tags", border).alias("b"))
    seen = checkpoint(rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")))
    seen = seen.withColumn("of", F.sum("n").over(Window.partitionBy("a"))).withColumn("share", (F.col("n") + 1) / (F.col("of") + STATES))
    unseen = seen.select("a", "of").distinct().select("a", log_parts(1 / (F.col("of") + STATES)).alias("score"))
    steps = [0] * (STATES * STATES)
    for row in unseen.collect():  # one row for each tag
        steps[row["a"] * STATES : (row["a"] + 1) * STATES] = [row["score"]] * STATES
    for row in seen.select("a", "b", log_parts(F.col("share")).alias("score")).collect():  # at most STATES squared
        steps[row["a"] * STATES + row["b"]] = row["score"]

    words = single.select("lang", F.lower(F.coalesce("form", F.lit("_"))).alias("form"), "tag")
    counts = checkpoint(words.groupBy("lang", "form", "tag").agg(F.count(F.lit(1)).alias("n")))
    of_tag = counts.groupBy("tag").agg(F.sum("n").alias("of"))
    known = counts.join(F.broadcast(of_tag), "tag").withColumn("key", lang_key(F.col("lang"), F.col("form")))  # one row for each tag
    forms = _candidates(known.select("key", "tag", log_parts(F.col("n") / F.col("of")).alias("score")))
    # Each form counts once for an ending: what is not known is a rare word.
    types = counts.withColumn("ending", F.explode(endings_of(F.col("form")))).groupBy("lang", "ending", "tag").agg(F.count(F.lit(1)).alias("n"))
    types = types.withColumn("key", lang_key(F.col("lang"), F.col("ending")))
    sizes = types.groupBy("key").agg(F.sum("n").alias("size"))
    scored = types.join(sizes, "key").join(F.broadcast(_shares(counts)), "tag")  # one row for each tag
    score = log_parts(F.col("n") / F.col("size") / F.col("prior"))
    return Tagger(forms, _candidates(scored.select("key", "tag", score.alias("score"))), steps)


def _shares(counts: DataFrame) -> DataFrame:
    """``tag, prior``: the share of different forms that a tag has."""
    sizes = counts.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1))).scalar()
    return sizes.select("tag", (F.col("n") / total).alias("prior"))


def _candidates(scored: DataFrame) -> DataFrame:
    value = F.sort_array(F.collect_list(F.struct("tag", "score"))).cast(CANDIDATES)
    return checkpoint(scored.groupBy("key").agg(value.alias("value")))


def candidates(vocabulary: DataFrame, tagger: Tagger) -> DataFrame:
    """``key, value`` for every ``key`` of a vocabulary: the form's candidate tags, else those of its longest known
    ending."""
    vocabulary = vocabulary.select("key")
    known = vocabulary.join(tagger.forms, "key")
    lang, form = F.split_part("key", F.lit(JOINT), F.lit(1)), F.split_part("key", F.lit(JOINT), F.lit(2))
    unknown = vocabulary.join(tagger.forms.select("key"), "key", "left_anti").withColumn("lang_of", lang)
    unknown = unknown.withColumn("endings", endings_of(form))
    unknown = unknown.select("key", F.transform("endings", lambda e: lang_key(F.col("lang_of"), e)).alias("endings"))
    found = looked_up(unknown, "endings", tagger.endings, "values", ["key"])
    first = F.get(F.filter("values", lambda v: v.isNotNull()), F.lit(0))
    return known.unionByName(found.select("key", first.alias("value")).filter("value IS NOT NULL"))


def viterbi(choices: Column, steps: list[int]) -> Column:
    """The best tags for an array of candidate lists; null entries count as ``X``."""
    @F.arrow_udf("array<string>")
    def best(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        listed = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        entries = words.flatten()
        tags = _best_tags(sizes, np.repeat(np.arange(len(words)), listed), entries.field(0).to_numpy(zero_copy_only=False),
                          entries.field(1).to_numpy(zero_copy_only=False), words.is_null().to_numpy(zero_copy_only=False),
                          np.array(steps, np.int64).reshape(STATES, STATES))
        named = pa.array(UPOS_TAGS).take(pa.array(tags))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), named)
    return best(choices)


def _best_tags(sizes: np.ndarray, word_of: np.ndarray, tag: np.ndarray, score: np.ndarray, unknown: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The tags of the words of many sentences, which go from word to word at the same time."""
    n, never = int(sizes.sum()), np.iinfo(np.int64).min // 4
    own = np.full((n, BORDER), never, np.int64)
    own[word_of, tag] = score
    own[np.flatnonzero(unknown), UPOS_TAGS.index("X")] = 0
    start = np.cumsum(sizes) - sizes
    of_length = np.argsort(-sizes, kind="stable")  # those that still have words are the first ones
    lengths = -sizes[of_length]
    came, path = np.zeros((n, BORDER), np.int8), np.zeros(n, np.int64)
    scores = np.full((len(sizes), BORDER), never, np.int64)
    longest = int(sizes.max(initial=0))
    for i in range(longest):
        s = of_length[: np.searchsorted(lengths, -i)]
        word = start[s] + i
        if i == 0:
            best = np.broadcast_to(steps[BORDER, :BORDER], (len(s), BORDER))
        else:
            # Tag by tag of the word before, so that of equal ones the first stays.
            best, back = np.full((len(s), BORDER), 2 * never, np.int64), np.zeros((len(s), BORDER), np.int8)
            for a in range(BORDER):
                with_a = scores[s, a][:, None] + steps[a, :BORDER]
                better = with_a > best
                best, back = np.where(better, with_a, best), np.where(better, np.int8(a), back)
            came[word] = back
        scores[s] = np.where(own[word] > never, best + own[word], never)
    last = np.argmax(scores + steps[:BORDER, BORDER], axis=1)
    for i in range(longest - 1, -1, -1):
        s = of_length[: np.searchsorted(lengths, -i)]
        path[start[s] + i] = last[s]
        last[s] = came[start[s] + i, last[s]]
    return path


def tag_sentences(sentences: DataFrame, tagger: Tagger) -> DataFrame:
    """``sentences`` with the tagger's tags."""
    counted = checkpoint(distinct_keys(sentences, form_keys()))
    found = looked_up(sentences, form_keys(), candidates(counted, tagger), "choices", ["doc_id", "sent_ix"], counted)
    return with_word_values(_with_tags(found, tagger), {"upos": F.col("found_tags")}).drop("choices", "found_tags")


def _with_tags(rows: DataFrame, tagger: Tagger) -> DataFrame:
    """Unpacked from a one-element array, so that tags are found once and not in every place that reads them."""
    return rows.select("*", F.explode(F.array(viterbi(F.col("choices"), tagger.steps))).alias("found_tags"))


def tag_tokens(tokens: DataFrame, tagger: Tagger) -> DataFrame:
    """A flat token table's ``doc_id, lang, sent_ix, tok_ix, FORM`` with the tagger's ``UPOS``."""
    rows = sentence_rows(tokens)

    def key(form: Column) -> Column:
        return lang_key(F.col("lang"), F.lower(F.coalesce(form, F.lit("_"))))

    # Distinct forms are found where the tokens are; sentences are put together once.
    single = tokens if "lang" in tokens.columns else tokens.withColumn("lang", F.lit(None).cast("string"))
    counted = checkpoint(single.groupBy(key(F.col("FORM")).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    found = looked_up(rows, F.transform("items.FORM", key), candidates(counted, tagger), "choices", ["doc_id", "lang", "sent_ix"], counted)
    zipped = F.arrays_zip(F.col("items").alias("item"), F.col("found_tags").alias("tag"))
    out = _with_tags(found, tagger).select("doc_id", "lang", "sent_ix", F.explode(zipped).alias("z"))
    return out.select("doc_id", "lang", "sent_ix", F.col("z.item.tok_ix").alias("tok_ix"),
                      F.col("z.item.FORM").alias("FORM"), F.col("z.tag").alias("UPOS"))
