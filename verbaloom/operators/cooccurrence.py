"""Lemma co-occurrence within a window of tokens.

Every pair of positions at most ``window`` apart is met from both ends, so it adds two to
its unordered pair of terms.  Distance counts the tokens that are left after exclusion.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbaloom.functions.text import value_or
from verbaloom.operators.filters import term, without_terms
from verbaloom.operators.frequencies import check_top
from verbaloom.operators.heaviest import CELLS, heaviest
from verbaloom.operators.views import token_view
from verbaloom.operators.vocabulary import looked_up
from verbaloom.operators.windows import counted_pairs, heavy_pairs, near_pairs
from verbaloom.schemas import is_nested, require_columns
from verbaloom.session import checkpoint, stored

# Positions that one window task takes at a time, and rows of a table of offsets as well.
BLOCK_BITS = 16
# Positions of a block whose terms are one row, unless the window is longer.
ROW_BITS = 12
# Pairs of blocks are counted by running sums from this window on; below, at each distance.
WIDE = 64
# Of so many most frequent pairs at most, only pairs that can be among them are moved, if rows are ordered first.
FEW = 1000


def cooccurrences(
    df: DataFrame,
    window: int = 2,
    *,
    by_sent: bool = True,
    lowercase: bool = True,
    exclude: Iterable[str] | DataFrame | None = None,
    use_lemma: bool = True,
    top: int | None = 200,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """``left, right, count`` with ``left <= right``, the most frequent pairs first.

    On the sentences table, pairs inside a sentence are formed in the sentence's own row
    and only counted pairs move; with ``by_sent=False`` the ends of each sentence move as
    well, as one row, to meet the next one's.  A flat token table has to be put in reading order: see
    ``_ordered_pairs``.  With an ``exclude`` that is itself a table, a sentences table is taken from the text
    once and its terms are stored (``_listed_pairs``), or put in order with ``by_sent=False``.  A
    missing term is ``_`` either way.  No ``top``, or 0, means all.
    """
    if window < 0:
        raise ValueError("the window must not be negative")
    if block_bits < 1:
        raise ValueError("a block needs two positions at least")
    check_top(top)
    listed = exclude if exclude is None or isinstance(exclude, DataFrame) else set(exclude)
    if is_nested(df) and not isinstance(listed, DataFrame):
        rows = _sequences(df, lowercase, listed, use_lemma)
        few = not by_sent and window and window < WIDE and top and top <= FEW
        rows = stored(rows, "terms") if few else rows
        inside = rows.select(F.col("seq").alias("terms"), F.size("seq").alias("firsts"))
        if few:
            pairs = heavy_pairs([inside, stored(_blocks_across(_sentence_ends(rows, window), window, block_bits), "blocks")], window, top)
        else:
            pairs = near_pairs(inside, window)
            if not by_sent and window:
                blocks = _blocks_across(_sentence_ends(rows, window), window, block_bits)
                pairs = pairs.unionByName(counted_pairs(blocks, window) if window >= WIDE else near_pairs(blocks, window))
    elif is_nested(df) and by_sent and window:
        pairs = _listed_pairs(df, window, block_bits, listed, lowercase, use_lemma)
    else:
        if is_nested(df):
            df = token_view(df, ["sent_ix", "tok_ix", "FORM", "LEMMA"])
        require_columns(df, "sent_ix", "tok_ix", "FORM", "LEMMA")
        doc = F.col("doc_id") if "doc_id" in df.columns else F.lit(0).alias("doc_id")
        terms = df.select(doc, "sent_ix", "tok_ix", term(use_lemma, lowercase).alias("term"))
        terms = without_terms(terms, F.col("term"), listed, lowercase)
        if by_sent:
            terms = terms.where(F.col("sent_ix").isNotNull())
        pairs = _ordered_pairs(terms, window, block_bits, by_sent, top)
    counted = pairs.groupBy(
        F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")
    ).agg((F.sum("rows") * 2).alias("count"))
    ordered = counted.orderBy(F.desc("count"), "left", "right")
    return ordered.limit(top) if top else ordered


def heaviest_cooccurrences(
    sentences: DataFrame, window: int = 2, top: int = 200, *, lowercase: bool = True,
    exclude: Iterable[str] | None = None, use_lemma: bool = True, cells: int = CELLS,
) -> DataFrame:
    """``cooccurrences`` of a sentences table, found without moving every pair (``heaviest``).

    It forms the pairs three times instead of once, so it pays where the pairs that differ are many
    times the pairs that are wanted, and moving them is what costs.
    """
    if window < 0:
        raise ValueError("the window must not be negative")
    rows = _sequences(sentences, lowercase, set(exclude) if exclude else None, use_lemma)
    pairs = _row_pairs(rows, window).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))
    return heaviest(pairs, ["left", "right"], top, cells).withColumn("count", F.col("count") * 2)


def _sequences(
    sentences: DataFrame, lowercase: bool, exclude: set[str] | None, use_lemma: bool
) -> DataFrame:
    """``doc_id, sent_ix, seq, n``: the terms of each sentence that are left, in order, and their number."""
    part, value = F.col("words.part"), F.col("words.lemma" if use_lemma else "words.tok_form")
    zipped = F.arrays_zip(part.alias("part"), value.alias("value"))
    one_each = F.coalesce(F.array_max(part), F.lit(1)) == 1
    seq = F.when(one_each, value).otherwise(F.filter(zipped, lambda w: w["part"] == 1)["value"])
    n = F.when(one_each, F.size(part)).otherwise(F.size(F.filter(part, lambda p: p == 1)))
    seq = F.transform(seq, lambda v: F.coalesce(F.nullif(v, F.lit("")), F.lit("_")))
    if lowercase:
        seq = F.transform(seq, F.lower)
    if exclude:
        words = sorted({word.lower() if lowercase else word for word in exclude})
        seq = F.filter(seq, lambda v: ~v.isin(words))
        n = F.size(seq)
    return sentences.select("doc_id", "sent_ix", seq.alias("seq"), n.alias("n"))


def _listed_pairs(
    df: DataFrame, window: int, block_bits: int, listed: DataFrame, lowercase: bool, use_lemma: bool
) -> DataFrame:
    """``a, b, rows`` inside sentences, without the terms that a table lists.

    Listed terms of the corpus are told in the sentences' rows (``vocabulary``).  Sentences that share
    their number, or whose tokens are not in order, are put in order as flat rows.
    """
    part, tok_ix, value = F.col("words.part"), F.col("words.tok_ix"), F.col("words.lemma" if use_lemma else "words.tok_form")
    first = F.filter(F.arrays_zip(part.alias("part"), value.alias("value"), tok_ix.alias("tok_ix")), lambda w: w["part"] == 1)
    # Nothing but ones; a part that is missing makes the second condition null.
    one_each = (F.array_max(part) == 1) & ~F.array_contains(part, F.lit(2)) & (F.array_min(part) == 1)
    terms = F.transform(F.when(one_each, value).otherwise(first["value"]), lambda v: F.lower(value_or(v)) if lowercase else value_or(v))
    tok_ix = F.when(one_each, tok_ix).otherwise(first["tok_ix"])
    doc = F.col("doc_id") if "doc_id" in df.columns else F.lit(0).alias("doc_id")
    rows = stored(df.where(F.col("sent_ix").isNotNull()).select(doc, "sent_ix", tok_ix.alias("tok_ix"), terms.alias("terms")), "terms")
    key = ["doc_id", "sent_ix"]
    in_order = F.col("tok_ix") == F.array_sort(F.array_distinct("tok_ix"))
    odd = checkpoint(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce(in_order, F.lit(False))).alias("in_order"))
                     .where("copies > 1 OR NOT in_order").select(*key))

    excluded = F.col(listed.columns[0])
    table = listed.select((F.lower(excluded) if lowercase else excluded).alias("key")).where("key IS NOT NULL").distinct()
    told = looked_up(rows, "terms", table.withColumn("value", F.lit(True)), "listed", key)
    left = F.filter(F.arrays_zip("tok_ix", "terms", "listed"), lambda w: w["listed"].isNull())
    told = told.select(*key, left.alias("left"))
    same = [told[name].eqNullSafe(odd[name]) for name in key]
    alone, others = (told, None) if odd.isEmpty() else (told.join(odd, same, "left_anti"), told.join(odd, same, "left_semi"))
    pairs = near_pairs(alone.select(F.col("left.terms").alias("terms"), F.coalesce(F.size("left"), F.lit(0)).alias("firsts")), window)
    if others is not None:
        flat = others.select(*key, F.explode("left").alias("w")).select(*key, F.col("w.tok_ix").alias("tok_ix"), F.col("w.terms").alias("term"))
        pairs = pairs.unionByName(_ordered_pairs(flat, window, block_bits, True))
    return pairs


def _row_pairs(rows: DataFrame, window: int) -> DataFrame:
    """Pairs ``a, b`` from arrays: the sequence beside itself, shifted by each distance."""
    farthest = F.least(F.lit(window), F.size("seq") - 1)
    # A row per distance, so that a long sentence and a wide window never build one
    # array of all their pairs.
    shifted = rows.select("seq", F.explode(_up_to(farthest)).alias("d"))
    n = F.size("seq") - F.col("d")
    return shifted.select(F.explode(F.arrays_zip(
        F.slice("seq", F.lit(1), n).alias("a"), F.slice("seq", F.col("d") + 1, n).alias("b"),
    )).alias("pair")).select("pair.a", "pair.b")


def _sentence_ends(rows: DataFrame, window: int) -> DataFrame:
    """The terms that can be near another sentence: ``window`` at either end of their own.

    A pair across sentences has only such terms between its two, so their distance among
    these rows is their distance in the document.
    """
    n, seq = F.size("seq"), F.col("seq")
    places = F.when(n <= 2 * window, F.sequence(F.lit(1), n)).otherwise(
        F.concat(F.sequence(F.lit(1), F.lit(window)), F.sequence(n - (window - 1), n)))
    ends = F.when(n <= 2 * window, seq).otherwise(F.concat(F.slice(seq, 1, window), F.slice(seq, n - (window - 1), F.lit(window))))
    return rows.where("n > 0").select("doc_id", "sent_ix", F.least("n", F.lit(2 * window)).alias("n"), places.alias("places"), ends.alias("terms"))


def _blocks_across(ends: DataFrame, window: int, block_bits: int) -> DataFrame:
    """``terms, firsts, apart``: blocks whose pairs are those of two sentences of a document, from the ends of its sentences.

    As in ``_ordered_pairs``, but a sentence is one row of its terms: positions are running sums over
    sentences, and what stands in a block goes there as a whole.  Rows that share their sentence are taken
    apart into terms, which are put in order by their place and term.
    """
    bits = max(min(block_bits, ROW_BITS), (window - 1).bit_length())
    key = ["doc_id", "sent_ix"]
    named = ends.select(F.struct(*key).alias("place"), "places", "terms")
    sentences = ends.groupBy(*key).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("copies"))
    sentences = _starts(sentences, block_bits, "sent_ix").select(F.struct(*key).alias("start_of"), "copies", "start")
    joined = named.join(sentences, F.col("place") == F.col("start_of"))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("terms").alias("terms")))
    singles = F.transform(F.arrays_zip(F.col("places").alias("at"), F.col("terms").alias("term")), lambda z: F.struct(
        z["at"].alias("at"), F.array(z["term"]).alias("terms")))
    pieces = joined.select("place", "start", F.explode(F.when(F.col("copies") == 1, whole).otherwise(singles)).alias("piece"))
    in_place = W.partitionBy("place").orderBy("piece.at", "piece.terms")
    pieces = pieces.select("place.doc_id", "place.sent_ix", "piece.terms", (F.col("start") + F.row_number().over(in_place)).alias("pos"))

    n = F.size("terms")
    own, last = F.shiftright("pos", bits), F.shiftright(F.col("pos") + n - 1, bits)
    near = (F.pmod("pos", F.lit(1 << bits)) < window) & (own > 0)
    copied = pieces.withColumn("block", F.explode(F.sequence(F.when(near, own - 1).otherwise(own), last)))
    # What stands before the block is cut off, as a block's firsts are counted from its first term.
    before = F.greatest(F.shiftleft("block", bits) - F.col("pos"), F.lit(0)).cast("int")
    cut = copied.withColumn("before", before).select(
        "doc_id", "block", (F.col("pos") + F.col("before")).alias("pos"), "sent_ix", F.slice("terms", F.col("before") + 1, n - F.col("before")).alias("terms"))
    firsts = F.least(F.greatest(F.shiftleft(F.col("block") + 1, bits) - F.col("pos"), F.lit(0)), n)
    blocks = cut.groupBy("doc_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "terms", "sent_ix"))).alias("seq"), F.sum(firsts).cast("int").alias("firsts"))
    labels = F.transform("seq", lambda s: F.array_repeat(s["sent_ix"], F.size(s["terms"])))
    return blocks.select(F.flatten("seq.terms").alias("terms"), "firsts", F.flatten(labels).alias("apart"))


def _up_to(last: Column) -> Column:
    """``[1 .. last]``, empty when ``last`` is below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last))


def _ordered_pairs(
    terms: DataFrame, window: int, block_bits: int, by_sent: bool, top: int | None = None
) -> DataFrame:
    """``a, b, rows``: pairs from the reading order of flat rows, or those that can be among the ``top`` most frequent.

    Every row gets its position in its document or sentence, and positions are cut into
    blocks of fixed length, not shorter than the window.  A row also goes to the block before its
    own if it is within ``window`` of that block's end; a pair counts in the block of its first row.
    A block is one row, whose terms stand beside themselves, shifted by each distance.  So
    memory is that of a block's terms, whatever the window, the plan is the same for all
    sizes, and one document or sentence with most of the rows is many blocks.  Pairs are
    counted before they are rows (``windows``).
    """
    if window == 0:
        return terms.select(F.col("term").alias("a"), F.col("term").alias("b"), F.lit(0).cast("long").alias("rows")).where(F.lit(False))
    bits = max(min(block_bits, ROW_BITS), (window - 1).bit_length())
    own = F.shiftright("pos", bits)
    near = F.pmod("pos", F.lit(1 << bits)) < window
    blocks = F.when(near & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))

    def in_blocks(placed: DataFrame, *group: str) -> DataFrame:
        copied = placed.withColumn("own", own).withColumn("block", F.explode(blocks))
        return copied.groupBy(*group, "block").agg(
            F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("seq"),
            F.count(F.when(F.col("own") == F.col("block"), 1)).cast("int").alias("firsts"),
        ).select("seq", "firsts")

    if by_sent:
        # A sentence of one stretch is where its blocks are formed; only longer ones move again.
        rows = in_blocks(_positions(terms, block_bits, True, F.col("runs") == 1), "place").unionByName(
            in_blocks(_positions(terms, block_bits, True, F.col("runs") > 1), "doc_id", "sent_ix"))
    else:
        rows = in_blocks(_positions(terms, block_bits, False), "doc_id")
    rows = rows.select(F.col("seq.term").alias("terms"), "firsts")
    if top and top <= FEW and window < WIDE:
        return heavy_pairs([stored(rows, "blocks")], window, top)
    return counted_pairs(rows, window) if window >= WIDE else near_pairs(rows, window)


def _positions(
    terms: DataFrame, block_bits: int, by_sent: bool, of: Column | None = None
) -> DataFrame:
    """``terms`` with ``pos``, counting from 1 in reading order in the sentence or document.

    ``of`` picks stretches, by the number of ``runs`` of their sentence.  Stretches are named by a struct,
    whose missing parts are equal, so that the rows stay where they were numbered.

    Rows are numbered in stretches of 2 ** ``block_bits`` token numbers of one sentence; where
    a stretch begins is a running sum over the table of stretches, by sentence and, for
    documents, by groups of sentences and over these groups.  Rows without a token or
    sentence number come last and are one stretch each.
    """
    stretch = terms.withColumn("run", F.shiftright(F.col("tok_ix").cast("long"), block_bits))
    place = ["doc_id", "sent_ix", "run"]
    in_run = W.partitionBy("place").orderBy(F.asc_nulls_last("tok_ix"), F.asc("term"))
    numbered = stretch.select(F.struct(*place).alias("place"), "tok_ix", "term").withColumn("in_run", F.row_number().over(in_run))
    runs = stretch.groupBy(*place).agg(F.count(F.lit(1)).alias("rows"))

    if by_sent:
        in_sentence = F.count(F.lit(1)).over(W.partitionBy("doc_id", "sent_ix"))
        starts = runs.withColumn("start", _before(["doc_id", "sent_ix"], "run")).withColumn("runs", in_sentence)
    else:
        starts = _starts(runs, block_bits, "sent_ix", "run")
    starts = starts if of is None else starts.where(of)
    starts = starts.select(F.struct(*place).alias("start_of"), "start")
    joined = numbered.join(starts, F.col("place") == F.col("start_of"))
    return joined.select("place", "place.doc_id", "place.sent_ix", "term", (F.col("start") + F.col("in_run")).alias("pos"))


def _starts(runs: DataFrame, block_bits: int, *order: str) -> DataFrame:
    """``runs`` with ``start``: the ``rows`` of those before it in its document."""
    runs = runs.withColumn("part", F.shiftright(F.col("sent_ix").cast("long"), block_bits))
    inside = runs.withColumn("start", _before(["doc_id", "part"], *order))
    parts = runs.groupBy("doc_id", "part").agg(F.sum("rows").alias("rows"))
    parts = parts.select(F.col("doc_id").alias("p_doc"), F.col("part").alias("p_part"), _before(["doc_id"], "part").alias("base"))
    same = F.col("doc_id").eqNullSafe(F.col("p_doc")) & F.col("part").eqNullSafe(F.col("p_part"))
    return inside.join(parts, same).withColumn("start", F.col("start") + F.col("base"))


def _before(keys: list[str], *order: str) -> Column:
    """The ``rows`` before a row, by ``order``, of those that agree in ``keys``."""
    ordered = W.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    rows = F.sum("rows").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(rows, F.lit(0))
