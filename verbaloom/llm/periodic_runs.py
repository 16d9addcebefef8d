"""Periodic runs of words, found on a recompressed grammar without suffix arrays.

A run is a longest stretch of consecutive words in which words ``period`` apart are equal,
``period`` being its smallest, that is at least ``max(MIN_WORDS, MIN_EXPONENT * period)`` long.

For a period q the words x with ``word[x] == word[x + q]`` of such a run are a stretch of
``max(MIN_WORDS, MIN_EXPONENT * q) - q`` words at least, so each run holds a multiple of that
number: candidates lie on a grid for each q, about n ln n / 3 of them for n words.  Where the
two words of a candidate are equal, longest common extensions to the right and to the left,
answered by the grammar (``recompression``), give the run's exact ends.  The same stretch found
for several periods has the smallest of them.

The texts of an Arrow batch are joined, with a symbol that occurs once between them, into
strings of ``GROUP_WORDS`` words or one text, so that arrays stay long and memory bounded: about
300 bytes a word of the longest text.  Nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to the empty
string.  Repeated rows count each.  An empty table gives an empty result.  Columns of the input
that bear a result's name are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from verbaloom.llm.common import free_name, table
from verbaloom.llm.recompression import common_extensions, recompressed

MIN_WORDS, MIN_EXPONENT = 6, 4
GROUP_WORDS = 1 << 18
SPACES = r"[\x20\x09-\x0D]+"

FOUND = StructType([
    StructField("n_words", LongType()),
    StructField("runs", ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))),
    StructField("collapsed", StringType()),
])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` members: each member's group, and its number in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _grid(first: np.ndarray, sizes: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods of the candidates with periods from ``low`` to ``2 * low - 1``."""
    most = np.where(sizes >= MIN_WORDS, np.minimum(2 * low - 1, sizes // MIN_EXPONENT), 0)
    text, number = _spread(np.maximum(most - low + 1, 0))
    period = low + number
    step = np.maximum(MIN_WORDS, MIN_EXPONENT * period) - period
    line, number = _spread(-(-(sizes[text] - period) // step))
    return first[text[line]] + number * step[line], period[line]


def runs_of(symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) in ``symbols``, which holds texts of ``sizes`` words from
    ``first`` on, with symbols that occur once before, between and behind them."""
    levels, found, low = None, [], 1
    reach, period_at = np.zeros(len(symbols), np.int64), np.ones(len(symbols), np.int64)
    while len(sizes) and MIN_EXPONENT * low <= sizes.max():
        at, period = _grid(first, sizes, low)
        # A multiple of a known run's period inside that run is the same run again.
        equal = (symbols[at] == symbols[at + period]) & ((reach[at] <= at + period) | (period % period_at[at] != 0))
        at, period = at[equal], period[equal]
        if len(at):
            levels = levels or recompressed(symbols)
            after = common_extensions(levels, at, at + period)
            before = common_extensions(levels, at - 1, at + period - 1, forward=False)
            length = before + after + period
            long = length >= np.maximum(MIN_WORDS, MIN_EXPONENT * period)
            rows = np.unique(np.column_stack([at - before, length, period])[long], axis=0)
            found.append(rows)
            for start, size, q in rows.tolist():
                longer = reach[start : start + size] < start + size
                period_at[start : start + size][longer] = q
                reach[start : start + size][longer] = start + size
        low *= 2
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)  # the smallest period of each stretch
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _groups(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        text = text.as_py()
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _described(texts: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Words of each text, its runs, and the text without the dropped words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for t in texts for w in t]
    codes, known = pd.factorize(flat)
    symbols = len(known) + np.arange(int(first[-1] + sizes[-1]) + 1)
    text, number = _spread(sizes)
    symbols[first[text] + number] = codes
    rows = runs_of(symbols, first, sizes)
    edges = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edges, rows[:, 0] + rows[:, 1], -1)
    stays = np.cumsum(edges[:-1]) == 0
    cuts = np.searchsorted(rows[:, 0], np.append(first, len(symbols)))
    runs, kept = [], []
    for words, begin, one, two in zip(texts, first.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        runs.append(rows[one:two] - [begin, 0, 0])
        if one < two:
            words = [w for w, stay in zip(words, stays[begin : begin + len(words)].tolist(), strict=True) if stay]
        kept.append(b" ".join(words))
    return sizes, runs, kept


@F.arrow_udf(FOUND)
def text_runs(texts: pa.Array) -> pa.Array:
    """``n_words``, ``runs`` by start and period, and the text ``collapsed``: a word is left out
    if a run contains it after the run's first ``period`` words, the others are joined by a space."""
    sizes, runs, kept = [], [], []
    for group in _groups(texts):
        for whole, part in zip((sizes, runs, kept), _described(group), strict=True):
            whole.extend(part)
    rows = np.concatenate([np.empty((0, 3), np.int64), *runs])
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(kept, pa.binary()).cast(pa.string())],
        names=FOUND.names)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period) and ``collapsed``."""
    own = free_name(docs, "runs_found")
    found = docs.withColumn(own, text_runs(F.col(text)))
    results = ["n_words", "runs", "collapsed"]
    through = [c for c in docs.columns if c not in results]
    return found.select(*through, *[F.col(own)[r].alias(r) for r in results])


def run_digest(runs: Column) -> Column:
    """Lower-case hex SHA-256 of the lines ``start,length,period`` of all runs."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.array_join(F.concat(line, F.array(F.lit(""))), "\n"), 256)


def longest_run(runs: Column) -> Column:
    """The run of the greatest length; of several the one with the smallest start, then period."""
    return F.get(F.sort_array(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``docs``, about a tenth of which, drawn by id, get a periodic tail in place of their own.

    With h = crc32(doc_id) and g = h // 10, texts with h % 10 = 0 keep their first a = g % n words;
    the next p = 1 + (n - a) // (3 + g % 8) words then repeat to the end.  A null id has none.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), SPACES), lambda w: w != "")
    chosen = F.when(h % 10 == 0, words)
    own, tail = free_name(docs, "tail_words"), free_name(docs, "tail_shape")
    g, n = F.floor(h / 10), F.size(own)
    a = F.when(n > 0, F.pmod(g, n)).cast("int")
    shape = F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"))
    head, p = F.col(tail)["a"], F.col(tail)["p"]
    block = F.slice(own, head + 1, p)
    rest = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - head) / p).cast("int"))), F.lit(1), n - head)
    text = F.when(F.size(own) > 0, F.concat_ws(" ", F.slice(own, F.lit(1), head), rest)).otherwise(F.col("text"))
    return docs.withColumn(own, chosen).withColumn(tail, shape).withColumn("text", text).drop(own, tail)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, a tenth of which have a planted period."""
    docs = with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs).withColumn("longest", longest_run(F.col("runs")))
    best = F.col("longest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        run_digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
