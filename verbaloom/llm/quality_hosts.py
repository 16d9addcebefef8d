"""Quality rules by host: rule failures are added up by domain, rates are shrunk with an
empirical beta prior, and the host's verdict is joined back to its documents.

Measures of a text (``text_measures``): words, code points in words, symbols, repeated lines,
and words inside repeated eight-word windows.  From them each document fails or passes every
rule of ``RULES``.  For each rule the failures of a host are a binomial draw; the prior of
its rate is fitted to all hosts by moments, so that a host with three documents is judged
mostly by the corpus and one with thousands by itself.

Defined cases: a null or empty text has no words and fails the base rule.  A null host is a
host of its own.  Repeated rows count each.  An empty table gives an empty result.  Columns
of the input that bear the name of a result column are replaced, all others pass through.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verbaloom.llm.common import free_name, in_slices, stored, table

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: A host is rejected when the shrunk failure rate of one rule is above this.
MAX_RATE = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 10_000.0)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Windows get names by doubling: two equal names of halves make an equal name, so equality
    is exact and each step sorts machine words.
    """
    if len(words) <= width:
        return 0
    codes: dict[bytes, int] = {}
    names = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    size = 1
    while size < width:
        step = min(size, width - size)
        pairs = names[:-step] * (int(names.max()) + 1) + names[step:]
        _, names = np.unique(pairs, return_inverse=True)
        size += step
        if int(names.max()) + 1 == len(names):
            return 0
    starts = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:-width][starts] += 1
    edges[width:][starts] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measures_of(text: str | None) -> tuple[int, int, int, int, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    word_bytes = raw.translate(None, SPACE)
    chars = len(text or "") - (len(raw) - len(word_bytes))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    repeats = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, symbols, repeats, repeated_words(words)


def _measured(texts: list[str | None]) -> list[dict[str, int]]:
    return [dict(zip(MEASURES, measures_of(t), strict=True)) for t in texts]


text_measures = in_slices(StructType([StructField(m, LongType()) for m in MEASURES]), _measured)


def rules(m: Column) -> dict[str, Column]:
    """Rule name to whether a document with the measures ``m`` fails it."""
    return {
        "short": m["n_words"] < 20,
        "repeats": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > 3 * m["n_words"],
        "lines": 10 * m["n_dup_lines"] > m["n_words"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    }


BASE_RULES = ["short", "repeats"]
RULES = [*BASE_RULES, "symbols", "lines", "word_length"]


def host_verdicts(measured: DataFrame, host: str, measures: str, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: documents, shrunk failure rate of each rule, and the verdict.

    The counts are partial sums by host before they move, so a host with a third of all
    documents is one row per task.  The prior needs sums over hosts: one row, kept as a
    window without order over the host table.
    """
    failed = rules(F.col(measures))
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(failed[r].cast("long")).alias(f"k_{r}") for r in RULES],
    )
    hosts = stored(hosts, "host-counts")
    n = F.col("n_docs")
    mean = {r: F.col(f"sum_{r}") / F.col("sum_docs") for r in RULES}
    sums = hosts.agg(
        F.sum("n_docs").alias("sum_docs"), F.count(F.lit(1)).alias("n_hosts"),
        *[F.sum(f"k_{r}").alias(f"sum_{r}") for r in RULES],
        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"square_{r}") for r in RULES],
    )
    prior = sums.select(*[
        column for r in RULES
        for column in (mean[r].alias(f"mean_{r}"), _strength(r, mean[r]).alias(f"strength_{r}"))
    ]).first()  # one row of ten numbers
    rate = {
        r: (F.col(f"k_{r}") + F.lit(prior[f"mean_{r}"]) * F.lit(prior[f"strength_{r}"])) / (n + F.lit(prior[f"strength_{r}"]))
        for r in RULES
    }
    verdict = functools.reduce(Column.__or__, [rate[r] > max_rate for r in RULES])
    return hosts.select("host", "n_docs", *[rate[r].alias(f"rate_{r}") for r in RULES],
                        F.coalesce(verdict, F.lit(False)).alias("host_rejected"))


def _strength(rule: str, mean: Column) -> Column:
    """Documents the prior is worth, from the variance between hosts beyond that of sampling."""
    noise = mean * (1 - mean)
    between = F.col(f"square_{rule}") / F.col("sum_docs") - mean * mean - noise * F.col("n_hosts") / F.col("sum_docs")
    low, high = STRENGTH
    return F.when(between <= 0, F.lit(high)).otherwise(
        F.greatest(F.lit(low), F.least(F.lit(high), noise / between - 1)))


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``host_rejected`` and ``kept``.

    The texts are measured twice, once for the hosts and once for the verdicts: that is
    cheaper than storing every text.  Only rejected hosts are joined back; their table is
    stored, so the optimizer broadcasts it only if its true size is below the threshold and
    otherwise joins by shuffle, where large hosts are split.
    """
    own = free_name(docs, "measures")
    measured = docs.withColumn(own, text_measures(F.col(text)))
    verdicts = host_verdicts(measured.select(host, own), host, own, max_rate)
    return with_verdicts(measured, verdicts, host, own)


def with_verdicts(measured: DataFrame, verdicts: DataFrame, host: str, own: str) -> DataFrame:
    rejected_host, mark = free_name(measured, "bad_host"), free_name(measured, "bad_mark")
    rejected = stored(verdicts.filter("host_rejected").select(
        F.col("host").alias(rejected_host), F.lit(True).alias(mark)), "rejected-hosts")
    joined = measured.join(rejected, measured[host].eqNullSafe(rejected[rejected_host]), "left")
    failed = rules(F.col(own))
    base = functools.reduce(Column.__or__, [failed[r] for r in BASE_RULES])
    hidden = {own, rejected_host, mark}
    results = {
        **{m: F.col(own)[m] for m in MEASURES},
        "base_failed": base,
        "host_rejected": F.coalesce(F.col(mark), F.lit(False)),
        "kept": ~(base | F.coalesce(F.col(mark), F.lit(False))),
    }
    through = [c for c in measured.columns if c not in hidden and c not in results]
    return joined.select(*through, *[v.alias(k) for k, v in results.items()])


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that their own rules and their host's verdict let pass."""
    own = free_name(docs, "measures")
    measured = docs.withColumn(own, text_measures(F.col("text")))
    verdicts = host_verdicts(measured.select("source", own), "source", own)
    judged = with_verdicts(measured.select(*docs.columns, own), verdicts, "source", own)
    return judged.filter("kept").select(*docs.columns)


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, its host's shrunk rates of failure (to six digits), and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = stored(docs.select("doc_id", "source", text_measures(F.col("text")).alias("measures")), "measures")
    verdicts = host_verdicts(measured, "source", "measures")
    judged = with_verdicts(measured, verdicts, "source", "measures")
    rates = verdicts.select(F.col("host").alias("rated"), *[F.round(f"rate_{r}", 6).alias(f"rate_{r}") for r in RULES])
    rated = judged.join(rates, judged["source"].eqNullSafe(rates["rated"]))
    return rated.select("doc_id", *MEASURES, "base_failed", "kept", *[f"rate_{r}" for r in RULES])


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), w AS (
  SELECT rid, i, list_aggregate(words[i : i + 7], 'string_agg', ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) > 8)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT rid, unnest(range(i, i + 8)) AS p
    FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM w) WHERE c > 1
  ) GROUP BY rid
), lines AS (
  SELECT rid, sum(c - 1) AS n_dup_lines FROM (
    SELECT rid, l, count(*) AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid, l
  ) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)
), f AS (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'word_length']) AS rule,
         unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > 3 * n_words,
                 10 * n_dup_lines > n_words, word_chars < 2 * n_words OR word_chars > 20 * n_words]) AS bad
  FROM m
), h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS k FROM f GROUP BY source, rule
), g AS (
  SELECT rule, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS square, count(*) / sum(n) AS hosts FROM h GROUP BY rule
), p AS (
  SELECT rule, mean, mean * (1 - mean) AS noise,
         square - mean * mean - mean * (1 - mean) * hosts AS between_hosts FROM g
), s AS (
  SELECT rule, mean, CASE WHEN between_hosts <= 0 THEN 10000.0
         ELSE greatest(1.0, least(10000.0, noise / between_hosts - 1)) END AS strength FROM p
), v AS (
  SELECT source, bool_or(rate > 0.5) AS host_rejected,
         max(rate) FILTER (rule = 'short') AS short, max(rate) FILTER (rule = 'repeats') AS repeats,
         max(rate) FILTER (rule = 'symbols') AS symbols, max(rate) FILTER (rule = 'lines') AS lines,
         max(rate) FILTER (rule = 'word_length') AS word_length
  FROM (SELECT source, rule, (k + mean * strength) / (n + strength) AS rate FROM h JOIN s USING (rule)) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR host_rejected) AS kept,
       round(short, 6) AS rate_short, round(repeats, 6) AS rate_repeats, round(symbols, 6) AS rate_symbols,
       round(v.lines, 6) AS rate_lines, round(word_length, 6) AS rate_word_length
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""
