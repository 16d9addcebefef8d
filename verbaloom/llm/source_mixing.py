"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of all words by its weight; no source is used more than
``MAX_REPEATS`` times, and what is cut off is shared again by weight.  A document of a source
is then wanted ``target / size of the source`` times: the whole part is taken, the fraction
is rounded so that the sum of fractions is kept.

Pivotal rounding pairs two units with fractions a and b.  If a + b < 1, one of them takes
all of it and the other becomes 0; else one becomes 1 and the other keeps a + b - 1; the
chances are such that each expectation is kept.  Along a sequence the mass that is carried
is the fractional part of the running sum whoever carries it, so each step's chance is known
from running sums alone.  A unit that does not become the carrier is settled on the spot, and
a carrier is settled by the step at which the next one takes over.  That makes a block of
units one window: running sum, a comparison with a number drawn from the row's hash, and a
look ahead for the next carrier.

Blocks have ``BLOCK`` units on average, so a source with a third of all rows is many blocks.
Units are ordered by size within a block, so mass moves between documents of nearly equal
size and the words taken stay near the target.  Each block leaves one residual unit at most;
residuals are the units of the next level, until one block is left per source, whose residual
is drawn.  The level count is the logarithm of the largest source to base ``BLOCK``.

All of it is DataFrame functions.  Numbers are drawn from a hash of the row's id and size, or of its
place in the input where it has no id, so reruns on the same files agree.

Defined cases: null text has size 0 and empty sources have target 0.  A null source is a
source of its own, last in order.  Rows that repeat are units of their own.  Ties in size are
ordered by id.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbaloom.llm.common import WORD, free_name, stored, table, unit_interval

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 4096
#: Fractions nearer to a whole number than this are that number.
NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source: ``source, n_docs, source_size, weight, target``.

    The windows here run over the table of sources, after it is added up.
    """
    totals = sized.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(size).cast("long").alias("source_size"))
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), rank % len(WEIGHTS) + 1)
    totals = totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    # Sources reach their cap in the order of cap per weight, as the common level rises.
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    room = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    totals = totals.withColumn("capped", F.col("cap") * rest <= F.col("weight") * room)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * left.cast("double") / share.cast("double"))
    return totals.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def _round_level(units: DataFrame, p: str, running: Column | None, order: list[str], keys: list[str],
                 level: int, blocks: Column) -> DataFrame:
    """Adds ``{p}_won`` (0, 1, or null for the residual) and ``{p}_mass`` to units with ``{p}_part``."""
    block = F.floor(unit_interval("block", str(level), *[F.col(c) for c in keys]) * blocks)
    units = units.withColumn(f"{p}_block", block).withColumn(
        f"{p}_draw", unit_interval("draw", str(level), *[F.col(c) for c in keys]))
    group = Window.partitionBy(f"{p}_source", f"{p}_block").orderBy(*order)
    part = F.col(f"{p}_part")
    if running is None:
        total = F.sum(part).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        total = running * F.row_number().over(group)
    units = units.withColumn(f"{p}_sum", total)
    # Whether a whole number is passed is read off the same two sums here and at the next unit,
    # so that rounding can't lose or add a copy.
    before = F.coalesce(F.lag(f"{p}_sum").over(group), F.lit(0.0))
    units = units.withColumn(f"{p}_before", before)
    passed = F.floor(f"{p}_sum") > F.floor(f"{p}_before")
    both = F.col(f"{p}_before") - F.floor(f"{p}_before") + part
    units = units.withColumn(f"{p}_over", passed.cast("int")).withColumn(
        f"{p}_took", F.col(f"{p}_draw") < F.when(passed, (1 - part) / (2 - both)).otherwise(F.try_divide(part, both)))
    over = f"PARTITION BY `{p}_source`, `{p}_block` ORDER BY {', '.join(f'`{c}`' for c in order)}"
    following = F.expr(f"lead(IF(`{p}_took`, `{p}_over`, NULL)) IGNORE NULLS OVER ({over})")
    last = F.max(f"{p}_sum").over(Window.partitionBy(f"{p}_source", f"{p}_block"))
    return units.withColumn(f"{p}_won", F.when(F.col(f"{p}_took"), following).otherwise(F.col(f"{p}_over"))).withColumn(
        f"{p}_mass", last - F.floor(last))


def mix(docs: DataFrame, size: str, source: str = "source", identity: str = "doc_id") -> DataFrame:
    """``docs`` with ``source_size, target, copies, taken``; ``size`` names the words of a row.

    Rows keep all their columns while they are rounded, so nothing is joined back by an id.
    """
    p = free_name(docs, "mix")
    targets = stored(source_targets(docs, source, size), "source-targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    # Rows without an id are told apart by their place in the input, so that they are dealt to all blocks.
    place = F.concat(F.col(size).cast("string"), F.lit("#"), F.monotonically_increasing_id().cast("string"))
    units = docs.withColumn(f"{p}_size", F.when(F.col(identity).isNull(), place).otherwise(F.col(size).cast("string")))
    units = units.withColumn(f"{p}_source", F.col(source))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.floor(wanted + NEAR)
    facts = targets.select(
        F.col("source").alias(f"{p}_name"), F.col("n_docs").alias(f"{p}_docs"),
        F.col("source_size").alias(f"{p}_total"), F.col("target").alias(f"{p}_target"),
        near.alias(f"{p}_whole"), F.greatest(wanted - near, F.lit(0.0)).alias(f"{p}_part"))
    units = units.join(facts, units[f"{p}_source"].eqNullSafe(facts[f"{p}_name"]), "inner").drop(f"{p}_name")
    units = units.withColumn(f"{p}_part", F.when(F.col(f"{p}_part") < NEAR, 0.0).otherwise(F.col(f"{p}_part")))
    keys, order = [identity, f"{p}_size"], [size, identity, f"{p}_size"]

    # Every row takes part in the first level, those without a fraction as settled zeros.
    blocks = F.ceil(F.col(f"{p}_docs") / F.lit(BLOCK))
    first = _round_level(units, p, F.col(f"{p}_part"), order, keys, 1, blocks)
    first = first.withColumn(f"{p}_won", F.when(F.col(f"{p}_part") == 0, 0).otherwise(F.col(f"{p}_won")))
    first = stored(first, "first-level")
    settled, open_units = first.filter(F.col(f"{p}_won").isNotNull()), first.filter(F.col(f"{p}_won").isNull())
    done, level, count = [settled], 1, largest
    while count > BLOCK:
        level, count = level + 1, math.ceil(count / BLOCK)
        blocks = F.ceil(blocks / F.lit(BLOCK))
        again = _round_level(open_units.withColumn(f"{p}_part", F.col(f"{p}_mass")), p, None, order, keys, level, blocks)
        again = stored(again, "next-level")
        done.append(again.filter(F.col(f"{p}_won").isNotNull()))
        open_units = again.filter(F.col(f"{p}_won").isNull())
    final = unit_interval("last", *[F.col(c) for c in keys]) < F.col(f"{p}_mass")
    done.append(open_units.withColumn(f"{p}_won", final.cast("int")))

    rounded = done[0]
    for part in done[1:]:
        rounded = rounded.unionByName(part)
    copies = (F.col(f"{p}_whole") + F.col(f"{p}_won")).cast("long")
    results = {"source_size": F.col(f"{p}_total"), "target": F.col(f"{p}_target"), "copies": copies,
               "taken": F.col(size) * copies}
    return rounded.select(*[c for c in docs.columns if c not in results], *[v.alias(k) for k, v in results.items()])


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with the copy's number."""
    size, copy = free_name(docs, "size"), free_name(docs, "copy")
    results = mix(docs.withColumn(size, word_count(F.col("text"))), size)
    numbers = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return results.filter("copies > 0").select(*docs.columns, numbers.alias(copy))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs, "size").select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Holds while no source has more than ``BLOCK`` documents, that is one level of blocks.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, count(*) AS n, sum(size)::BIGINT AS total, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
  FROM d GROUP BY source
), b AS (
  SELECT *, 3 * total AS cap, sum(total) OVER () AS t, sum(w) OVER () AS ws,
    coalesce(sum(3 * total) OVER o, 0) AS c0, coalesce(sum(w) OVER o, 0) AS w0
  FROM s WINDOW o AS (ORDER BY 3 * total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, cap * (ws - w0) <= w * (t - c0) AS capped FROM b
), g AS (
  SELECT source, total, CASE WHEN capped THEN cap::DOUBLE ELSE w::DOUBLE
    * (t - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE / (ws - coalesce(sum(w) FILTER (capped) OVER (), 0))::DOUBLE END AS target
  FROM c
), f AS (
  SELECT source, total, target, floor(CASE WHEN total > 0 THEN target / total ELSE 0 END + 1e-9) AS whole,
    CASE WHEN total > 0 THEN target / total ELSE 0 END AS wanted FROM g
), u AS (
  SELECT d.doc_id, d.size, d.source, total, target, whole, CASE WHEN wanted - whole < 1e-9 THEN 0.0::DOUBLE ELSE wanted - whole END AS p,
    ('0x' || substr(md5('draw|1|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw,
    ('0x' || substr(md5('last|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS last
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS rn FROM u
), k AS (SELECT *, p * rn AS run, p * (rn - 1) AS run_before, max(p * rn) OVER (PARTITION BY source) AS top FROM r
), m AS (
  SELECT *, (floor(run) > floor(run_before))::INT AS is_over, run_before - floor(run_before) + p AS both_parts FROM k
), m2 AS (
  SELECT *, draw < CASE WHEN is_over = 1 THEN (1 - p) / (2 - both_parts) ELSE p / both_parts END AS took FROM m
), z AS (
  SELECT *, CASE WHEN p = 0 THEN 0 WHEN took THEN coalesce(
      lead(CASE WHEN took THEN is_over END IGNORE NULLS) OVER (PARTITION BY source ORDER BY size, doc_id),
      (last < top - floor(top))::INT) ELSE is_over END AS won FROM m2
)
SELECT doc_id, size, total AS source_size, target, (size * (whole + won))::BIGINT AS taken, (whole + won)::BIGINT AS copies FROM z
"""
