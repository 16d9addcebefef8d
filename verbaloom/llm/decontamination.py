"""Benchmark decontamination with a hash set of the benchmark's word windows.

A text's words are its runs of ASCII letters, digits and all characters beyond ASCII, with
A-Z in lower case.  Each item has all windows of ``WIDTH`` consecutive words, or one window
of all its words if it has fewer.  Documents are scanned in three steps, all of them DataFrame
functions: every document window is reduced to a 64-bit hash and looked up in the set of
benchmark hashes; the windows of the documents that were hit are then compared as text; and
what stands is either reported, or its words are cut out, or the document is dropped.

The hash set is broadcast if it has at most ``MAX_BROADCAST`` rows of one long, which is
counted first; only the texts of documents that were hit move then.  A larger one is joined by
shuffle on the hash.  Hits are keyed by id and text hash.

Defined cases: null or empty texts have no words and no hits; items without words have no
windows.  Repeated rows get the same result each.  Windows that several items share count for
all of them; a null item id counts for none.  Empty tables give no hits or no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaloom.functions.arrays import let
from verbaloom.llm.common import free_name, stored, table

WIDTH = 10
#: Rows of 8 bytes in a broadcast set of hashes: about 100 MB as a hash relation.
MAX_BROADCAST = 2_000_000
LETTERS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"[{LETTERS}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[{LETTERS}]+")), F.lit(0)).cast("long")


def _starts(count: Column, width: int) -> Column:
    return F.when(count >= width, F.sequence(F.lit(1), count - (width - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct window: ``window, width, hash, items`` (sorted item ids as text)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(WIDTH))
    items = items.select("item", "words", width.alias("width"))
    texts = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda i: F.slice("words", i, F.col("width")))
    windows = items.select("item", "width", F.explode(F.array_distinct(texts)).alias("of"))
    hashed = F.xxhash64(F.transform("of", lambda w: F.xxhash64(w)))
    windows = windows.select("item", "width", F.array_join("of", " ").alias("window"), hashed.alias("hash"))
    return windows.groupBy("window", "width", "hash").agg(F.sort_array(F.collect_set("item")).alias("items"))


def candidate_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``id, key, text, spots`` of documents with a window whose hash is in the set; ``docs`` has ``id, key, text``.

    With a broadcast set the text goes along as a reference and is copied for hits only: the
    hashes are an array column first, so that the explode and the lookup are one generated
    loop.  With a larger set windows move by hash, and texts join their hits afterwards.
    """
    hashes = windows.select("width", "hash").distinct()
    sizes = [(r["width"], r["n"]) for r in hashes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()]  # WIDTH rows at most
    small = sum(n for _, n in sizes) <= MAX_BROADCAST
    carried = ["id", "key", "text"] if small else ["id", "key"]
    found = []
    for width, _ in sorted(sizes):
        known = hashes.filter(F.col("width") == width).select("hash")
        per_word = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
        per_window = let(per_word, lambda h: F.transform(
            _starts(F.size(h), width), lambda i: F.xxhash64(F.slice(h, i, width))))
        rows = docs.select(*carried, per_window.alias("hashes")).select(*carried, F.posexplode("hashes").alias("at", "hash"))
        rows = rows.join(F.broadcast(known) if small else known, "hash", "left_semi")
        found.append(rows.select(*carried, F.struct((F.col("at") + 1).alias("at"), F.lit(width).alias("width")).alias("spot")))
    if not found:
        return docs.select("id", "key", "text", F.array().cast("array<struct<at:int,width:int>>").alias("spots")).limit(0)
    rows = functools.reduce(DataFrame.unionByName, found).groupBy("id", "key")
    if small:
        return rows.agg(F.first("text").alias("text"), F.collect_set("spot").alias("spots"))
    spots = rows.agg(F.collect_set("spot").alias("spots")).withColumnsRenamed({"id": "hit_id", "key": "hit_key"})
    return docs.join(spots.hint("merge"), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))).drop("hit_id", "hit_key")


def verified_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``id, key, hit_words`` (their numbers, from 1) and ``items`` of contaminated documents."""
    texts = candidate_hits(docs, windows)
    read = let(words(F.col("text")), lambda w: F.transform("spots", lambda s: F.struct(
        s["at"].alias("at"), s["width"].alias("width"), F.array_join(F.slice(w, s["at"], s["width"]), " ").alias("window"))))
    claimed = texts.select("id", "key", F.explode(read).alias("hit")).select("id", "key", "hit.*")
    sure = claimed.join(windows.select("window", "items"), "window")
    hit_words = F.flatten(F.transform("spots", lambda s: F.sequence(s["at"], s["at"] + s["width"] - 1)))
    return sure.groupBy("id", "key").agg(
        F.collect_set(F.struct("at", "width")).alias("spots"), F.collect_set("items").alias("items"),
    ).select("id", "key", F.array_distinct(hit_words).alias("hit_words"),
             F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def without_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 drop_documents: bool = False) -> DataFrame:
    """``docs`` without the words of benchmark windows (and what follows them up to the next word).

    Documents of which no word is left go, and with ``drop_documents`` all that were hit.
    """
    windows = stored(benchmark_windows(benchmark), "benchmark-windows")
    own_id, own_key, spots = (free_name(docs, n) for n in ("hit_id", "hit_key", "hit_words"))
    hits = stored(verified_hits(keyed(docs, doc_id, text), windows).select(
        F.col("id").alias(own_id), F.col("key").alias(own_key), F.col("hit_words").alias(spots)), "verified-hits")
    # The same plan at every size: rows with their texts move once, by the whole key.
    joined = docs.join(hits.hint("merge"), F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_key)), "left")
    if drop_documents:
        return joined.filter(F.col(spots).isNull()).select(*docs.columns)
    lead = F.regexp_extract(text, f"^[^{LETTERS}]*", 0)
    pieces = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]+[^{LETTERS}]*"), F.lit(0))
    left = F.filter(pieces, lambda _, i: ~F.array_contains(F.col(spots), i + 1))
    clean = F.when(F.col(spots).isNull(), F.col(text)).when(F.size(left) > 0, F.concat(lead, F.array_join(left, "")))
    changed = joined.withColumn(text, clean).filter(F.col(spots).isNull() | F.col(text).isNotNull())
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(spots).isNull(), F.col("n_chars")).otherwise(F.length(text)))
    return changed.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages are cut out of the texts."""
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    windows = stored(benchmark_windows(table(spark, sf_dir, "benchmark")), "benchmark-windows")
    hits = verified_hits(docs, windows).select(
        F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    every = docs.select("id", "key", word_count(F.col("text")).alias("n_words"))
    joined = every.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, list_aggregate(words[i : i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT item, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)
), dw AS (
  SELECT rid, i, n, list_aggregate(words[i : i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)
), h AS (SELECT DISTINCT rid, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), w AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid
), t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN w USING (rid) LEFT JOIN t USING (rid)
"""
