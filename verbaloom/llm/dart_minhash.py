"""Near-duplicate classes by weighted MinHash with darts, banded joining and exact checks.

A text is the weighted set of its five-word shingles, weight being how often one occurs.
Darts are thrown by hash at the plane of weight and rank above each shingle: every unit of
weight has its own stream of darts along the rank axis, with exponential gaps and a hashed
coordinate.  A text owns the darts below its weight, up to the rank at which it is expected
to own ``DARTS * (ln DARTS + 2)`` of them; per coordinate the earliest dart is kept.  Two texts
share a coordinate with the probability of their weighted Jaccard similarity, and a long text
costs little more than one pass over its shingles.

``BANDS`` bands of ``ROWS`` coordinates are bucket keys.  Texts with equal words are one node.
A bucket's nodes are not paired with each other: first each is compared with the bucket's
smallest node, then, where a bucket still holds several classes, with ``CENTRES`` drawn nodes of
other classes.  What is still outside the class of the bucket's smallest node is compared
with all nodes of the bucket in blocks: a task holds ``QUERIES`` of the former and ``OTHERS`` of
the latter on average and returns only the links that join classes.  Nodes are left out only
if what they have in common with any other node is too little.  So every pair that shares a
bucket is compared, ruled out, or already in one class.  Similarities are exact.

Classes are connected components, found by contraction on the table of links.  All tables of
nodes, pairs, links and classes stay distributed; state between rounds is written to the
shared folder.

Defined cases: a null text is an empty one.  Texts with equal words, also those without any,
are one class.  A text of fewer than five words is one shingle.  The class id is the smallest
document id of the class, null if there is none; classes can share it where ids are null or
stand on several texts, so the class label, the hash of one of its texts, tells them apart.
Repeated rows are in one class.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from verbaloom.llm.common import free_name, in_slices, stored, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
DARTS = BANDS * ROWS
#: Nodes of a bucket that the others are compared with in the second step, on average.
CENTRES = 8
#: Nodes in a block of the third step, on average.
QUERIES, OTHERS = 128, 1024

_BASE = 0x9E3779B97F4A7C15
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def shingles(words: str | None, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles in order, and their weights; ``words`` are joined by single spaces."""
    raw = np.frombuffer((words or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = _powers(1 << max(12, len(raw).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    word = _mix((sums[ends] - sums[starts]) * inverse[starts])
    width = min(width, len(word))
    name = np.zeros(len(word) - width + 1, np.uint64)
    for k in range(width):
        name = name * _MIX[2] + word[k : len(word) - width + 1 + k] * _MIX[3]
    return np.unique(_mix(name), return_counts=True)


def dart_sketch(values: np.ndarray, weights: np.ndarray, size: int = DARTS) -> np.ndarray:
    """For each coordinate the earliest dart of a weighted set (whole weights)."""
    units = _copies(values, weights)
    reach = size * (math.log(size) + 2) / len(units)
    while True:
        darts, ranks = _darts(units, reach)
        sketch, hit = np.zeros(size, np.uint64), np.zeros(size, bool)
        order = np.argsort(-ranks, kind="stable")
        at = (darts[order] >> np.uint64(20)) % np.uint64(size)
        sketch[at], hit[at] = darts[order], True
        if hit.all():
            return sketch
        reach *= 2  # darts of a higher rank can only fill what is empty


def _darts(units: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """All darts of the units with a rank below ``reach``."""
    block = int(reach + 6 * math.sqrt(reach) + 10) if reach > 4 else 1
    at, darts, ranks, number = np.zeros(len(units)), [], [], 0
    while len(units):
        name = _mix(units[:, None] + np.arange(number + 1, number + block + 1, dtype=np.uint64) * _MIX[2])
        gap = -np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
        rank = at[:, None] + np.cumsum(gap, axis=1)
        inside = rank < reach
        darts.append(_mix(name + _MIX[3])[inside])
        ranks.append(rank[inside])
        going = inside[:, -1]
        units, at, number = units[going], rank[going, -1], number + block
    return np.concatenate(darts), np.concatenate(ranks)


def buckets(words: str | None) -> list[int]:
    values, weights = shingles(words)
    if not len(values):
        return []
    rows = dart_sketch(values, weights).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[4]
    for k in range(ROWS):
        key = _mix(key * _MIX[2] + rows[:, k])
    return key.view(np.int64).tolist()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two outputs of ``shingles``."""
    both = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (both - shared) if both > shared else 1.0


def _buckets(words: list[str]) -> list[list[int]]:
    return [buckets(w) for w in words]


def _similarities(a: list[str], b: list[str]) -> list[float]:
    cached = functools.lru_cache(maxsize=64)(shingles)
    return [similarity(cached(x), cached(y)) for x, y in zip(a, b, strict=True)]


text_buckets = in_slices(ArrayType(LongType()), _buckets)
text_similarity = in_slices(DoubleType(), _similarities)


def normal_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def node_of(words: Column) -> Column:
    return F.unhex(F.md5(words))


def bucket_members(nodes: DataFrame) -> DataFrame:
    """``bucket, node, n, centre`` of buckets with several nodes; ``nodes`` has ``node, buckets``."""
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).filter("n > 1")
    return rows.join(sizes.hint("merge"), "bucket")


def contracted(links: DataFrame) -> DataFrame:
    """``old, new``: each end of ``links`` (columns ``a, b``) with the label of its component.

    Every node takes its smallest neighbour's name if that is smaller, links are renamed, and
    so on until none is left.  Names are hashes, so their order is random and each pass
    settles a share of what remains, also along chains.
    """
    links = stored(links, "links")
    labels = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(links.select("b", "a"))
        step = stored(ends.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("old"), F.least("x", "y").alias("new")), "step")
        labels = step if labels is None else stored(labels.join(
            step.select(F.col("old").alias("new"), F.col("new").alias("newer")), "new", "left",
        ).select("old", F.coalesce("newer", "new").alias("new")), "labels")
        to_a, to_b = step.toDF("a", "new_a"), step.toDF("b", "new_b")
        renamed = links.join(to_a, "a").join(to_b, "b").filter("new_a <> new_b")
        links = stored(renamed.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "links")
    return labels if labels is not None else links.toDF("old", "new")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose texts are similar enough."""
    left, right = texts.toDF("a", "words_a"), texts.toDF("b", "words_b")
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return joined.filter(text_similarity("words_a", "words_b") >= SIMILARITY).select("a", "b")


def _drawn(node: Column) -> Column:
    """A number in [0, 1) for a node, the same in all its buckets."""
    return (F.xxhash64(node) / F.lit(float(1 << 63)) + 1) / 2


def _shingle_lists(words: list[str]) -> list[np.ndarray]:
    return [shingles(w)[0].view(np.int64) for w in words]


def _shingle_weights(words: list[str]) -> list[int]:
    return [int(shingles(w)[1].sum()) for w in words]


_units = in_slices(ArrayType(LongType()), _shingle_lists)
_weight = in_slices(LongType(), _shingle_weights)


def common_parts(texts: DataFrame) -> DataFrame:
    """``node, weight, common``: the weight of each node and an upper bound of what it can share.

    A shingle that no other of the nodes has is never shared.  Two nodes are similar only if
    the smaller of their common parts is 4/9 of the sum of their weights at least, at 0.8.
    """
    parts = texts.select(F.xxhash64("node").alias("owner"), F.explode(_units("words")).alias("shingle"))
    lone = parts.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner")).filter("n = 1")
    lone = lone.groupBy("owner").agg(F.count(F.lit(1)).alias("lone"))
    weighed = texts.select("node", F.xxhash64("node").alias("owner"), _weight("words").alias("weight"))
    return weighed.join(lone, "owner", "left").select("node", "weight", (F.col("weight") - F.coalesce("lone", F.lit(0))).alias("common"))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _centre_pairs(rest: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes with drawn nodes of other classes in their bucket."""
    chosen = rest.filter(_drawn(F.col("node")) < F.lit(float(CENTRES)) / F.col("n")).select(
        "bucket", F.col("node").alias("other"), F.col("label").alias("other_label"),
        F.col("weight").alias("other_weight"), F.col("common").alias("other_common"))
    can = 9 * F.least("common", "other_common") >= 4 * (F.col("weight") + F.col("other_weight"))
    return rest.join(chosen, "bucket").filter((F.col("label") != F.col("other_label")) & can).select(
        *_ordered("node", "other")).distinct()


LINK = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def _block_links(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` between classes, from all nodes outside their bucket's major class and all
    nodes of the bucket, block by block."""
    outside = F.col("label") != F.col("major")
    sizes = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("all"), F.sum(outside.cast("long")).alias("minor"))
    sizes = sizes.filter("minor > 0").select(
        "bucket", F.ceil(F.col("minor") / QUERIES).alias("rows"), F.ceil(F.col("all") / OTHERS).alias("columns"))
    placed = rest.join(sizes, "bucket").join(texts, "node")
    queries = placed.filter(outside).withColumn("row", F.pmod(F.xxhash64("node"), "rows")).withColumn(
        "column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)))
    others = placed.withColumn("column", F.pmod(F.xxhash64("node", F.lit(1)), "columns")).withColumn(
        "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    key, taken = ["bucket", "row", "column"], ["node", "label", "words"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        links = block_links([tuple(r.values()) for r in left.select(taken).to_pylist()],
                            [tuple(r.values()) for r in right.select(taken).to_pylist()])
        ordered = [(min(p), max(p)) for p in links]
        return pa.table({"a": pa.array([a for a, _ in ordered], pa.binary()), "b": pa.array([b for _, b in ordered], pa.binary())})
    left, right = (rows.select(*key, *taken).toDF(*key, *taken).groupBy(*key) for rows in (queries, others))
    return left.cogroup(right).applyInArrow(compare, LINK).distinct()


def block_links(queries: list[tuple], others: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Similar pairs that join classes, from rows (node, label, words): one for each class joined."""
    if not queries or not others:
        return []
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [shingles(words) for _, _, words in others]
    # One unit for each copy of a shingle, so that a weighted overlap is a count of units.
    units = [_copies(*s) for s in sets]
    flat, owner = np.concatenate(units), np.repeat(np.arange(len(units)), [len(u) for u in units])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    weights = np.array([len(u) for u in units])
    links = []
    for node, label, words in queries:
        mine = _copies(*shingles(words))
        low, high = np.searchsorted(flat, mine), np.searchsorted(flat, mine, side="right")
        count = high - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        shared = np.bincount(owner[at], minlength=len(units))
        union = len(mine) + weights - shared
        for j in np.flatnonzero(shared >= SIMILARITY * union).tolist():
            other, other_label, _ = others[j]
            x, y = find(label), find(other_label)
            if other != node and x != y:
                root[x] = y
                links.append((node, other))
    return links


def _copies(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    copy = np.arange(int(weights.sum()), dtype=np.uint64) - np.repeat(np.cumsum(weights) - weights, weights).astype(np.uint64)
    return _mix(np.repeat(values, weights) + copy * _MIX[4])


def node_classes(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, label`` of nodes that are similar to others; ``words`` has ``node, words`` (repeats allowed)."""
    members = stored(bucket_members(nodes), "bucket-members")
    involved = members.select("node").distinct()
    # The same plan at every size: texts move once, by node.
    texts = stored(words.join(involved.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words")), "texts")
    pairs = stored(members.filter("node <> centre").select(*_ordered("node", "centre")).distinct(), "pairs")
    labels = contracted(_verified(pairs, texts))
    parts = None
    for step in ("centres", "blocks"):
        labelled = members.filter("n > 2").join(labels.toDF("node", "label"), "node", "left").select(
            "bucket", "node", "n", "centre", F.coalesce("label", "node").alias("label"))
        labelled = stored(labelled, "labelled")
        mixed = labelled.groupBy("bucket").agg(
            F.min("label").alias("low"), F.max("label").alias("high"),
            F.max(F.when(F.col("node") == F.col("centre"), F.col("label"))).alias("major")).filter("low <> high")
        rest = stored(labelled.join(mixed.select("bucket", "major"), "bucket"), "mixed")
        if rest.isEmpty():
            break
        if parts is None:  # the next step has fewer nodes, so what is not shared here is not shared there
            still = texts.join(rest.select("node").distinct().hint("merge"), "node", "left_semi")
            parts = stored(common_parts(still), "common-parts")
        # A node whose own bound rules out every partner of at least its common part is settled.
        rest = rest.join(parts, "node").filter(9 * F.col("common") >= 4 * (F.col("weight") + F.col("common")))
        found = _verified(_centre_pairs(rest), texts) if step == "centres" else _block_links(rest, texts)
        named = labels.toDF("node", "label")
        ends = found.join(named.toDF("a", "label_a"), "a", "left").join(named.toDF("b", "label_b"), "b", "left").select(
            F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y"))
        joined = contracted(ends.select(*_ordered("x", "y")).filter("a <> b").distinct())
        kept = labels.join(joined.toDF("new", "newer"), "new", "left").select("old", F.coalesce("newer", "new").alias("new"))
        added = joined.join(labels.select("old"), "old", "left_anti")
        labels = stored(kept.unionByName(added), "labels")
    return labels.toDF("node", "label")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, node, class_id, class_size, label``, one row per row of ``docs``; ``label`` names the class."""
    words = docs.select(F.col(doc_id).alias("doc_id"), normal_words(F.col(text)).alias("words")).withColumn("node", node_of(F.col("words")))
    sketched = stored(words.select("doc_id", "node", text_buckets("words").alias("buckets")), "sketches")
    nodes = sketched.groupBy("node").agg(F.first("buckets").alias("buckets"))
    classes = node_classes(words.select("node", "words"), nodes)
    members = stored(sketched.select("doc_id", "node").join(classes, "node", "left").select(
        "doc_id", "node", F.coalesce("label", "node").alias("label")), "members")
    names = members.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return members.join(names, "label").select("doc_id", "node", "class_id", "class_size", "label")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays, null being last, one row of it."""
    node, key = free_name(docs, "node"), free_name(docs, "kept_id")
    first = near_duplicate_classes(docs).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"))
    first = first.select(F.col("first.doc_id").alias(key), F.col("first.node").alias(f"{node}_kept")).hint("merge")
    rows = docs.withColumn(node, node_of(normal_words(F.col("text"))))
    kept = rows.join(first, (rows[node] == first[f"{node}_kept"]) & rows["doc_id"].eqNullSafe(first[key]), "left_semi")
    return kept.dropDuplicates([node]).select(*docs.columns)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", F.hex("label").alias("class_label"))
