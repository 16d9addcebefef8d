"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, white space as one
blank, hashed into ``BUCKETS``.  For each bucket r is the log ratio of how often it is found
in toxic and in clean texts, smoothed by 1; a logistic regression is then fitted on features
that are r where the bucket is found and 0 elsewhere, with a penalty on the weights.  The
model is one vector and one number, so scoring a text is a sum over its buckets.

Only labels whose crc32 of the id, modulo ``FOLDS``, is not 0 are learnt from.  The fit takes
``MAX_LABELLED`` of them at most, those with the smallest hashes of their ids, so the table of
labels that is broadcast and the matrix that one task holds are bounded by that parameter
(and by ``BUCKETS`` per row).  Every text of the table is then scored as a whole.

Defined cases: a null or empty text has the features of the empty text and gets the score of
the bias.  Several labels of one id count as toxic if one is.  Repeated documents are scored
each.  Without labels, or with labels of one kind only, the score is the smoothed share of
toxic labels.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from verbaloom.llm.common import free_name, table

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
SHIFT = np.uint64(64 - 18)
FOLDS = 5
#: Labelled rows that a model is fitted on, at most.
MAX_LABELLED = 8_000
#: Buckets found in fewer labelled texts than this are left out of the model.
MIN_TEXTS = 5
STEPS, RATE, PENALTY = 60, 0.3, 1e-4


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's n-grams, in no order."""
    words = " ".join((text or "").lower().split())
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = np.zeros(BUCKETS, np.bool_)
    name = np.zeros(len(codes), np.uint64)
    for order in range(1, min(ORDERS[-1], len(codes)) + 1):
        # The name of an n-gram is made of the name of its first n - 1 characters and its last one.
        name = (name[: len(codes) - order + 1] + codes[order - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
        if order in ORDERS:
            found[(name * np.uint64(0xBF58476D1CE4E5B9)) >> SHIFT] = True
    return np.flatnonzero(found).astype(np.int32)


def fit(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) from the buckets and labels of texts."""
    n, positive = len(rows), int(toxic.sum())
    prior = float(np.log((positive + 1) / (n - positive + 1)))
    if positive in (0, n):
        return np.zeros(BUCKETS, np.float32), prior
    flat = np.concatenate(rows)
    lengths = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
    of_toxic = toxic[owner] > 0
    p = np.bincount(flat[of_toxic], minlength=BUCKETS).astype(np.float64)
    q = np.bincount(flat[~of_toxic], minlength=BUCKETS).astype(np.float64)
    ratio = np.log((p + 1) / (positive + 2)) - np.log((q + 1) / (n - positive + 2))
    # A ratio that sampling alone explains says nothing; long texts would add up many of them.
    noise = np.sqrt(1 / (p + 1) + 1 / (q + 1))
    ratio[(p + q < MIN_TEXTS) | (np.abs(ratio) < 3 * noise)] = 0.0
    keep = ratio[flat] != 0
    flat, owner = flat[keep], owner[keep]
    names, flat = np.unique(flat, return_inverse=True)
    scale = ratio[names]
    y = toxic.astype(np.float64)
    # Both labels weigh the same, whatever their shares.
    weight = np.where(y > 0, 0.5 / positive, 0.5 / (n - positive))
    w, bias = np.zeros(len(names)), 0.0
    speed, drift = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        margin = np.bincount(owner, (w * scale)[flat], minlength=n) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        slope = np.append(np.bincount(flat, error[owner], minlength=len(names)) * scale + PENALTY * w, error.sum())
        drift = 0.9 * drift + 0.1 * slope
        speed = 0.99 * speed + 0.01 * slope * slope
        move = RATE * (drift / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    model = np.zeros(BUCKETS, np.float32)
    model[names] = w * scale
    return model, bias


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, toxic, text`` of at most ``most`` labels that may be learnt from."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """The model. Features are made where the texts are; one task fits them."""
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())],
                                             names=["doc_id", "toxic", "buckets"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))
        model, bias = fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary()), pa.array([bias])], names=["model", "bias"])

    texts = labelled_texts(docs, labels, most).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text")
    made = texts.mapInArrow(features, StructType([
        StructField("doc_id", LongType()), StructField("toxic", IntegerType()), StructField("buckets", BinaryType())]))
    row = made.repartition(1).mapInArrow(learn, StructType([
        StructField("model", BinaryType()), StructField("bias", DoubleType())])).first()
    if row is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(bytes(row["model"]), np.float32), row["bias"]


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    weights, bias = model

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        margins = np.array([float(weights[buckets(t)].sum(dtype=np.float64)) + bias for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(margins, -30, 30))), dtype="float64")

    hidden = free_name(docs, "toxicity")
    return docs.withColumn(hidden, score(F.col(text))).withColumns({
        "score": F.col(hidden), "predicted": (F.col(hidden) >= 0.5).cast("int")}).drop(hidden)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
