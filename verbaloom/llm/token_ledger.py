"""Token counts as rollups that are kept up to date by signed deltas.

A ledger is a folder with three tables.  ``rows`` has one signed row per document, tokenizer
version and change: an insert adds +1, a delete repeats the row it takes back with -1, a
revision is both.  A row is known by its id and 128 bits of the SHA-256 of its text, since ids may
be null or stand on several texts.  ``deltas`` has each batch's sums of these by source, language and tokenizer
version.  ``commits`` names the batches that count.  A batch first replaces its own part of
``rows`` and ``deltas`` and is then named in ``commits``; one that is named already is not
applied again, and one that failed half-way is not seen by readers and is simply repeated.
Totals are sums over the deltas of committed batches, whatever the order of the batches.

Tokens are counted with public vocabularies in the rank-file format, found in a folder that
every executor can read (``folder``); nothing is trained.

Defined cases: null text has no tokens and no characters.  Null source, language, id and text
are values of their own.  Repeated rows count each; a delete takes back all live rows of its id,
or of its id and text where it names one.  Deletes and revisions of rows that are not live take nothing back.  A long text is
encoded in pieces that end where no token can span.  A table without rows gives a batch without
deltas.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from verbaloom.llm.common import shared_folder, table

FOLDER = "/opt/tokenizers"
#: Tokenizer version -> rank file.
TOKENIZERS = {"byte_bpe_50k@1": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k@1": "byte_bpe_multi_50k.tiktoken"}
#: The pattern that splits text before merges; a fixed value that belongs to the rank files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer"]
ROW = "doc_id long, text_key binary, source string, lang string, tokenizer string, n_tokens long, n_chars long, sign int"
#: Characters after which a text is cut at the next space behind an ASCII letter or digit: no
#: match of ``SPLIT`` spans that border, and one very long text takes bounded memory.
PIECE = 1 << 20
BORDER = re.compile(r"(?<=[0-9A-Za-z]) ")


@functools.lru_cache(maxsize=8)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(path).stem, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    at = 0
    while at < len(text):
        border = BORDER.search(text, at + size) if at + size < len(text) else None
        end = border.start() if border else len(text)
        yield text[at:end]
        at = end


def token_count(text: Column, file: str, folder: str = FOLDER) -> Column:
    path = f"{folder}/{file}"

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([sum(len(encode(p)) for p in pieces(t)) if t else 0 for t in texts], dtype="int64")
    return count(text)


def text_key(docs: DataFrame) -> Column:
    return F.unhex(F.substring(F.sha2(docs["text"], 256), 1, 32)).alias("text_key")


class TokenLedger:
    """The ledger in the folder ``path``, which is made if it is not there."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str] | None = None, folder: str = FOLDER):
        self.spark, self.path, self.folder = spark, path, folder
        self.tokenizers = dict(TOKENIZERS if tokenizers is None else tokenizers)
        empty = spark.createDataFrame([], ROW)
        empty.write.mode("ignore").parquet(f"{path}/rows/batch=0")
        self._sums(empty).write.mode("ignore").parquet(f"{path}/deltas/batch=0")
        spark.createDataFrame([], "batch string").write.mode("ignore").parquet(f"{path}/commits")

    def counted(self, docs: DataFrame) -> DataFrame:
        """Inserts: +1 rows of ``doc_id, source, lang, text`` for each tokenizer version."""
        text = F.coalesce("text", F.lit(""))
        counts = [token_count(text, file, self.folder).alias(f"t{i}") for i, file in enumerate(self.tokenizers.values())]
        wide = docs.select(F.col("doc_id").cast("long"), text_key(docs), "source", "lang", F.length(text).cast("long").alias("n_chars"), *counts)
        versions = F.explode(F.array(*[
            F.struct(F.lit(name).alias("tokenizer"), F.col(f"t{i}").alias("n_tokens")) for i, name in enumerate(self.tokenizers)]))
        return wide.select("*", versions.alias("v")).select(
            "doc_id", "text_key", "source", "lang", "v.tokenizer", "v.n_tokens", "n_chars", F.lit(1).alias("sign"))

    def live(self) -> DataFrame:
        """Rows that are inserted and not taken back, with their number as ``sign``."""
        return self._committed("rows", ROW).groupBy("doc_id", "text_key", *KEYS, "n_tokens", "n_chars").agg(
            F.sum("sign").cast("int").alias("sign")).filter("sign > 0")

    def taken_back(self, docs: DataFrame) -> DataFrame:
        """Deletes: the live rows of an id among ``docs``, or of an id and its text where ``docs`` has a
        column ``text``, with the sign turned."""
        live = self.live()
        gone = docs.select(F.col("doc_id").cast("long").alias("gone_id"), *([text_key(docs).alias("gone_text")] if "text" in docs.columns else []))
        gone = gone.distinct()
        same = live["doc_id"].eqNullSafe(gone["gone_id"])
        if "text" in docs.columns:
            same &= live["text_key"].eqNullSafe(gone["gone_text"])
        return live.join(gone, same, "left_semi").withColumn("sign", -F.col("sign"))

    def revised(self, docs: DataFrame) -> DataFrame:
        """Revisions by id: the live rows of each id go, whatever their text, and ``docs`` come."""
        return self.taken_back(docs.select("doc_id")).unionByName(self.counted(docs))

    def rewritten(self, docs: DataFrame, new_text: Column) -> DataFrame:
        """Revisions by id and text: every one of ``docs`` gets ``new_text`` in place of its ``text``."""
        return self.taken_back(docs).unionByName(self.counted(docs.withColumn("text", new_text)))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Applies the batch unless it is applied already; says whether it did."""
        commits = self.spark.read.schema("batch string").parquet(f"{self.path}/commits")
        if not commits.filter(F.col("batch") == batch).isEmpty():
            return False
        signed.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        rows = self.spark.read.schema(ROW).parquet(f"{self.path}/rows/batch={batch}")
        self._sums(rows).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens, n_chars`` of what is live."""
        sums = ["n_docs", "n_tokens", "n_chars"]
        deltas = self._committed("deltas", "source string, lang string, tokenizer string, " + ", ".join(f"{c} long" for c in sums))
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in sums])

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        sign = F.col("sign").cast("long")
        return rows.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.col("n_tokens")).alias("n_tokens"),
                                       F.sum(sign * F.col("n_chars")).alias("n_chars"))

    def _committed(self, name: str, schema: str) -> DataFrame:
        every = self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")
        commits = self.spark.read.schema("batch string").parquet(f"{self.path}/commits")
        return every.join(commits.distinct(), "batch", "left_semi").drop("batch")


def repeated_texts(docs: DataFrame) -> DataFrame:
    """Rows whose text stands on a row with a smaller id, too; a null id is the largest.  Rows that
    are equal in both stay together, and those without a text are none.

    The first id of each text is found before rows move, and rows are compared by text and id, so
    that a text on a third of all rows is dealt out.
    """
    known = docs.filter(F.col("text").isNotNull())
    first = known.groupBy(text_key(known).alias("first_text")).agg(F.min("doc_id").alias("first_id"))
    same = text_key(known).eqNullSafe(first["first_text"]) & known["doc_id"].eqNullSafe(first["first_id"])
    return known.join(first, same, "left_anti")


def op10_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; runs of symbols are cut out of the texts that have them, which
    revises their counts; texts that repeat an earlier one are deleted; each batch is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    ledger = TokenLedger(spark, shared_folder(spark, "token-ledger"))
    clean = F.regexp_replace("text", r"[#*$%&]{3,}", "")
    for _ in range(2):
        ledger.commit("1-load", ledger.counted(docs))
        ledger.commit("2-clean", ledger.rewritten(docs.filter(clean != F.col("text")), clean))
        ledger.commit("3-repeats", ledger.taken_back(repeated_texts(docs).withColumn("text", clean)))
    return ledger.totals()
