"""From raw documents to a training mix, in stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbaloom.llm import dart_minhash, decontamination, quality_hosts, secret_scan, source_mixing
from verbaloom.llm.common import stored, table

#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("quality_rules", quality_hosts.keep_good_documents),
    ("near_duplicates", dart_minhash.without_near_duplicates),
    ("decontamination", decontamination.decontaminated),
    ("secrets", secret_scan.without_secrets),
    ("source_mix", source_mixing.mixed_documents),
]

#: SQL can't express the stages: signatures and trained models are part of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on the documents; each result is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
