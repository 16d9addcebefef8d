"""Queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbaloom.llm import (
    chat_formatting,
    dart_minhash,
    decontamination,
    html_extraction,
    periodic_runs,
    quality_hosts,
    secret_scan,
    source_mixing,
    suffix_dedup,
    token_ledger,
    toxicity,
    wacz,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_duplicates": dart_minhash.op1_near_duplicates,
        "op2_secret_scan": secret_scan.op2_secret_scan,
        "op3_source_mix": source_mixing.op3_source_mix,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_html_text": html_extraction.op5_html_text,
        "op6_host_quality": quality_hosts.op6_host_quality,
        "op7_repeated_bytes": suffix_dedup.op7_repeated_bytes,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_chat_format": chat_formatting.op9_chat_format,
        "op10_token_totals": token_ledger.op10_token_totals,
        "op11_whitening": whitening.op11_whitening,
        "op12_web_archive": wacz.op12_web_archive,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mix": source_mixing.OP3_SQL,
        "op6_host_quality": quality_hosts.OP6_SQL,
        "op8_decontamination": decontamination.OP8_SQL,
        "op9_chat_format": chat_formatting.OP9_SQL,
        "op12_web_archive": wacz.OP12_SQL,
    }
