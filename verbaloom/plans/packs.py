"""The result packs: several tables from one annotation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbaloom.operators import chartdata, frequencies
from verbaloom.operators.cooccurrence import cooccurrences
from verbaloom.operators.matrix import dependency_role_matrix
from verbaloom.operators.views import token_view
from verbaloom.plans.annotate import store_annotation
from verbaloom.schemas import is_nested, require_columns
from verbaloom.session import checkpoint
from verbaloom.sinks import write_conllu, write_json, write_report, write_tables, write_tokens


def stats_pack(
    df: DataFrame,
    *,
    top_lemmas: int = 50,
    window_cooc: int = 2,
    exclude_tokens: Iterable[str] | DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``pos, lemmas, ner, deprel, lengths, cooc, dep_matrix_pct`` of a stored annotation.

    The four tag tables come from one pass: tokens are first counted per combination of
    tags, and that small table is kept.
    """
    tags = ["UPOS", "DEPREL"]
    if is_nested(df):
        tags.append("NER")
        tokens = token_view(df, tags)
    else:
        require_columns(df, *tags)
        tags += [name for name in ("NER",) if name in df.columns]
        tokens = df
    combined = checkpoint(tokens.groupBy(*tags).agg(F.count(F.lit(1)).alias("rows")))
    ner = (
        frequencies.ner_counts(combined, weight="rows")
        if "NER" in tags else frequencies.empty_counts(df, "NER_tag")
    )
    return {
        "pos": frequencies.pos_counts(combined, weight="rows"),
        "lemmas": frequencies.lemma_freqs(df, top_lemmas),
        "ner": ner,
        "deprel": frequencies.deprel_counts(combined, weight="rows"),
        "lengths": frequencies.sentence_lengths(df),
        "cooc": cooccurrences(df, window_cooc, exclude=exclude_tokens),
        "dep_matrix_pct": dependency_role_matrix(combined, weight="rows"),
    }


def summary_pack(df: DataFrame) -> dict[str, DataFrame]:
    """``tokens, pos_counts, lemma_freqs, ner_counts``: nulls left out, ``O`` counted."""
    def tokens(*columns: str) -> DataFrame:
        return token_view(df, list(columns) or None) if is_nested(df) else df

    return {
        "tokens": tokens(),
        "pos_counts": frequencies.summary_pos_counts(tokens("UPOS")),
        "lemma_freqs": frequencies.summary_lemma_freqs(tokens("LEMMA")),
        "ner_counts": frequencies.summary_ner_counts(tokens("NER")),
    }


def chart_pack(
    df: DataFrame,
    *,
    topk_lemmas: int = 20,
    topk_deprel: int | None = None,
    make_wordcloud: bool = False,
    stopwords: Iterable[str] | DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``upos, lemmas, ner, deprel, sentlen`` and, on request, ``wordcloud``."""
    charts = {
        "upos": chartdata.pos_bars(df),
        "lemmas": chartdata.lemma_bars(df, topk_lemmas),
        "ner": chartdata.ner_bars(df),
        "deprel": chartdata.deprel_bars(df, topk_deprel),
        "sentlen": chartdata.sentence_length_histogram(df),
    }
    if make_wordcloud:
        charts["wordcloud"] = chartdata.wordcloud_weights(df, stopwords=stopwords)
    return charts


def export_all(
    sentences: DataFrame, path: str, *, report: bool = False, mode: str = "errorifexists",
    compression: str = "none",
) -> dict[str, str]:
    """Every export of one annotation below ``path``; returns where each one went.

    The annotation is stored first and the exports read the stored copy.  ``compression`` is that of the
    text files: plain, all of them take about a hundred times the corpus' Parquet file.
    """
    base = path.rstrip("/")
    stored = store_annotation(sentences, f"{base}/annotation", mode)
    written = {name: f"{base}/{name}" for name in ("annotation", "tsv", "conllu", "json")}
    write_tokens(stored, written["tsv"], mode=mode, compression=compression)
    write_conllu(stored, written["conllu"], mode, compression)
    write_json(stored, written["json"], mode, compression)
    for name, place in write_tables(summary_pack(stored), f"{base}/summary", mode=mode).items():
        written[f"summary/{name}"] = place
    if report:
        written["report"] = f"{base}/report"
        write_report(stored, written["report"], mode, compression)
    return written
