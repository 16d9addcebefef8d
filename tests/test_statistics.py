import random
import re

import numpy as np
import pytest
from golden import COLUMNS, TWO_SENTENCES, brute_pairs, rows, two_sentences
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbaloom.operators import chartdata, frequencies, matrix
from verbaloom.operators.cooccurrence import cooccurrences
from verbaloom.operators.filters import without_terms


def test_pos_counts(spark):
    assert rows(frequencies.pos_counts(two_sentences(spark))) == [
        ("PROPN", 3, 25.0), ("DET", 2, 16.67), ("NOUN", 2, 16.67), ("PUNCT", 2, 16.67),
        ("VERB", 2, 16.67), ("ADP", 1, 8.33),
    ]


def test_pos_counts_of_nothing(spark):
    assert rows(frequencies.pos_counts(two_sentences(spark).limit(0))) == []


def test_pos_total_reuses_the_counts(spark):
    df = frequencies.pos_counts(two_sentences(spark))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 4000), min_size=1, max_size=12))
def test_percent_is_rounded_like_arrays(spark, amounts):
    data = [(f"T{i:02d}", n) for i, n in enumerate(amounts)]
    df = spark.createDataFrame(data, "UPOS string, rows long")
    got = {tag: percent for tag, _, percent in rows(frequencies.pos_counts(df, weight="rows"))}
    counts = np.array(amounts)
    expected = (counts / counts.sum() * 100).round(2)
    assert got == {f"T{i:02d}": p for i, p in enumerate(expected)}


def test_lemma_freqs(spark):
    df = two_sentences(spark)
    assert rows(frequencies.lemma_freqs(df, 3)) == [(".", 2), ("el", 2), ("gato", 2)]
    assert rows(frequencies.lemma_freqs(df, 0)) == []
    assert frequencies.lemma_freqs(df, None).count() == 9
    with pytest.raises(ValueError):
        frequencies.lemma_freqs(df, -1)


def test_ner_counts(spark):
    df = two_sentences(spark)
    entities = [("B-LOC", 1), ("B-PER", 1), ("I-LOC", 1)]
    assert rows(frequencies.ner_counts(df)) == entities
    assert rows(frequencies.ner_counts(df, drop_o=False)) == [("O", 9), *entities]


def test_deprel_counts(spark):
    df = two_sentences(spark)
    expected = [("det", 2), ("nsubj", 2), ("punct", 2), ("root", 2),
                ("case", 1), ("flat", 1), ("obj", 1), ("obl", 1)]
    assert rows(frequencies.deprel_counts(df)) == expected
    assert rows(frequencies.deprel_counts(df, 0)) == expected
    assert rows(frequencies.deprel_counts(df, 3)) == expected[:3]


def test_top_lemmas(spark):
    df = two_sentences(spark)
    assert rows(frequencies.top_lemmas_by_upos(df, "PROPN", 2)) == [("José", 1), ("María", 1)]
    each = sorted(rows(frequencies.top_lemmas_each_upos(df, 1)))
    assert each == [("ADP", "en", 1), ("DET", "el", 2), ("NOUN", "gato", 2),
                    ("PROPN", "José", 1), ("PUNCT", ".", 2), ("VERB", "comer", 1)]


def test_lengths_and_histogram(spark):
    df = two_sentences(spark)
    assert rows(frequencies.sentence_lengths(df, ordered=True)) == [(1, 1, 6), (1, 2, 6)]
    bins = rows(chartdata.sentence_length_histogram(df, 10))
    assert len(bins) == 10 and [b[3] for b in bins] == [0, 0, 0, 0, 0, 2, 0, 0, 0, 0]
    assert (bins[0][1], bins[-1][2]) == (5.5, 6.5)


def test_sentence_without_index_is_left_out(spark):
    df = two_sentences(spark).withColumn("sent_ix", F.when(F.col("sent_ix") == 1, 1).cast("long"))
    assert rows(frequencies.sentence_lengths(df)) == [(1, 1, 6)]
    assert sum(r[2] for r in rows(cooccurrences(df, 2, top=None))) == 18


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 13))
def test_histogram_like_arrays(spark, lengths, bins):
    data = [(1, s, t, "x", "x") for s, n in enumerate(lengths, 1) for t in range(1, n + 1)]
    df = spark.createDataFrame(data, "doc_id long, sent_ix long, tok_ix long, FORM string, LEMMA string")
    got = rows(chartdata.sentence_length_histogram(df, bins))
    counts, edges = np.histogram(lengths, bins=bins)
    assert [g[3] for g in got] == counts.tolist()
    assert [g[1] for g in got] == pytest.approx(edges[:-1].tolist(), abs=1e-12)
    assert [g[2] for g in got] == pytest.approx(edges[1:].tolist(), abs=1e-12)


COOC = {
    ("el", "gato"): 6, ("el", "ver"): 4, ("gato", "ver"): 4, (".", "el"): 2, (".", "gato"): 2,
    ("comer", "maría"): 2, ("comer", "en"): 2, ("en", "san"): 2, ("josé", "san"): 2,
    (".", "josé"): 2, ("en", "maría"): 2, ("comer", "san"): 2, ("en", "josé"): 2, (".", "san"): 2,
}


def as_pairs(df):
    return {(a, b): n for a, b, n in rows(df)}


def test_cooccurrences(spark):
    df = two_sentences(spark)
    assert as_pairs(cooccurrences(df, 2)) == COOC
    first = rows(cooccurrences(df, 2, top=2))
    assert first == [("el", "gato", 6), ("el", "ver", 4)]
    assert len(rows(cooccurrences(df, 2, top=0))) == len(COOC)


def test_cooccurrences_of_nothing(spark):
    for empty in (cooccurrences(two_sentences(spark), 0),
                  cooccurrences(two_sentences(spark).limit(0), 2)):
        assert rows(empty) == []
        assert empty.dtypes == [("left", "string"), ("right", "string"), ("count", "bigint")]


def test_distance_counts_what_is_left(spark):
    got = as_pairs(cooccurrences(two_sentences(spark), 1, exclude=["VER", "el"]))
    seqs = [["gato", "gato", "."], ["maría", "comer", "en", "san", "josé", "."]]
    assert got == brute_pairs(seqs, 1)
    assert got[("gato", "gato")] == 2


def test_forms_with_case(spark):
    got = as_pairs(cooccurrences(two_sentences(spark), 1, use_lemma=False, lowercase=False))
    seqs = [[r[3] for r in TWO_SENTENCES if r[1] == s] for s in (1, 2)]
    assert got == brute_pairs(seqs, 1)


def test_whole_document_is_in_reading_order(spark):
    got = as_pairs(cooccurrences(two_sentences(spark), 3, by_sent=False))
    assert got == brute_pairs([[r[4].lower() for r in TWO_SENTENCES]], 3)


def test_table_without_document_id_is_one_document(spark):
    got = as_pairs(cooccurrences(two_sentences(spark).drop("doc_id"), 2))
    assert got == COOC


def _random_tokens(seed, sentences, longest):
    rng = random.Random(seed)
    return {
        (doc, s): [rng.choice("abcdefg") for _ in range(rng.randint(1, longest))]
        for doc in (1, 2, 3) for s in range(1, (sentences if doc == 1 else 3) + 1)
    }


@pytest.mark.parametrize("nested", [True, False])
@pytest.mark.parametrize("by_sent", [True, False])
@pytest.mark.parametrize("window", [1, 3, 9])
@pytest.mark.parametrize("longest", [2, 90])
def test_large_documents_in_pieces(spark, nested, by_sent, window, longest):
    """One document holds nearly all rows; pieces are shorter than some windows."""
    data = _random_tokens(window, 60, longest)
    df = spark.createDataFrame(
        [(d, s, t, w, w) for (d, s), seq in data.items() for t, w in enumerate(seq, 1)],
        "doc_id long, sent_ix long, tok_ix long, FORM string, LEMMA string",
    ).repartition(5)
    if nested:
        word = F.struct(F.lit(1).alias("part"), "tok_ix", F.col("FORM").alias("tok_form"), F.col("LEMMA").alias("lemma"))
        df = df.groupBy("doc_id", "sent_ix").agg(F.sort_array(F.collect_list(F.struct("tok_ix", word.alias("w"))))["w"].alias("words"))
    if by_sent:
        sequences = list(data.values())
    else:
        sequences = [[w for (d, _), seq in sorted(data.items()) if d == doc for w in seq]
                     for doc in (1, 2, 3)]
    got = as_pairs(cooccurrences(df, window, by_sent=by_sent, top=None, block_bits=3))
    assert got == brute_pairs(sequences, window)


def test_one_huge_sentence_in_pieces(spark):
    rng = random.Random(5)
    seq = [rng.choice(["x", "x", "y", "z"]) for _ in range(3000)]
    df = spark.createDataFrame([(7, 1, t, w, w) for t, w in enumerate(seq, 1)],
                               "doc_id long, sent_ix long, tok_ix long, FORM string, LEMMA string")
    assert as_pairs(cooccurrences(df, 4, top=None, block_bits=6)) == brute_pairs([seq], 4)


def test_wrong_arguments(spark):
    df = two_sentences(spark)
    for bad in ({"window": -1}, {"top": -1}, {"block_bits": 0}):
        with pytest.raises(ValueError):
            cooccurrences(df, **bad)
    with pytest.raises(ValueError):
        chartdata.sentence_length_histogram(df, 0)


@pytest.mark.parametrize("call, column", [
    (frequencies.pos_counts, "UPOS"), (frequencies.lemma_freqs, "LEMMA"),
    (frequencies.ner_counts, "NER"), (frequencies.deprel_counts, "DEPREL"),
    (frequencies.sentence_lengths, "sent_ix"), (cooccurrences, "LEMMA"),
    (matrix.dependency_role_matrix, "UPOS"), (chartdata.wordcloud_weights, "LEMMA"),
])
def test_missing_column(spark, call, column):
    with pytest.raises(ValueError, match=column):
        call(two_sentences(spark).drop(column))


def test_matrix(spark):
    wide = matrix.dependency_role_matrix(two_sentences(spark))
    assert wide.columns == ["DEPREL", "ADP", "DET", "NOUN", "PROPN", "PUNCT", "VERB"]
    got = {r["DEPREL"]: {k: v for k, v in r.asDict().items() if k != "DEPREL" and v} for r in wide.collect()}
    assert list(got) == sorted(got)
    assert got["nsubj"] == {"NOUN": 50.0, "PROPN": 50.0}
    assert got["case"] == {"ADP": 100.0} and got["flat"] == {"PROPN": 100.0}
    picked = matrix.dependency_role_matrix(two_sentences(spark), ["NOUN"])
    assert {r["DEPREL"]: r["NOUN"] for r in picked.collect()}["nsubj"] == 50.0


def test_wordcloud(spark):
    got = rows(chartdata.wordcloud_weights(two_sentences(spark), stopwords=["EL"]))
    assert got[0] == ("gato", 2, 1.0)
    assert {r[0] for r in got} == {"gato", "ver", "comer", "en", "San", "José", "María"}
    everything = rows(chartdata.wordcloud_weights(two_sentences(spark), min_length=1, top=None))
    assert {r[0] for r in everything} >= {".", "el"}


def test_bars(spark):
    df = two_sentences(spark)
    assert rows(chartdata.pos_bars(df, sort_desc=False))[0] == ("ADP", 1)
    assert rows(chartdata.ner_bars(df.withColumn("NER", F.lit("O")))) == []


def test_exclusion_lists_of_any_length_and_kind_agree(spark):
    df = two_sentences(spark)
    many = [f"w{i}" for i in range(6000)] + ["EL", "."]
    assert without_terms(df, F.lower("LEMMA"), many).count() == 8
    table = spark.createDataFrame([("el",), (".",), (None,)], "word string")
    assert without_terms(df, F.lower("LEMMA"), table).count() == 8
    want = as_pairs(cooccurrences(df, 1, exclude=["el", "."]))
    assert as_pairs(cooccurrences(df, 1, exclude=table)) == want == as_pairs(cooccurrences(df, 1, exclude=many))


def test_missing_terms_are_one_term_on_every_path(spark):
    flat = spark.createDataFrame([(1, 1, 1, "a", "a"), (1, 1, 2, "", None), (1, 1, 3, "b", "b")],
                                 "doc_id long, sent_ix long, tok_ix long, FORM string, LEMMA string")
    word = F.struct(F.lit(1).alias("part"), "tok_ix", F.col("FORM").alias("tok_form"), F.col("LEMMA").alias("lemma"),
                    *[F.lit(None).cast("string").alias(n) for n in ("upos", "xpos", "deprel")], F.lit(0).alias("head"))
    nested = flat.groupBy("doc_id", "sent_ix").agg(F.sort_array(F.collect_list(F.struct("tok_ix", word.alias("w"))))["w"].alias("words"))
    nested = nested.withColumns({"lang": F.lit("en"), "entities": F.array()})
    listed = spark.createDataFrame([("zzz",)], "word string")
    for use_lemma in (True, False):
        for df, exclude in ((flat, None), (nested, None), (nested, listed), (flat, listed)):
            got = as_pairs(cooccurrences(df, 1, use_lemma=use_lemma, exclude=exclude))
            assert got == {("_", "a"): 2, ("_", "b"): 2}


def test_counts_add_up(spark):
    df = spark.createDataFrame(TWO_SENTENCES, COLUMNS)
    n = df.count()
    for counts in (frequencies.pos_counts(df), frequencies.deprel_counts(df),
                   frequencies.ner_counts(df, drop_o=False), frequencies.lemma_freqs(df, None)):
        assert counts.agg(F.sum("count")).first()[0] == n
    assert frequencies.sentence_lengths(df).agg(F.sum("length")).first()[0] == n
    assert all(r[2] % 2 == 0 for r in rows(cooccurrences(df, 2)))


def test_sentences_of_one_stretch_move_once(spark):
    """Numbered rows stay where they are, to meet their stretch's start and to form blocks; longer sentences count as well."""
    rows_in = [(doc, sent, tok, f"f{(tok * 7 + (sent or 0)) % 5}") for doc in (1, 2, None) for sent in (1, 2) for tok in range(1, 4 if sent == 1 else 30)]
    frame = spark.createDataFrame(rows_in, "doc_id long, sent_ix long, tok_ix long, FORM string").selectExpr("*", "FORM AS LEMMA")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cooccurrences(frame, 3, top=None, block_bits=2)
        told = {(r["left"], r["right"]): r["count"] for r in got.collect()}
        plan = spark._jvm.PythonSQLUtils.explainString(cooccurrences(frame, 3, top=None)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    sequences = [[r[3] for r in rows_in if r[:2] == (doc, sent)] for doc in (1, 2, None) for sent in (1, 2)]
    assert told == brute_pairs(sequences, 3)
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (hashpartitioning\(.*)", plan)
    # Terms move by their stretch, and by sentence only where it has several: no third time, to meet the starts.
    assert sum("in_run" in columns for columns, _ in moved) == 0
