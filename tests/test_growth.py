"""What a step makes per input row stays bounded, with the results of the plain way."""

import random
from collections import Counter

import pytest
from golden import brute_pairs, rows
from pyspark.sql import functions as F

from verbaloom.operators import chartdata, cooccurrence, views, vocabulary, windows
from verbaloom.operators.cooccurrence import WIDE, _ordered_pairs, cooccurrences
from verbaloom.operators.lexicon import Lexicon
from verbaloom.plans import annotate
from verbaloom.sinks.token_tsv import tsv_rows


def _flat(spark, data):
    return spark.createDataFrame(
        [(d, s, t, w, w) for (d, s), seq in data.items() for t, w in enumerate(seq, 1)],
        "doc_id long, sent_ix long, tok_ix long, FORM string, LEMMA string").repartition(3)


def _words(seed, letters, sizes):
    rng = random.Random(seed)
    return {(d, s): [rng.choice(letters) for _ in range(n)] for d, s, n in sizes}


SIZES = [(1, 1, 700), (1, 2, 3), (1, 3, 90), (1, 4, 1), (2, 1, 40), (3, 1, 1)]


@pytest.mark.parametrize("by_sent", [True, False])
@pytest.mark.parametrize("window", [WIDE, 100, 5000])
@pytest.mark.parametrize("held", [windows.HELD, 1000])
def test_wide_windows_are_exact(spark, monkeypatch, by_sent, window, held):
    monkeypatch.setattr(windows, "HELD", held)
    data = _words(window, ["a", "b", "c", "d", "é", "f", "a b"], SIZES)
    seqs = list(data.values()) if by_sent else [[w for (d, _), seq in sorted(data.items()) if d == doc for w in seq] for doc in (1, 2, 3)]
    got = {(a, b): n for a, b, n in rows(cooccurrences(_flat(spark, data), window, by_sent=by_sent, top=None, block_bits=7))}
    assert got == brute_pairs(seqs, window)


def test_wide_windows_of_a_sentences_table(spark):
    data = _words(3, "abc", [(1, s, n) for s, n in enumerate([50, 200, 1, 1, 70], 1)])
    word = F.struct(F.lit(1).alias("part"), "tok_ix", F.col("FORM").alias("tok_form"), F.col("LEMMA").alias("lemma"))
    df = _flat(spark, data).groupBy("doc_id", "sent_ix").agg(F.sort_array(F.collect_list(F.struct("tok_ix", word.alias("w"))))["w"].alias("words"))
    got = {(a, b): n for a, b, n in rows(cooccurrences(df, 80, by_sent=False, top=None))}
    assert got == brute_pairs([[w for seq in data.values() for w in seq]], 80)


def test_pairs_of_a_wide_window_are_counted_in_their_block(spark):
    """Three terms are at most nine rows a block, not a row for each pair of places."""
    df = _flat(spark, _words(1, "abc", [(1, 1, 2000)]))
    terms = df.select("doc_id", "sent_ix", "tok_ix", F.col("FORM").alias("term"))
    pairs = _ordered_pairs(terms, 500, 16, False)
    assert pairs.count() <= 9
    assert pairs.agg(F.sum("rows")).first()[0] == sum(min(500, 1999 - i) for i in range(2000))


def _sentences(spark, data):
    """A sentences table of ``(doc, sentence, terms)``, whose rows may share their sentence."""
    word = "transform(terms, (t, i) -> named_struct('part', 1, 'tok_form', t, 'lemma', t)) AS words"
    return spark.createDataFrame(data, "doc_id long, sent_ix long, terms array<string>").repartition(3).selectExpr("doc_id", "sent_ix", word)


def test_pairs_of_a_narrow_window_are_counted_before_they_are_rows(spark, monkeypatch):
    """Three terms are six rows, with or without sentences to cross; where few are held, counts are told in parts."""
    df = _sentences(spark, [(1, s, list("abc") * 20) for s in range(1, 40)]).coalesce(1)
    rows_ = df.selectExpr("words.lemma AS terms", "size(words) AS firsts")
    assert windows.near_pairs(rows_, 3).count() == 6
    expected = {r[:2]: r[2] for r in rows(cooccurrences(df, 3, by_sent=False, top=None))}
    assert expected == brute_pairs([list("abc") * 20 * 39], 3)
    for name, limit in (("TERMS", 100), ("PAIRS", 2), ("NAMES", 2), ("ROWS", 2)):
        monkeypatch.setattr(windows, name, limit)
    assert windows.near_pairs(rows_, 3).count() > 6
    assert {r[:2]: r[2] for r in rows(cooccurrences(df, 3, by_sent=False, top=None))} == expected


@pytest.mark.parametrize("window", [1, 3, 6])
@pytest.mark.parametrize("block_bits", [1, 2, 16])
def test_sentences_that_share_their_number(spark, window, block_bits):
    """Rows of one sentence are one when they meet the next; a pair inside a row is near in that row."""
    rng = random.Random(window)
    data = [(d, s, [rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 5]))])
            for d in (1, 2) for s in (1, 2, 2, 3, 4, 4, 4, 5, 300)]
    expected = Counter()
    for _, _, terms in data:
        expected.update({p: n for p, n in brute_pairs([terms], window).items()})
    for doc in (1, 2):
        placed = sorted((s, i, t) for d, s, terms in data if d == doc for i, t in _ends(terms, window))
        for i, (s, _, a) in enumerate(placed):
            for z, _, b in placed[i + 1 : i + 1 + window]:
                if s != z:
                    expected[min(a, b), max(a, b)] += 2
    got = cooccurrences(_sentences(spark, data), window, by_sent=False, top=None, block_bits=block_bits)
    assert {(a, b): n for a, b, n in rows(got)} == expected


def _ends(terms, window):
    placed = list(enumerate(terms))
    return placed if len(placed) <= 2 * window else placed[:window] + placed[-window:]


def test_sentences_move_as_one_row(spark):
    """What meets across sentences is not taken apart into a row for each term."""
    ends = cooccurrence._sentence_ends(cooccurrence._sequences(_sentences(spark, [(1, s, list("abcd")) for s in range(9)]), True, None, True), 3)
    assert ends.count() == 9


def _annotated(spark, texts, layers, lexicon=None):
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    return annotate(docs, layers, lexicon=lexicon)


def test_what_follows_from_a_tag_is_not_searched(spark):
    """Relations are elements of an array by the tag's number, not entries of a map of tags."""
    bare = Lexicon(tags={}, contractions={}, names={})
    plan = _annotated(spark, ["A b."], "tokenize,depparse", bare)._jdf.queryExecution().optimizedPlan().toString()
    assert "try_element_at" not in plan and "keys:" not in plan


def test_capitals_at_the_opening_with_own_tags(spark):
    """Only the capital's rule minds the opening; a listed tag stays, also in split tokens and odd tags."""
    lexicon = Lexicon(tags={("en", "ann"): ("ann", "PROPN"), ("en", "odd"): ("odd", "ODD")},
                      contractions={("en", "Xy".lower()): ["Not", "Us"]}, names={})
    texts = ["Ann saw Bob", "\"Bob saw Odd", "Xy saw Ann Xy", "Éa Éb 12 ...", "...", "- Odd"]
    got = _annotated(spark, texts, "tokenize,mwt,pos,depparse,ner", lexicon).orderBy("doc_id").select(
        "words.upos", "words.deprel", "words.head", "entities.text").collect()
    assert [r["upos"] for r in got] == [
        ["PROPN", "NOUN", "PROPN"], ["PUNCT", "NOUN", "NOUN", "ODD"], ["NOUN", "NOUN", "NOUN", "PROPN", "PROPN", "PROPN"],
        ["NOUN", "PROPN", "NUM", "PUNCT", "PUNCT", "PUNCT"], ["PUNCT"] * 3, ["PUNCT", "ODD"]]
    assert [r["deprel"] for r in got][:2] == [["root", "obl", "nmod"], ["punct", "root", "obl", "dep"]]
    assert [r["head"] for r in got][4] == [0, 1, 1]
    assert [r["text"] for r in got] == [["Ann", "Bob"], [], ["Ann Xy"], ["Éb"], [], []]


ODD = ["Ann saw Bob at the inn. It cannot be!", "\"Bob went: Éa Éb 12 ...", "Anna de Buenos Aires", "...", "cannot", "Not A"]


def _through_words(sentences):
    """The same table without what is known of its making, as one that is read from a file."""
    return sentences.select("*")


@pytest.mark.parametrize("layers", ["tokenize", "tokenize,mwt,pos,lemma,depparse,ner", "tokenize,mwt,depparse", "lemma,ner"])
def test_words_are_not_put_together_to_be_taken_apart(spark, layers):
    """tokens come from a sentence's arrays; words are only built where they are kept."""
    s = _annotated(spark, ODD, layers)
    told = views.token_view(s)
    assert "feats" not in told._jdf.queryExecution().optimizedPlan().toString()
    kept = views.token_view(_through_words(s))
    assert told.schema == kept.schema
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, kept.collect()))


def test_a_cached_annotation_is_read(spark):
    """what is kept is not worked out again."""
    s = _annotated(spark, ODD, "tokenize,mwt,pos").cache()
    assert "InMemoryRelation" in views.token_view(s)._jdf.queryExecution().withCachedData().toString()
    s.unpersist()


def test_entities_are_told_without_words(spark):
    """the side of the join that has the entities builds no words, and asks no size of what it has yet to make."""
    s = _annotated(spark, ODD, "tokenize,mwt,pos,ner")
    plan = views.entity_view(s)._jdf.queryExecution().optimizedPlan().toString()
    assert "feats" not in plan and plan.count("regexp_extract_all(text") == 2  # sentences, tokens
    kept = views.entity_view(_through_words(s))
    assert sorted(map(tuple, views.entity_view(s).collect())) == sorted(map(tuple, kept.collect())) != []


def test_only_lines_that_would_break_are_rewritten(spark):
    """one look at a line instead of one at every character of every field."""
    row = (1, "e\tn", 1, 1, "a\tb", "l\n", "N\r", "x\x00", 0, None, "O")
    schema = "doc_id long, lang string, sent_ix long, tok_ix long, FORM string, LEMMA string, UPOS string, XPOS string, HEAD int, DEPREL string, NER string"
    rows = tsv_rows(spark.createDataFrame([row, (2, "en", 1, 1, "a b", "", "N", "x", 0, "d", "O")], schema))
    assert "RLIKE" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [
        (1, "e n", 1, 1, "a b", "l ", "N ", "x ", 0, None, "O"), (2, "en", 1, 1, "a b", "", "N", "x", 0, "d", "O")]


@pytest.mark.parametrize("entries", [50_000, 0])
def test_a_listed_table_is_excluded_in_the_rows(spark, monkeypatch, entries):
    """As flat rows would be, also for sentences that share their number and documents without one."""
    monkeypatch.setattr(vocabulary, "ENTRIES", entries)
    texts = [(1, "en", "A b c a d. b a c e f b"), (2, "en", "a c b"), (2, "en", "c e a d a"), (None, "en", "e d a. d"), (None, "en", "f a e d"),
             (4, "en", None), (5, "es", "Voy al b del a c."), (6, "en", "c")]
    held = annotate(spark.createDataFrame(texts, "doc_id long, lang string, text string"), "tokenize,mwt,lemma")
    listed = spark.createDataFrame([("C",), ("d",), ("zz",), (None,), ("D",)], "word string")
    for window, use_lemma in ((1, True), (3, False)):
        told = cooccurrences(held, window, exclude=listed, top=None, use_lemma=use_lemma)
        flat = cooccurrences(views.token_view(held, ["sent_ix", "tok_ix", "FORM", "LEMMA"]), window, exclude=listed, top=None, use_lemma=use_lemma)
        assert rows(told) == rows(flat) != []


def test_terms_of_sentences_with_a_listed_table_do_not_move(spark):
    held = annotate(spark.createDataFrame([(1, "en", "a b c a d.")], "doc_id long, lang string, text string"), "tokenize,mwt,lemma")
    pairs = cooccurrences(held, exclude=spark.createDataFrame([("b",)], "word string"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Window" not in plan, "the text is read once, and no token is numbered"


def test_lemmas_of_a_word_cloud_are_counted_once_and_chosen_after(spark):
    docs = spark.createDataFrame([(1, "en", "The cat saw a cat. It saw the dog, the dog saw it. x x x x")], "doc_id long, lang string, text string")
    cloud = chartdata.wordcloud_weights(annotate(docs, "tokenize,mwt,lemma"), stopwords=["the"], top=3)
    assert [tuple(r) for r in cloud.collect()] == [("saw", 3, 1.0), ("cat", 2, 2 / 3), ("dog", 2, 2 / 3)]
    plan = cloud._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") == 1 and "scalar-subquery" not in plan
    below = plan[plan.index("Aggregate [LEMMA"):] if "Aggregate [LEMMA" in plan else plan[plan.index("Aggregate"):]
    assert "length(" not in below and " NOT " not in below
    every = chartdata.wordcloud_weights(annotate(docs, "tokenize,mwt,lemma"), stopwords=["the"], top=None)
    assert {tuple(r) for r in cloud.collect()} <= {tuple(r) for r in every.collect()}


@pytest.mark.parametrize("by_sent", [True, False])
def test_few_pairs_are_those_of_all(spark, monkeypatch, by_sent):
    rng = random.Random(3)
    texts = [(d, "en", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz")[: rng.randint(0, 1)] + rng.choice("xyzéß") for _ in range(80)) + ".") for d in range(30)]
    held = annotate(spark.createDataFrame(texts, "doc_id long, lang string, text string"), "tokenize,mwt,lemma")
    flat = views.token_view(held, ["sent_ix", "tok_ix", "FORM", "LEMMA"])
    made = []
    monkeypatch.setattr(cooccurrence, "heavy_pairs", lambda *given: made.append(windows.heavy_pairs(*given)) or made[-1])
    for table in [held, flat] if not by_sent else [flat]:
        every = [tuple(r) for r in cooccurrences(table, 3, by_sent=by_sent, top=None).collect()]
        for top in (1, 7, 20, 1000):
            assert [tuple(r) for r in cooccurrences(table, 3, by_sent=by_sent, top=top).collect()] == every[:top]
        assert made[-4].select(F.least("a", "b"), F.greatest("a", "b")).distinct().count() < len(every) / 2
