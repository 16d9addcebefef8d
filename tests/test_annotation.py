import sys
import warnings
from types import SimpleNamespace as N

import pytest
from golden import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verbaloom.functions import layer_list, normalise_layers
from verbaloom.operators import frequencies, views
from verbaloom.operators.lexicon import CLOSED_CLASS, Lexicon
from verbaloom.operators.plugin import DocumentTreeAnnotator, tree_sentence
from verbaloom.operators.whitespace import WhitespaceAnnotator
from verbaloom.plans import annotate
from verbaloom.schemas import ENTITY, UPOS_TAGS, WORD
from verbaloom.sources import corpus_from_text

# The plug-ins below are defined here; executors do not have this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sentences_of(spark, text, lang="es", **options):
    return annotate(corpus_from_text(spark, text, lang), **options)


def test_contraction_keeps_word_and_token_indices_apart(spark):
    s = sentences_of(spark, "Voy al cine")
    tokens = rows(views.token_view(s, ["tok_ix", "FORM", "LEMMA", "UPOS", "HEAD"]).drop("doc_id", "lang"))
    assert tokens == [(1, "Voy", "ir", "VERB", 0), (2, "al", "a", "ADP", 1), (3, "cine", "cine", "NOUN", 1)]
    words = rows(views.word_view(s).select("word_id", "tok_ix", "TOK_FORM", "FORM"))
    assert words == [(1, 1, "Voy", "Voy"), (2, 2, "al", "a"), (3, 2, "al", "el"), (4, 3, "cine", "cine")]


# The hand-made parse: "al" is one token of two words, and the head of "a" is word 4.
PARSED = {
    "text": "Voy al cine",
    "words": [
        {"tok_ix": 1, "part": 1, "tok_form": "Voy", "form": "Voy", "lemma": "ir", "upos": "VERB", "head": 0, "deprel": "root"},
        {"tok_ix": 2, "part": 1, "tok_form": "al", "form": "a", "lemma": "a", "upos": "ADP", "head": 4, "deprel": "case"},
        {"tok_ix": 2, "part": 2, "tok_form": "al", "form": "el", "lemma": "el", "upos": "DET", "head": 4, "deprel": "det"},
        {"tok_ix": 3, "part": 1, "tok_form": "cine", "form": "cine", "lemma": "", "upos": None, "head": 1, "deprel": "obl"},
    ],
    "entities": [],
}


class Fixed:
    """Returns the same sentences for every text."""

    def __init__(self, sentences):
        self.sentences = sentences

    def open(self, lang, layers):
        return self

    def annotate(self, texts):
        return [self.sentences for _ in texts]


def test_heads_are_words_not_tokens(spark):
    s = sentences_of(spark, "x", annotator=Fixed([PARSED]))
    assert rows(views.token_view(s).select("tok_ix", "FORM", "LEMMA", "UPOS", "XPOS", "HEAD", "DEPREL", "NER")) == [
        (1, "Voy", "ir", "VERB", "_", 0, "root", "O"),
        (2, "al", "a", "ADP", "_", 4, "case", "O"),
        (3, "cine", "_", "_", "_", 1, "obl", "O"),
    ]
    expected = [("ROOT", "Voy"), ("cine", "a"), ("cine", "el"), ("Voy", "cine")]
    assert rows(views.head_forms(s).select("head_form", "dep_form")) == expected
    flat = views.join_head_forms(views.word_view(s)).orderBy("word_id")
    assert rows(flat.select("head_form", "FORM")) == expected


def test_unknown_head_is_root(spark):
    lost = {**PARSED, "words": [{**PARSED["words"][0], "head": 9}, {**PARSED["words"][3], "head": None}]}
    s = sentences_of(spark, "x", annotator=Fixed([lost]))
    assert rows(views.head_forms(s).select("head_form")) == [("ROOT",), ("ROOT",)]
    assert rows(views.token_view(s, ["HEAD"]).select("HEAD")) == [(9,), (0,)]


def test_later_entities_overwrite_earlier_ones(spark):
    words = [{"tok_ix": i, "part": 1, "tok_form": f"t{i}", "form": f"t{i}"} for i in range(1, 8)]
    entities = [
        {"type": "A", "text": "t2 t3 t4", "tok_start": 2, "tok_end": 4},
        {"type": "B", "text": "t4 t5", "tok_start": 4, "tok_end": 5},
        {"type": "C", "text": "t3", "tok_start": 3, "tok_end": 3},
        {"type": "D", "text": "elsewhere"},
    ]
    s = sentences_of(spark, "x", annotator=Fixed([{"text": "x", "words": words, "entities": entities}]))
    expected = ["O", "B-A", "B-C", "B-B", "I-B", "O", "O"]
    assert [r[0] for r in rows(views.token_view(s, ["NER"]).select("NER"))] == expected
    tokens = views.token_view(s, ["sent_ix", "tok_ix", "FORM"])
    joined = views.join_bio_tags(tokens, views.entity_view(s).where("tok_start IS NOT NULL"))
    assert [r[0] for r in rows(joined.orderBy("tok_ix").select("NER"))] == expected


def test_names_and_openings(spark):
    s = sentences_of(spark, "¡Ayer llegó con Anna de Buenos Aires para un curso UNESCO!\n¿Qué más?")
    assert rows(views.entity_view(s).select("type", "text", "tok_start", "tok_end")) == [
        ("PER", "Anna", 5, 5), ("LOC", "Buenos Aires", 7, 8), ("ORG", "UNESCO", 12, 12)]
    tags = rows(views.token_view(s, ["sent_ix", "tok_ix", "UPOS"]).select("UPOS"))
    assert tags[1] == ("ADV",) and ("PROPN",) not in tags[13:]


def test_german_capitals_are_no_names(spark):
    s = sentences_of(spark, "Er geht zum Haus.", "de")
    assert views.entity_view(s).count() == 0


def test_every_ink_character_is_in_one_token(spark):
    text = "... Hm!? (a_b)\t12.5%\r\n\n  \x07 “x” ñandú é  fin"
    s = sentences_of(spark, text)
    joined = "".join(r[0] for r in rows(views.token_view(s, ["FORM"]).select("FORM")))
    assert joined == "...Hm!?(a_b)12.5%“x”ñandúéfin"
    lengths = frequencies.sentence_lengths(s)
    assert lengths.agg(F.sum("length")).first()[0] == views.token_view(s, ["FORM"]).count()


def test_empty_documents_have_no_sentences(spark):
    docs = spark.createDataFrame([(1, "en", ""), (2, "en", None), (3, None, " \n "), (4, None, "A b")],
                                 "doc_id long, lang string, text string")
    assert rows(annotate(docs).select("doc_id", "sent_ix", "text")) == [(4, 1, "A b")]
    plugged = annotate(docs, annotator=WhitespaceAnnotator())
    assert rows(plugged.select("doc_id", "sent_ix", "text")) == [(4, 1, "A b")]


@pytest.mark.parametrize("layers, empty", [
    ("tokenize", ["LEMMA", "UPOS", "DEPREL"]), ("tokenize,pos", ["LEMMA", "DEPREL"]),
    ("tokenize,lemma", ["UPOS", "DEPREL"]), ("depparse", ["LEMMA", "UPOS"]), ("ner", ["LEMMA", "UPOS", "DEPREL"]),
])
def test_layers_that_were_not_asked_for(spark, layers, empty):
    s = sentences_of(spark, "Voy al parque con Anna.", layers=layers)
    view = views.token_view(s)
    assert view.count() == 6
    for name in ("LEMMA", "UPOS", "DEPREL"):
        assert (view.where(F.col(name) != "_").count() == 0) == (name in empty), name
    assert (views.entity_view(s).count() == 0) == ("ner" not in layers)
    assert ("el" in {r[0] for r in rows(views.word_view(s).select("FORM"))}) == ("mwt" in layers)


def test_annotation_does_not_shuffle(spark):
    s = sentences_of(spark, "Voy al cine.")
    for df in (s, views.token_view(s), views.word_view(s), views.entity_view(s), views.head_forms(s)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_conditions_stay_above_the_annotation(spark):
    """A condition on words must not copy the annotation's expressions below itself."""
    plain = sentences_of(spark, "Voy al cine.")
    filtered = plain.where(F.size("words") > 2).where(F.array_contains("words.upos", "VERB"))
    size = len(plain._jdf.queryExecution().optimizedPlan().toString())
    assert len(filtered._jdf.queryExecution().optimizedPlan().toString()) < 1.5 * size
    assert filtered.count() == 1


def test_own_lexicon(spark):
    lexicon = Lexicon(tags={("xx", "gato"): ("GATO", "ADJ")}, contractions={}, names={})
    s = sentences_of(spark, "el gato al Sol", "xx", lexicon=lexicon)
    assert rows(views.token_view(s, ["LEMMA", "UPOS"]).select("LEMMA", "UPOS")) == [
        ("el", "NOUN"), ("GATO", "ADJ"), ("al", "NOUN"), ("sol", "PROPN")]
    bare = sentences_of(spark, "el gato", "xx", lexicon=Lexicon({}, {}, {}))
    assert rows(views.token_view(bare, ["LEMMA", "UPOS"]).select("LEMMA", "UPOS")) == [("el", "NOUN"), ("gato", "NOUN")]


def test_lexicon_uses_known_tags():
    assert {tag for by_tag in CLOSED_CLASS.values() for tag in by_tag} <= set(UPOS_TAGS)


def test_layer_names(spark):
    given = " ner, tokenize,pos,,pos ,foo"
    assert normalise_layers(given) == ("tokenize,pos,ner,foo", ["unknown layers: foo"])
    df = spark.createDataFrame([(given,)], "layers string")
    assert rows(df.select(F.array_join(layer_list(F.col("layers")), ",")))[0][0] == "tokenize,pos,ner,foo"
    with pytest.warns(UserWarning, match="foo"):
        sentences_of(spark, "x", layers=given)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        sentences_of(spark, "x", layers="pos")


# --- plug-ins -----------------------------------------------------------------------------

class CountsOpenings:
    """Every word's lemma tells how often the model was opened in this task."""

    def __init__(self):
        self.opened = 0

    def open(self, lang, layers):
        self.opened += 1
        self.seen = f"{self.opened}|{lang}|{layers}"
        return Bound(self.seen)


class Bound:
    def __init__(self, seen):
        self.seen = seen

    def annotate(self, texts):
        return [[{"text": t, "words": [{"tok_ix": 1, "part": 1, "tok_form": t, "form": t, "lemma": self.seen}]}]
                for t in texts]


def test_model_is_opened_once_per_task_and_language(spark):
    docs = spark.createDataFrame([(i, "es" if i % 2 else "en", f"t{i}") for i in range(200)],
                                 "doc_id long, lang string, text string").coalesce(1)
    s = annotate(docs, "pos,tokenize", annotator=CountsOpenings())
    got = rows(views.token_view(s, ["FORM", "LEMMA"]))
    assert len(got) == 200 and {r[2] for r in got} == {f"t{i}" for i in range(200)}
    assert {r[3].split("|")[0] for r in got} == {"1", "2"}
    assert {r[3].split("|", 1)[1] for r in got} == {"en|tokenize,pos", "es|tokenize,pos"}
    assert all(r[1] == r[3].split("|")[1] for r in got)


def test_string_ids_pass_through_plugins(spark):
    docs = spark.createDataFrame([("a/1", "en", "x y\nz")], "doc_id string, lang string, text string")
    s = annotate(docs, annotator=WhitespaceAnnotator())
    assert rows(s.select("doc_id", "sent_ix", "text")) == [("a/1", 1, "x y"), ("a/1", 2, "z")]


def _tree(text):
    def word(form, **more):
        return N(text=form, **{"lemma": form.lower(), "upos": "X", "xpos": None, "feats": None, **more})
    al = N(text="al", words=[word("a", head=4, deprel="case"), word("el", head=4, deprel="det")])
    voy = N(text="Voy", words=[word("Voy", head=0, deprel="root")])
    cine = N(text="cine", words=[word("cine", head=1, deprel="obl", feats="Gender=Masc")])
    other = N(text="?", words=[])
    ents = [N(type="MISC", text="al cine", tokens=[al, cine]), N(type="LOC", text="?", tokens=[other])]
    return N(sentences=[N(text=text, tokens=[voy, al, cine], ents=ents)])


def test_document_trees(spark):
    s = sentences_of(spark, "Voy al cine", annotator=DocumentTreeAnnotator(lambda lang, layers: _tree))
    assert rows(views.token_view(s).select("tok_ix", "FORM", "HEAD", "NER")) == [
        (1, "Voy", 0, "O"), (2, "al", 4, "B-MISC"), (3, "cine", 1, "I-MISC")]
    assert rows(views.word_view(s).select("word_id", "FORM", "FEATS"))[3] == (4, "cine", "Gender=Masc")
    assert rows(views.entity_view(s).select("type", "text", "tok_start")) == [("MISC", "al cine", 2), ("LOC", "?", None)]
    row = tree_sentence(_tree("t").sentences[0])
    assert set(row["words"][0]) <= set(WORD.fieldNames()) and set(row["entities"][0]) <= set(ENTITY.fieldNames())
