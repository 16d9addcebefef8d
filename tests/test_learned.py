"""Lookups in large tables, the tagger, the parser and names against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbaloom.operators import abbreviations, heaviest, lemmatizer, lexicon_table, names, parser, segment, tagger, views, vocabulary
from verbaloom.plans import annotate
from verbaloom.schemas import UPOS_TAGS


def sentences_of(spark, texts, layers="tokenize,mwt,pos,lemma"):
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(texts)], "doc_id long, lang string, text string")
    return annotate(docs, layers)


@pytest.mark.parametrize("share", [1, 3, 10**9])
def test_lookup_of_frequent_and_rare_keys(spark, monkeypatch, share):
    monkeypatch.setattr(vocabulary, "SHARE", share)
    draw = random.Random(1)
    rows = [(i % 7 if i % 5 else None, i, [draw.choice(["the", "of", None, f"w{draw.randrange(40)}", ""]) for _ in range(draw.randrange(6))]) for i in range(80)]
    rows += [rows[3], rows[3], (50, 50, []), (51, 51, None)]
    table = [(f"w{k}", (k, [f"x{k}"])) for k in range(0, 40, 2)] + [("the", (-1, [])), ("", (0, None))]
    frame = spark.createDataFrame(rows, "a long, b long, keys array<string>")
    lexicon = spark.createDataFrame(table, "key string, value struct<n:long,list:array<string>>")
    got = vocabulary.looked_up(frame, "keys", lexicon, "found", ["a", "b"])
    assert got.columns == ["a", "b", "keys", "found"]
    answers = dict(table)
    want = [(a, b, keys, None if keys is None else [answers.get(k) for k in keys]) for a, b, keys in rows]
    assert sorted(map(str, want)) == sorted(str((r.a, r.b, r["keys"], None if r.found is None else [None if v is None else tuple(v) for v in r.found])) for r in got.collect())
    empty = vocabulary.looked_up(frame, "keys", lexicon.limit(0), "found", ["a", "b"])
    assert all(v is None for r in empty.collect() for v in r.found or [])
    assert vocabulary.looked_up(frame.limit(0), "keys", lexicon, "found", ["a", "b"]).collect() == []


@pytest.mark.parametrize("share", [1, 3, 10**9])
def test_rows_are_moved_without_answers(spark, monkeypatch, share):
    """The maps of frequent keys are as large as thousands of rows: no shuffle may carry them, nor an expression's keys."""
    monkeypatch.setattr(vocabulary, "SHARE", share)
    monkeypatch.setattr(vocabulary, "ENTRIES", 0)
    rows = [(i % 4 if i % 5 else None, i % 9, ["the", f"w{i % 6}", None, "x"][: i % 5]) for i in range(40)] + [(7, 7, None)]
    frame = spark.createDataFrame(rows, "a long, b long, words array<string>")
    table = [("THE", (1,)), ("W1", (2,)), ("W5", (3,)), ("Y", (4,))]
    lexicon = spark.createDataFrame(table, "key string, value struct<n:long>")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = vocabulary.looked_up(frame, F.transform("words", F.upper), lexicon, "found", ["a", "b"])
        told = got.collect()
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any("maps" in columns.replace("found_map", "") for columns in moved)
    answers = dict(table)
    want = [(a, b, words, None if words is None else [answers.get(w.upper()) if w else None for w in words]) for a, b, words in rows]
    assert sorted(map(str, want)) == sorted(str((r.a, r.b, r.words, None if r.found is None else [None if v is None else tuple(v) for v in r.found])) for r in told)


def test_plan_does_not_grow_with_the_lexicon(spark):
    sentences = sentences_of(spark, [("en", "The cat saw Paris."), ("de", "The Katze.")])
    plans = []
    for size in (10, 100_000):
        lexicon = spark.range(size).select(F.lit("en").alias("lang"), F.concat(F.lit("cat"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("form"),
                                           F.lit("katz").alias("lemma"), F.lit("VERB").alias("upos"))
        told = lexicon_table.apply_lexicon(sentences, lexicon)
        words = {(r.FORM, r.LEMMA, r.UPOS) for r in views.word_view(told).collect()}
        assert ("cat", "katz", "VERB") in words and ("Katze", "katze", "NOUN") in words
        plans.append(len(told._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[0] - plans[1]) < 200


def test_lexicon_leaves_what_it_does_not_say(spark):
    entries = [("en", "cat", None, "ADJ"), ("en", "saw", "see", None), ("en", "cat", "b", "VERB"), (None, "x", "nolang", "SYM"), ("en", None, "z", "X")]
    lexicon = spark.createDataFrame(entries, "lang string, form string, lemma string, upos string")
    told = lexicon_table.apply_lexicon(sentences_of(spark, [("en", "Cat saw x"), (None, "x cat"), ("de", "saw"), ("en", None), ("en", "")]), lexicon)
    words = sorted((r.doc_id, r.FORM, r.LEMMA, r.UPOS) for r in views.word_view(told).collect())
    assert words == [(0, "Cat", "cat", "ADJ"), (0, "saw", "see", "NOUN"), (0, "x", "x", "NOUN"), (1, "cat", "cat", "NOUN"), (1, "x", "nolang", "SYM"), (2, "saw", "saw", "NOUN")]


def best_paths(choices, steps):
    """All paths of the best score."""
    border, states = tagger.BORDER, tagger.STATES
    scored = {}
    for path in itertools.product(*[[t for t, _ in c] for c in choices]):
        own = sum(dict(c)[t] for c, t in zip(choices, path, strict=True))
        moves = sum(steps[a * states + b] for a, b in itertools.pairwise([border, *path, border]))
        scored[path] = own + moves
    top = max(scored.values())
    return {p for p, s in scored.items() if s == top}


def test_decoding_equals_all_paths(spark):
    draw = random.Random(2)
    steps = [draw.randint(-3000, 0) for _ in range(tagger.STATES**2)]
    rows = [(i, [sorted((t, draw.randint(-900, 0)) for t in draw.sample(range(18), draw.randint(1, 4))) for _ in range(draw.randint(0, 6))]) for i in range(150)]
    frame = spark.createDataFrame(rows, f"id long, choices array<{tagger.CANDIDATES}>")
    for r in frame.select("id", tagger.viterbi(F.col("choices"), steps).alias("tags")).collect():
        assert tuple(UPOS_TAGS.index(t) for t in r.tags) in best_paths(rows[r.id][1], steps)
    even = frame.select("id", tagger.viterbi(F.col("choices"), [0] * tagger.STATES**2).alias("tags")).collect()
    assert all(tuple(UPOS_TAGS.index(t) for t in r.tags) in best_paths(rows[r.id][1], [0] * tagger.STATES**2) for r in even)
    tie = spark.createDataFrame([([[(2, 0), (5, 0)], [(1, 0), (7, 0)]],)], f"choices array<{tagger.CANDIDATES}>")
    assert tie.select(tagger.viterbi(F.col("choices"), [0] * tagger.STATES**2)).first()[0] == [UPOS_TAGS[2], UPOS_TAGS[1]]


def test_decoding_moves_nothing(spark):
    frame = spark.createDataFrame([([[(2, 0)]],)], f"choices array<{tagger.CANDIDATES}>")
    assert "Exchange" not in frame.select(tagger.viterbi(F.col("choices"), [0] * tagger.STATES**2))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in parser.parse_sentences(sentences_of(spark, [("en", "a b")]))._jdf.queryExecution().executedPlan().toString()


def test_a_tagger_learns_what_context_tells(spark):
    """The same form is a noun after a determiner and a verb after a pronoun; endings tell unknown words."""
    lines = ["the/DET run/NOUN", "we/PRON run/VERB", "the/DET walk/NOUN ended/VERB", "they/PRON walk/VERB", "a/DET long/ADJ walk/NOUN",
             "we/PRON slowly/ADV run/VERB", "quickly/ADV they/PRON run/VERB", "she/PRON jumped/VERB", "the/DET talk/NOUN started/VERB", "we/PRON talk/VERB"] * 3
    rows = [(i, "en", 1, k, *word.split("/")) for i, line in enumerate(lines) for k, word in enumerate(line.split())]
    tokens = spark.createDataFrame(rows, "doc_id long, lang string, sent_ix long, tok_ix long, FORM string, UPOS string")
    model = tagger.train_tagger(tokens)
    told = tagger.tag_sentences(sentences_of(spark, [("en", "the run"), ("en", "we run"), ("en", "They hopped"), ("en", "we nicely walk"), ("fr", "le run")], "tokenize"), model)
    tags = {r.doc_id: [w.upos for w in r.words] for r in told.collect()}
    assert tags == {0: ["DET", "NOUN"], 1: ["PRON", "VERB"], 2: ["PRON", "VERB"], 3: ["PRON", "ADV", "VERB"], 4: ["X", "X"]}
    flat = tagger.tag_tokens(tokens.drop("UPOS"), model)
    right = flat.withColumnRenamed("UPOS", "told").join(tokens, ["doc_id", "sent_ix", "tok_ix"]).filter("told = UPOS").count()
    assert right == len(rows)
    nothing = tagger.train_tagger(tokens.limit(0))
    assert {w.upos for r in tagger.tag_sentences(sentences_of(spark, [("en", "the run")], "tokenize"), nothing).collect() for w in r.words} == {"X"}


def assert_tree(heads):
    n = len(heads)
    assert n == 0 or heads.count(0) == 1
    for word in range(1, n + 1):
        seen, at = 0, word
        while at:
            at, seen = heads[at - 1], seen + 1
            assert 0 <= at <= n and seen <= n
    arcs = [(min(i, h), max(i, h)) for i, h in enumerate(heads, 1) if h]
    assert not any(a < c < b < d for a, b in arcs for c, d in arcs)


def test_trees_are_trees(spark):
    draw = random.Random(3)
    model = parser.Parser([draw.randint(-50, 50) for _ in range(18 * 18 * 6)], [draw.randint(-50, 50) for _ in range(18)], ["r"] * (18 * 18 * 2))
    rows = [(i, [draw.randrange(18) for _ in range(draw.randint(0, 25))]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, tags array<int>")
    shapes = {}
    for r in frame.select("id", parser.heads(F.col("tags"), model).alias("heads")).collect():
        assert len(r.heads) == len(rows[r.id][1])
        assert_tree(r.heads)
        shapes.setdefault(len(r.heads), set()).add(tuple(r.heads))
    assert sum(len(s) > 3 for n, s in shapes.items() if n > 3) > 15
    level = frame.select(parser.heads(F.col("tags"), parser.Parser([0] * (18 * 18 * 6), [0] * 18, ["r"] * (18 * 18 * 2))).alias("heads")).collect()
    assert all(r.heads == [*range(2, len(r.heads) + 1), 0][: len(r.heads)] for r in level)  # ties: left first


def test_baseline_trees(spark):
    told = parser.parse_sentences(sentences_of(spark, [("en", "The war in Berlin came and Paul said it.")], "tokenize,mwt,pos"))
    words = {w.form: (w.head, w.deprel) for w in told.first().words}
    forms = [w.form for w in told.first().words]
    assert forms[words["The"][0] - 1] == "war" and forms[words["in"][0] - 1] == "Berlin" and forms[words["war"][0] - 1] == "came"
    assert sum(h == 0 for h, _ in words.values()) == 1 and {d for _, d in words.values()} >= {"root", "det", "case"}


def test_a_parser_learns_its_arcs(spark):
    lines = [("DET", 2, "det"), ("NOUN", 3, "nsubj"), ("VERB", 0, "root"), ("DET", 5, "det"), ("NOUN", 3, "obj")]
    rows = [(i, 1, k, *line) for i in range(20) for k, line in enumerate(lines, 1)] + [(99, 1, 1, "X", 7, "bad"), (99, 1, 2, None, None, None), (99, 1, None, "NOUN", 1, "odd")]
    words = spark.createDataFrame(rows, "doc_id long, sent_ix long, word_id int, UPOS string, HEAD int, DEPREL string")
    told = parser.parse_words(words.filter("doc_id < 2"), parser.train_parser(words)).orderBy("doc_id", "word_id").collect()
    assert [(r.HEAD, r.DEPREL) for r in told] == [(h, d) for _, h, d in lines] * 2
    assert len(parser.train_parser(words.limit(0)).scores) == 18 * 18 * 6


def test_names_leftmost_longest(spark):
    table = [("New York", "LOC"), ("New York Times", "ORG"), ("york", "PER"), ("Times Square", "LOC"), ("a b c d e f g", "WORK"), ("a", "PER"), ("a", "AAA"),
             ("", "X"), (None, "X"), ("d.", "DOT"), ("Größe", "WORK")]
    texts = [("en", "new york times square in York"), ("en", "A b c d e f a b c d e f g"), ("en", "a b c"), (None, "GRÖSSE Größe d ."), ("en", "nothing here"), ("en", None)]
    told = names.apply_names(sentences_of(spark, texts, "tokenize"), spark.createDataFrame(table, "name string, type string"))
    found = {}
    for r in views.entity_view(told).orderBy("doc_id", "sent_ix", "ent_ix").collect():
        found.setdefault(r.doc_id, []).append((r.ent_ix, r.type, r.text, r.tok_start, r.tok_end))
    assert found == {
        0: [(1, "ORG", "new york times", 1, 3), (2, "PER", "York", 6, 6)],
        1: [(1, "AAA", "A", 1, 1), (2, "WORK", "a b c d e f g", 7, 13)], 2: [(1, "AAA", "a", 1, 1)], 3: [(1, "WORK", "Größe", 2, 2), (2, "DOT", "d .", 3, 4)]}
    assert names.apply_names(sentences_of(spark, texts, "tokenize"), spark.createDataFrame([], "name string, type string")).filter("size(entities) > 0").isEmpty()


def test_words_with_other_values_are_made_once(spark):
    held = sentences_of(spark, [("en", "Some words here."), ("en", "")], "tokenize")
    lexicon = spark.createDataFrame([("en", "words", "word", "NOUN")], "lang string, form string, lemma string, upos string")
    view = views.word_view(lexicon_table.apply_lexicon(held, lexicon))
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate explode(array(struct(words"), "what is asked of words stays above them"
    assert [(r.FORM, r.LEMMA, r.UPOS) for r in view.collect()] == [("Some", None, None), ("words", "word", "NOUN"), ("here", None, None), (".", None, None)]


@pytest.mark.parametrize("seconds", [0, 1, 256])
def test_stretches_follow_two_tokens(spark, monkeypatch, seconds):
    monkeypatch.setattr(names, "SECONDS", seconds)
    table = [("a b", "X"), ("a c d e", "Y"), ("a c", "Z"), ("f", "W"), ("f g", "V"), ("a a", "U")]
    starts, whole = names.name_tables(spark.createDataFrame(table, "name string, type string"))
    words = "a b a c d f f g a z a c d e a a b a".split()
    found = {r.key: r.value for r in starts.collect()}
    row = spark.createDataFrame([(words, [found.get(w) for w in words])], "words array<string>, " + f"starts array<{starts.schema['value'].dataType.simpleString()}>")
    told = row.select(names._stretches(F.col("words"), F.col("starts")).alias("s")).first().s
    named = {r.key for r in whole.collect()}
    picked = [(r.start, r.length, r.phrase) for r in told if r.phrase in named]
    assert picked == [(i + 1, n, p) for i in range(len(words)) for n in (4, 3, 2, 1) if i + n <= len(words) and (p := " ".join(words[i:i + n])) in named]
    # By the longest name alone there would be 4 for every "a", as far as the row goes, and 2 for every "f".
    assert len(told) < 25 and (seconds < 256 or len(told) <= len(picked) + 2)


def test_many_names_do_not_grow_the_plan(spark):
    sentences = sentences_of(spark, [("en", "It is name 77777 x y z here.")], "tokenize")
    plans = []
    for size in (10, 100_000):
        table = spark.range(size).select(F.concat(F.lit("name "), F.col("id").cast("string"), F.lit(" x y z")).alias("name"), F.lit("LOC").alias("type"))
        told = names.apply_names(sentences, table)
        plans.append(len(told._jdf.queryExecution().optimizedPlan().toString()))
        assert [r.text for r in views.entity_view(told).collect()] == (["name 77777 x y z"] if size > 10 else [])
    assert abs(plans[0] - plans[1]) < 200


def test_lemmas_of_unknown_words_follow_their_endings(spark):
    """Rules learned from four fifths of regular forms give the rest their lemmas."""
    draw = random.Random(8)
    stems = sorted({"".join(draw.choices("bdfgklmnprt", k=2)) + draw.choice("aiou") + "".join(draw.choices("bdfgklmnprt", k=2)) for _ in range(400)})
    pairs = [(s + e, s, "VERB") for s in stems for e in ("ed", "ing", "")] + [(s + e, s + a, "NOUN") for s in stems for e, a in (("s", ""), ("ies", "y"))]
    draw.shuffle(pairs)
    cut = len(pairs) * 4 // 5
    rows = [("en", *p) for p in pairs[:cut]] + [("en", "went", "go", "VERB"), ("en", "went", "go", "VERB"), ("en", "went", "wend", "VERB"), (None, "xs", "x", "NOUN"), ("en", "", "e", "X"), ("en", "y", None, "X")]
    model = lemmatizer.train_lemmatizer(spark.createDataFrame(rows, "lang string, FORM string, LEMMA string, UPOS string"))
    words = [*pairs[cut:], ("Went", "go", "VERB"), ("Unknown", "unknown", "ADV")]
    held = sentences_of(spark, [("en", " ".join(f for f, _, _ in words))], "tokenize")
    tagged = lexicon_table.with_word_values(held, {"upos": F.array(*[F.lit(t) for _, _, t in words])})
    told = [w.lemma for w in lemmatizer.apply_lemmas(tagged, model).first().words]
    assert told[-2:] == ["go", "unknown"]
    right = sum(t == lemma for t, (_, lemma, _) in zip(told, words, strict=True))
    assert right >= 0.97 * len(words)


def test_lemmas_of_a_small_model_move_nothing(spark, monkeypatch):
    rows = [("en", f + e, f, "VERB") for f in ("walk", "talk", "look") for e in ("ed", "ing")] + [("en", "went", "go", "VERB"), (None, "xs", "x", "_"), (None, "ys", "y", "_")]
    model = lemmatizer.train_lemmatizer(spark.createDataFrame(rows, "lang string, FORM string, LEMMA string, UPOS string"))
    texts = [("en", "Went Walked jumping s ing x. Ös went"), (None, "zs Xs went"), ("de", "walked"), ("en", None)]
    held = sentences_of(spark, texts, "tokenize")
    tagged = lexicon_table.with_word_values(held, {"upos": F.transform("words", lambda w: F.when(w["form"] != "x", F.when(F.col("lang") == "en", "VERB")))})
    tagged = tagged.withColumn("words", F.transform("words", lambda w: F.when(w["form"] != "s", w)))
    told = []
    for entries in (vocabulary.ENTRIES, 0):
        monkeypatch.setattr(vocabulary, "ENTRIES", entries)
        lemmas = views.word_view(lemmatizer.apply_lemmas(tagged, model))
        told.append(sorted(map(str, lemmas.select("doc_id", "sent_ix", "word_id", "FORM", "LEMMA").collect())))
        if entries:
            plan = lemmas._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Join") == plan.count("Range (0, 4096") > 0  # only those inside the two values
            assert plan.index("Filter") < plan.index("Generate explode(array(struct(words")
    assert told[0] == told[1] and len(told[0]) == 13


def test_abbreviations_and_their_sentences(spark):
    draw = random.Random(9)
    text = " ".join(f"{''.join(draw.choices('abcdefghij', k=6))} Dr. Smith left{'.' if i % 3 == 0 else ' and'} it cost {i}.14 then" for i in range(200))
    docs = spark.createDataFrame([(1, "en", text), (2, "en", None), (3, None, "a. b"), (4, "de", "")], "doc_id long, lang string, text string")
    found = abbreviations.abbreviations(docs)
    assert "dr" in {r.word for r in found.filter("lang = 'en'").collect()} and not {"smith", "left", "then"} & {r.word for r in found.collect()}
    texts = [("en", "It is 3.14 today. Dr. Smith left."), ("en", "No dr.\nNew line. 3. 4"), ("en", "Dr. dr... Dr.! x"), ("de", "Dr. Smith."), (None, None), ("en", "퟿ Dr.")]
    own = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts)], "doc_id long, lang string, text string")
    listed = spark.createDataFrame([("en", "dr"), ("en", "dr")], "lang string, word string")
    got = {}
    for r in abbreviations.split_by_abbreviations(own, listed).orderBy("doc_id", "sent_ix").collect():
        got.setdefault(r.doc_id, []).append((r.sent_ix, r.text))
    assert got == {
        0: [(1, "It is 3.14 today."), (2, "Dr. Smith left.")], 1: [(1, "No dr."), (2, "New line."), (3, "3."), (4, "4")],
        2: [(1, "Dr. dr..."), (2, "Dr.!"), (3, "x")], 3: [(1, "Dr."), (2, "Smith.")], 5: [(1, "퟿ Dr.")]}
    unlisted = spark.createDataFrame([(1, "en", "A b. C d! E\nf")], "doc_id long, lang string, text string")
    assert [r.text for r in abbreviations.split_by_abbreviations(unlisted, listed).orderBy("sent_ix").collect()] == [r.text for r in segment.split_sentences(unlisted).orderBy("sent_ix").collect()]


@pytest.mark.parametrize("cells", [1, 7, 1 << 16])
def test_heaviest_groups_are_exact(spark, cells):
    draw = random.Random(10)
    rows = [(draw.choice(["a", "b", None, f"k{int(draw.paretovariate(1)) % 500}"]), draw.randrange(3)) for _ in range(5000)]
    counts = Counter(rows)
    want = sorted(((-n, a is not None, a or "", b, a) for (a, b), n in counts.items()))
    frame = spark.createDataFrame(rows, "a string, b int")
    for top in (1, 10, 50, 10_000):
        got = [(-r["count"], r.a is not None, r.a or "", r.b, r.a) for r in heaviest.heaviest(frame, ["a", "b"], top, cells).collect()]
        assert got == want[:top]
    if cells > 7:
        assert heaviest.candidate_counts(frame, ["a", "b"], 10, cells).count() < len(counts) / 4
    assert heaviest.heaviest(frame.limit(0), ["a", "b"], 5, cells).collect() == []


def _groupings(monkeypatch, module):
    """How often the plans that a module stores put sentences together."""
    seen, stored = [], module.checkpoint

    def store(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("collect_list"))
        return stored(df)
    monkeypatch.setattr(module, "checkpoint", store)
    return seen


def test_sentences_are_put_together_once_to_learn(spark, monkeypatch):
    """Counts of single words are taken where the words are; decoding is no fold of expressions."""
    flat = spark.createDataFrame([(d, 1, t, "a", "NOUN", 0, "root") for d in range(3) for t in (1, 2)],
                                 "doc_id long, sent_ix int, tok_ix int, FORM string, UPOS string, HEAD int, DEPREL string")
    words = flat.withColumnRenamed("tok_ix", "word_id")
    seen = _groupings(monkeypatch, parser)
    trees = parser.parse_words(words, parser.train_parser(words))
    assert seen and sum(seen) == 1
    seen = _groupings(monkeypatch, tagger)
    model = tagger.train_tagger(flat)
    assert sum(seen[:2]) == 1  # pairs of tags, and tags of forms
    before = len(seen)
    told = tagger.tag_tokens(flat, model)
    assert sum(seen[before:]) == 0
    for df in (trees, told):
        assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert told.count() == trees.count() == 6


def test_batches_of_sentences_decode_as_each_alone(spark):
    """Sentences of any length, missing and empty ones, in one batch."""
    draw = random.Random(7)
    steps = [draw.randint(-3000, 0) for _ in range(tagger.STATES**2)]
    lists = [[None if draw.random() < 0.2 else sorted((t, draw.randint(-9, 0)) for t in draw.sample(range(18), 3)) for _ in range(n)]
             for n in (0, 1, 40, 2, 0, 7, 3, 300)]
    frame = spark.createDataFrame(list(enumerate(lists)), f"id long, choices array<{tagger.CANDIDATES}>").coalesce(1)
    found = tagger.viterbi(F.col("choices"), steps).alias("tags")
    together = {r.id: r.tags for r in frame.select("id", found).collect()}
    assert together == {i: frame.filter(F.col("id") == i).select(found).first().tags for i in range(len(lists))}
    assert [len(together[i]) for i in range(len(lists))] == [len(c) for c in lists]
    assert all(together[i][j] == "X" for i, c in enumerate(lists) for j, choice in enumerate(c) if choice is None)
    numbers = spark.createDataFrame([(i, [draw.randrange(18) for _ in range(n)]) for i, n in enumerate((0, 1, 30, 2, 9, 200))], "id long, tags array<int>").coalesce(1)
    arcs = parser.heads(F.col("tags"), parser.baseline_parser()).alias("heads")
    both = {r.id: r.heads for r in numbers.select("id", arcs).collect()}
    assert both == {i: numbers.filter(F.col("id") == i).select(arcs).first().heads for i in range(6)}
    assert all(h.count(0) == min(1, len(h)) for h in both.values())
