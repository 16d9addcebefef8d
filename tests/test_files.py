"""Sources, sinks and packs: what is written is read back and compared."""

import json
from pathlib import Path

import pytest
from golden import rows, two_sentences
from pyspark.sql import functions as F

from verbaloom import session
from verbaloom.functions import clean_field, pad_left, sheet_name, slug, time_stamp, value_or
from verbaloom.operators import frequencies, views
from verbaloom.plans import annotate, chart_pack, export_all, stats_pack, store_annotation, summary_pack
from verbaloom.schemas import TOKEN_COLUMNS
from verbaloom.session import ensure_checkpoint_dir
from verbaloom.sinks import (
    conllu,
    conllu_blocks,
    read_report,
    report_lines,
    write_conllu,
    write_json,
    write_report,
    write_tables,
    write_tokens,
)
from verbaloom.sources import corpus_from_table, corpus_from_text, read_text_files, read_tokens

TEXT = "Ayer llegó con Anna de Buenos Aires. Voy al cine \"NA\" 007.\n% null"


@pytest.fixture()
def sentences(spark):
    return annotate(corpus_from_text(spark, TEXT, "es"))


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café\r\nñ".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.md").write_bytes(b"not read")
    docs = read_text_files(spark, str(tmp_path), "es").orderBy("doc_id")
    got = rows(docs)
    assert [Path(r[0]).name for r in got] == ["a.txt", "b.txt"]
    assert [r[1:] for r in got] == [("es", "café\nñ"), ("es", "café")]


def test_hostile_token_table(spark, tmp_path):
    lines = [
        "\t".join(TOKEN_COLUMNS),
        '1\t1\t"\t"\tPUNCT\t_\t0\troot\tO',
        "1\t2\tNA\tnull\tNOUN\t_\tx\tdep\tO",
        "x\t3\t007\t\tNUM\t_\t2.7\t\t",
        "2\t4.0\t sp \tNone\t\t\t-1\tdep\tB-X",
        "9007199254740993\tna\\x\t#x\tnan\tX\t_\tinf\tdep\tO",
    ]
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = read_tokens(spark, str(tmp_path / "t.tsv"))
    assert got.columns == ["doc_id", *TOKEN_COLUMNS]
    assert {r[0].rsplit("/", 1)[1] for r in rows(got)} == {"t.tsv"}
    assert rows(got.drop("doc_id")) == [
        (1, 1, '"', '"', "PUNCT", "_", 0, "root", "O"),
        (1, 2, "NA", "null", "NOUN", "_", 0, "dep", "O"),
        (None, 3, "007", "_", "NUM", "_", 2, "_", "O"),
        (2, 4, " sp ", "None", "_", None, -1, "dep", "B-X"),
        (9007199254740993, None, "#x", "nan", "X", "_", 0, "dep", "O"),
    ]
    raw = read_tokens(spark, str(tmp_path / "t.tsv"), fill=False)
    assert ("_", 1) not in rows(frequencies.summary_lemma_freqs(raw))
    assert ("O", 3) in rows(frequencies.summary_ner_counts(raw))


def test_token_table_may_lack_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("sent_ix\tFORM\n1\ta\n", encoding="utf-8")
    got = read_tokens(spark, str(tmp_path / "t.tsv"))
    assert rows(frequencies.sentence_lengths(got).select("length")) == [(1,)]
    assert rows(frequencies.summary_ner_counts(got)) == []
    with pytest.raises(ValueError, match="UPOS"):
        frequencies.pos_counts(got)


def test_token_table_round_trip(spark, sentences, tmp_path):
    path = str(tmp_path / "tsv")
    write_tokens(sentences, path)
    back = read_tokens(spark, path).withColumn("doc_id", F.col("doc_id").cast("long"))
    assert rows(back.orderBy("sent_ix", "tok_ix")) == rows(views.token_view(sentences).orderBy("sent_ix", "tok_ix"))
    write_tokens(sentences, path + "9", keys=())
    first = next(Path(path + "9").glob("*.csv")).read_text(encoding="utf-8").split("\n")[0]
    assert first == "\t".join(TOKEN_COLUMNS)


def test_line_breaking_characters_become_spaces(spark, tmp_path):
    df = two_sentences(spark).withColumn("FORM", F.lit("a\tb\r\nc\x00d"))
    write_tokens(df, str(tmp_path / "t"))
    assert {r[0] for r in rows(read_tokens(spark, str(tmp_path / "t")).select("FORM"))} == {"a b  c d"}


def _parse_conllu(path):
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(Path(path).glob("part-*")))
    blocks = [b.split("\n") for b in text.strip("\n").split("\n\n")]
    return [([l for l in b if l.startswith("# ")], [l.split("\t") for l in b if "\t" in l]) for b in blocks]


def test_conllu_round_trip(spark, sentences, tmp_path):
    write_conllu(sentences, str(tmp_path / "c"))
    blocks = _parse_conllu(tmp_path / "c")
    assert blocks[0][0] == ["# newdoc id = 0", "# doc_id = 0", "# sent_id = 1", "# text = Ayer llegó con Anna de Buenos Aires."]
    assert [b[0][:2] for b in blocks[1:]] == [["# doc_id = 0", "# sent_id = 2"], ["# doc_id = 0", "# sent_id = 3"]]
    words = [tuple(w) for _, ws in blocks for w in ws]
    view = views.word_view(sentences).orderBy("sent_ix", "word_id")
    expected = [(str(r.word_id), r.FORM, r.LEMMA, r.UPOS, "_", "_", str(r.HEAD), r.DEPREL, "_", "_") for r in view.collect()]
    assert words == expected and ("3", "el") in {w[:2] for w in words}


def test_line_breaking_characters_in_conllu(spark):
    s = annotate(corpus_from_text(spark, "Hola mundo", "es"), "tokenize")
    word = F.transform("words", lambda w: w.withField("form", F.concat(w["form"], F.lit("\t\n"))))
    lines = rows(conllu_blocks(s.withColumn("words", word)))[0][2].split("\n")
    assert lines[-2:] == ["1\tHola  \t_\t_\t_\t_\t0\t_\t_\t_", "2\tmundo  \t_\t_\t_\t_\t0\t_\t_\t_"]


def test_missing_layers_in_conllu(spark):
    block = rows(conllu_blocks(annotate(corpus_from_text(spark, "Hola", "es"), "tokenize")))[0][2]
    assert block.split("\n")[-1] == "1\tHola\t_\t_\t_\t_\t0\t_\t_\t_"


def test_json_round_trip(spark, sentences, tmp_path):
    write_json(sentences, str(tmp_path / "j"))
    lines = [json.loads(l) for p in sorted((tmp_path / "j").glob("*.json")) for l in p.read_text(encoding="utf-8").splitlines()]
    first = lines[0]
    assert list(first) == ["doc_id", "lang", "index", "text", "tokens", "entities", "dependencies"]
    assert first["entities"] == [{"type": "PER", "text": "Anna"}, {"type": "LOC", "text": "Buenos Aires"}]
    assert first["tokens"][1] == {"tok_ix": 2, "form": "llegó", "lemma": "llegar", "upos": "VERB", "xpos": "_", "head": 0, "deprel": "root"}
    assert first["dependencies"][0] == {"head_form": "llegó", "dep_form": "Ayer", "deprel": "advmod", "head": 2, "dep": 1}
    assert sum(len(s["tokens"]) for s in lines) == views.token_view(sentences, ["FORM"]).count()
    assert lines[2]["entities"] == []


def test_report(spark, tmp_path):
    s = annotate(corpus_from_text(spark, "Voy al cine. Veo a María Internacionalísima.", "es"))
    lines = [r[3] for r in rows(report_lines(s).orderBy("sent_ix", "line_no"))]
    assert lines[:11] == [
        "", "=== Oración 1 ===", "Voy al cine.", "", "Tokens / Lema / UPOS", "-" * 28,
        f"{'Voy':>15}  {'ir':>15}  {'VERB':>6}", f"{'a':>15}  {'a':>15}  {'ADP':>6}",
        f"{'el':>15}  {'el':>15}  {'DET':>6}", f"{'cine':>15}  {'cine':>15}  {'NOUN':>6}",
        f"{'.':>15}  {'.':>15}  {'PUNCT':>6}",
    ]
    assert lines[11:20] == ["", "Dependencias (HEAD ─deprel→ DEP)", "-" * 28, "ROOT ─root→ Voy", "Voy ─case→ a",
                            "Voy ─det→ el", "Voy ─obl→ cine", "Voy ─punct→ .", ""]
    assert lines[20] == "Entidades NER: (ninguna)"
    assert lines[-2:] == ["Entidades NER:", "[MISC] «María Internacionalísima»"]
    assert any(l.startswith("Internacionalísima  internacionalísima") for l in lines)
    write_report(s, str(tmp_path / "r"))
    written = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "r").glob("part-*"))).splitlines()
    assert [l for l in written if not l.startswith("# doc_id = ")] == lines
    assert sorted(rows(read_report(spark, str(tmp_path / "r")))) == [("0", 1), ("0", 2)]


def test_stats_pack_equals_the_single_statistics(spark, sentences, tmp_path):
    stored = store_annotation(sentences, str(tmp_path / "s"))
    pack = stats_pack(stored, top_lemmas=5)
    assert list(pack) == ["pos", "lemmas", "ner", "deprel", "lengths", "cooc", "dep_matrix_pct"]
    assert rows(pack["pos"]) == rows(frequencies.pos_counts(stored))
    assert rows(pack["ner"]) == rows(frequencies.ner_counts(stored))
    assert rows(pack["deprel"]) == rows(frequencies.deprel_counts(stored))
    assert pack["lemmas"].count() == 5 and pack["lengths"].count() == 3
    flat = stats_pack(views.token_view(stored))
    assert rows(flat["cooc"]) == rows(pack["cooc"])
    assert rows(flat["dep_matrix_pct"]) == rows(pack["dep_matrix_pct"])
    written = write_tables(pack, str(tmp_path / "stats"))
    assert rows(spark.read.parquet(written["dep_matrix_pct"]).orderBy("DEPREL")) == rows(pack["dep_matrix_pct"])


def test_stats_pack_without_entities(spark):
    pack = stats_pack(two_sentences(spark).drop("NER"))
    assert rows(pack["ner"]) == [] and pack["ner"].columns == ["NER_tag", "count"]


def test_summary_and_chart_packs(spark, sentences):
    pack = summary_pack(sentences)
    assert list(pack) == ["tokens", "pos_counts", "lemma_freqs", "ner_counts"]
    assert "O" in {r[0] for r in rows(pack["ner_counts"])} and pack["pos_counts"].columns == ["UPOS", "count"]
    charts = chart_pack(sentences, topk_lemmas=3, topk_deprel=2, make_wordcloud=True, stopwords=["cine"])
    assert list(charts) == ["upos", "lemmas", "ner", "deprel", "sentlen", "wordcloud"]
    assert charts["lemmas"].count() == 3 and charts["deprel"].count() == 2
    assert "cine" not in {r[0] for r in rows(charts["wordcloud"])}
    assert "wordcloud" not in chart_pack(sentences)


def test_export_all(spark, sentences, tmp_path):
    written = export_all(sentences, str(tmp_path / "out"), report=True)
    assert set(written) == {"annotation", "tsv", "conllu", "json", "report", "summary/tokens",
                            "summary/pos_counts", "summary/lemma_freqs", "summary/ner_counts"}
    assert all(Path(p, "_SUCCESS").exists() for p in written.values())
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        export_all(sentences, str(tmp_path / "out"))


def test_table_names(spark, tmp_path):
    df = spark.range(1)
    assert write_tables({"": df, "n" * 40: df}, str(tmp_path)) == {
        "": f"{tmp_path}/sheet", "n" * 40: f"{tmp_path}/{'n' * 31}"}
    with pytest.raises(ValueError):
        write_tables({"n" * 40: df, "n" * 50: df}, str(tmp_path))


def test_statistics_read_only_the_columns_they_need(spark, sentences, tmp_path):
    stored = store_annotation(sentences, str(tmp_path / "s"))
    plan = frequencies.pos_counts(stored)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<words:array<struct<part:int,upos:string>>>" in plan


def test_corpora_from_tables(spark):
    table = spark.createDataFrame([(1, 2, "x"), (12, None, "y")], "a int, b int, body string")
    docs = corpus_from_table(table, ["a", "b"], "body", "en")
    assert rows(docs) == [("1/2", "en", "x"), ("12/~", "en", "y")]
    tricky = spark.createDataFrame([("a/b", "c"), ("a", "b/c"), ("a~", "/")], "a string, b string")
    ids = [r[0] for r in rows(corpus_from_table(tricky, ["a", "b"], "a", "en"))]
    assert ids == ["a~1b/c", "a/b~1c", "a~0/~1"]


def test_a_corpus_is_dealt_out_on_request_only(spark):
    table = spark.createDataFrame([(i, "en", "x") for i in range(40)], "doc_id long, lang string, text string").coalesce(1)
    assert corpus_from_table(table, "doc_id").rdd.getNumPartitions() == 1
    assert corpus_from_table(table, "doc_id", repartition_to=6).rdd.getNumPartitions() == 6


def test_a_file_with_another_column_order_is_refused(spark, tmp_path):
    lines = {"a": "sent_ix\ttok_ix\tFORM\n1\t1\tx\n", "b": "sent_ix\tFORM\ttok_ix\n1\ty\t2\n"}
    for name, body in lines.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.tsv").write_text(body)
    columns = ["sent_ix", "tok_ix", "FORM"]
    assert [r["FORM"] for r in read_tokens(spark, str(tmp_path / "a"), columns=columns).collect()] == ["x"]
    both = [str(tmp_path / "a"), str(tmp_path / "b")]
    with pytest.raises(Exception, match="CSV header"):
        read_tokens(spark, both, columns=columns).collect()


def test_checkpoint_folder_of_the_session_is_kept(spark):
    ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert before and spark.sparkContext.getCheckpointDir() == before


def test_scalars(spark):
    df = spark.createDataFrame([("  Mi  archivo (1)!.TXT ",), ("",), ("x" * 40,)], "s string")
    names = rows(df.select(slug(F.col("s")), slug(F.col("s"), lower=False), sheet_name(F.col("s"))))
    assert names[0][:2] == ("mi-archivo-1-.txt", "Mi-archivo-1-.TXT")
    assert names[1][2] == "sheet" and names[2][2] == "x" * 31
    one = df.limit(1)
    got = rows(one.select(
        pad_left(F.lit("ñu"), 5), pad_left(F.lit("longer"), 5), value_or(F.lit("")), value_or(F.lit(None).cast("string")),
        clean_field(F.lit("a\tb")), time_stamp(F.lit("2024-03-05 06:07:08").cast("timestamp")),
    ))[0]
    assert got == ("   ñu", "longer", "_", "_", "a b", "20240305-060708")


def test_compressed_exports_read_back(spark, sentences, tmp_path):
    """Plain exports are many times the corpus, so they can be written compressed; the readers see the same."""
    from verbaloom.sinks import read_conllu
    plain = export_all(sentences, str(tmp_path / "plain"), report=True)
    packed = export_all(sentences, str(tmp_path / "packed"), report=True, compression="gzip")
    for name in ("tsv", "conllu", "json", "report"):
        parts = [p.name for p in Path(packed[name]).iterdir() if p.name.startswith("part-")]
        assert parts and all(p.endswith(".gz") for p in parts)
    assert not [p for p in Path(plain["tsv"]).iterdir() if p.name.endswith(".gz")]
    readers = {
        "tsv": read_tokens, "conllu": read_conllu, "report": read_report,
        "json": lambda s, path: s.read.text(path),
    }
    for name, read in readers.items():
        assert sorted(rows(read(spark, packed[name]))) == sorted(rows(read(spark, plain[name]))) != []


def test_stored_annotation_and_tables_are_zstd(spark, sentences, tmp_path):
    store_annotation(sentences, str(tmp_path / "a"))
    write_tables({"t": spark.range(3)}, str(tmp_path / "t"))
    for folder in (tmp_path / "a", tmp_path / "t" / "t"):
        assert all(".zstd." in p.name for p in folder.iterdir() if p.name.startswith("part-"))


def _hostile(spark):
    docs = spark.createDataFrame([(1, "en", "Anna saw it. He saw Anna.\nNo"), (2, "es", "Voy al cine."), (None, "en", "x y")], "doc_id long, lang string, text string")
    held = annotate(docs)
    odd = F.transform("words", lambda w: F.when(w["word_id"] == 2, w.withField("lemma", F.lit("a\tb\r\nc\x00")).withField("upos", F.lit(""))
                                          .withField("head", F.lit(99))).when(w["form"] != "Anna", w))
    held = held.withColumn("words", F.when(F.col("text") == "No", F.array().cast(held.schema["words"].dataType)).otherwise(odd))
    return held.withColumn("text", F.when(F.col("doc_id").isNotNull(), F.concat("text", F.lit("\n")))).coalesce(1)


def test_rows_of_conllu_files_are_the_blocks(spark, tmp_path):
    held = store_annotation(_hostile(spark), str(tmp_path / "a"))
    write_conllu(held, str(tmp_path / "c"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "c").glob("part-*")))
    assert text == "".join(r.block + "\n\n" for r in conllu_blocks(held).collect())
    assert "transform(" not in conllu._rows(held)._jdf.queryExecution().executedPlan().toString()


def test_written_reports_are_the_report_lines(spark, tmp_path):
    held = store_annotation(_hostile(spark), str(tmp_path / "a"))
    lines = report_lines(held).collect()
    assert "transform(" not in report_lines(held)._jdf.queryExecution().executedPlan().toString()
    write_report(held, str(tmp_path / "r"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "r").glob("part-*")))
    written = []
    for r in lines:
        if r.line_no == 1:
            written.append("" if r.doc_id is None else f"# doc_id = {r.doc_id}\t{r.sent_ix}")
        written.append("" if r.line is None else " ".join(x for x in [r.line.replace("\r\n", "\n").replace("\n", " ")]))
    assert text.split("\n")[:-1] == written and len(written) > 50


def test_tokens_are_written_packed(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_shared_path", lambda spark, name: str(tmp_path / name))
    assert entry.queries()["tsv_roundtrip"](spark, entry.SMOKE_DIR).count() > 0
    assert not list((tmp_path / "tokens").glob("*.csv")) and list((tmp_path / "tokens").glob("*.csv.gz"))
