"""

Every query reads a whole table, from the text, with only the annotation layers it needs.
Those that write and read back, store the annotation first or train a model start jobs when
they are built; the others run lazily.  On a corpus you keep, annotate once
(``plans.store_annotation``) and call the same operators on the stored table.
"""

from __future__ import annotations

import functools
import sys
import uuid
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import duckdb_checks  # noqa: E402
import duckdb_learned  # noqa: E402
from verbaloom.functions import layer_list, sheet_name, slug, time_stamp  # noqa: E402
from verbaloom.operators import abbreviations, chartdata, frequencies, lemmatizer, lexicon_table, matrix, names, parser  # noqa: E402
from verbaloom.operators import segment, tagger, views  # noqa: E402
from verbaloom.operators.cooccurrence import cooccurrences, heaviest_cooccurrences  # noqa: E402
from verbaloom.operators.whitespace import whitespace_tokens  # noqa: E402
from verbaloom.plans import annotate, chart_pack, export_all, stats_pack, store_annotation, summary_pack  # noqa: E402
from verbaloom.schemas import TOKEN_COLUMNS, UPOS_TAGS  # noqa: E402
from verbaloom.session import ensure_checkpoint_dir  # noqa: E402
from verbaloom.sinks import (  # noqa: E402
    conllu_blocks,
    read_conllu,
    read_report,
    report_lines,
    sentence_objects,
    write_conllu,
    write_report,
    write_tables,
    write_tokens,
)
from verbaloom.sources import corpus_from_table, decode_text, read_text_files, read_tokens, without_markup  # noqa: E402

try:
    import corpus_pipeline
    from verbaloom.llm import registry as llm
except ImportError as missing:  # the training-data subpackage, or what it needs, may be left out
    if missing.name not in {"corpus_pipeline", "verbaloom.llm"}:
        warnings.warn(f"queries of the training-data subpackage are left out: {missing}", stacklevel=1)
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables given here are one small file each, which would be one task.
    tasks = 4 * spark.sparkContext.defaultParallelism
    return corpus_from_table(_table(spark, sf_dir, "documents"), "doc_id", repartition_to=tasks)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_table(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], lang="en")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = without_markup(F.col("html"))
    return corpus_from_table(_table(spark, sf_dir, "pages"), "page_id", html, lang="en")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_table(_table(spark, sf_dir, "benchmark"), "item_id", lang="en")


def _on(layers: str, operator: Callable[[DataFrame], DataFrame], corpus=_documents) -> Query:
    """A query that annotates a corpus with ``layers`` and applies ``operator``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(annotate(corpus(spark, sf_dir), layers))
    return run


def _shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors see; it is removed when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def _on_stored(layers: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    """As ``_on`` for operators that read the annotation several times: it is stored first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sentences = annotate(_documents(spark, sf_dir), layers)
        return operator(store_annotation(sentences, _shared_path(spark, "annotation")))
    return run


def _tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in the shared folder and read back, so the file is what is compared."""
    path = _shared_path(spark, "tokens")
    write_tokens(annotate(_documents(spark, sf_dir)), path, compression="gzip")
    columns = ["doc_id", "lang", *TOKEN_COLUMNS]
    return read_tokens(spark, path, columns=columns).withColumn("doc_id", F.col("doc_id").cast("long"))


def _json(sentences: DataFrame) -> DataFrame:
    keep = {"ignoreNullFields": "false"}
    return sentence_objects(sentences).select("doc_id", "lang", "index", "text", *[
        F.to_json(name, keep).alias(name) for name in ("tokens", "entities", "dependencies")
    ])


def _decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    latin = F.regexp_replace("text", r"[^\x00-\xff]", "?")
    return docs.select(
        "doc_id",
        decode_text(F.encode("text", "UTF-8")).alias("from_utf8"),
        decode_text(F.encode(latin, "ISO-8859-1")).alias("from_latin1"),
    )


def _bio_joined(sentences: DataFrame) -> DataFrame:
    tokens = views.token_view(sentences, ["sent_ix", "tok_ix", "FORM"]).drop("lang")
    return views.join_bio_tags(tokens, views.entity_view(sentences))


def _heads_joined(sentences: DataFrame) -> DataFrame:
    words = views.word_view(sentences).select("doc_id", "lang", "sent_ix", "word_id", "FORM", "HEAD", "DEPREL")
    return views.join_head_forms(words).select(
        "doc_id", "lang", "sent_ix", "word_id", F.col("FORM").alias("dep_form"),
        F.col("HEAD").alias("head"), F.col("DEPREL").alias("deprel"), "head_form",
    )


def _stored(spark: SparkSession, sf_dir: str, layers: str) -> DataFrame:
    return store_annotation(annotate(_documents(spark, sf_dir), layers), _shared_path(spark, "annotation"))


def _long(tables: dict[str, DataFrame]) -> DataFrame:
    """A pack as one table: the table's name, up to two keys and two numbers of each row."""
    parts = []
    for name, table in tables.items():
        if name == "dep_matrix_pct":
            table = table.unpivot("DEPREL", [c for c in table.columns if c != "DEPREL"], "UPOS", "percent").where("percent <> 0")
        if name == "tokens":
            table = table.select("FORM", "LEMMA", "sent_ix", "tok_ix")
        kinds = dict(table.dtypes)
        keys = [c for c in table.columns if kinds[c] == "string" or c in {"doc_id", "bin"}]
        numbers = [c for c in table.columns if c not in keys]
        picked = [F.col(c).cast("string") for c in keys] + [F.lit(None).cast("string")] * 2
        values = [F.col(c).cast("double") for c in numbers] + [F.lit(None).cast("double")] * 3
        parts.append(table.select(
            F.lit(name).alias("pack_table"), picked[0].alias("key"), picked[1].alias("key2"),
            *[v.alias(f"v{i}") for i, v in enumerate(values[:3], 1)]))
    return functools.reduce(DataFrame.unionByName, parts)


def _export_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is exported; what is read back is counted by export and document."""
    path = _shared_path(spark, "export")
    written = export_all(annotate(_documents(spark, sf_dir)), path, report=True, compression="gzip")
    doc = F.col("doc_id").cast("long").alias("doc_id")
    parts = {
        "tsv": read_tokens(spark, written["tsv"]).select(doc),
        "conllu": read_conllu(spark, written["conllu"]).select(doc),
        "report": read_report(spark, written["report"]).select(doc),
        "json": spark.read.json(written["json"], schema="doc_id long").select(doc),
    }
    return functools.reduce(DataFrame.unionByName, [
        t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("export"), "doc_id", "rows")
        for n, t in parts.items()])


def _file_of(write: Callable, read: Callable) -> Query:
    """Written from a stored annotation that deals each document's sentences out to eight files, in small row groups."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _shared_path(spark, "file")
        sentences = annotate(_documents(spark, sf_dir))
        dealt = sentences.withColumn("part", F.pmod(F.xxhash64("doc_id", "sent_ix"), F.lit(8)))
        stored = dealt.write.partitionBy("part").options(compression="zstd", **{"parquet.block.size": 64 * 1024})
        stored.parquet(f"{path}/annotation")
        write(spark.read.parquet(f"{path}/annotation").drop("part"), f"{path}/text", compression="gzip")
        return read(spark, f"{path}/text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return run


def _flat(operator: Callable[[DataFrame], DataFrame], columns: str = duckdb_checks.FLAT_COLUMNS) -> Query:
    """On a flat token table with many tags, gaps and heads anywhere, made of ``lineitem``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(_table(spark, sf_dir, "lineitem").selectExpr(*columns.split(";")))
    return run


def _flat_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    tokens = lines.selectExpr(*duckdb_checks.WORD_COLUMNS.split(";"))
    spans = lines.where("l_quantity < 20").selectExpr(*duckdb_checks.SPAN_COLUMNS.split(";"))
    return views.join_bio_tags(tokens.select("doc_id", "sent_ix", F.col("word_id").alias("tok_ix"), "FORM"), spans)


def _long_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is a table: every form of the benchmark."""
    listed = views.token_view(annotate(_benchmark(spark, sf_dir), "tokenize"), ["FORM"]).select("FORM")
    return cooccurrences(annotate(_documents(spark, sf_dir), "tokenize,mwt,lemma"), exclude=listed)


def _benchmark_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon made of a table: the forms of the benchmark with odd lemmas, and tags by length."""
    tokens = F.transform(segment.token_array(F.col("text")), F.lower)
    forms = _table(spark, sf_dir, "benchmark").select(F.explode(tokens).alias("form")).distinct()
    size = F.length("form")
    tag = F.when(size % 4 == 0, "VERB").when(size % 4 == 1, "ADJ").when(size % 4 == 2, "SYM")
    english = forms.select(F.lit("en").alias("lang"), "form", F.reverse("form").alias("lemma"), tag.alias("upos"))
    german = forms.where(size > 3).select(F.lit("de").alias("lang"), "form", F.concat("form", F.lit("+")).alias("lemma"), F.lit("NUM").alias("upos"))
    return english.unionByName(german)


def _lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_table.apply_lexicon(_stored(spark, sf_dir, "tokenize,mwt,pos,lemma"), _benchmark_lexicon(spark, sf_dir))


def _benchmark_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of a table: stretches of one to twelve tokens of the benchmark, with four types."""
    tokens = _table(spark, sf_dir, "benchmark").select("item_id", segment.token_array(F.col("text")).alias("ts"))
    spans = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(n).alias("size")) for a, n in ((2, 1), (1, 2), (1, 5), (4, 3), (3, 12))]))
    types = F.array(*[F.lit(t) for t in ("PER", "LOC", "ORG", "WORK")])
    return tokens.select("item_id", "ts", spans.alias("x")).select(
        F.array_join(F.slice("ts", F.col("x.start"), F.col("x.size")), " ").alias("name"),
        F.get(types, ((F.col("item_id") + F.col("x.size")) % 4).cast("int")).alias("type"))


def _stored_of(spark: SparkSession, sf_dir: str, corpus: Callable, layers: str) -> DataFrame:
    return store_annotation(annotate(corpus(spark, sf_dir), layers), _shared_path(spark, "annotation"))


def _hmm_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger learned from the documents' tags, on the conversations."""
    learned = tagger.train_tagger(_stored(spark, sf_dir, "tokenize,mwt,pos"))
    told = tagger.tag_sentences(_stored_of(spark, sf_dir, _conversations, "tokenize,mwt"), learned)
    return views.word_view(told).select("doc_id", "sent_ix", "word_id", "FORM", "UPOS")


def _flat_hmm_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    learned = tagger.train_tagger(lines.selectExpr(*duckdb_learned.TAGGED_COLUMNS.split(";")))
    return tagger.tag_tokens(lines.selectExpr(*duckdb_learned.OTHER_COLUMNS.split(";")), learned).select("doc_id", "tok_ix", "FORM", "UPOS")


def _parsed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = parser.parse_sentences(annotate(_conversations(spark, sf_dir), "tokenize,mwt,pos"))
    return views.word_view(sentences).select("doc_id", "sent_ix", "word_id", "FORM", "UPOS", "HEAD", "DEPREL")


def _flat_parsed_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "lineitem").selectExpr(*duckdb_learned.HEADED_COLUMNS.split(";"))
    return parser.parse_words(words, parser.train_parser(words)).drop("sent_ix")


def _table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.entity_view(names.apply_names(_stored(spark, sf_dir, "tokenize"), _benchmark_names(spark, sf_dir)))


def _suffix_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix rules learned from the benchmark's words with made lemmas, on the documents."""
    low = F.lower("FORM")
    made = F.concat(F.regexp_replace(low, "(.)(ing|ion|er|es|th|an|s|e)$", "$1"), F.when(low.like("%e"), "").otherwise("o"))
    words = views.word_view(annotate(_benchmark(spark, sf_dir), "tokenize,mwt,pos")).withColumn("LEMMA", made)
    told = lemmatizer.apply_lemmas(_stored(spark, sf_dir, "tokenize,mwt,pos"), lemmatizer.train_lemmatizer(words))
    return views.word_view(told).select("doc_id", "sent_ix", "word_id", "FORM", "LEMMA")


def _shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).withColumn("text", F.expr(duckdb_learned.SHORTENED.format("$1", 1)))


def _abbreviation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shortened(spark, sf_dir)
    some = ["de", "en", "la", "le", "of", "on"]
    listed = _table(spark, sf_dir, "documents").select("lang", F.explode(F.array(*[F.lit(w) for w in some])).alias("word")).distinct()
    return abbreviations.split_by_abbreviations(docs, listed)


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as files, every second one in Latin-1, read back and split."""
    path = _shared_path(spark, "texts")
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    content = F.when(F.col("item_id") % 2 == 1, latin).otherwise(F.encode("text", "UTF-8"))
    files = _table(spark, sf_dir, "benchmark").select("item_id", content.cast("string").alias("value"))
    files.write.partitionBy("item_id").text(path)
    docs = read_text_files(spark, path, "en")
    item = F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long").alias("item_id")
    return segment.split_sentences(docs).select(item, "sent_ix", "text")


def _pack_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics as a pack of tables that is written, and read back from where it went."""
    pack = stats_pack(_stored(spark, sf_dir, "tokenize,mwt,pos,lemma,depparse,ner"))
    places = write_tables(pack, _shared_path(spark, "pack"))
    return _long({name: spark.read.parquet(place) for name, place in places.items()})


def _export_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is exported; what is read back is added up by export and document, contents by a checksum."""
    written = export_all(annotate(_documents(spark, sf_dir)), _shared_path(spark, "export"), report=True, compression="gzip")
    doc = F.col("doc_id").cast("long").alias("doc_id")
    tokens = read_tokens(spark, written["tsv"])
    told = {
        "tsv": tokens.select(doc, F.concat_ws("|", *[F.col(c).cast("string") for c in TOKEN_COLUMNS]).alias("content")),
        "conllu": read_conllu(spark, written["conllu"]).select(doc, F.col("block").alias("content")),
        "json": spark.read.json(written["json"], schema="doc_id long, index long, text string").select(
            doc, F.concat_ws("|", F.col("index").cast("string"), "text").alias("content")),
        "tokens": spark.read.parquet(written["summary/tokens"]).select(
            F.lit(0).cast("long").alias("doc_id"), F.concat_ws("|", "FORM", "LEMMA", F.col("sent_ix").cast("string"), F.col("tok_ix").cast("string")).alias("content")),
    }
    check = F.conv(F.substring(F.md5(F.col("content").cast("binary")), 1, 8), 16, 10).cast("long")
    return functools.reduce(DataFrame.unionByName, [
        t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(check).alias("checksum")).select(F.lit(n).alias("export"), "doc_id", "rows", "checksum")
        for n, t in told.items()])


def _layer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.concat_ws(",", F.when(F.col("l_partkey") % 2 == 0, " ner"), F.lit("tokenize "), F.when(F.col("l_suppkey") % 3 == 0, "lemma"),
                        F.when(F.col("l_linenumber") > 3, "odd"), F.when(F.col("l_partkey") % 5 == 0, "pos,,pos"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", layer_list(lists)).alias("layers"))


def _learned_queries() -> dict[str, Query]:
    return {
        "lexicon_words": lambda spark, d: views.word_view(_lexicon_words(spark, d)).select(
            "doc_id", "lang", "sent_ix", "word_id", "FORM", "LEMMA", "UPOS"),
        "lexicon_pos_counts": lambda spark, d: frequencies.pos_counts(_lexicon_words(spark, d)).drop("percent"),
        "hmm_tags": _hmm_tags,
        "flat_hmm_tags": _flat_hmm_tags,
        "parsed_trees": _parsed_trees,
        "flat_parsed_trees": _flat_parsed_trees,
        "table_names": _table_names,
        "suffix_lemmas": _suffix_lemmas,
        "cooc_sent_heaviest": lambda spark, d: heaviest_cooccurrences(_stored(spark, d, "tokenize,mwt,lemma")),
        "text_files": _text_files,
        "pack_written_long": _pack_written,
        "export_contents": _export_contents,
        "layer_lists": _layer_lists,
        "flat_cooc_wide": _flat(lambda t: cooccurrences(t, 1000, by_sent=False, top=None)),
        "found_abbreviations": lambda spark, d: abbreviations.abbreviations(_shortened(spark, d)),
        "abbreviation_sentences": _abbreviation_sentences,
    }


def queries() -> dict[str, Query]:
    own = {**_own_queries(), **_learned_queries()}
    if llm is None:
        return own
    return {**own, **llm.queries(), "pipeline": corpus_pipeline.run}


def _own_queries() -> dict[str, Query]:
    every = "tokenize,mwt,pos,lemma,depparse,ner"
    pos, lemma, both = "tokenize,mwt,pos", "tokenize,mwt,lemma", "tokenize,mwt,pos,lemma"
    ner, parse = "tokenize,mwt,pos,ner", "tokenize,mwt,pos,depparse"
    flat = ["sent_ix", "tok_ix", "FORM", "LEMMA"]
    return {
        "sentences": lambda spark, d: segment.split_sentences(_documents(spark, d)),
        "tokens": lambda spark, d: segment.split_tokens(segment.split_sentences(_documents(spark, d))),
        "words_mwt": _on("tokenize,mwt", lambda s: views.word_view(s).select(
            "doc_id", "lang", "sent_ix", "word_id", "tok_ix", "TOK_FORM", "FORM")),
        "token_view_tagged": _on(every, lambda s: views.token_view(s)),
        "tsv_roundtrip": _tsv_roundtrip,
        "words_tagged": _on(every, lambda s: views.word_view(s).select(
            "doc_id", "lang", "sent_ix", "word_id", "FORM", "LEMMA", "UPOS", "HEAD", "DEPREL")),
        "entities": _on(ner, views.entity_view),
        "bio_tags": _on(ner, lambda s: views.token_view(
            s, ["sent_ix", "tok_ix", "FORM", "NER"]).drop("lang")),
        "bio_tags_joined": _on(ner, _bio_joined),
        "head_forms": _on(parse, views.head_forms),
        "head_forms_joined": _on(parse, _heads_joined),
        "pos_counts": _on(pos, frequencies.pos_counts),
        "lemma_freqs_top": _on(lemma, frequencies.lemma_freqs),
        "lemma_freqs_all": _on(lemma, lambda s: frequencies.lemma_freqs(s, None)),
        "ner_counts": _on(ner, frequencies.ner_counts),
        "ner_counts_with_o": _on(ner, lambda s: frequencies.ner_counts(s, drop_o=False)),
        "deprel_counts": _on(parse, frequencies.deprel_counts),
        "deprel_topk": _on(parse, lambda s: chartdata.deprel_bars(s, 5)),
        "top_lemmas_by_upos": _on(both, lambda s: frequencies.top_lemmas_by_upos(s, "NOUN")),
        "top_lemmas_each_upos": _on(both, frequencies.top_lemmas_each_upos),
        "sentence_lengths": _on("tokenize", frequencies.sentence_lengths),
        "sentence_length_histogram": _on("tokenize", chartdata.sentence_length_histogram),
        "cooc_sent": _on(lemma, cooccurrences),
        "cooc_sent_flat": _on_stored(lemma, lambda s: cooccurrences(views.token_view(s, flat))),
        "cooc_sent_all": _on(lemma, lambda s: cooccurrences(s, 1, top=None)),
        "cooc_doc": _on_stored(lemma, lambda s: cooccurrences(s, 3, by_sent=False)),
        "cooc_doc_in_pieces": _on_stored(lemma, lambda s: cooccurrences(s, 3, by_sent=False, block_bits=9)),
        "cooc_excluding": _on(lemma, lambda s: cooccurrences(s, 4, exclude=duckdb_checks.EXCLUDED)),
        "cooc_form_cased": _on("tokenize", lambda s: cooccurrences(s, use_lemma=False, lowercase=False)),
        "dep_matrix_long": _on(parse, matrix.dependency_role_cells),
        "dep_matrix_wide": _on(parse, lambda s: matrix.dependency_role_matrix(s, UPOS_TAGS)),
        "wordcloud_weights": _on(lemma, lambda s: chartdata.wordcloud_weights(
            s, stopwords=duckdb_checks.STOPWORDS)),
        "pos_bars_ascending": _on(pos, lambda s: chartdata.pos_bars(s, sort_desc=False)),
        "summary_pos_counts": _on(pos, lambda s: frequencies.summary_pos_counts(
            views.token_view(s, ["UPOS"]))),
        "summary_ner_counts": _on(ner, lambda s: frequencies.summary_ner_counts(
            views.token_view(s, ["NER"]))),
        "conllu_blocks": _on(every, conllu_blocks),
        "json_sentences": _on(every, _json),
        "report_lines": _on(every, report_lines),
        "conversation_tokens": _on(every, lambda s: views.token_view(s), _conversations),
        "page_lemmas": _on(lemma, lambda s: frequencies.lemma_freqs(s, None), _pages),
        "benchmark_pos_counts": _on(pos, frequencies.pos_counts, _benchmark),
        "slug_names": lambda spark, d: _table(spark, d, "part").select(
            "p_partkey", slug(F.col("p_name")).alias("slug")),
        "sheet_names": lambda spark, d: _table(spark, d, "documents").select(
            "doc_id", sheet_name(F.col("text")).alias("sheet")),
        "time_stamps": lambda spark, d: _table(spark, d, "events").select(
            "event_id", time_stamp(F.col("ts")).alias("stamp")),
        "decode_bytes": _decode_bytes,
        "plugin_annotate": lambda spark, d: whitespace_tokens(_documents(spark, d)),
        "cooc_long_exclude": _long_exclude,
        "conllu_file": _file_of(write_conllu, read_conllu),
        "report_file": _file_of(write_report, read_report),
        "export_all_readback": _export_readback,
        "stats_pack_long": lambda spark, d: _long(stats_pack(_stored(spark, d, every))),
        "chart_pack_long": lambda spark, d: _long(chart_pack(_stored(spark, d, every), make_wordcloud=True)),
        "summary_pack_long": lambda spark, d: _long(summary_pack(_stored(spark, d, every))),
        "flat_cooc_sent": _flat(lambda t: cooccurrences(t, 3, top=None)),
        "flat_cooc_doc": _flat(lambda t: cooccurrences(t, 3, by_sent=False, top=None)),
        "flat_pos_counts": _flat(frequencies.pos_counts),
        "flat_lemma_freqs": _flat(lambda t: frequencies.lemma_freqs(t, None)),
        "flat_ner_counts": _flat(frequencies.ner_counts),
        "flat_deprel_counts": _flat(frequencies.deprel_counts),
        "flat_dep_matrix": _flat(matrix.dependency_role_cells),
        "flat_dep_matrix_wide": _flat(lambda t: matrix.dependency_role_matrix(t, UPOS_TAGS)),
        "flat_lengths": _flat(frequencies.sentence_lengths),
        "flat_head_forms": _flat(views.join_head_forms, duckdb_checks.WORD_COLUMNS),
        "flat_bio_tags": _flat_bio,
    }


def oracle_sql() -> dict[str, str]:
    own = {**duckdb_checks.statements(), **duckdb_learned.statements()}
    if llm is None:
        return own
    piped = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**own, **llm.oracle_sql(), **piped}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the most frequent lemma pairs within two tokens of each other."""
    return queries()["cooc_sent"](spark, SMOKE_DIR)
