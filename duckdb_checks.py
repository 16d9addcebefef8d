"""The registered queries once more, as SQL for DuckDB over the same Parquet tables.

The statements are built from the patterns and word tables that the package declares, but
work differently: flat rows, joins and window functions instead of arrays.
"""

from __future__ import annotations

from verbaloom.operators.lexicon import Lexicon
from verbaloom.operators.rules import (
    CAPITAL_PATTERN,
    NO_CAPITAL_RULE,
    NUMBER_PATTERN,
    OTHER_NAME_TYPE,
    OTHER_RELATION,
    RELATION_BY_TAG,
    SYMBOL_PATTERN,
)
from verbaloom.operators.segment import INK_PATTERN, SENTENCE_PATTERN, SPACES, TOKEN_PATTERN
from verbaloom.schemas import UPOS_TAGS
from verbaloom.sinks import report

# A flat token table with tags in variety, some unknown or missing, out of order, and words and
# spans of the same table: expressions that both engines read.
FLAT_COLUMNS = """l_suppkey AS doc_id;
CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 5 END AS sent_ix;
CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS tok_ix;
CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 6 THEN '' ELSE concat('f', l_partkey % 13) END AS FORM;
CASE WHEN l_linenumber = 3 THEN NULL ELSE concat('L', l_partkey % 9) END AS LEMMA;
CASE l_linenumber WHEN 1 THEN 'NOUN' WHEN 2 THEN 'VERB' WHEN 3 THEN 'ZZZ' WHEN 4 THEN NULL WHEN 5 THEN l_returnflag ELSE 'X' END AS UPOS;
CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE concat('rel', l_partkey % 7) END AS DEPREL;
CASE l_returnflag WHEN 'R' THEN 'B-PER' WHEN 'A' THEN 'I-LOC' ELSE NULL END AS NER"""
WORD_COLUMNS = """l_orderkey AS doc_id;1 AS sent_ix;CAST(l_linenumber AS INT) AS word_id;concat('f', l_partkey % 13) AS FORM;
CAST(l_partkey % 8 AS INT) AS HEAD;lower(l_returnflag) AS DEPREL"""
SPAN_COLUMNS = """l_orderkey AS doc_id;1 AS sent_ix;l_partkey * 10 + l_linenumber AS ent_ix;l_linestatus AS type;
CAST(l_linenumber AS INT) AS tok_start;CAST(l_linenumber + l_partkey % 3 AS INT) AS tok_end"""
_FLAT = ("WITH raw AS (SELECT " + FLAT_COLUMNS.replace(";", ",") + """ FROM lineitem),
tokens AS (SELECT doc_id, sent_ix, tok_ix, coalesce(nullif(FORM, ''), '_') AS FORM, coalesce(LEMMA, '_') AS LEMMA,
  coalesce(UPOS, '_') AS UPOS, coalesce(DEPREL, '_') AS DEPREL, coalesce(NER, 'O') AS NER FROM raw)
""")

STOPWORDS = ["the", "of", "de", "la", "der", "die", "und", "le", "et"]
EXCLUDED = [".", ",", "%", "$", "#", "*", "&", "The"]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


_LEXICON = Lexicon()
_TAG_ROWS = [(lang, form, lemma, tag) for (lang, form), (lemma, tag) in _LEXICON.tags.items()]
_SPLIT_ROWS = ", ".join(
    f"({text(lang)}, {text(token)}, [{', '.join(text(p) for p in parts)}])"
    for (lang, token), parts in _LEXICON.contractions.items()
)


def half_even(x: str) -> str:
    """Round ``x`` to two places, halves to even, on the scaled double."""
    y = f"({x}) * 100.0"
    return (
        f"((floor({y}) + CASE WHEN {y} - floor({y}) > 0.5 THEN 1 WHEN {y} - floor({y}) < 0.5 THEN 0 "
        f"ELSE abs(floor({y})) % 2 END) / 100.0)::DOUBLE"
    )


def with_layers(docs: str = "SELECT doc_id, lang, text FROM documents") -> str:
    """The ``WITH`` clause: sentences, tokens, words, tags, heads, entities and BIO tags."""
    return rf"""WITH docs AS ({docs}),
pieces AS (
  SELECT doc_id, lang, list_filter(regexp_extract_all(text, {text(SENTENCE_PATTERN)}),
         lambda s: regexp_matches(s, {text(INK_PATTERN)})) AS ss FROM docs),
sentences AS (
  SELECT doc_id, lang, unnest(range(1, len(ss) + 1)) AS sent_ix,
         trim(unnest(ss), {text(SPACES)}) AS text FROM pieces),
split AS (SELECT doc_id, lang, sent_ix, regexp_extract_all(text, {text(TOKEN_PATTERN)}) AS ts
  FROM sentences),
toks AS (SELECT doc_id, lang, sent_ix, unnest(range(1, len(ts) + 1)) AS tok_ix,
         unnest(ts) AS tok FROM split),
contractions(c_lang, c_tok, parts) AS (VALUES {_SPLIT_ROWS}),
expanded AS (
  SELECT doc_id, lang, sent_ix, tok_ix, tok, coalesce(parts, [tok]) AS forms
  FROM toks LEFT JOIN contractions ON c_lang = lang AND c_tok = lower(tok)),
parts AS (SELECT doc_id, lang, sent_ix, tok_ix, tok, unnest(range(1, len(forms) + 1)) AS part,
         unnest(forms) AS form FROM expanded),
openings AS (SELECT doc_id AS o_doc, sent_ix AS o_sent, min(tok_ix) AS opening FROM toks
  WHERE regexp_matches(tok, '^[\p{{L}}\p{{M}}\p{{N}}_]') GROUP BY ALL),
lexicon(l_lang, l_form, l_lemma, l_tag) AS (VALUES {_values(_TAG_ROWS)}),
words AS (
  SELECT doc_id, lang, sent_ix, tok_ix, part, tok, form,
    row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY tok_ix, part)::INTEGER AS word_id,
    coalesce(l_lemma, lower(form)) AS lemma,
    coalesce(l_tag, CASE
      WHEN regexp_matches(form, {text(NUMBER_PATTERN)}) THEN 'NUM'
      WHEN regexp_matches(form, {text(SYMBOL_PATTERN)}) THEN 'PUNCT'
      WHEN regexp_matches(form, {text(CAPITAL_PATTERN)}) AND form <> lower(form)
        AND lang NOT IN ({', '.join(text(x) for x in NO_CAPITAL_RULE)})
        AND tok_ix IS DISTINCT FROM opening THEN 'PROPN'
      ELSE 'NOUN' END) AS upos
  FROM parts
  LEFT JOIN lexicon ON l_lang = lang AND l_form = lower(form)
  LEFT JOIN openings ON o_doc = doc_id AND o_sent = sent_ix),
roots AS (
  SELECT doc_id AS r_doc, sent_ix AS r_sent, coalesce(min(word_id) FILTER (upos = 'VERB'),
    min(word_id) FILTER (upos <> 'PUNCT'), 1)::INTEGER AS root FROM words GROUP BY ALL),
relations(tag, relation) AS (VALUES {_values(list(RELATION_BY_TAG.items()))}),
parsed AS (
  SELECT words.*, CASE WHEN word_id = root THEN 0 ELSE root END AS head,
    CASE WHEN word_id = root THEN 'root' ELSE coalesce(relation, {text(OTHER_RELATION)}) END AS deprel
  FROM words JOIN roots ON r_doc = doc_id AND r_sent = sent_ix LEFT JOIN relations ON tag = upos),
named AS (
  SELECT doc_id, lang, sent_ix, tok_ix, tok,
    tok_ix - row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY tok_ix) AS island
  FROM words WHERE part = 1 AND upos = 'PROPN'),
names(kind, name) AS (VALUES {_values([(kind, name) for name, kind in _LEXICON.names.items()])}),
spans AS (
  SELECT doc_id, lang, sent_ix, min(tok_ix) AS tok_start, max(tok_ix) AS tok_end,
    string_agg(tok, ' ' ORDER BY tok_ix) AS text FROM named GROUP BY doc_id, lang, sent_ix, island),
entities AS (
  SELECT doc_id, lang, sent_ix,
    row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY tok_start)::INTEGER AS ent_ix,
    coalesce(kind, {text(OTHER_NAME_TYPE)}) AS type, text, tok_start, tok_end
  FROM spans LEFT JOIN names ON name = lower(text)),
bio AS (
  SELECT doc_id AS b_doc, sent_ix AS b_sent, unnest(range(tok_start, tok_end + 1)) AS b_tok,
    unnest(list_transform(range(tok_start, tok_end + 1),
      lambda p: CASE WHEN p = tok_start THEN 'B-' ELSE 'I-' END || type)) AS tag FROM entities),
tokens AS (
  SELECT doc_id, lang, sent_ix, tok_ix, tok AS FORM, lemma AS LEMMA, upos AS UPOS, '_' AS XPOS,
    head AS HEAD, deprel AS DEPREL, coalesce(tag, 'O') AS NER
  FROM parsed LEFT JOIN bio ON b_doc = doc_id AND b_sent = sent_ix AND b_tok = tok_ix
  WHERE part = 1)
"""


def _pairs(order: str, group: str, terms: str, window: int, top: int | None) -> str:
    """Count pairs by joining positions, both ways round."""
    return f""", seq AS (SELECT {group}, term,
    row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM ({terms})),
shifts AS (SELECT unnest(range(1, {window + 1})) AS d),
shifted AS (SELECT {group}, term, rn, rn + d AS other_rn FROM seq, shifts)
SELECT least(a.term, b.term) AS "left", greatest(a.term, b.term) AS "right",
  2 * count(*) AS "count"
FROM shifted a JOIN seq b ON {' AND '.join(f'a.{g} = b.{g}' for g in group.split(', '))}
  AND b.rn = a.other_rn
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2{f' LIMIT {top}' if top else ''}"""


def _top(select: str, key: str, top: int | None) -> str:
    return f"{select} ORDER BY 2 DESC, {key}{f' LIMIT {top}' if top is not None else ''}"


def _word_list(words: list[str]) -> str:
    return ", ".join(text(word) for word in words)


def _pad(column: str, width: int) -> str:
    return f"CASE WHEN length({column}) < {width} THEN lpad({column}, {width}, ' ') ELSE {column} END"


_HEAD_FORMS = """, heads AS (
  SELECT doc_id, lang, sent_ix, word_id, form AS dep_form, head, deprel,
    CASE WHEN head = 0 THEN 'ROOT' ELSE coalesce(forms[head], 'ROOT') END AS head_form
  FROM (SELECT *, list(form) OVER (PARTITION BY doc_id, sent_ix ORDER BY word_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS forms FROM parsed))
"""

_HISTOGRAM = """, lens AS (SELECT count(*) AS v FROM tokens GROUP BY doc_id, sent_ix),
ends AS (SELECT min(v)::DOUBLE - CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS lo,
  max(v)::DOUBLE + CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS hi FROM lens),
edges AS (SELECT i AS bin, (i - 1) * ((hi - lo) / {bins}) + lo AS low,
  CASE WHEN i = {bins} THEN hi ELSE i * ((hi - lo) / {bins}) + lo END AS high
  FROM ends, range(1, {bins} + 1) AS r(i))
SELECT bin, low, high, (SELECT count(*) FROM lens WHERE v >= low
  AND (v < high OR (bin = {bins} AND v <= high))) AS "count" FROM edges"""

_REPORT = rf""", numbered AS (
  SELECT doc_id, sent_ix, text AS stext FROM sentences),
lines AS (
  SELECT doc_id, sent_ix, 1 AS sec, 0 AS pos, unnest(['', {text(report.SENTENCE_TITLE)}.replace('{{}}', sent_ix::VARCHAR),
    stext, '', {text(report.WORDS_TITLE)}, {text(report.RULE)}]) AS line, unnest(range(1, 7)) AS sub FROM numbered
  UNION ALL SELECT doc_id, sent_ix, 2, word_id, concat({_pad('form', 15)}, '  ', {_pad('lemma', 15)}, '  ', {_pad('upos', 6)}), 0
    FROM parsed
  UNION ALL SELECT doc_id, sent_ix, 3, 0, unnest(['', {text(report.HEADS_TITLE)}, {text(report.RULE)}]), unnest(range(1, 4)) FROM numbered
  UNION ALL SELECT doc_id, sent_ix, 4, word_id, head_form || ' ─' || deprel || '→ ' || dep_form, 0 FROM heads
  UNION ALL SELECT doc_id, sent_ix, 5, 0, '', 0 FROM numbered
  UNION ALL SELECT doc_id, sent_ix, 6, 0, {text(report.NO_ENTITIES)}, 0 FROM numbered n
    WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.doc_id = n.doc_id AND e.sent_ix = n.sent_ix)
  UNION ALL SELECT DISTINCT doc_id, sent_ix, 6, 0, {text(report.ENTITIES_TITLE)}, 0 FROM entities
  UNION ALL SELECT doc_id, sent_ix, 7, ent_ix, '[' || type || '] «' || text || '»', 0 FROM entities)
SELECT doc_id, sent_ix, row_number() OVER (PARTITION BY doc_id, sent_ix ORDER BY sec, pos, sub)::INTEGER AS line_no,
  line FROM lines"""

_CONLLU = """, lines AS (SELECT doc_id, sent_ix, string_agg(concat_ws(chr(9), word_id, form, lemma, upos,
    '_', '_', head, deprel, '_', '_'), chr(10) ORDER BY word_id) AS body FROM parsed GROUP BY ALL)
SELECT s.doc_id, s.sent_ix, CASE WHEN s.sent_ix = 1 THEN '# newdoc id = ' || s.doc_id || chr(10) ELSE '' END
  || '# doc_id = ' || s.doc_id || chr(10) || '# sent_id = ' || s.sent_ix || chr(10) || '# text = ' || translate(s.text, chr(9) || chr(13) || chr(10), '   ')
  || chr(10) || body AS block
FROM sentences s JOIN lines l ON l.doc_id = s.doc_id AND l.sent_ix = s.sent_ix"""

_JSON = """, tok_lists AS (SELECT doc_id, sent_ix, list(struct_pack(tok_ix := tok_ix, form := FORM,
    lemma := LEMMA, upos := UPOS, xpos := XPOS, head := HEAD, deprel := DEPREL) ORDER BY tok_ix) AS tokens
  FROM tokens GROUP BY ALL),
ent_lists AS (SELECT doc_id, sent_ix, list(struct_pack(type := type, text := text) ORDER BY ent_ix) AS entities
  FROM entities GROUP BY ALL),
dep_lists AS (SELECT doc_id, sent_ix, list(struct_pack(head_form := head_form, dep_form := dep_form,
    deprel := deprel, head := head, dep := word_id) ORDER BY word_id) AS dependencies FROM heads GROUP BY ALL)
SELECT s.doc_id, s.sent_ix AS "index", s.lang, s.text, to_json(t.tokens)::VARCHAR AS tokens,
  coalesce(to_json(e.entities)::VARCHAR, '[]') AS entities, to_json(d.dependencies)::VARCHAR AS dependencies
FROM sentences s JOIN tok_lists t ON t.doc_id = s.doc_id AND t.sent_ix = s.sent_ix
JOIN dep_lists d ON d.doc_id = s.doc_id AND d.sent_ix = s.sent_ix
LEFT JOIN ent_lists e ON e.doc_id = s.doc_id AND e.sent_ix = s.sent_ix"""

_CELLS = """, cells AS (SELECT DEPREL, UPOS, count(*) AS n FROM tokens GROUP BY ALL),
shares AS (SELECT DEPREL, UPOS, n AS "count", {percent} AS percent FROM
  (SELECT *, sum(n) OVER (PARTITION BY DEPREL) AS total FROM cells))
""".replace("{percent}", half_even("n::DOUBLE / total::DOUBLE * 100"))

_PAIRS_OF_SENTENCES = "{pairs}"

_WIDE_CELLS = _CELLS.replace(
    "SELECT DEPREL, UPOS, count(*) AS n", f"SELECT DEPREL, CASE WHEN UPOS IN ({', '.join(text(t) for t in UPOS_TAGS)}) "
    "THEN UPOS ELSE 'other' END AS UPOS, count(*) AS n").replace("GROUP BY ALL", "GROUP BY 1, 2", 1)

_SLUG = (
    r"lower(trim(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9._-]+', '-', 'g'), "
    r"'-{2,}', '-', 'g'), '-'))"
)


def statements() -> dict[str, str]:
    base = with_layers()
    conversations = with_layers(
        "SELECT conv_id || '/' || turn AS doc_id, 'en' AS lang, text FROM conversations")
    pages = with_layers(
        "SELECT page_id AS doc_id, 'en' AS lang, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
    benchmark = with_layers("SELECT item_id AS doc_id, 'en' AS lang, text FROM benchmark")
    tokens = "SELECT doc_id, sent_ix, tok_ix, lower(LEMMA) AS term FROM tokens"
    by_sent = ("tok_ix", "doc_id, sent_ix")
    wide = ", ".join(
        f"coalesce(max(percent) FILTER (UPOS = {text(tag)}), 0.0)::DOUBLE AS \"{tag}\"" for tag in [*UPOS_TAGS, "other"]
    )
    share = half_even('"count"::DOUBLE / (sum("count") OVER ())::DOUBLE * 100')
    count_of = "SELECT {0}, count(*) AS \"count\" FROM tokens {1} GROUP BY 1"
    head_forms = "SELECT doc_id, lang, sent_ix, word_id, dep_form, head, deprel, head_form FROM heads"
    bio_tags = "SELECT doc_id, sent_ix, tok_ix, FORM, NER FROM tokens"
    sent_pairs = base + _pairs(*by_sent, tokens, 2, 200)
    return {
        "sentences": base + "SELECT doc_id, lang, sent_ix, text FROM sentences",
        "tokens": base + "SELECT doc_id, lang, sent_ix, tok_ix, tok AS FORM FROM toks",
        "words_mwt": base + "SELECT doc_id, lang, sent_ix, word_id, tok_ix, tok AS TOK_FORM, form AS FORM FROM words",
        "token_view_tagged": base + "SELECT * FROM tokens",
        "tsv_roundtrip": base + "SELECT * FROM tokens",
        "words_tagged": base + (
            "SELECT doc_id, lang, sent_ix, word_id, form AS FORM, lemma AS LEMMA, upos AS UPOS, "
            "head AS HEAD, deprel AS DEPREL FROM parsed"),
        "entities": base + "SELECT doc_id, lang, sent_ix, ent_ix, type, text, tok_start, tok_end FROM entities",
        "bio_tags": base + bio_tags,
        "bio_tags_joined": base + bio_tags,
        "head_forms": base + _HEAD_FORMS + head_forms,
        "head_forms_joined": base + _HEAD_FORMS + head_forms,
        "pos_counts": base + f'SELECT UPOS, "count", {share} AS percent FROM ({count_of.format("UPOS", "")}) ORDER BY 2 DESC, 1',
        "lemma_freqs_top": base + _top(count_of.format("LEMMA", ""), "1", 100),
        "lemma_freqs_all": base + _top(count_of.format("LEMMA", ""), "1", None),
        "ner_counts": base + _top(count_of.format("NER AS NER_tag", "WHERE NER <> 'O'"), "1", None),
        "ner_counts_with_o": base + _top(count_of.format("NER AS NER_tag", ""), "1", None),
        "deprel_counts": base + _top(count_of.format("DEPREL", ""), "1", None),
        "deprel_topk": base + _top(count_of.format("DEPREL", ""), "1", 5),
        "top_lemmas_by_upos": base + _top(count_of.format("LEMMA", "WHERE UPOS = 'NOUN'"), "1", 20),
        "top_lemmas_each_upos": base + """SELECT UPOS, LEMMA, count(*) AS "count" FROM tokens GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY UPOS ORDER BY count(*) DESC, LEMMA) <= 20""",
        "sentence_lengths": base + "SELECT doc_id, sent_ix, count(*) AS length FROM tokens GROUP BY ALL",
        "sentence_length_histogram": base + _HISTOGRAM.replace("{bins}", "10"),
        "cooc_sent": sent_pairs,
        "cooc_sent_flat": sent_pairs,
        "cooc_sent_all": base + _pairs(*by_sent, tokens, 1, None),
        "cooc_doc": base + _pairs("sent_ix, tok_ix", "doc_id", tokens, 3, 200),
        "cooc_doc_in_pieces": base + _pairs("sent_ix, tok_ix", "doc_id", tokens, 3, 200),
        "cooc_excluding": base + _pairs(
            *by_sent, f"SELECT * FROM ({tokens}) WHERE term NOT IN ({_word_list([w.lower() for w in EXCLUDED])})", 4, 200),
        "cooc_form_cased": base + _pairs(*by_sent, "SELECT doc_id, sent_ix, tok_ix, FORM AS term FROM tokens", 2, 200),
        "dep_matrix_long": base + _CELLS + "SELECT * FROM shares",
        "dep_matrix_wide": base + _WIDE_CELLS + f"SELECT DEPREL, {wide} FROM shares GROUP BY DEPREL",
        "wordcloud_weights": base + f"""SELECT LEMMA, "count", "count"::DOUBLE / (max("count") OVER ())::DOUBLE AS weight
FROM (SELECT LEMMA, count(*) AS "count" FROM tokens WHERE lower(LEMMA) NOT IN ({_word_list(STOPWORDS)})
  AND length(LEMMA) >= 2 GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 200""",
        "pos_bars_ascending": base + count_of.format("UPOS", "") + " ORDER BY 2, 1",
        "summary_pos_counts": base + _top(count_of.format("UPOS", "WHERE UPOS IS NOT NULL"), "1", None),
        "summary_ner_counts": base + _top(count_of.format("NER AS NER_tag", ""), "1", None),
        "conllu_blocks": base + _CONLLU,
        "json_sentences": base + _HEAD_FORMS + _JSON,
        "report_lines": base + _HEAD_FORMS + _REPORT,
        "conversation_tokens": conversations + "SELECT * FROM tokens",
        "page_lemmas": pages + _top(count_of.format("LEMMA", ""), "1", None),
        "benchmark_pos_counts": benchmark + f'SELECT UPOS, "count", {share} AS percent FROM ({count_of.format("UPOS", "")})',
        "slug_names": f"SELECT p_partkey, {_SLUG} AS slug FROM part",
        "sheet_names": "SELECT doc_id, coalesce(nullif(substring(text, 1, 31), ''), 'sheet') AS sheet FROM documents",
        "time_stamps": "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events",
        "decode_bytes": r"""SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS from_utf8,
  regexp_replace(regexp_replace(text, '[^\x00-\xff]', '?', 'g'), '\r\n?', chr(10), 'g') AS from_latin1 FROM documents""",
        "plugin_annotate": r"""WITH lines AS (SELECT doc_id, lang, list_filter(string_split(text, chr(10)),
    lambda l: regexp_matches(l, '[^\p{Z}\p{Cc}]')) AS ls FROM documents),
sents AS (SELECT doc_id, lang, unnest(range(1, len(ls) + 1)) AS sent_ix,
  regexp_extract_all(unnest(ls), '[^\p{Z}\t\n\r\f\x0b\x1c-\x1f\x85]+') AS ts FROM lines),
toks AS (SELECT doc_id, lang, sent_ix, unnest(range(1, len(ts) + 1)) AS tok_ix, unnest(ts) AS FORM FROM sents)
SELECT doc_id, lang, sent_ix, tok_ix, FORM, lower(FORM) AS LEMMA, 'X' AS UPOS, '_' AS XPOS,
  CASE WHEN tok_ix = 1 THEN 0 ELSE 1 END AS HEAD, CASE WHEN tok_ix = 1 THEN 'root' ELSE 'dep' END AS DEPREL,
  'O' AS NER FROM toks""",
        "cooc_long_exclude": base + ", listed AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, "
            + text(TOKEN_PATTERN) + "))) AS w FROM benchmark)" + _pairs(
                *by_sent, f"SELECT * FROM ({tokens}) WHERE term NOT IN (SELECT w FROM listed)", 2, 200),
        "conllu_file": base + _CONLLU,
        "report_file": base + "SELECT doc_id, sent_ix FROM sentences",
        "export_all_readback": base + """SELECT 'tsv' AS export, doc_id, count(*) AS "rows" FROM tokens GROUP BY doc_id
UNION ALL SELECT e, doc_id, count(*) FROM sentences, (VALUES ('conllu'), ('report'), ('json')) AS x(e) GROUP BY ALL""",
        "stats_pack_long": base + _PAIRS_OF_SENTENCES.format(pairs=_pairs(*by_sent, tokens, 2, 200).split("SELECT least", 1)[0])
            + _CELLS + f"""SELECT 'pos' AS pack_table, UPOS AS key, NULL::VARCHAR AS key2, "count"::DOUBLE AS v1, {share} AS v2, NULL::DOUBLE AS v3
  FROM ({count_of.format("UPOS", "")})
UNION ALL SELECT * FROM (SELECT 'lemmas', LEMMA, NULL, count(*), NULL, NULL FROM tokens GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 50)
UNION ALL SELECT 'ner', NER, NULL, count(*), NULL, NULL FROM tokens WHERE NER <> 'O' GROUP BY 2
UNION ALL SELECT 'deprel', DEPREL, NULL, count(*), NULL, NULL FROM tokens GROUP BY 2
UNION ALL SELECT 'lengths', doc_id::VARCHAR, NULL, sent_ix, count(*), NULL FROM tokens GROUP BY doc_id, sent_ix
UNION ALL SELECT * FROM (SELECT 'cooc', least(a.term, b.term) AS x, greatest(a.term, b.term) AS y, 2 * count(*) AS n, NULL, NULL FROM shifted a
  JOIN seq b ON a.doc_id = b.doc_id AND a.sent_ix = b.sent_ix AND b.rn = a.other_rn GROUP BY 2, 3 ORDER BY n DESC, x, y LIMIT 200)
UNION ALL SELECT 'dep_matrix_pct', DEPREL, UPOS, percent, NULL, NULL FROM shares WHERE percent <> 0""",
        "chart_pack_long": base + _HISTOGRAM.replace("{bins}", "10").replace("SELECT bin, low", ", bins AS (SELECT bin, low") + f""")
SELECT 'upos' AS pack_table, UPOS AS key, NULL::VARCHAR AS key2, count(*)::DOUBLE AS v1, NULL::DOUBLE AS v2, NULL::DOUBLE AS v3 FROM tokens GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'lemmas', LEMMA, NULL, count(*), NULL, NULL FROM tokens GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 20)
UNION ALL SELECT 'ner', NER, NULL, count(*), NULL, NULL FROM tokens WHERE NER <> 'O' GROUP BY 2
UNION ALL SELECT 'deprel', DEPREL, NULL, count(*), NULL, NULL FROM tokens GROUP BY 2
UNION ALL SELECT 'sentlen', bin::VARCHAR, NULL, low, high, "count" FROM bins
UNION ALL SELECT * FROM (SELECT 'wordcloud', LEMMA, NULL, "count", "count"::DOUBLE / (max("count") OVER ())::DOUBLE, NULL
  FROM (SELECT LEMMA, count(*) AS "count" FROM tokens WHERE length(LEMMA) >= 2 GROUP BY 1) ORDER BY 4 DESC, 2 LIMIT 200)""",
        "summary_pack_long": base + """SELECT 'tokens' AS pack_table, FORM AS key, LEMMA AS key2, sent_ix::DOUBLE AS v1, tok_ix::DOUBLE AS v2, NULL::DOUBLE AS v3 FROM tokens
UNION ALL SELECT 'pos_counts', UPOS, NULL, count(*), NULL, NULL FROM tokens GROUP BY 2
UNION ALL SELECT 'lemma_freqs', LEMMA, NULL, count(*), NULL, NULL FROM tokens GROUP BY 2
UNION ALL SELECT 'ner_counts', NER, NULL, count(*), NULL, NULL FROM tokens GROUP BY 2""",
        "flat_cooc_sent": _FLAT + _pairs("tok_ix, term", "doc_id, sent_ix", f"{tokens} WHERE sent_ix IS NOT NULL", 3, None),
        "flat_cooc_doc": _FLAT + _pairs("sent_ix NULLS LAST, tok_ix, term", "doc_id", tokens, 3, None),
        "flat_pos_counts": _FLAT + f'SELECT UPOS, "count", {share} AS percent FROM ({count_of.format("UPOS", "")})',
        "flat_lemma_freqs": _FLAT + count_of.format("LEMMA", ""),
        "flat_ner_counts": _FLAT + count_of.format("NER AS NER_tag", "WHERE NER <> 'O'"),
        "flat_deprel_counts": _FLAT + count_of.format("DEPREL", ""),
        "flat_dep_matrix": _FLAT + _CELLS + "SELECT * FROM shares",
        "flat_dep_matrix_wide": _FLAT + _WIDE_CELLS + f"SELECT DEPREL, {wide} FROM shares GROUP BY DEPREL",
        "flat_lengths": _FLAT + "SELECT doc_id, sent_ix, count(*) AS length FROM tokens WHERE sent_ix IS NOT NULL GROUP BY ALL",
        "flat_head_forms": f"""WITH w AS (SELECT {WORD_COLUMNS.replace(";", ",")} FROM lineitem)
SELECT w.*, coalesce(h.FORM, 'ROOT') AS head_form FROM w LEFT JOIN w h ON h.doc_id = w.doc_id AND h.word_id = w.HEAD""",
        "flat_bio_tags": f"""WITH w AS (SELECT {WORD_COLUMNS.replace(";", ",")} FROM lineitem),
s AS (SELECT {SPAN_COLUMNS.replace(";", ",")} FROM lineitem WHERE l_quantity < 20),
c AS (SELECT doc_id, ent_ix, unnest(range(tok_start, tok_end + 1)) AS p, type, tok_start FROM s),
b AS (SELECT doc_id, p, arg_max(CASE WHEN p = tok_start THEN 'B-' ELSE 'I-' END || type, ent_ix) AS tag FROM c GROUP BY doc_id, p)
SELECT w.doc_id, w.sent_ix, word_id AS tok_ix, FORM, coalesce(tag, 'O') AS NER FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND p = word_id""",
    }
