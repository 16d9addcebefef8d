"""SQL for DuckDB of the queries that look values up in tables or learn from them.

Patterns, tags and formulas are written out here once more, so that they check the package's.
"""

from __future__ import annotations

from duckdb_checks import statements as _older
from duckdb_checks import text as _sql_text
from duckdb_checks import with_layers
from verbaloom.operators.parser import baseline_parser
from verbaloom.operators.segment import SPACES

# Sentences of up to seven words whose tags depend on the form, the place and the line, and the
# same with some forms that these sentences don't have.
TAGGED_COLUMNS = """l_orderkey AS doc_id;1 AS sent_ix;l_linenumber AS tok_ix;concat('f', l_partkey % 13) AS FORM;
CASE (l_partkey % 13 + 2 * l_linenumber + l_suppkey % 2) % 5 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' WHEN 3 THEN 'odd' ELSE NULL END AS UPOS"""
OTHER_COLUMNS = TAGGED_COLUMNS.replace("l_partkey % 13) AS", "l_partkey % 17) AS")
# Words with heads, most of them in the sentence.
HEADED_COLUMNS = """l_orderkey AS doc_id;1 AS sent_ix;CAST(l_linenumber AS INT) AS word_id;
CASE l_partkey % 5 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' WHEN 3 THEN 'DET' ELSE 'odd' END AS UPOS;
CAST((l_partkey % 5 + l_linenumber + l_suppkey % 2) % 7 AS INT) AS HEAD;CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('r', l_suppkey % 3) END AS DEPREL"""

TAG_NUMBER = """(list_position(['ADJ', 'ADP', 'ADV', 'AUX', 'CCONJ', 'DET', 'INTJ', 'NOUN', 'NUM', 'PART', 'PRON', 'PROPN', 'PUNCT',
  'SCONJ', 'SYM', 'VERB', 'X', '_'], CASE WHEN {0} IS NULL THEN '_' WHEN {0} IN ('ADJ', 'ADP', 'ADV', 'AUX', 'CCONJ', 'DET', 'INTJ', 'NOUN',
  'NUM', 'PART', 'PRON', 'PROPN', 'PUNCT', 'SCONJ', 'SYM', 'VERB', 'X', '_') THEN {0} ELSE 'X' END) - 1)"""
TAG_NAME = """(['ADJ', 'ADP', 'ADV', 'AUX', 'CCONJ', 'DET', 'INTJ', 'NOUN', 'NUM', 'PART', 'PRON', 'PROPN', 'PUNCT',
  'SCONJ', 'SYM', 'VERB', 'X', '_'])[{0} + 1]"""


def _flat(columns: str) -> str:
    return f"SELECT {columns.replace(';', ',')} FROM lineitem"


def _tagging(train: str, target: str) -> str:
    """CTEs up to ``tagged (s, pos, tag)``.  ``train``: s, pos, lang, form, tag name; ``target``: s, pos, lang, form; forms in lower case."""
    return f"""tr AS (SELECT s, pos, lang, form, {TAG_NUMBER.format('tag')} AS tag FROM ({train})),
seq AS (SELECT *, lead(tag) OVER w AS after, lag(tag) OVER w AS before FROM tr WINDOW w AS (PARTITION BY s ORDER BY pos)),
moves AS (SELECT coalesce(before, 18) AS a, tag AS b FROM seq UNION ALL SELECT tag, 18 FROM seq WHERE after IS NULL),
seen AS (SELECT a, b, count(*) AS n FROM moves GROUP BY a, b),
starts AS (SELECT a, sum(n) AS total FROM seen GROUP BY a),
steps AS (SELECT starts.a, x.b, floor(ln((coalesce(n, 0) + 1)::DOUBLE / (total + 19)::DOUBLE) * 1000 + 0.5)::BIGINT AS score
  FROM starts CROSS JOIN range(0, 19) AS x(b) LEFT JOIN seen ON seen.a = starts.a AND seen.b = x.b),
counts AS (SELECT lang, form, tag, count(*) AS n FROM tr GROUP BY ALL),
tags AS (SELECT tag, sum(n) AS total, count(*)::DOUBLE / (SELECT count(*) FROM counts)::DOUBLE AS prior FROM counts GROUP BY tag),
emitted AS (SELECT lang, form, c.tag, floor(ln(n::DOUBLE / total::DOUBLE) * 1000 + 0.5)::BIGINT AS score FROM counts c JOIN tags t ON t.tag = c.tag),
ends AS (SELECT lang, right(form, k) AS ending, tag, count(*) AS n FROM counts, range(0, 5) AS x(k) WHERE k <= length(form) GROUP BY ALL),
end_sizes AS (SELECT lang, ending, sum(n) AS size FROM ends GROUP BY ALL),
end_scores AS (SELECT e.lang, e.ending, e.tag, floor(ln(n::DOUBLE / size::DOUBLE / prior) * 1000 + 0.5)::BIGINT AS score
  FROM ends e JOIN end_sizes z ON z.lang = e.lang AND z.ending = e.ending JOIN tags t ON t.tag = e.tag),
tg AS (SELECT *, max(pos) OVER (PARTITION BY s) AS last FROM ({target})),
vocab AS (SELECT DISTINCT lang, form FROM tg),
unknown AS (SELECT v.lang, v.form, max(length(ending)) AS size FROM vocab v JOIN end_sizes z ON z.lang = v.lang AND z.ending = right(v.form, length(z.ending))
  WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.lang = v.lang AND c.form = v.form) AND length(ending) <= 4 GROUP BY ALL),
choices AS (SELECT lang, form, tag, score FROM emitted
  UNION ALL SELECT u.lang, u.form, tag, score FROM unknown u JOIN end_scores e ON e.lang = u.lang AND e.ending = right(u.form, u.size)
  UNION ALL SELECT lang, form, 16, 0 FROM vocab v WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.lang = v.lang)),
paths AS (
  SELECT tg.s, tg.pos, tg.last, c.tag, st.score + c.score AS score, [c.tag] AS path
  FROM tg JOIN choices c ON c.lang = tg.lang AND c.form = tg.form JOIN steps st ON st.a = 18 AND st.b = c.tag WHERE pos = 1
  UNION ALL
  SELECT s, pos, last, tag, best.score + own, list_append(best.path, tag) FROM (
    SELECT tg.s, tg.pos, tg.last, c.tag, c.score AS own, max(struct_pack(score := p.score + st.score, least := -p.tag, path := p.path)) AS best
    FROM paths p JOIN tg ON tg.s = p.s AND tg.pos = p.pos + 1 JOIN choices c ON c.lang = tg.lang AND c.form = tg.form
    JOIN steps st ON st.a = p.tag AND st.b = c.tag GROUP BY tg.s, tg.pos, tg.last, c.tag, c.score)),
ended AS (SELECT p.s, max(struct_pack(score := p.score + st.score, least := -p.tag, path := path)).path AS path
  FROM paths p JOIN steps st ON st.a = p.tag AND st.b = 18 WHERE pos = last GROUP BY p.s),
tagged AS (SELECT s, unnest(range(1, len(path) + 1)) AS pos, unnest(path) AS tag FROM ended)"""


def _parsing(target: str) -> str:
    """CTEs up to ``attached (s, word, head, n)``; ``target``: s, numbers (tag numbers in order).  ``points (arcs)`` is the list of scores."""
    def score(head: str, dependent: str, side: int) -> str:
        far = f"CASE WHEN abs({head} - {dependent}) <= 1 THEN 0 WHEN abs({head} - {dependent}) <= 3 THEN 1 ELSE 2 END"
        return f"arcs[((numbers[{head}] * 18 + numbers[{dependent}]) * 2 + {side}) * 3 + {far} + 1]"
    return f"""states AS (
  SELECT s, numbers, arcs, roots, []::INTEGER[] AS stack, 1 AS word, 0 AS done, NULL::INTEGER AS taken, NULL::INTEGER AS head FROM ({target}), points
  UNION ALL
  SELECT s, numbers, arcs, roots, CASE WHEN action = 'shift' THEN list_append(stack, word) ELSE stack[1 : len(stack) - 1] END,
    CASE WHEN action = 'shift' THEN word + 1 ELSE word END, done + 1, CASE WHEN action <> 'shift' THEN top END,
    CASE action WHEN 'left' THEN word WHEN 'right' THEN below WHEN 'end' THEN 0 END
  FROM (SELECT *, CASE WHEN top IS NULL THEN 'shift' WHEN more AND l >= h AND (below IS NULL OR l >= r) THEN 'left'
      WHEN below IS NOT NULL AND (NOT more OR r >= h) THEN 'right' WHEN more THEN 'shift' ELSE 'end' END AS action
    FROM (SELECT *, CASE WHEN more THEN {score('word', 'top', 0)} END AS l, {score('below', 'top', 1)} AS r, CASE WHEN more THEN greatest({score('top', 'word', 1)}, roots[numbers[top] + 1]) END AS h
      FROM (SELECT *, stack[-1] AS top, CASE WHEN len(stack) > 1 THEN stack[-2] END AS below, word <= len(numbers) AS more FROM states WHERE done < 2 * len(numbers))))),
attached AS (SELECT s, taken AS word, head, numbers FROM states WHERE taken IS NOT NULL)"""


# Texts in which some words always have a full stop, and numbers have one inside.
SHORTENED = r"regexp_replace(regexp_replace(text, ' (de|en|le|on|un) ', ' {0}. ', {1}), ' (of|la) ', ' 3.14 {0}. ', {1})"


def _contents() -> str:
    conllu = _older()["conllu_blocks"]
    cut = conllu.rindex("SELECT s.doc_id, s.sent_ix")
    told = f"""{conllu[:cut]}, blocks AS ({conllu[cut:]}),
told AS (SELECT 'tsv' AS export, doc_id, concat_ws('|', sent_ix, tok_ix, FORM, LEMMA, UPOS, XPOS, HEAD, DEPREL, NER) AS content FROM tokens
  UNION ALL SELECT 'conllu', doc_id, block FROM blocks UNION ALL SELECT 'json', doc_id, concat_ws('|', sent_ix, text) FROM sentences
  UNION ALL SELECT 'tokens', 0, concat_ws('|', FORM, LEMMA, sent_ix, tok_ix) FROM tokens)"""
    return told + """ SELECT export, doc_id, count(*) AS "rows", sum(('0x' || substr(md5(content), 1, 8))::BIGINT)::BIGINT AS checksum FROM told GROUP BY ALL"""


def _rule_tagged(docs: str) -> str:
    """Words of the rule annotator: ``words`` of ``with_layers``, without its leading WITH."""
    return with_layers(docs).removeprefix("WITH ")


def statements() -> dict[str, str]:
    documents = _rule_tagged("SELECT doc_id, lang, text FROM documents")
    conversations = _rule_tagged("SELECT conv_id || '/' || turn AS doc_id, 'en' AS lang, text FROM conversations")
    benchmark_words = r"""lexicon_words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{Z}\p{Cc}\p{L}\p{M}\p{N}_]'))) AS form FROM benchmark),
entries AS (SELECT 'en' AS e_lang, form AS e_form, reverse(form) AS e_lemma, CASE length(form) % 4 WHEN 0 THEN 'VERB' WHEN 1 THEN 'ADJ' WHEN 2 THEN 'SYM' END AS e_upos FROM lexicon_words
  UNION ALL SELECT 'de', form, form || '+', 'NUM' FROM lexicon_words WHERE length(form) > 3)"""
    tagged_flat = _tagging(
        f"SELECT doc_id AS s, row_number() OVER (PARTITION BY doc_id ORDER BY tok_ix, FORM, UPOS NULLS FIRST) AS pos, '' AS lang, lower(FORM) AS form, UPOS AS tag FROM ({_flat(TAGGED_COLUMNS)})",
        f"SELECT doc_id AS s, row_number() OVER (PARTITION BY doc_id ORDER BY tok_ix, FORM, UPOS NULLS FIRST) AS pos, '' AS lang, lower(FORM) AS form FROM ({_flat(OTHER_COLUMNS)})")
    headed = f"""w AS (SELECT *, {TAG_NUMBER.format('UPOS')} AS tag FROM ({_flat(HEADED_COLUMNS)})),
heads AS (SELECT doc_id, word_id, min(tag) AS tag FROM w GROUP BY ALL),
arcs AS (SELECT h.tag AS h, d.tag AS d, (d.word_id > d.HEAD)::INT AS side, CASE WHEN abs(d.word_id - d.HEAD) <= 1 THEN 0 WHEN abs(d.word_id - d.HEAD) <= 3 THEN 1 ELSE 2 END AS far,
  coalesce(d.DEPREL, '_') AS rel FROM w d JOIN heads h ON h.doc_id = d.doc_id AND h.word_id = d.HEAD WHERE d.HEAD <> d.word_id),
totals AS (SELECT tag AS d, count(*) AS total FROM w GROUP BY tag),
seen AS (SELECT h, d, side, far, count(*) AS n FROM arcs GROUP BY ALL),
every AS (SELECT ((h * 18 + d) * 2 + side) * 3 + far AS id, h, d, side, far FROM range(0, 18) AS a(h), range(0, 18) AS b(d), range(0, 2) AS c(side), range(0, 3) AS e(far)),
root_points AS (SELECT list(floor(ln((coalesce(n, 0) + 1)::DOUBLE / (coalesce(total, 0) + 109)::DOUBLE) * 1000 + 0.5)::BIGINT ORDER BY x.d) AS roots
  FROM range(0, 18) AS x(d) LEFT JOIN totals ON totals.d = x.d LEFT JOIN (SELECT tag, count(*) AS n FROM w WHERE HEAD = 0 GROUP BY tag) z ON z.tag = x.d),
points AS (SELECT (SELECT roots FROM root_points) AS roots, list(floor(ln((coalesce(n, 0) + 1)::DOUBLE / (coalesce(total, 0) + 109)::DOUBLE) * 1000 + 0.5)::BIGINT ORDER BY id) AS arcs
  FROM every LEFT JOIN totals USING (d) LEFT JOIN seen USING (h, d, side, far)),
rels AS (SELECT h, d, side, rel FROM (SELECT h, d, side, rel, count(*) AS n FROM arcs GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY h, d, side ORDER BY n DESC, rel) = 1)"""
    return {
        "lexicon_words": f"WITH {documents}, {benchmark_words}" + """
SELECT doc_id, lang, sent_ix, word_id, form AS FORM, coalesce(e_lemma, lemma) AS LEMMA, coalesce(e_upos, upos) AS UPOS
FROM words LEFT JOIN entries ON e_lang = lang AND e_form = lower(form)""",
        "lexicon_pos_counts": f"WITH {documents}, {benchmark_words}" + """
SELECT coalesce(e_upos, upos) AS UPOS, count(*) AS "count" FROM words LEFT JOIN entries ON e_lang = lang AND e_form = lower(form) WHERE part = 1 GROUP BY 1""",
        "hmm_tags": f"WITH RECURSIVE {documents.replace('docs AS', 'docs AS', 1)}, trained AS (SELECT doc_id || '/' || sent_ix AS s, word_id AS pos, lang, lower(form) AS form, upos AS tag FROM words), "
            + "c_words AS (SELECT * FROM (WITH " + conversations + " SELECT doc_id, sent_ix, word_id, form FROM words)), "
            + _tagging("SELECT * FROM trained", "SELECT doc_id || '#' || sent_ix AS s, word_id AS pos, 'en' AS lang, lower(form) AS form FROM c_words")
            + f" SELECT doc_id, sent_ix, word_id, form AS FORM, {TAG_NAME.format('tag')} AS UPOS FROM c_words JOIN tagged ON s = doc_id || '#' || sent_ix AND pos = word_id",
        "flat_hmm_tags": f"WITH RECURSIVE {tagged_flat} SELECT s AS doc_id, tok_ix, FORM, {TAG_NAME.format('tag')} AS UPOS "
            + f"FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tok_ix, FORM, UPOS NULLS FIRST) AS rn FROM ({_flat(OTHER_COLUMNS)})) JOIN tagged ON s = doc_id AND pos = rn",
        "parsed_trees": f"WITH RECURSIVE {conversations}, points AS (SELECT {baseline_parser().scores}::BIGINT[] AS arcs, {baseline_parser().roots}::BIGINT[] AS roots), "
            + f"names_of AS (SELECT {baseline_parser().relations}::VARCHAR[] AS rel), "
            + _parsing(f"SELECT doc_id || '#' || sent_ix AS s, list({TAG_NUMBER.format('upos')} ORDER BY word_id) AS numbers FROM words GROUP BY 1")
            + """ SELECT doc_id, sent_ix, word_id, form AS FORM, upos AS UPOS, a.head AS HEAD,
  CASE WHEN a.head = 0 THEN 'root' ELSE rel[(numbers[a.head] * 18 + numbers[word_id]) * 2 + (word_id > a.head)::INT + 1] END AS DEPREL
FROM words, names_of JOIN attached a ON a.s = doc_id || '#' || sent_ix AND a.word = word_id""".replace("FROM words, names_of JOIN", "FROM words CROSS JOIN names_of JOIN"),
        "flat_parsed_trees": f"WITH RECURSIVE {headed}, " + _parsing("SELECT doc_id AS s, list(tag ORDER BY word_id, tag) AS numbers FROM w GROUP BY 1")
            + """ SELECT s AS doc_id, word_id, a.head AS HEAD, CASE WHEN a.head = 0 THEN 'root' ELSE coalesce(rel, 'dep') END AS DEPREL
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY word_id, tag) AS rn FROM w) x JOIN attached a ON a.s = x.doc_id AND a.word = rn
LEFT JOIN rels ON rels.h = a.numbers[a.head] AND rels.d = x.tag AND rels.side = (rn > a.head)::INT""",
        "suffix_lemmas": f"WITH {documents}, b_words AS (SELECT * FROM (WITH " + _rule_tagged("SELECT item_id AS doc_id, 'en' AS lang, text FROM benchmark") + r""" SELECT form, upos FROM words)),
train AS (SELECT upos, lower(form) AS f, regexp_replace(lower(form), '(.)(ing|ion|er|es|th|an|s|e)$', '\1') || CASE WHEN lower(form) LIKE '%e' THEN '' ELSE 'o' END AS l FROM b_words),
kinds AS (SELECT upos, f, l, count(*) AS n FROM train GROUP BY ALL),
known AS (SELECT upos, f, l FROM kinds QUALIFY row_number() OVER (PARTITION BY upos, f ORDER BY n DESC, l) = 1),
scripts AS (SELECT upos, f, length(f) - p AS cut, substring(l, p + 1) AS added
  FROM (SELECT *, list_max(list_filter(range(0, least(length(f), length(l)) + 1), lambda k: left(f, k) = left(l, k))) AS p FROM kinds)),
rules AS (SELECT upos, ending, cut, added FROM (SELECT upos, right(f, k) AS ending, cut, added, count(*) AS n
    FROM scripts, range(0, 7) AS x(k) WHERE k >= cut AND k <= length(f) GROUP BY ALL HAVING count(*) >= 2)
  QUALIFY row_number() OVER (PARTITION BY upos, ending ORDER BY n DESC, cut, added) = 1),
vocab AS (SELECT DISTINCT lang, upos, lower(form) AS f FROM words),
solved AS (SELECT v.lang, v.upos, v.f, coalesce(any_value(known.l), arg_max(left(v.f, length(v.f) - cut) || added, length(ending)), v.f) AS lemma
  FROM vocab v LEFT JOIN known ON v.lang = 'en' AND known.upos = v.upos AND known.f = v.f
  LEFT JOIN rules r ON v.lang = 'en' AND r.upos = v.upos AND r.ending = right(v.f, length(r.ending)) AND length(r.ending) <= length(v.f) GROUP BY v.lang, v.upos, v.f)
SELECT doc_id, sent_ix, word_id, form AS FORM, solved.lemma AS LEMMA FROM words JOIN solved ON solved.lang = words.lang AND solved.upos = words.upos AND solved.f = lower(form)""",
        "found_abbreviations": f"WITH docs AS (SELECT lang, {SHORTENED.format(chr(92) + '1', chr(39) + 'g' + chr(39))} AS text FROM documents)" + r""",
hits AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+\.?')) AS hit FROM docs),
counts AS (SELECT lang, rtrim(hit, '.') AS word, count(*) AS n, count(*) FILTER (hit LIKE '%.') AS stops FROM hits GROUP BY ALL),
shares AS (SELECT lang, sum(stops)::DOUBLE / sum(n)::DOUBLE AS share FROM counts GROUP BY lang)
SELECT * FROM (SELECT c.lang, word, round(2 * ((stops * ln(0.99::DOUBLE) + (n - stops) * ln(1 - 0.99::DOUBLE)) - (stops * ln(share) + (n - stops) * ln(1 - share)))
  / exp(length(word)) / pow(length(word), n - stops), 6) AS score FROM counts c JOIN shares s ON s.lang IS NOT DISTINCT FROM c.lang WHERE stops > 0 AND share < 1) WHERE score >= 0.3""",
        "abbreviation_sentences": f"WITH docs AS (SELECT doc_id, lang, {SHORTENED.format(chr(92) + '1', chr(39) + 'g' + chr(39))} AS text FROM documents)" + r""",
pieces AS (SELECT doc_id, lang, regexp_extract_all(text, '[^.!?…\n]+[.!?…]*|[.!?…]+|\n') AS ps FROM docs),
rows AS (SELECT doc_id, lang, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM pieces),
marked AS (SELECT *, lead(p) OVER w AS after FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
borders AS (SELECT *, CASE WHEN after IS NOT NULL AND after <> chr(10) AND ((regexp_matches(p, '\p{L}\.$') AND lower(regexp_extract(p, '(\p{L}+)\.$', 1)) IN ('of', 'la', 'de', 'en', 'le', 'on'))
  OR (regexp_matches(p, '\d\.$') AND regexp_matches(after, '^\d'))) THEN 0 ELSE 1 END AS ends FROM marked),
numbered AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM borders),
sents AS (SELECT doc_id, lang, s, string_agg(p, '' ORDER BY i) AS text FROM numbered GROUP BY ALL)
SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS sent_ix, trim(text, {spaces}) AS text FROM sents WHERE regexp_matches(text, '[^\p{Z}\p{Cc}]')""".replace("{spaces}", _sql_text(SPACES)),
        "cooc_sent_heaviest": _older()["cooc_sent"],
        "pack_written_long": _older()["stats_pack_long"],
        "text_files": r"""WITH docs AS (SELECT item_id, CASE WHEN item_id % 2 = 1 THEN regexp_replace(text, '[^\x00-\xff]', '?', 'g') ELSE text END AS text FROM benchmark),
pieces AS (SELECT item_id, list_filter(regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '[^.!?…\n]+[.!?…]*|[.!?…]+'), lambda s: regexp_matches(s, '[^\p{Z}\p{Cc}]')) AS ss FROM docs)
SELECT item_id, unnest(range(1, len(ss) + 1)) AS sent_ix, trim(unnest(ss), {spaces}) AS text FROM pieces""".replace("{spaces}", _sql_text(SPACES)),
        "layer_lists": """WITH lists AS (SELECT l_orderkey, l_linenumber, [trim(x) FOR x IN string_split(concat_ws(',',
  CASE WHEN l_partkey % 2 = 0 THEN ' ner' END, 'tokenize ', CASE WHEN l_suppkey % 3 = 0 THEN 'lemma' END, CASE WHEN l_linenumber > 3 THEN 'odd' END,
  CASE WHEN l_partkey % 5 = 0 THEN 'pos,,pos' END), ',')] AS names FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN list_contains(names, 'tokenize') THEN 'tokenize' END, CASE WHEN list_contains(names, 'pos') THEN 'pos' END,
  CASE WHEN list_contains(names, 'lemma') THEN 'lemma' END, CASE WHEN list_contains(names, 'ner') THEN 'ner' END, CASE WHEN list_contains(names, 'odd') THEN 'odd' END) AS layers FROM lists""",
        "export_contents": _contents(),
        "flat_cooc_wide": _older()["flat_cooc_doc"].replace("unnest(range(1, 4))", "unnest(range(1, 1001))"),
        "table_names": f"WITH RECURSIVE {documents}" + r""", b_tokens AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{Z}\p{Cc}\p{L}\p{M}\p{N}_]') AS ts FROM benchmark),
listed AS (SELECT min(['PER', 'LOC', 'ORG', 'WORK'][(item_id + size) % 4 + 1]) AS type, lower(array_to_string(ts[start : start + size - 1], ' ')) AS name, len(any_value(ts[start : start + size - 1])) AS size
  FROM b_tokens, (VALUES (2, 1), (1, 2), (1, 5), (4, 3), (3, 12)) AS x(start, size) WHERE len(ts) >= start GROUP BY 2),
lowered AS (SELECT doc_id, sent_ix, list(tok ORDER BY tok_ix) AS ts, list(lower(tok) ORDER BY tok_ix) AS ls FROM toks GROUP BY ALL),
firsts AS (SELECT doc_id AS d, sent_ix AS x, tok_ix AS i, ls FROM toks JOIN lowered USING (doc_id, sent_ix)
  WHERE lower(tok) IN (SELECT split_part(name, ' ', 1) FROM listed)),
hits AS (SELECT d, x, i, size, type FROM firsts JOIN listed ON name = array_to_string(ls[i : i + size - 1], ' ')
  QUALIFY row_number() OVER (PARTITION BY d, x, i ORDER BY size DESC) = 1),
taken AS (
  SELECT d, x, i, size, type, 1 AS ent FROM hits QUALIFY row_number() OVER (PARTITION BY d, x ORDER BY i) = 1
  UNION ALL
  SELECT h.d, h.x, h.i, h.size, h.type, t.ent + 1 FROM taken t JOIN hits h ON h.d = t.d AND h.x = t.x AND h.i >= t.i + t.size
  QUALIFY row_number() OVER (PARTITION BY h.d, h.x ORDER BY h.i) = 1)
SELECT doc_id, lang, sent_ix, ent::INTEGER AS ent_ix, type, array_to_string(ts[i : i + size - 1], ' ') AS text, i AS tok_start, i + size - 1 AS tok_end
FROM taken JOIN lowered l ON l.doc_id = d AND l.sent_ix = x JOIN (SELECT DISTINCT doc_id, lang FROM docs) USING (doc_id)""",
    }
