import collections
import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import SMALL, no_docs, odd_docs, odd_rows, prose
from pyspark.sql import functions as F

from verbaloom.llm import chat_formatting as chat
from verbaloom.llm import token_ledger
from verbaloom.llm.common import shared_folder


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PARTS = ["<", "s>", "</s>", "\\", "[INST]", "[/INST]", "<|turn|>", "<\\|turn|>", "[", "/INST]", "\n", "a", "<s>", "|>", "<|im_end|>", "é"]


def test_formatting_can_be_read_back(spark):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
    def escaped_like_the_column(text):
        escaped = chat.re.sub(chat.CONTROL.format(r"\\*"), r"\1\2\\\3", text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>"))
    escaped_like_the_column()
    rows = [(i, 0, role, "".join(PARTS[(i * k) % len(PARTS)] for k in range(9))) for i, role in
            enumerate(["user", "assistant", None, "a\nb", "\\n", "x</s>", "system"] * 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_turns(turns).collect():
        assert chat.read_piece(r["piece"]) == (r["role"] or "", r["text"])
        assert chat.unescape(r["piece"][r["loss_from"]:r["loss_to"]]) == (r["text"] if r["role"] == "assistant" else "")
        assert r["piece"].count("</s>") == 1 and r["piece"].endswith("</s>\n")


def test_digests_of_odd_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, None, None, None), (2, 0, "assistant", None),
            (None, 1, "user", "x"), (None, 0, "assistant", "</s>")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(5000)]
    turns = chat.turns_of_table(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string"))
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert set(got) == set(groups)
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in group if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(group) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in group))
        assert got[conv]["loss_sha256"] == sha(loss)
    assert chat.conversation_digests(chat.format_turns(turns.limit(0))).collect() == []


def test_turns_and_loss_are_read_out_of_the_joined_text(spark):
    rows = [(1, i, ["user", "assistant", "assistant", "a\nb", ""][i % 5], "".join(PARTS[(i * k + i) % len(PARTS)] for k in range(8))) for i in range(60)]
    pieces = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    whole = "".join(r["piece"] for r in pieces)
    want = [(r[2], r[3], r[2] == "assistant") for r in rows]
    for step in (1, 2, 3, 7, 64, 10**6):
        reader = chat.TurnReader()
        assert [t for at in range(0, len(whole), step) for t in reader.read(whole[at:at + step])] == want
        reader.close()
    reader = chat.TurnReader()
    assert list(reader.read(whole[:-3]))[-1] == want[-2]
    for broken in (lambda: reader.close(), lambda: list(chat.TurnReader().read("x" + whole))):
        try:
            broken()
        except ValueError:
            continue
        raise AssertionError("a damaged text was read")
    # Borders come from the text alone: the same text in other parts gives the same digests.
    joined = spark.createDataFrame([(1, 0, "", whole[:1001], whole[:1001]), (1, 1, "", whole[1001:], whole[1001:])], "conv_id long, turn long, role string, text string, piece string")
    apart = chat.conversation_digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert chat.conversation_digests(joined).collect() == apart.collect()


def test_odd_json_records(spark):
    records = ['{"messages":[{"role":"user","content":"a"},"x"]}', '{"messages": []}', '{"messages[]": {"role": "u", "content": "c"}}',
               '{"": {"prompt": 1, "response": 2}}', '{"messages":[{"role":["user"],"content":{"a":1}},{"role":"user","content":"b"}]}',
               "[" * 100_000, '{"prompt": "\\ud800", "response": null}', '{"messages":[{"role":7,"content":1.5}]}', "3", '"x"', "[]", "{}",
               '{"prompt": ["a"], "response": "b"}', '{"question": {"x": 1}, "answer": "b"}']
    rows = [(i, r) for i, r in enumerate(records)]
    rows += [(100, json.dumps({"conv_id": 200, "turn": k, "role": r, "text": f"t{k}"})) for k, r in ((2, "user"), (0, "user"), (1, "assistant"), (3, None))]
    rows += [(101, json.dumps({"conv_id": "c", "turn": 1 << 70, "role": "user", "text": None}))]
    by = collections.defaultdict(list)
    for t in chat.turns_of_records(spark.createDataFrame(rows, "conv_id long, record string")).collect():
        by[t["conv_id"]].append((t["turn"], t["role"], t["text"]))
    unknown = {i: [(None, None, records[i])] for i in (0, 2, 3, 5, 8, 9, 10, 11, 13)}
    assert {i: by[i] for i in unknown} == unknown
    assert 1 not in by
    assert by[4] == [(0, '["user"]', '{"a": 1}'), (1, "user", "b")] and by[7] == [(0, "7", "1.5")]
    assert by[6] == [(0, "user", "?"), (1, "assistant", "")]
    assert sorted(by[200]) == [(0, "user", "t0"), (1, "assistant", "t1"), (2, "user", "t2"), (3, "", "t3")] and by[101] == [(None, "user", "")]


def test_layouts_are_recognised_by_their_paths(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"}, {"question": "q", "answer": "a"},
        {"instruction": "q", "input": "", "output": "a", "id": 4}, {"prompt": "q", "completion": "a", "meta": {"x": [1]}},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, '{"other": 1}'), (91, "not json"), (92, None)]
    turns = chat.turns_of_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    by = collections.defaultdict(list)
    for t in turns:
        by[t["conv_id"]].append((t["turn"], t["role"], t["text"]))
    for i in range(len(records)):
        assert sorted(by[i]) == [(0, "user", "q"), (1, "assistant", "a")], records[i]
    assert by[90] == [(None, None, '{"other": 1}')] and by[91][0][1] is None and by[92][0][1] is None
    nested = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in chat.turns_of_table(nested).collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "")]
    wide = spark.createDataFrame([(1, "s", "q", "a")], "conv_id long, system string, prompt string, response string")
    assert [r["role"] for r in chat.turns_of_table(wide).collect()] == ["system", "user", "assistant"]


def ledger_sums(rows):
    sums = collections.Counter()
    for source, lang, text in rows:
        for name, file in token_ledger.TOKENIZERS.items():
            encode = token_ledger.encoding(f"{token_ledger.FOLDER}/{file}").encode_ordinary
            sums[source, lang, name, "docs"] += 1
            sums[source, lang, name, "tokens"] += len(encode(text or ""))
            sums[source, lang, name, "chars"] += len(text or "")
    return {k: v for k, v in sums.items() if v}


def read_sums(ledger):
    return sums_of(ledger.totals().collect())


def sums_of(rows):
    out = {}
    for r in rows:
        for kind in ("docs", "tokens", "chars"):
            out[r["source"], r["lang"], r["tokenizer"], kind] = r[f"n_{kind}"]
    return {k: v for k, v in out.items() if v}


def test_ledger_follows_inserts_revisions_and_deletes(spark):
    docs = odd_docs(spark)
    ledger = token_ledger.TokenLedger(spark, shared_folder(spark, "ledger"))
    assert ledger.commit("a", ledger.counted(docs)) and not ledger.commit("a", ledger.counted(docs))
    live = [(i, s, lang, t) for i, t, lang, s, _ in odd_rows()]
    assert read_sums(ledger) == ledger_sums([r[1:] for r in live])
    revised = spark.createDataFrame([(1, "new words", "en", "moved"), (8, None, "de", "c"), (77, "fresh", "en", "a")],
                                    "doc_id long, text string, lang string, source string")
    assert ledger.commit("b", ledger.revised(revised)) and not ledger.commit("b", ledger.revised(revised))
    live = [r for r in live if r[0] not in (1, 8)] + [(1, "moved", "en", "new words"), (8, "c", "de", None), (77, "a", "en", "fresh")]
    assert read_sums(ledger) == ledger_sums([r[1:] for r in live])
    gone = spark.createDataFrame([(7,), (None,), (500,)], "doc_id long")
    ledger.commit("c", ledger.taken_back(gone))
    live = [r for r in live if r[0] not in (7, None)]
    assert read_sums(ledger) == ledger_sums([r[1:] for r in live])
    # A batch that failed before it was named does not count and can be sent again.
    ledger.counted(docs).write.parquet(f"{ledger.path}/rows/batch=d")
    assert read_sums(ledger) == ledger_sums([r[1:] for r in live])
    assert ledger.commit("d", ledger.counted(no_docs(spark)))
    assert read_sums(ledger) == ledger_sums([r[1:] for r in live])
    again = token_ledger.TokenLedger(spark, ledger.path)
    assert read_sums(again) == ledger_sums([r[1:] for r in live])


def slow_totals(rows):
    """The query's totals from rows (doc_id, text, lang, source)."""
    first = {}
    for doc, text, _, _ in rows:
        if text is not None:
            first[text] = min([d for d in (first.get(text), doc) if d is not None], default=None)
    kept = [r for r in rows if r[1] is None or first[r[1]] == r[0]]
    return ledger_sums([(s, lang, None if t is None else re.sub(r"[#*$%&]{3,}", "", t)) for _, t, lang, s in kept])


def test_ledger_query_with_null_and_shared_ids(spark, tmp_path):
    rows = [(None, "null one ### words", "en", "a"), (None, "null two", "en", "a"), (None, "null three", None, "a"), (1, "one", "en", "a"),
            (1, "other $$$$ text", "en", "a"), (2, "other $$$$ text", "en", "b"), (2, "two stays", "en", "b"), (None, "one", "en", "c"),
            (3, None, "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (6, "", "en", "a"), (7, "same row %%%", "en", "a"),
            (7, "same row %%%", "en", "a"), (8, "null two", "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("sign", F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sums_of(token_ledger.op10_token_totals(spark, str(tmp_path)).collect()) == slow_totals(rows)


def test_ledger_query_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert sums_of(token_ledger.op10_token_totals(spark, SMALL).collect()) == slow_totals(rows)


def test_long_texts_are_counted_in_pieces():
    encode = token_ledger.encoding(f"{token_ledger.FOLDER}/byte_bpe_50k.tiktoken").encode_ordinary
    for text in [prose(3, 500), "it's  a \n b's 12 34 don't  " * 40, "x" * 5000, "Größe \U0001f600 9 naïve's  " * 30, " a" * 300]:
        parts = list(token_ledger.pieces(text, 50))
        assert "".join(parts) == text and (len(parts) > 3 or " " not in text)
        assert [t for p in parts for t in encode(p)] == encode(text)
