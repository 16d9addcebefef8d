import collections
import math
import random

import pytest
from llm_tables import SMALL, no_docs, odd_docs, odd_rows, prose, with_clashes

from verbaloom.llm import quality_hosts, source_mixing
from verbaloom.llm.quality_hosts import MEASURES, measures_of, repeated_words


def slow_measures(text):
    text = text or ""
    spaces = " \t\n\v\f\r"
    words = []
    for c in text:
        if c in spaces:
            words.append("")
        else:
            words = words or [""]
            words[-1] += c
    words = [w for w in words if w]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if any(c not in spaces for c in line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered)


def test_measures_match_the_slow_form():
    draw = random.Random(5)
    texts = [r[1] for r in odd_rows() if r[0] != 7]
    for _ in range(300):
        texts.append("".join(draw.choices(["a", "b", " ", "\n", "#", " ", "\x1c", "é"], k=draw.randint(0, 200))))
    for text in texts:
        assert measures_of(text) == slow_measures(text)


def test_repeated_words_of_other_widths():
    draw = random.Random(6)
    for width in (1, 2, 3, 5, 8, 11):
        words = [draw.choice([b"a", b"b", b"c"]) for _ in range(120)]
        windows = collections.defaultdict(list)
        for i in range(len(words) - width + 1):
            windows[tuple(words[i:i + width])].append(i)
        want = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + width)}
        assert repeated_words(words, width) == len(want)


def test_a_bad_host_loses_its_documents_and_small_hosts_lean_on_the_prior(spark):
    rows = [(i, "spam spam", "en", "bad", 9) for i in range(200)]
    rows += [(1000 + i, prose(i, 50), "en", f"good{i % 7}", 9) for i in range(200)]
    rows += [(2000, prose(999, 50), "en", "bad", 9), (3000, "tiny", "en", "small", 9), (3001, prose(998, 50), "en", "small", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = {r["doc_id"]: r for r in quality_hosts.judge_documents(docs).collect()}
    assert not judged[2000]["kept"] and not judged[2000]["base_failed"] and judged[2000]["host_rejected"]
    assert all(judged[1000 + i]["kept"] for i in range(200))
    assert judged[3001]["host_rejected"] is False and judged[3001]["kept"] and not judged[3000]["kept"]


def test_quality_of_odd_rows(spark):
    docs = with_clashes(odd_docs(spark))
    judged = quality_hosts.judge_documents(docs)
    assert set(judged.columns) == set(docs.columns) | {*MEASURES, "base_failed", "host_rejected"}
    rows = judged.collect()
    assert len(rows) == len(odd_rows())
    for row in rows:
        assert tuple(row[m] for m in MEASURES) == measures_of(row["text"])
        assert row["base_failed"] == (row["n_words"] < 20 or 100 * row["n_repeat_words"] > 30 * row["n_words"])
    kept = quality_hosts.keep_good_documents(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in rows)
    assert quality_hosts.keep_good_documents(spark, no_docs(spark), SMALL).collect() == []


def targets_of(sizes):
    """Water filling by repeated cutting."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * left > 3 * sizes[s] * share}
        if not over:
            break
        capped |= over
    return {s: float(3 * sizes[s]) if s in capped else weight[s] * left / share for s in names}


@pytest.mark.parametrize("block", [4096, 5])
def test_mix_meets_its_targets(spark, monkeypatch, block):
    monkeypatch.setattr(source_mixing, "BLOCK", block)
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", "b", "b", "b", "b", "c", "d", None]), draw.randint(0, 60)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = source_mixing.mix(docs, "size").collect()
    assert sorted((r["doc_id"], r["source"] or "", r["size"]) for r in out) == sorted((i, s or "", z) for i, s, z in rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = targets_of(sizes)
    for r in out:
        assert math.isclose(r["target"], want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in want:
        # Blocks of five pair documents that differ by a fifth of the range of sizes.
        assert abs(taken[s] - want[s]) <= (130 if block > 5 else 600), (s, taken[s], want[s])
    again = source_mixing.mix(docs.repartition(7), "size").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_rows_without_id_are_dealt_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "BLOCK", 100)
    largest, plain = [], source_mixing._round_level

    def watched(units, p, *rest):
        level = plain(units, p, *rest)
        largest.append(level.groupBy(f"{p}_source", f"{p}_block").count().agg({"count": "max"}).first()[0])
        return level
    monkeypatch.setattr(source_mixing, "_round_level", watched)
    rows = [(None, "a" if i % 4 else "b", 10) for i in range(8000)]
    out = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), "size").collect()
    assert largest[0] < 200
    for source, target in targets_of({"a": 60_000, "b": 20_000}).items():
        taken = sum(r["taken"] for r in out if r["source"] == source)
        assert abs(taken - target) <= 20


def test_strength_of_the_prior_at_its_bounds(spark):
    def strengths(hosts):
        rows = [(f"h{i}", (5 if j < bad else 50, 100, 0, 0, 0)) for i, (n, bad) in enumerate(hosts) for j in range(n)]
        frame = spark.createDataFrame(rows, "host string, m struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>")
        return {r["host"]: (r["n_docs"], r["rate_short"]) for r in quality_hosts.host_verdicts(frame, "host", "m").collect()}

    def rate(n, k, mean, strength):
        return (k + mean * strength) / (n + strength)
    alike = strengths([(20, 5)] * 4)  # no variance beyond sampling: the corpus speaks
    assert all(math.isclose(r, rate(20, 5, 0.25, 10_000)) for _, r in alike.values())
    apart = strengths([(200, 200), (200, 0)])  # hosts are all or nothing: they speak for themselves
    assert math.isclose(apart["h0"][1], rate(200, 200, 0.5, 1)) and math.isclose(apart["h1"][1], rate(200, 0, 0.5, 1))
    between = strengths([(100, 30), (100, 10), (100, 20), (2, 2)])
    assert 0.2 < between["h3"][1] < 1 and between["h1"][1] > 0.1 and between["h0"][1] < 0.3


def test_each_fraction_is_kept_in_expectation(spark):
    rows = [(i, "a" if i < 300 else "b", 10) for i in range(900)]
    out = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), "size").collect()
    half = [r["copies"] for r in out if r["source"] == "b"]
    wanted = targets_of({"a": 3000, "b": 6000})["b"] / 6000
    assert abs(sum(half) / 600 - wanted) < 2 / 600 and set(half) <= {math.floor(wanted), math.ceil(wanted)}
    # The drawn documents are spread over the table, not the first ones.
    assert abs(sum(half[:300]) - sum(half[300:])) < 60


def test_mix_of_odd_rows(spark):
    docs = with_clashes(odd_docs(spark))
    mixed = source_mixing.mixed_documents(spark, docs, SMALL)
    assert mixed.columns[: len(docs.columns)] == docs.columns and len(mixed.columns) == len(docs.columns) + 1
    assert mixed.filter("text is null").count() <= 3
    assert source_mixing.mixed_documents(spark, no_docs(spark), SMALL).collect() == []
    empties = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "doc_id long, text string, source string")
    sized = empties.select("doc_id", "source", source_mixing.word_count(empties["text"]).alias("size"))
    assert [r["taken"] for r in source_mixing.mix(sized, "size").collect()] == [0, 0]
