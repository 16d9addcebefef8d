"""Runs on the grammar against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import SMALL, no_docs, odd_docs, odd_rows, with_clashes

from verbaloom.llm import periodic_runs as pr
from verbaloom.llm.recompression import common_extensions, recompressed


def slow_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            if words[x] != words[x + q]:
                x += 1
                continue
            end = x
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - x >= max(6, 4 * q):
                found.setdefault((x, end + q - x), q)
            x = end
    return sorted((s, length, q) for (s, length), q in found.items())


def slow_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def key(row):
    return tuple((x is not None, x or 0) for x in row[:2]) + (str(row),)


def fast_runs(words):
    return [tuple(r) for r in pr._described([[w.encode() for w in words]])[1][0].tolist()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=4), st.integers(1, 9)), max_size=14))
def test_runs_equal_brute_force(parts):
    words = list("".join(piece * times for piece, times in parts))
    assert fast_runs(words) == slow_runs(words)


@pytest.mark.parametrize("word", ["a", "ab", "aab", "aaaaaaab"])
def test_one_period_all_over(word):
    words = list((word * 3000)[:3000])
    assert fast_runs(words) == slow_runs(words)


def test_nested_and_long_words():
    draw = random.Random(5)
    for _ in range(60):
        words = [draw.choice("abc") for _ in range(draw.randint(0, 30))]
        for _ in range(draw.randint(1, 4)):
            words = words[: draw.randint(0, len(words))] * draw.randint(1, 7) + [draw.choice("abc")] * draw.randint(0, 8)
            words = words[:1500]
        assert fast_runs(words) == slow_runs(words)


def test_extensions_equal_comparison():
    draw = np.random.default_rng(3)
    for size, letters in [(2, 2), (50, 1), (300, 2), (3000, 3), (2000, 500)]:
        inner = draw.integers(0, letters, size)
        symbols = np.concatenate([[letters], inner, [letters + 1]])
        levels = recompressed(symbols)
        a, b = draw.integers(1, size + 1, 500), draw.integers(1, size + 1, 500)
        a, b = a[a != b], b[a != b]
        right = [next(k for k in range(size + 2) if symbols[x + k] != symbols[y + k]) for x, y in zip(a, b, strict=True)]
        left = [next(k for k in range(size + 2) if symbols[x - k] != symbols[y - k]) for x, y in zip(a, b, strict=True)]
        assert common_extensions(levels, a, b).tolist() == right
        assert common_extensions(levels, a, b, forward=False).tolist() == left


def test_levels_shrink():
    symbols = np.random.default_rng(1).integers(0, 1000, 100_000)
    levels = recompressed(symbols)
    assert len(levels) < 60 and sum(len(level.symbols) for level in levels) < 6 * len(symbols)


def test_groups_of_texts_do_not_change_runs(monkeypatch):
    texts = [" ".join(["x y"] * k) for k in range(40)] + [None, "", "z " * 50]
    whole = pr.text_runs.func(pr.pa.array(texts)).to_pylist()
    monkeypatch.setattr(pr, "GROUP_WORDS", 7)
    assert pr.text_runs.func(pr.pa.array(texts)).to_pylist() == whole
    assert [r["n_words"] for r in whole] == [len((t or "").split()) for t in texts]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in pr.op13_periodic_runs(spark, SMALL).collect()]
    assert sorted(rows, key=key) == sorted((slow_row(r.doc_id, r.text) for r in docs), key=key)
    assert sum(r[1] > 0 for r in rows) > 10


def test_odd_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in pr.op13_periodic_runs(spark, str(tmp_path)).collect()]
    expected = [slow_row(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 50_000]
    assert sorted((r for r in rows if r[0] != 7), key=key) == sorted((r for r in expected if r[0] != 7), key=key)
    assert sum(r[0] == 7 for r in rows) == 1


def test_empty_table_and_clashing_columns(spark):
    assert pr.periodic_runs(no_docs(spark)).count() == 0
    clashing = pr.periodic_runs(with_clashes(odd_docs(spark)))
    plain = pr.periodic_runs(odd_docs(spark))
    columns = ["doc_id", "n_words", "runs", "collapsed"]
    assert sorted(map(str, clashing.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    assert {r[0] for r in clashing.select("kept").distinct().collect()} == {"kept"}
