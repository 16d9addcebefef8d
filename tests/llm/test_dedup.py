import collections
import hashlib
import random
import re

import numpy as np
import pytest
from llm_tables import SMALL, no_docs, odd_docs, odd_rows, prose, with_clashes

from verbaloom.llm import dart_minhash, suffix_array, suffix_dedup


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        self[self.find(x)] = self.find(y)


def slow_classes(rows):
    """Class id by index of the rows (id, text), from all pairs."""
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    sets = [collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in words]
    union = Union()
    for i in range(len(rows)):
        for j in range(i):
            if words[i] == words[j]:
                union.join(i, j)
            elif sets[i] and sets[j] and union.find(i) != union.find(j):
                shared = (sets[i] & sets[j]).total()
                if shared >= 0.8 * (sets[i].total() + sets[j].total() - shared):
                    union.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[union.find(i)] = min(doc, least.get(union.find(i), doc))
    return [least.get(union.find(i)) for i in range(len(rows))]


def edited(text, seed, edits):
    draw, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**9)}"
    return " ".join(words)


def families():
    rows, n = [], 0
    for family, (copies, edits) in enumerate([(40, 2), (60, 5), (30, 9), (3, 1)]):
        base = prose(100 + family, 300)
        for k in range(copies):
            n += 1
            rows.append((n, edited(base, 1000 * family + k, edits)))
    chain = prose(55, 200).split()
    for k in range(12):  # each like the next, the ends unlike
        n += 1
        rows.append((n, " ".join(chain[8 * k:] + prose(700, 96).split()[: 8 * k])))
    return rows


def test_classes_equal_all_pairs(spark):
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicate_classes(docs).collect()}
    assert [got[i] for i, _ in rows] == slow_classes(rows)


def test_classes_of_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.op1_near_duplicates(spark, SMALL).collect()}
    assert [got[i] for i, _ in rows] == slow_classes(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    docs = with_clashes(odd_docs(spark))
    got = dart_minhash.near_duplicate_classes(docs).collect()
    want = collections.Counter(zip([r[0] for r in rows], slow_classes([r[:2] for r in rows]), strict=True))
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in got) == want
    kept = dart_minhash.without_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(set(slow_classes([r[:2] for r in rows])))
    assert dart_minhash.without_near_duplicates(spark, no_docs(spark), SMALL).collect() == []


def test_classes_that_share_an_id_stay_apart(spark):
    rows = [(None, prose(20 + i, 40)) for i in range(6)] + [(None, prose(20, 40))]
    rows += [(1, prose(30, 40)), (2, prose(30, 40)), (1, prose(31, 40)), (3, prose(31, 40)), (None, prose(31, 40))]
    rows += [(4, prose(32, 40)), (None, prose(32, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in dart_minhash.without_near_duplicates(spark, docs, SMALL).collect()]
    want = [(None, prose(20 + i, 40)) for i in range(6)] + [(1, prose(30, 40)), (1, prose(31, 40)), (4, prose(32, 40))]
    assert collections.Counter(kept) == collections.Counter(want)
    members = collections.Counter(r["label"] for r in dart_minhash.near_duplicate_classes(docs).collect())
    assert sorted(members.values()) == [1, 1, 1, 1, 1, 2, 2, 2, 3]


def test_sketches_estimate_weighted_similarity():
    draw, errors = np.random.default_rng(1), []
    for trial in range(60):
        names = np.unique(draw.integers(1, 1 << 60, 300).astype(np.uint64))
        a, b = draw.integers(1, 5, len(names)), draw.integers(1, 5, len(names))
        cut = len(names) // 2 + trial
        left, right = (names[:cut + 80], a[:cut + 80]), (names[cut // 2:], np.where(np.arange(len(names)) % 3, a, b)[cut // 2:])
        same = dart_minhash.dart_sketch(*left) == dart_minhash.dart_sketch(*right)
        errors.append(same.mean() - dart_minhash.similarity(left, right))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_contraction_finds_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    union = Union()
    for a, b in pairs:
        union.join(a, b)
    links = spark.createDataFrame([(min(p), max(p)) for p in pairs if p[0] != p[1]], "a long, b long")
    label = {r["old"]: r["new"] for r in dart_minhash.contracted(links).collect()}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for node, name in label.items():
        groups[name].add(node)
        want[union.find(node)].add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def slow_cut(texts, length=200):
    counts = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        counts.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                gone[i:i + length] = True
        x = np.frombuffer(b, np.uint8)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(x[~gone].tobytes()).hexdigest()))
    return out


def test_suffixes_sort_like_slices():
    draw = np.random.default_rng(4)
    for trial in range(40):
        x = draw.integers(97, 97 + [1, 2, 3, 20][trial % 4], draw.integers(40, 600)).astype(np.uint8)
        if trial % 2:
            x[-35:] = x[:35]
        length = [8, 13, 30][trial % 3]
        starts = np.arange(len(x) - length + 1)
        key = suffix_array.next_bytes(x, 2 * length + 16)
        order = suffix_array.sorted_suffixes(key, len(x), starts, length).tolist()
        slices = [x[s:s + length].tobytes() for s in order]
        assert slices == sorted(slices) and sorted(order) == starts.tolist()


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    shared = prose(9, 45)
    texts = [prose(i, 60) + (f" {shared} " if i % 3 else " ") + prose(i + 500, 20) for i in range(40)]
    texts += ["ab" * 300, "x" * 250, "x" * 199, ("Größe \U0001f600 naïve " * 40), None, "", texts[3], texts[3], shared, prose(9, 46)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                              for r in suffix_dedup.without_repeats(docs).collect())
    assert got == collections.Counter((i, *w) for (i, _), w in zip(rows, slow_cut([t for _, t in rows]), strict=True))


def test_repeated_bytes_of_odd_rows(spark):
    rows = odd_rows()
    got = collections.Counter((r["doc_id"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest())
                              for r in suffix_dedup.without_repeats(with_clashes(odd_docs(spark))).collect())
    want = slow_cut([r[1] for r in rows])
    assert got == collections.Counter((r[0], w[1], w[3]) for r, w in zip(rows, want, strict=True))
    assert suffix_dedup.without_repeats(no_docs(spark)).collect() == []


def windows_that_repeat(raw):
    seen = collections.Counter(raw[i:i + 200] for i in range(len(raw) - 199))
    gone = bytearray(len(raw))
    for i in range(len(raw) - 199):
        if seen[raw[i:i + 200]] > 1:
            gone[i:i + 200] = b"\1" * 200
    return sum(gone)


def test_equal_windows_are_of_different_runs():
    """Else a string that repeats only within one periodic stretch would count once."""
    draw = random.Random(11)
    for case in range(150):
        period, size = draw.randint(1, 168), draw.randint(201, 900)
        unit = bytes(draw.randrange(3) for _ in range(period))
        x = np.frombuffer(bytes(draw.randrange(256) for _ in range(draw.randint(0, 400))) + (unit * 900)[:size] + bytes(draw.randrange(256) for _ in range(300)), np.uint8)
        name, start = suffix_dedup.runs(x)
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x) - 199)))
        places = collections.defaultdict(list)
        for i in range(len(x) - 199):
            places[x[i:i + 200].tobytes()].append(i)
        for same in places.values():
            assert len({of[i] for i in same}) == len(same) and len({name[of[i]] for i in same}) == 1, case


def test_periodic_stretches_astride_64_kib(spark):
    draw, texts = random.Random(12), []
    for k, period in enumerate([1, 2, 3, 7, 31, 32, 33, 64, 100, 168]):
        unit = "".join(draw.choices("abcdefgh", k=period))
        lead = prose(7000 + k, 30_000)
        texts.append(lead[: 65_536 - 170 + 20 * k] + (unit * 400)[: 200 + period + k] + prose(8000 + k, 12_000)[: 65_300] + (unit[::-1] * 400)[:401])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.without_repeats(docs, keep_bytes=False).collect()}
    assert all(got.values())
    assert got == {i: windows_that_repeat(t.encode()) for i, t in enumerate(texts)}


def test_many_equal_rows_are_one_text(spark):
    same, other = prose(90, 200), prose(90, 200)[100:400] + prose(91, 50)
    docs = spark.createDataFrame([(1, same)] * 3000 + [(2, other), (None, same)], "doc_id long, text string")
    tasks = docs.rdd.getNumPartitions()
    assert suffix_dedup.merged_texts(suffix_dedup.long_texts(docs, 3)).count() <= 4 * tasks
    rows = suffix_dedup.without_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_removed, r.n_spans) for r in rows) == {(1, len(same), 1): 3000, (None, len(same), 1): 1, (2, 300, 1): 1}
