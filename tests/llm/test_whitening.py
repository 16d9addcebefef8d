"""Components against a dense eigensolver, exact numbers against Python's integers."""

import math

import numpy as np
import pytest
from llm_tables import SMALL
from pyspark.sql import functions as F

from verbaloom.llm import whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def slow(rows, components=4):
    """vec_id, component, n, deviation, whitened without sign, explained."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in usable), default=0)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v)) for _, v in usable]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit]).reshape(n, dims)
    values, vectors = np.linalg.eigh(centred.T @ centred / n) if dims else (np.empty(0), np.empty((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    result = []
    for (i, _), v in zip(usable, x, strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        own = np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)])
        for k in range(min(components, dims)):
            flat = values[k] <= 1e-12 * max(values[0], 1e-300)
            score = None if flat else abs(float(own @ vectors[:, k])) / math.sqrt(values[k])
            result.append((i, k + 1, n, deviation if deviation < 2**63 else None, score, (0.0 if flat else values[k] / values.sum()) if values.sum() > 1e-9 else None))
    return result


def assert_same(rows, expected):
    def key(r):
        return (r[0] is not None, r[0] or 0, r[1], r[3] or 0, r[4] is not None, round(abs(r[4] or 0), 6))
    rows = sorted((tuple(r) for r in rows), key=key)
    expected = sorted(expected, key=key)
    assert [r[:4] for r in rows] == [e[:4] for e in expected]
    for r, e in zip(rows, expected, strict=True):
        for got, want in ((r[4], e[4]), (r[5], e[5])):
            assert (got is None) == (want is None)
            assert got is None or abs(abs(got) - want) <= 1e-8 * max(1, abs(want))


def saved(spark, rows, folder):
    spark.createDataFrame([(i, v, 0) for i, v in rows], EMBEDDINGS).withColumns({"x": F.lit("clash"), "whitened": F.lit(1)}).write.parquet(f"{folder}/embeddings.parquet")


def test_given_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = whitening.op11_whitening(spark, SMALL).collect()
    assert_same(found, slow([tuple(r) for r in rows]))
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-10
    signs = {}
    for r in found:
        signs.setdefault(r.component, []).append(r.whitened)
    assert all(abs(np.mean(v)) < 1e-9 for v in signs.values())  # one sign for all rows, centred


def test_odd_vectors(spark, tmp_path):
    draw = np.random.default_rng(1)
    good = [(i, [float(c) for c in draw.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(300)]
    good += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(500)]  # one vector in most rows
    odd = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [math.nan] * 5), (2003, [math.inf, 0.0, 0.0, 0.0, 0.0]),
           (2004, [1.0, 2.0]), (2005, []), (2006, [-0.0, 0.0, -0.001, 0.001, 0.0]), (None, [9.0, 9.0, 9.0, 9.0, 9.0]), (7, good[7][1])]
    saved(spark, good + odd, tmp_path)
    assert_same(whitening.op11_whitening(spark, str(tmp_path)).collect(), slow(good + odd))


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [3.0]), (2, [4.0]), (3, [4.0])],
    [(i, [float(i), 2.0 * i, -i * 1.0, 0.0, 1.0]) for i in range(20)],  # one direction only
    [(1, [1.0, 2.0]), (2, [1.0, 2.0])],
])
def test_few_rows_and_flat_components(spark, tmp_path, rows):
    saved(spark, rows, tmp_path)
    assert_same(whitening.op11_whitening(spark, str(tmp_path)).collect(), slow(rows))


def test_large_entries_are_exact(spark, tmp_path):
    rows = [(i, [float(i) * 1e9, -float(i * i) * 1e11, 3.0]) for i in range(1, 30)]
    saved(spark, rows, tmp_path)
    found = {(r.vec_id, r.component): r.deviation for r in whitening.op11_whitening(spark, str(tmp_path)).collect()}
    assert found == {(r[0], r[1]): r[3] for r in slow(rows)}


@pytest.mark.parametrize("spectrum", [
    np.linspace(900, 1000, 300), np.r_[[5000, 4999.9, 4999.8, 4999.7, 4999.6], np.full(200, 10.0)], np.ones(100),
    np.r_[np.full(40, 7.0), np.ones(100)], 2.0 ** -np.arange(90.0), np.r_[[1.0], np.zeros(80)], np.zeros(50),
])
def test_eigenpairs_of_hard_spectra(spectrum):
    draw = np.random.default_rng(4)
    turn = np.linalg.qr(draw.normal(size=(len(spectrum),) * 2))[0]
    matrix = turn * spectrum @ turn.T
    values, vectors = whitening.leading_eigenpairs(lambda q: matrix @ q, len(spectrum), 4)
    top = max(spectrum)
    assert np.abs(values - np.sort(spectrum)[::-1][:4]).max() <= 1e-11 * top
    assert np.linalg.norm(matrix @ vectors - vectors * values) <= 1e-10 * top
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_sums_do_not_lose_digits():
    total = whitening._Sum(1, 1)
    for part in [1e16, *[1.0] * 1000, -1e16]:
        total.add(np.array([[part]]))
    assert total.total()[0, 0] == 1000.0
