"""Whitening of embeddings along their leading principal components.

Vectors become integers, each distinct one counts once, and the leading eigenvectors of the
covariance V are found by Chebyshev-filtered subspace iteration, without V:

1. A pass over the vectors adds up ``(x - mean)((x - mean)ᵀ Q)`` for a block Q of ``BLOCK``
   columns (or of all dimensions, if they are fewer).  Vectors are centred exactly before they
   are multiplied; tasks report one small matrix each, which Spark adds up by dimension.  What
   comes to the driver is dimensions times ``BLOCK`` numbers, whatever the number of vectors.
2. A short Lanczos run gives a lower bound of the spectrum.  From there to the block's least
   Ritz value lies what is not wanted; a Chebyshev polynomial of degree ``DEGREE``, one pass for each
   degree, damps it.
3. QR and Rayleigh-Ritz give new Ritz pairs.  They are certified when the residuals
   ``|V u - e u|`` are below ``TOLERANCE`` times the largest eigenvalue, which bounds the
   eigenvalues' errors by as much and the angles of the eigenvectors by that over their gaps.

The passes read the distinct vectors from a table in the shared folder, packed in blocks.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out.
Shorter vectors count as filled up with zeros.  Repeated rows and equal vectors are each
projected but fitted once.  Entries beyond 64 bits take the nearest long.  There are at most as
many components as dimensions; one without variance has ``explained`` 0 (null, if nothing
varies) and ``whitened`` null, and is no part of ``identity_error`` (null, if no component is).
A deviation beyond 64 bits is null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from verbaloom.llm.common import free_name, stored, table

SCALE = 256
COMPONENTS = 4
BLOCK, DEGREE, LANCZOS = 32, 12, 8
#: Residuals relative to the largest eigenvalue: where a pair is certified, and where it is
#: certified still if rounding lets it come no nearer.
TOLERANCE, ROUNDING = 2e-14, 1e-11
#: A component is without variance if it has less than this share of the first one's.
FLAT = 1e-12
MAX_ROUNDS = 200
#: Vectors that are packed, and multiplied, together.
ROWS = 2048
LIMBS, LIMB_BITS = 6, 32
PACKED = StructType([StructField("n", LongType()), StructField("type", LongType()), StructField("data", BinaryType())])


def integer_vector(vector: Column) -> Column:
    """Each entry times ``SCALE``, rounded down, as long; null unless all entries are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x``, of Python's integers if results up to ``bound`` don't fit 64 bits."""
    return x if bound < 1 << 63 else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def packed_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """Column ``x`` in blocks of ``ROWS`` vectors, as bytes of the narrowest integers."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS), dims)
                size = next((s for s in (1, 2, 4) if _largest(x) < 1 << (8 * s - 1)), 8)
                raw = x.astype(f"<i{size}").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], names=PACKED.names)
    return vectors.mapInArrow(pack, PACKED)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.to_pylist():
            yield np.frombuffer(row["data"], f"<i{row['type']}").astype(np.int64).reshape(row["n"], dims)


class _Sum:
    """Adds matrices up in twice the precision."""

    def __init__(self, *shape: int):
        self.high, self.low = np.zeros(shape), np.zeros(shape)

    def add(self, part: np.ndarray) -> None:
        total = self.high + part
        back = total - self.high
        self.low += (self.high - (total - back)) + (part - back)
        self.high = total

    def total(self) -> np.ndarray:
        return self.high + self.low


@dataclass(frozen=True)
class Fit:
    """The distinct vectors: how many, and exact sums and sums of squares by dimension."""

    packed: DataFrame
    n: int
    sums: list[int]
    squares: list[int]

    @property
    def dims(self) -> int:
        return len(self.sums)

    def trace(self) -> float:
        return float(sum(self.n * q - s * s for s, q in zip(self.sums, self.squares, strict=True))) / self.n / self.n if self.n else 0.0


def fitted(vectors: DataFrame, dims: int) -> Fit:
    packed = stored(packed_vectors(vectors.select("x").distinct(), dims), "whitening-vectors")
    limbs = [f"limb{k}" for k in range(LIMBS)]
    schema = StructType([StructField(c, LongType()) for c in ("dim", *limbs)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * dims, [0] * dims
        for x in _blocks(batches, dims):
            most = _largest(x)
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, _exact(x, most * len(x)).sum(axis=0), strict=True)]
            wide = _exact(x, most * most * len(x))
            squares = [a + int(b) for a, b in zip(squares, (wide * wide).sum(axis=0), strict=True)]
        rows = []
        for value in (n, *sums, *squares):  # limbs, so that Spark's sums of them are exact
            row = [(value >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)]
            rows.append([*row, value >> (LIMB_BITS * (LIMBS - 1))])
        columns = [range(len(rows)), *zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=schema.names)
    added = packed.mapInArrow(add, schema).groupBy("dim").agg(*[F.sum(c).alias(c) for c in limbs])
    totals = [0] * (2 * dims + 1)
    for row in added.collect():  # 2 * dims + 1 rows
        totals[row["dim"]] = sum(int(row[c]) << (LIMB_BITS * k) for k, c in enumerate(limbs))
    return Fit(packed, totals[0], totals[1 : dims + 1], totals[dims + 1 :])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact."""
    bound = n * _largest(x) + max(map(abs, sums), default=0)
    return _exact(x, bound) * n - np.array(sums, np.int64 if bound < 1 << 63 else object)


def _distributed(fit: Fit, part: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum over all blocks of centred vectors of ``part``, a matrix of ``rows`` by ``columns``."""
    n, sums, dims = fit.n, fit.sums, fit.dims
    names = [f"c{k}" for k in range(columns)]
    schema = StructType([StructField("row", LongType()), *[StructField(c, DoubleType()) for c in names]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sum(rows, columns)
        for x in _blocks(batches, dims):
            total.add(part((_centred(x, n, sums) / n).astype(np.float64)))
        columns_ = [pa.array(np.arange(rows)), *[pa.array(np.ascontiguousarray(c)) for c in total.total().T]]
        yield pa.RecordBatch.from_arrays(columns_, names=schema.names)
    added = fit.packed.mapInArrow(add, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    result = np.zeros((rows, columns))
    for row in added.collect():  # ``rows`` rows
        result[row["row"]] = [row[c] for c in names]
    return result


def covariance_times(fit: Fit, q: np.ndarray) -> np.ndarray:
    return _distributed(fit, lambda x: x.T @ (x @ q), *q.shape) / fit.n


def lowest_bound(times: Callable[[np.ndarray], np.ndarray], dims: int, draw: np.random.Generator) -> float:
    """A lower bound of the spectrum by ``LANCZOS`` steps: least Ritz value less what is left over."""
    q = draw.standard_normal(dims)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(LANCZOS, dims)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= FLAT * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    return max(0.0, float(ritz[0]) - beta[len(alpha) - 1])


def chebyshev_filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, cut: float, top: float) -> np.ndarray:
    """The polynomial of degree ``DEGREE`` that is small between ``low`` and ``cut``, applied to
    the columns of ``q`` by its three-term recurrence, scaled to 1 at ``top``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = half / (top - middle)
    tau = 2 / sigma
    y = (times(q) - middle * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        following = 1 / (tau - sigma)
        q, y = y, (times(y) - middle * y) * (2 * following / half) - sigma * following * q
        sigma = following
    return y


def leading_eigenpairs(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns, of the
    symmetric matrix without negative eigenvalues that ``times`` multiplies by."""
    draw = np.random.default_rng(seed)
    q = np.linalg.qr(draw.standard_normal((dims, min(dims, max(BLOCK, 2 * wanted)))))[0]
    low, last = None, float("inf")
    for _ in range(MAX_ROUNDS):
        w = times(q)
        inner = q.T @ w
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        residual = float(np.linalg.norm(w - q * values, axis=0)[:wanted].max())
        top = max(float(values[0]), 0.0)
        if residual <= TOLERANCE * top or (last / 2 <= residual <= ROUNDING * top):
            vectors = q[:, :wanted]
            return np.maximum(values[:wanted], 0.0), vectors / np.linalg.norm(vectors, axis=0)
        last = residual
        if low is None:
            low = lowest_bound(times, dims, draw)
        cut = min(max(float(values[-1]), 1e-9 * top), (1 - 1e-9) * top)
        q = np.linalg.qr(chebyshev_filtered(times, q, min(low, 0.999 * cut), cut, top))[0]
    raise RuntimeError(f"components are not certified after {MAX_ROUNDS} rounds: residual {last:g}")


@dataclass(frozen=True)
class Whitening:
    fit: Fit
    #: Eigenvalues and unit eigenvectors (columns) of the components, by falling eigenvalue.
    values: np.ndarray
    vectors: np.ndarray

    @property
    def varying(self) -> np.ndarray:
        return self.values > FLAT * max(float(self.values.max(initial=0.0)), 0.0)

    def matrix(self) -> np.ndarray:
        """Vectors over the roots of their eigenvalues, for the components that vary."""
        return self.vectors[:, self.varying] / np.sqrt(self.values[self.varying])

    def explained(self) -> list[float | None]:
        trace = self.fit.trace()
        return [float(e) / trace if trace and v else (0.0 if trace else None) for e, v in zip(self.values, self.varying, strict=True)]

    def identity_error(self) -> float | None:
        """Largest absolute entry of the whitened vectors' covariance less the identity, by a pass of its own."""
        matrix = self.matrix()
        k = matrix.shape[1]
        if not k:
            return None

        def part(x: np.ndarray) -> np.ndarray:
            w = x @ matrix
            return np.vstack([w.T @ w, w.sum(axis=0)])
        sums = _distributed(self.fit, part, k + 1, k) / self.fit.n
        return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())

    def projected(self, x: Column) -> Column:
        """``deviation`` and ``whitened`` (an array by component) of the integer vectors ``x``."""
        n, sums, dims, matrix, varying = self.fit.n, self.fit.sums, self.fit.dims, self.matrix(), self.varying

        @F.arrow_udf(StructType([StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]))
        def project(lists: pa.Array) -> pa.Array:
            deviations, scores = [], []
            for at in range(0, len(lists), ROWS):
                centred = _centred(_matrix(lists.slice(at, ROWS), dims), n, sums)
                most = _largest(centred)
                wide = _exact(centred, most * most * dims)
                deviations += [int(v) if v < 1 << 63 else None for v in (wide * wide).sum(axis=1)]
                whole = np.full((len(centred), len(varying)), np.nan)
                whole[:, varying] = (centred / n).astype(np.float64) @ matrix
                scores.append(whole)
            flat = np.concatenate(scores).ravel() if scores else np.empty(0)
            values = pa.array(flat, pa.float64(), mask=np.isnan(flat))
            offsets = np.arange(len(lists) + 1, dtype=np.int32) * len(varying)
            return pa.StructArray.from_arrays(
                [pa.array(deviations, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["deviation", "whitened"])
        return project(x)


def whitened(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The rows of ``df`` that have a usable vector, with ``deviation`` and ``whitened`` (array), and
    the fit.  Columns of these names are replaced.  The fit is null where no row or dimension is left."""
    own = free_name(df, "x")
    rows = df.withColumn(own, integer_vector(F.col(vector))).filter(F.col(own).isNotNull())
    dims = rows.agg(F.max(F.size(own))).first()[0] or 0
    through = [F.col(c) for c in df.columns if c not in ("deviation", "whitened")]
    if not dims:
        nothing = F.when(F.col(own).isNotNull(), F.lit(0)).cast("long")
        return rows.select(*through, nothing.alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    short = F.size(own) < dims
    filled = F.when(short, F.concat(own, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(own)))).otherwise(F.col(own))
    rows = rows.withColumn(own, filled)
    fit = fitted(rows.select(F.col(own).alias("x")), dims)
    values, vectors = leading_eigenpairs(lambda q: covariance_times(fit, q), dims, min(components, dims))
    model = Whitening(fit, values, vectors)
    shape = free_name(rows, "projected")
    rows = rows.withColumn(shape, model.projected(F.col(own)))
    return rows.select(*through, F.col(shape)["deviation"].alias("deviation"), F.col(shape)["whitened"].alias("whitened")), model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first components."""
    rows, model = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(e).cast("double") for e in (model.explained() if model else [])]).cast("array<double>")
    n, error = (model.fit.n, model.identity_error()) if model else (0, None)
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
