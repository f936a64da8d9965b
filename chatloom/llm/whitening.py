"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Every entry c becomes the integer floor(64 c) + 1000000 (the offset cancels in all that
follows, so it is never carried). Counts, sums and products are added up exactly: inside
a task by floating-point products that stay below 2^53, between tasks as decimals of
56-bit digits. That gives the integer scatter n * sum(x x') - S S', n^2 times the
covariance. Its characteristic polynomial is worked out modulo one prime a task
(``charpoly``), joined by Chinese remaindering, its largest roots isolated, and each
component found by inverse iteration on the null space, one component a task.

The driver holds the scatter and the polynomial, which depend on the dimension alone.
Rows are read three times (sums, spread of the whitened values, output) and never
shuffled.

Rows with a null vector, null or non-finite components, or a length other than the most
common one (the longer of equally common ones) are dropped. Entries beyond the range of
a long are held at its ends. Components of variance zero cannot be whitened and are left
out, so a single row, or rows that are all equal, give no rows. Components of equal
variance are an orthonormal basis of their space. Repeated rows count each, null and
repeated ids are carried. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import charpoly
from .common import common_length, finite, matrix

STEPS = 64
COMPONENTS = 32
#: bits of an entry in one product, rows of one product: 2 * 20 + 13 bits are exact
_LIMB, _ROWS = 20, 8192
#: bits of a digit between tasks
_DIGIT = 56


# ---- exact sums -----------------------------------------------------------------
def steps_of(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) as longs."""
    return np.clip(np.floor(STEPS * vectors), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers."""
    limbs, rest = [], x
    while np.abs(rest.astype(np.float64)).max(initial=0) >= 1 << _LIMB:
        limbs.append(rest & ((1 << _LIMB) - 1))
        rest = rest >> _LIMB
    limbs = [p.astype(np.float64) for p in (*limbs, rest)]
    out = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            for s in range(0, len(x), _ROWS):
                out += (a[s : s + _ROWS].T @ b[s : s + _ROWS]).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return out


def _digits(v: int) -> list[int]:
    out = []
    while not -(1 << _DIGIT) < v < 1 << _DIGIT:
        out.append(v & ((1 << _DIGIT) - 1))
        v >>= _DIGIT
    return [*out, v]


def scatter(rows: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, the sums S and n * sum(x x') - S S' of the vectors in ``rows``."""

    def run(batches):
        n, sums, products = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            x = steps_of(matrix(batch.column(0), dimension))
            n += len(x)
            sums += x.astype(object).sum(axis=0) if len(x) else 0
            products += exact_products(x)
        told = [(-1, -1, n), *[(i, -1, int(v)) for i, v in enumerate(sums)]]
        told += [(i, j, int(products[i, j])) for i in range(dimension) for j in range(i, dimension)]
        flat = [(i, j, k, v) for i, j, total in told for k, v in enumerate(_digits(total))]
        cols = list(zip(*flat, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["i", "j", "k", "v"])

    parts = rows.mapInArrow(run, "i int, j int, k int, v long")
    found = parts.groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    total: dict[tuple[int, int], int] = {}
    for r in found:
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (int(r.v) << (_DIGIT * r.k))
    n = total.get((-1, -1), 0)
    sums = [total.get((i, -1), 0) for i in range(dimension)]
    products = [[n * total.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(dimension)] for i in range(dimension)]
    return n, sums, products


# ---- components -----------------------------------------------------------------
def _over(spark: SparkSession, count: int):
    """One row, and one task as long as there are cores, for each of ``count`` pieces of work."""
    return spark.range(0, count, 1, max(1, min(count, spark.sparkContext.defaultParallelism)))


def characteristic(spark: SparkSession, products: list[list[int]]) -> list[int]:
    """Coefficients of the characteristic polynomial, constant first."""
    primes = charpoly.primes_needed(len(products), sum(products[i][i] for i in range(len(products))))

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                residues = charpoly.charpoly_mod(products, primes[k])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([residues.tolist()], pa.list_(pa.int64()))], ["k", "residues"])

    rows = _over(spark, len(primes)).mapInArrow(run, "k long, residues array<long>").collect()
    return charpoly.from_residues([primes[r.k] for r in rows], [list(r.residues) for r in rows])


def principal(spark: SparkSession, products: list[list[int]], most: int = COMPONENTS) -> tuple[list[Fraction], np.ndarray]:
    """Eigenvalues (falling, as exact middles of their intervals) and unit eigenvectors of ``products``."""
    poly = characteristic(spark, products)
    roots = charpoly.isolate(poly, most)
    if not roots:
        return [], np.zeros((0, len(products)))

    def run(batches):
        for batch in batches:
            for r in batch.column(0).to_pylist():
                a, b, k, count = roots[r]
                if count == 1:
                    a, b, k = charpoly.refine(poly, a, b, k)
                with localcontext() as ctx:
                    ctx.prec = charpoly.DIGITS
                    root = Decimal(a + b) / (Decimal(2) ** (k + 1))
                vectors = charpoly.null_space(products, root, count)
                told = [pa.array([r] * count), pa.array([str(Fraction(a + b, 2 ** (k + 1)))] * count), pa.array(vectors.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(told, ["r", "root", "vector"])

    found = _over(spark, len(roots)).mapInArrow(run, "r long, root string, vector array<double>").collect()
    found = sorted(found, key=lambda f: f.r)[:most]
    return [Fraction(f.root) for f in found], np.array([list(f.vector) for f in found])


def _root(value: Fraction) -> float:
    """Square root of a fraction, to double precision."""
    shift = max(0, 120 - value.numerator.bit_length() + value.denominator.bit_length())
    shift += shift & 1
    return float(Fraction(isqrt((value.numerator << shift) // value.denominator), 1 << (shift // 2)))


# ---- rows -----------------------------------------------------------------------
class Whitener:
    """Deviation and whitened values of integer vectors."""

    def __init__(self, n: int, sums: list[int], values: list[Fraction], vectors: np.ndarray):
        self.n, self.sums = n, sums
        # the eigenvalues of the covariance are those of the scatter over n^2
        self.axes = (vectors / np.array([_root(v) for v in values])[:, None]).T

    def of(self, x: np.ndarray) -> tuple[list[int] | np.ndarray, np.ndarray]:
        most = self.n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) + max(map(abs, self.sums))
        small = most * most * x.shape[1] < 1 << 62
        kind = np.int64 if small else object
        away = self.n * x.astype(kind) - np.array(self.sums, kind)
        return (away * away).sum(axis=1), away.astype(np.float64) @ self.axes


def identity_error(rows: DataFrame, dimension: int, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity."""
    m = whitener.axes.shape[1]

    def run(batches):
        n, sums, inner, outer = 0, np.zeros(m), np.zeros((m, m)), np.zeros((m, m))
        for batch in batches:
            if not batch.num_rows:
                continue
            w = whitener.of(steps_of(matrix(batch.column(0), dimension)))[1]
            mean = w.mean(axis=0)
            away = w - mean
            n += len(w)
            sums += len(w) * mean
            inner += away.T @ away
            outer += len(w) * np.outer(mean, mean)
        i, j = np.triu_indices(m)
        spread = (inner + outer)[i, j]
        cols = [np.concatenate((i, np.arange(m))), np.concatenate((j, np.full(m, -1))), np.concatenate((spread, sums))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "v"])

    found = rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    told = {(r.i, r.j): r.v / whitener.n for r in found}
    # block means are of the order of rounding errors, so their products cancel nothing
    return max(abs(v - told[i, -1] * told[j, -1] - (i == j)) for (i, j), v in told.items() if j >= 0)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is exact, and null where it does not fit in a long.
    """
    spark = vectors.sparkSession
    dimension = common_length(vectors, vector)
    rows = vectors.filter(finite(vectors[vector], dimension)).select(vectors[key].alias("__key"), vectors[vector].alias("__vector"))
    kind = rows.schema["__key"].dataType
    schema = T.StructType([
        T.StructField("__key", kind), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    n, sums, products = scatter(rows.select("__vector"), dimension) if dimension else (0, [], [])
    values, axes = principal(spark, products, components) if n else ([], None)
    if not values:
        empty = spark.createDataFrame([], schema)
        return empty.select(
            F.col("__key").alias(key), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation",
            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"),
        )
    whitener = Whitener(n, sums, values, axes)
    error = identity_error(rows.select("__vector"), dimension, whitener)
    trace = sum(products[i][i] for i in range(dimension))
    width = len(values)

    def run(batches):
        for batch in batches:
            deviation, white = whitener.of(steps_of(matrix(batch.column(1), dimension)))
            told = [int(v) if v < 1 << 63 else None for v in deviation] if deviation.dtype == object else deviation
            edges = np.arange(0, white.size + 1, width, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.int64()), lists], schema.names)

    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    told = rows.mapInArrow(run, schema).select("__key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return told.select(
        F.col("__key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
