"""Whitening of vectors through the exact characteristic polynomial of their scatter.

1. A vector becomes integers, floor(64 c) + 1,000,000 an entry. The fit list has
   each distinct integer vector once; one aggregation gives its number n, sums S
   and products G, all exact. M = n G - S S' is n * n times their covariance.
2. The characteristic polynomial of M, integers of thousands of bits: a Spark task
   reduces M to Hessenberg form modulo a 31-bit prime and reads the polynomial
   off; as many primes as Maclaurin's bound on the coefficients of a positive
   semidefinite matrix asks for are put together by Chinese remaindering.
3. All roots are real, so Descartes' rule counts the roots above a point
   exactly, repeated ones included. Halving intervals isolates the largest.
4. For each isolated root a task bisects it to ``BITS`` bits, by the exact sign of
   the polynomial, and finds the null space of M - root by inverse iteration in
   decimal arithmetic of ``DIGITS`` digits. Roots that agree in ``BITS`` bits are
   one, with a space of as many dimensions.
5. Every vector is projected on the components, a map without a shuffle.

What passes the driver has the size of M, whatever the number of vectors.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilowatt.llm.shared import checkpointed

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BITS = 192
DIGITS = 100
#: Rows worked on at once.
ROWS = 4_096
#: 64 times an entry stops here: what follows must fit in 64 bits.
LARGEST = 9e18


def integers(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry, taken as double; 64 c stops at +-9e18."""
    scaled = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(scaled(c)) + F.lit(SHIFT))


def whole(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _rows(column: pa.Array, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, floor(64 c) of ROWS rows at most) of a list column of integers."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d) - SHIFT


def _products(x: np.ndarray) -> np.ndarray:
    """x' x in exact integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:
        part = x.astype(float)
        return (part.T @ part).astype(np.int64).astype(object)
    if most * most * len(x) < 1 << 62:
        return (x.T @ x).astype(object)
    x = x.astype(object)
    return x.T @ x


def scatter(distinct: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of the distinct vectors x - 1,000,000; a row for each pair of
    dimensions leaves a task and reaches the driver."""
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for _, x in _rows(batch.column(0), d):
                n, sums, products = n + len(x), sums + x.astype(object).sum(0), products + _products(x)
        if n:
            value = [n, *sums, *products[upper]]
            i = np.concatenate([[-2], np.full(d, -1), upper[0]]).astype(np.int32)
            j = np.concatenate([[0], np.arange(d), upper[1]]).astype(np.int32)
            parts = [pa.array([decimal.Decimal(part) for part in half], pa.decimal128(38, 0)) for half in zip(*[divmod(int(v), 1 << 64) for v in value], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *parts], names=["i", "j", "high", "low"])

    rows = distinct.mapInArrow(partial, "i int, j int, high decimal(38,0), low decimal(38,0)")
    total = rows.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = {(r["i"], r["j"]): (int(r["high"]) << 64) + int(r["low"]) for r in total}
    n, s = found[-2, 0], [found[-1, j] for j in range(d)]
    return n, s, [[n * found[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these witnesses decide all n below 3,215,031,751."""
    low, twos = n - 1, 0
    while low % 2 == 0:
        low, twos = low // 2, twos + 1
    for witness in (2, 3, 5, 7):
        x = pow(witness, low, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bound: int) -> list[int]:
    """The largest primes below 2**31 whose product is over ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(m: list[list[int]], p: int) -> np.ndarray:
    """Coefficients, the constant first, of det(x - m) modulo p < 2**31."""
    h = np.array([[v % p for v in row] for row in m], np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        r = k + int(below[0])
        h[[k, r]] = h[[r, k]]
        h[:, [k, r]] = h[:, [r, k]]
        times = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - times[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * times % p).sum(1)) % p
    # leading minors: the k-th from all before it, along the subdiagonal
    out = np.zeros((d + 1, d + 1), np.int64)
    out[0, 0] = 1
    for k in range(1, d + 1):
        out[k, 1:] = out[k - 1, :-1]
        factor = np.zeros(k, np.int64)
        along = 1
        for i in range(k - 1, -1, -1):
            factor[i] = int(h[i, k - 1]) * along % p
            along = along * int(h[i, i - 1]) % p if i else along
        out[k] = (out[k] - (factor[:, None] * out[:k] % p).sum(0)) % p
    return out[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients, the constant first, of det(x - m), m positive semidefinite.

    The k-th symmetric function of the roots is at most C(d, k) (trace / d)**k.
    """
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    modulus = primes(2 * max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([polynomial_mod(m, modulus[k]).tolist() for k in which], pa.list_(pa.int64()))], names=["k", "residues"])

    tasks = min(len(modulus), 256)
    found = spark.range(0, len(modulus), 1, tasks).toDF("k").mapInArrow(reduced, "k long, residues array<long>").collect()
    product, out = 1, [0] * (d + 1)
    for row in found:  # one prime more at a time
        p = modulus[row["k"]]
        inverse = pow(product % p, -1, p)
        out = [c + product * ((r - c) * inverse % p) for c, r in zip(out, row["residues"], strict=True)]
        product *= p
    return [c - product if 2 * c > product else c for c in out]


def roots_above(c: list[int], point: int, k: int) -> int:
    """How many roots, repeated ones included, are above point / 2**k, if all are
    real: the changes of sign of the polynomial moved there."""
    d = len(c) - 1
    q = [v << k * (d - i) for i, v in enumerate(c)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            q[j] += point * q[j + 1]
    signs = [v > 0 for v in q if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolate(c: list[int], wanted: int, bits: int = BITS) -> list[tuple[int, int, int, int]]:
    """(low, high, k, number of roots) of intervals (low, high] / 2**k, the highest
    first, with at least ``wanted`` of the positive roots, if there are so many: one root in each, or
    several that agree in ``bits`` bits."""
    if len(c) < 2:
        return []
    top = max(1, -c[-2]).bit_length()  # the sum of the roots bounds each
    out, found = [], 0
    todo = [(0, 1 << top, 0, roots_above(c, 0, 0), 0)]
    while todo and found < wanted:
        low, high, k, above_low, above_high = todo.pop()
        n = above_low - above_high
        if n == 0:
            continue
        if n == 1 and low > 0 or (high - low) << bits <= low:
            out.append((low, high, k, n))
            found += n
            continue
        middle = roots_above(c, low + high, k + 1)
        todo.append((2 * low, low + high, k + 1, above_low, middle))
        todo.append((low + high, 2 * high, k + 1, middle, above_high))
    return out


def refine(c: list[int], low: int, high: int, k: int, n: int, bits: int = BITS) -> decimal.Decimal:
    """The root in (low, high] / 2**k to ``bits`` bits, by the exact sign at middles."""
    def sign(point: int, k: int) -> int:
        value = 0
        for i, v in enumerate(reversed(c)):
            value = value * point + (v << k * i)
        return (value > 0) - (value < 0)

    if n == 1 and sign(high, k) == 0:
        return decimal.Decimal(high) / (1 << k)
    at_high = sign(high, k) if n == 1 else 0
    while (high - low) << bits > low:
        low, high, k = 2 * low, 2 * high, k + 1
        middle = (low + high) // 2
        here = sign(middle, k)
        if here == 0:
            return decimal.Decimal(middle) / (1 << k)
        low, high = (low, middle) if here == at_high else (middle, high)
    return decimal.Decimal(low + high) / (1 << (k + 1))


def null_space(m: list[list[int]], root: decimal.Decimal, n: int) -> list[np.ndarray]:
    """n orthonormal vectors of the null space of m - root: elimination with row
    exchanges once, then inverse iteration. Each has its largest entry positive."""
    d = len(m)
    a = np.array([[decimal.Decimal(v) for v in row] for row in m], object)
    a[np.arange(d), np.arange(d)] -= root
    largest = max(abs(v) for v in a.ravel()) or decimal.Decimal(1)
    least = largest.scaleb(-DIGITS + 8)
    order = np.arange(d)
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, r]], order[[k, r]] = a[[r, k]], order[[r, k]]
        if abs(a[k, k]) < least:
            a[k, k] = least
        if k + 1 < d:
            a[k + 1:, k] = a[k + 1:, k] / a[k, k]
            a[k + 1:, k + 1:] -= a[k + 1:, k, None] * a[k, k + 1:]
    rng = np.random.default_rng(d)
    out: list[np.ndarray] = []
    for _ in range(n):
        y = np.array([decimal.Decimal(int(v)) for v in rng.integers(-1 << 20, 1 << 20, d)], object)
        for _ in range(4):
            y = y[order]
            for k in range(1, d):
                y[k] -= a[k, :k] @ y[:k]
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] - (a[k, k + 1:] @ y[k + 1:] if k + 1 < d else 0)) / a[k, k]
            y = y / max(abs(v) for v in y)
            for _ in range(2):
                for v in out:
                    y = y - (v @ y) * v
            y = y / (y @ y).sqrt()
        out.append(y if max(y, key=abs) > 0 else -y)
    return out


def components(spark: SparkSession, m: list[list[int]], wanted: int = COMPONENTS) -> list[tuple[decimal.Decimal, np.ndarray]]:
    """(root of m, unit vector) of the largest positive roots, the largest first; each
    root is a row that a task works on."""
    c = characteristic_polynomial(spark, m)
    zero = next(i for i, v in enumerate(c) if v)
    c = c[zero:]
    clusters = isolate(c, wanted)
    if not clusters:
        return []

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with decimal.localcontext(prec=DIGITS):
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    root = refine(c, *clusters[at])
                    space = null_space(m, root, clusters[at][3])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at] * len(space)), pa.array([str(root)] * len(space)), pa.array([[float(v) for v in y] for y in space], pa.list_(pa.float64()))],
                        names=["at", "root", "vector"])

    rows = spark.range(0, len(clusters), 1, len(clusters)).toDF("at").mapInArrow(solve, "at long, root string, vector array<double>").collect()
    rows.sort(key=lambda r: r["at"])
    return [(decimal.Decimal(r["root"]), np.array(r["vector"])) for r in rows[:wanted]]


def whiten(df: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row
    for each usable row and each of its ``wanted`` largest components.

    Rows whose vector is null or empty, holds null or non-finite entries, or has
    another length than most (ties: the shorter) are left out; zero vectors, repeated vectors and
    repeated or null ids stay. deviation is exact, decimal(38,0), and null
    beyond 38 digits. A component whose eigenvalue is 0 cannot be whitened and
    is not returned, so equal vectors alone give no rows; nor does an empty table.
    Components of equal eigenvalues are some orthonormal basis of their space,
    the same in each run. Other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    result = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    usable = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(whole(F.col("v")))
    length = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if length is None:
        return spark.createDataFrame([], result)
    d = length["d"]
    rows = usable.where(F.size("v") == d).select("id", integers(F.col("v")).alias("x"))
    distinct = checkpointed(rows.select("x").distinct())
    n, s, m = scatter(distinct, d)
    found = components(spark, m, wanted)
    if not found:
        return spark.createDataFrame([], result)
    trace, k = sum(m[i][i] for i in range(d)), len(found)
    explained = np.array([float(root / trace) for root, _ in found])
    # whitened = (x - S / n) on the component over sqrt(root) / n
    onto = np.stack([v / float(root.sqrt()) for root, v in found], axis=1)
    sums = np.array(s, object)

    def apart(x: np.ndarray) -> np.ndarray:
        """n x - S, in 64 bits if it fits."""
        if n * int(np.abs(x).max(initial=0)) + max(abs(v) for v in s) < 1 << 62:
            return n * x - sums.astype(np.int64)
        return n * x.astype(object) - sums

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in _rows(batch.column(0), d):
                y = apart(x).astype(float) @ onto
                total += np.vstack([y.T @ y, y.sum(0)])
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    found_sums = distinct.mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    moment = np.zeros((k + 1, k))
    for row in found_sums:
        moment[row["i"], row["j"]] = row["v"] / n
    error = float(np.abs(moment[:k] - np.outer(moment[k], moment[k]) - np.eye(k)).max())

    def deviations(z: np.ndarray) -> pa.Array:
        if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * d < 2.0**62:
            return pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0), safe=False)
        exact = [int(v) for v in (z.astype(object) ** 2).sum(1)]
        return pa.array([decimal.Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _rows(batch.column(1), d):
                z = apart(x)
                y = z.astype(float) @ onto
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                     deviations(z).take(each), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, result)
