"""Whitening against numpy's eigenvectors and exact determinants."""

import decimal
from fractions import Fraction

import numpy as np
import pytest

from kilowatt.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, n string"


def _polynomial(m):
    """det(x - m) by Faddeev and LeVerrier, in fractions."""
    d = len(m)
    a = [[Fraction(v) for v in row] for row in m]
    c, power = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        power = [[sum(a[i][t] * (power[t][j] + (c[-1] if t == j else 0)) for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(power[i][i] for i in range(d)) / k)
    return [int(v) for v in c[::-1]]


def _scatter(seed, d, scale=50, rank=None):
    rng = np.random.default_rng(seed)
    x = rng.integers(-scale, scale, (d + 3 if rank is None else rank, d)).astype(object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize("m", [_scatter(1, 1), _scatter(2, 5), _scatter(3, 9, 10**6), _scatter(4, 6, rank=3), [[2, 0, 0], [0, 2, 0], [0, 0, 0]], [[0, 0], [0, 0]]])
def test_characteristic_polynomial(spark, m):
    assert whitening.characteristic_polynomial(spark, m) == _polynomial(m)


def test_roots_with_repeats():
    c = [1]
    for root in (7, 7, 7, 3, 1000, 12345):
        c = [a - root * b for a, b in zip([0, *c], [*c, 0], strict=True)]
    assert [whitening.roots_above(c, p, 0) for p in (0, 3, 6, 7, 1000, 12345)] == [6, 5, 5, 2, 1, 0]
    found = whitening.isolate(c, 6)
    assert [x[3] for x in found] == [1, 1, 3, 1]
    with decimal.localcontext(prec=whitening.DIGITS):
        roots = [whitening.refine(c, *x) for x in found]
    assert all(abs(a - b) < decimal.Decimal(10) ** -40 for a, b in zip(roots, (12345, 1000, 7, 3), strict=True))


def _numpy(rows):
    x = np.floor(64 * rows) + 1_000_000
    fit = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    return x, fit, e, v


def _whitened(got, ids):
    return got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].values


def test_whitening_against_numpy(spark):
    """A third of the rows are one vector, which counts once; zero vectors stay; a foreign column ``n``."""
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(300, 20)) * np.linspace(0.1, 3, 20)
    rows[100:200] = rows[0]
    rows[200] = 0
    data = [(i, r.tolist(), "x") for i, r in enumerate(rows)]
    data += [(1000, None, "x"), (1001, [None] + [1.0] * 19, "x"), (1002, [float("nan")] + [1.0] * 19, "x"),
             (1003, [float("-inf")] + [1.0] * 19, "x"), (1004, [1.0, 2.0], "x"), (1005, [], "x")]
    got = whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(5)).toPandas()
    x, fit, e, v = _numpy(rows)
    assert sorted(got.vec_id.unique()) == list(range(300)) and set(got.component) == set(range(1, 17)) and len(got) == 300 * 16
    want = (x - fit.mean(0)) @ v[:, :16] / np.sqrt(e[:16])
    have = _whitened(got, range(300))
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), e[:16] / e.sum(), rtol=1e-12)
    n, s = len(fit), fit.sum(0).astype(int)
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    assert got[got.component == 1].set_index("vec_id").deviation.astype(object).loc[list(range(300))].map(int).tolist() == exact
    assert got.n.unique().tolist() == [n] and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_equal_eigenvalues_share_a_space(spark):
    """The corners of a box of equal sides: all eigenvalues are one."""
    rows = [(i, [float(a), float(b), float(c)], None) for i, (a, b, c) in enumerate(np.ndindex(2, 2, 2))]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    have = _whitened(got, range(8))
    assert np.abs(have.T @ have / 8 - np.eye(3)).max() < 1e-12 and np.allclose(got.explained, 1 / 3, rtol=1e-14)


def test_close_eigenvalues_are_told_apart(spark):
    """Two eigenvalues that agree in ten digits: only one of the coordinates has the larger."""
    far = 10**6
    rows = [[far, 0], [-far, 0], [0, far + 1e-4], [0, -far - 1e-4]]
    rows = [(i, [float(x) for x in r], None) for i, r in enumerate(rows)]
    got = _whitened(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(2)).toPandas(), range(4))
    assert np.allclose(np.abs(got), [[0, 2**0.5], [0, 2**0.5], [2**0.5, 0], [2**0.5, 0]], atol=1e-6)


def test_flat_directions_large_numbers_and_few_rows(spark):
    """A component without variance is not returned; 64 c stops at 9e18; equal vectors have none at all."""
    flat = [(i, [float(i), 2.0 * i, 5.0], None) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).toPandas()
    assert set(got.component) == {1} and got.explained[0] == 1.0
    large = [(0, [1e300, 1.0], None), (1, [-1e300, 2.0], None), (2, [0.5, 3.0], None)]
    got = whitening.whiten(spark.createDataFrame(large, SCHEMA)).toPandas()
    assert len(got) == 6 and got.identity_error[0] < 1e-4
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], None)] * 3, SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    repeated = whitening.whiten(spark.createDataFrame([(None, [1.0], None), (7, [2.0], None), (7, [2.0], None)], SCHEMA)).toPandas()
    assert sorted(repeated.whitened.abs().round(12)) == [1.0, 1.0, 1.0] and repeated.vec_id.isna().sum() == 1


def test_query(spark):
    got = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint"
    pdf = got.toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x, fit, e, v = _numpy(np.stack(rows.embedding).astype(float))
    want = (x - fit.mean(0)) @ v[:, :16] / np.sqrt(e[:16])
    have = _whitened(pdf, rows.vec_id)
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-9
