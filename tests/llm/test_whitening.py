"""Whitening against exact fractions, and on the awkward tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from inocula.llm import whitening
from inocula.llm.common import importable
from inocula.llm.queries import op11_embedding_whitening


@pytest.fixture(scope="module")
def session(spark):
    importable(spark)
    return spark


def lattice(v, scale=whitening.SCALE, shift=whitening.SHIFT):
    return [math.floor(scale * float(np.float32(c))) + shift for c in v]


def exact(rows):
    """(n, sums, covariance as numerators over n**3) in whole numbers."""
    n, d = len(rows), len(rows[0])
    sums = [sum(r[i] for r in rows) for i in range(d)]
    y = [[n * r[i] - sums[i] for i in range(d)] for r in rows]
    return n, sums, y, [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]


SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, x int, w int"


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    base = [[rng.gauss(0, 1 + i) for i in range(6)] for _ in range(300)]
    base += [base[0]] * 100  # one vector with a quarter of the rows
    odd = [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf] + [0.0] * 5, [], [1.0, 2.0]]
    rows = [(i, v, 0, "kept", 1, 2) for i, v in enumerate(base)] + [(1000 + i, v, 0, "kept", 1, 2) for i, v in enumerate(odd)]
    return base, [*rows, (None, base[1], None, None, None, None)]


def test_covariance_is_exact_and_components_are_white(session, vectors):
    base, rows = vectors
    df = session.createDataFrame(rows, SCHEMA).repartition(5)
    model = whitening.fit_whitening(df, components=4)
    n, sums, y, cov = exact([lattice(v) for v in [*base, base[1]]])
    assert (model.n, list(model.sums)) == (n, sums)
    values, axes = np.linalg.eigh(np.array([[c / n**3 for c in row] for row in cov]))
    assert np.allclose(model.values, values[::-1][:4], rtol=1e-12)
    assert model.trace == pytest.approx(sum(cov[i][i] for i in range(6)) / n**3)
    white = whitening.whiten(df, model, out="whitened")
    assert sorted(white.columns) == sorted([*df.columns, "deviation"])
    got = sorted(((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"], r["whitened"]) for r in white.collect()), key=lambda r: r[0])
    assert [g[0] for g in got] == [-1, *range(len(base))]
    order = [len(base), *range(len(base))]
    assert [int(g[1]) for g in got] == [sum(a * a for a in y[i]) for i in order]
    want = (np.array(y, float) / n) @ (axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4]))
    mine = np.array([g[2] for g in got])
    for k in range(4):
        assert np.allclose(np.abs(mine[:, k]), np.abs(want[order, k]), atol=1e-9)
    w = mine - mine.mean(axis=0)
    error = np.abs(w.T @ w / n - np.eye(4)).max()
    assert whitening.identity_error(white, components=4) == pytest.approx(error, abs=1e-12)
    assert error < 1e-9


def test_numbers_wider_than_64_bits_stay_exact(session):
    rows = [(0, [1e12, 1.0]), (1, [-3e12, 2.0]), (2, [2e12, 4.0]), (3, [7e11, -1.0])]
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df)
    n, sums, y, cov = exact([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
    assert (model.n, list(model.sums)) == (n, sums)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, model).collect()}
    assert got == {i: sum(a * a for a in y[i]) for i in range(4)}
    assert model.trace == pytest.approx((cov[0][0] + cov[1][1]) / n**3, rel=1e-15)
    with pytest.raises(ValueError):
        whitening.fit_whitening(session.createDataFrame([(0, [1e15])], "vec_id long, embedding array<double>"))


def test_limb_sums():
    rng = np.random.default_rng(0)
    s = rng.integers(-(1 << 61), 1 << 61, (500, 3))
    assert whitening.square_sums(s) == [sum(int(v) ** 2 for v in s[:, j]) for j in range(3)]
    assert whitening.square_sums(s.astype(object)) == whitening.square_sums(s)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_to_whiten(session, rows):
    df = session.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whitening.fit_whitening(df)
    white = whitening.whiten(df, model)
    assert model.values == ()
    assert all(r["whitened"] == [] and r["deviation"] == 0 for r in white.collect())
    assert whitening.identity_error(white) is None


def test_registered_query(session):
    rows = op11_embedding_whitening(session, "/root/testdata/sf0.001").collect()
    vectors = session.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    n, sums, y, cov = exact([lattice(r["embedding"]) for r in vectors])
    values = np.linalg.eigvalsh(np.array([[c / n**3 for c in row] for row in cov]))[::-1]
    far = {r["vec_id"]: sum(a * a for a in z) for r, z in zip(vectors, y, strict=True)}
    assert len(rows) == 8 * n
    for r in rows:
        assert (r["n"], r["deviation"]) == (n, far[r["vec_id"]])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
