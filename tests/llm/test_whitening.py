"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest

from tidewell.llm import whitening
from tidewell.session import load

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(vectors, k=16):
    """vec_id -> (deviation, projections), eigenvalue shares; ``vectors``: (vec_id, floats)."""
    x = np.floor(64 * np.array([v for _, v in vectors], dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    exact = n * x - s
    deviation = [sum(int(v) ** 2 for v in row) for row in exact]
    return n, deviation, exact / n @ basis / np.sqrt(values), values / np.trace(y.T @ y / n)


def compare(rows, vectors, tolerance=1e-6):
    n, deviation, white, share = plain(vectors)
    place = {v[0]: i for i, v in enumerate(vectors)}
    assert len(rows) == len(vectors) * white.shape[1]
    got = np.zeros_like(white)
    for r in rows:
        i, c = place[r.vec_id], r.component - 1
        got[i, c] = r.whitened
        assert r.n == n and r.deviation == deviation[i] and r.identity_error <= 1e-4
        assert abs(r.explained - share[c]) <= 1e-4 * share[c]
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() <= tolerance


def test_equals_a_plain_eigendecomposition(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in load(spark, small, "embeddings").collect()]
    compare(whitening.whiten(load(spark, small, "embeddings")).collect(), rows)


def test_many_dimensions_need_several_passes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 220)) * np.linspace(3, 1, 220)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compare(whitening.whiten(df).collect(), rows)
    q = whitening.quantised(df).select("x").distinct()
    sums = [int(v) for v in np.array([r.x for r in q.collect()]).sum(axis=0)]
    model = whitening.fit(q, q.count(), sums, width=64)
    assert model.passes > 2 and len(model.values) == 16


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 11), float(i % 3) / 2]) for i in range(20)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [nan, 1.0, 1.0]), (94, [inf, 1.0, 1.0])]
    rows = [(*r, "x") for r in good + bad] + [(None, good[0][1], None), (3, good[3][1], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, N string")
    out = whitening.whiten(df)
    assert out.columns == COLUMNS
    found = out.collect()
    assert len(found) == 22 * 3
    null = {r.component: r.whitened for r in found if r.vec_id is None}
    assert null == {r.component: r.whitened for r in found if r.vec_id == 0}
    assert found[0].n == len({tuple(np.floor(64 * np.array(g[1]))) for g in good})
    # equal vectors have no variance; several lengths are spaces of their own
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0
    assert whitening.whiten(df.where("false")).count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 9)) for r in whitening.whiten(mixed).collect()) == [(i, 1, 2, 1.0) for i in (1, 2, 3, 4)]


def test_values_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(df).count()
