"""Exact percentiles against numpy, with buckets so small that they must be split."""

import numpy as np

from tidewell.operators.quantiles import percentiles
from tidewell.session import Scratch


def check(spark, rows, shares, most):
    df = spark.createDataFrame(rows, "k string, v double")
    scratch = Scratch(spark)
    table = scratch.put(df, "values")
    found = {r.k: (r["values"], r.p) for r in percentiles(table, ["k"], "v", shares, scratch, most).collect()}
    want = {}
    for k, v in rows:
        if v is not None and v == v:
            want.setdefault(k, []).append(v)
    assert found.keys() == want.keys()
    for k, values in want.items():
        n, p = found[k]
        assert n == len(values)
        assert np.allclose(p, np.quantile(values, shares), rtol=1e-12, atol=1e-300), k
    scratch.clear()


def test_percentiles_equal_numpy_when_buckets_are_split(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.lognormal(8, 2, 700)] + [("b", float(v)) for v in rng.normal(0, 1, 400)]
    rows += [("hot", 1000.0 + float(v)) for v in rng.random(2000)] + [("same", 5.0)] * 300 + [(None, float(v)) for v in range(50)]
    rows += [("zero", 0.0), ("zero", -0.0), ("zero", 1e-300), ("wide", -1e307), ("wide", 1e307), ("one", 3.5), ("none", None), ("none", float("nan"))]
    check(spark, rows, [0.0, 0.02, 0.5, 0.98, 1.0], 20)


def test_one_pass_is_enough_for_small_buckets(spark):
    rows = [("a", float(v % 17)) for v in range(100)] + [("a", None)] * 3
    check(spark, rows, [0.5], 100_000)
    check(spark, [("x", None)], [0.5], 10)
