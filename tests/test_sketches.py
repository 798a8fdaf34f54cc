"""Quantile sketches: stated errors, merging, bounds and histograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import sketches as K
from gridspark.operators import statistics as ST


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    v = {"even": rng.uniform(-3, 9, 60000), "steep": rng.exponential(2, 60000) ** 2, "steps": rng.integers(0, 7, 60000).astype(float)}
    rows = list(zip(*(x.tolist() for x in v.values()), (rng.integers(0, 9, 60000)).tolist()))
    return v, spark.createDataFrame(rows, "even double, steep double, steps double, tile int").repartition(13).cache()


@pytest.mark.parametrize("k", [100, 400])
def test_rank_error(values, k):
    """Quantiles are within the stated error, from one pass and from tiles merged in two steps."""
    v, df = values
    tiles = K.quantile_sketches(df, list(v), ["tile"], k)
    some = K.merge_sketches(tiles.where("tile < 4").drop("tile"), k=k), K.merge_sketches(tiles.where("tile >= 4").drop("tile"), k=k)
    shares = [i / 20 for i in range(21)]
    for sketches in (K.quantile_sketches(df, list(v), k=k), K.merge_sketches(*some, k=k)):
        rows = K.quantiles(sketches, {f"q{i}": q for i, q in enumerate(shares)}).collect()
        assert {r.feat for r in rows} == set(v)
        for r in rows:
            x = np.sort(v[r.feat])
            assert r.n == len(x) and (r.q0, r.q20) == (x[0], x[-1])
            for i, q in enumerate(shares):
                below, upto = np.searchsorted(x, r[f"q{i}"], "left") / len(x), np.searchsorted(x, r[f"q{i}"], "right") / len(x)
                assert below - K.rank_error(k) <= q <= upto + K.rank_error(k)


def test_proposed_bounds_and_exact_counts(values):
    v, df = values
    sketches = K.quantile_sketches(df, list(v))
    bounds = K.proposed_bounds(sketches, 0.01)
    for f in ("even", "steep"):
        lo, hi = bounds[f]
        assert abs(float((v[f] < lo).mean()) - 0.01) <= K.rank_error() and abs(float((v[f] > hi).mean()) - 0.01) <= K.rank_error()
    assert K.proposed_bounds(sketches, 0.0)["steps"] == (0.0, 6.0)
    got = K.counts_within(df, bounds, 20).collect()
    for f, (lo, hi) in bounds.items():
        mine = {r.bin: r.n for r in got if r.feat == f}
        want = np.minimum(np.floor((np.clip(v[f], lo, hi) - lo) / (hi - lo) * 20), 19).astype(int)
        assert mine == {int(b): int(n) for b, n in zip(*np.unique(want, return_counts=True))}
        assert sum(r.n_under for r in got if r.feat == f) == (v[f] < lo).sum() and sum(r.n_over for r in got if r.feat == f) == (v[f] > hi).sum()


def test_sketched_histogram_is_as_near_as_stated(spark, sf):
    errors = fx.errors(spark, sf).cache()
    exact = {(r.feat, r.source, r.bin): r.n for r in ST.range_histogram(errors, "true_res", "pred_res", 40).collect()}
    parts = K.sketches_by_source(errors.withColumn("half", F.col("x") % 2), {"truth": "true_res", "pred": "pred_res"}, by=["half"])
    whole = K.merge_sketches(parts.drop("half"), by=["source"])
    about = K.sketched_histogram(whole, 40).collect()
    assert len(about) == 2 * 2 * 40 and {(r.feat, r.source, r.bin) for r in about} >= set(exact)
    for r in about:
        assert abs(r.n_about - exact.get((r.feat, r.source, r.bin), 0)) <= r.n_error
    # Read once, against twice for the exact one.
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan")
    assert scans(K.sketched_histogram(K.sketches_by_source(errors, {"truth": "true_res", "pred": "pred_res"}), 40)) <= scans(
        ST.range_histogram(errors, "true_res", "pred_res", 40))
    errors.unpersist()


def test_odd_values(spark):
    df = spark.createDataFrame([(1, None, float("nan"), 4.0), (1, None, 2.0, 4.0), (2, None, None, 4.0)], "k int, a double, b double, c double")
    rows = {(r.k, r.feat): (r.n, r.lo, r.hi) for r in K.quantiles(K.quantile_sketches(df, ["a", "b", "c"], ["k"]), {"lo": 0, "hi": 1}).collect()}
    assert rows[1, "a"] == (0, None, None) and rows[1, "b"] == (1, 2.0, 2.0) and rows[2, "b"] == (0, None, None) and rows[1, "c"] == (2, 4.0, 4.0)
    merged = K.merge_sketches(K.quantile_sketches(df, ["a", "b", "c"], ["k"]).drop("k"))
    assert K.proposed_bounds(merged) == {"b": (2.0, 3.0), "c": (4.0, 5.0)}
    assert K.merge_sketches(K.quantile_sketches(df.limit(0), ["a"], ["k"]).drop("k")).count() == 0
