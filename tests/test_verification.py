"""Verification, merging, statistics and scoring on hand-made frames and by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import merging as M
from gridspark.operators import presets as P
from gridspark.operators import statistics as ST
from gridspark.operators import verification as V

KEYS = "y int, x int, init int, step int, feat string, true_prev double, true_state double, pred_res double"


def forecast(spark, states, preds, feat="a", x=0):
    """One sample from its states (initial one first) and predicted increments."""
    return spark.createDataFrame([
        (0, x, 0, i + 1, feat, float(states[i]), float(states[i + 1]), float(preds[i])) for i in range(len(preds))], KEYS)


def random_errors(spark, samples=20, steps=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(samples):
        for feat in ("a", "b"):
            s = rng.normal(20, 4, steps + 1)
            p = rng.normal(0, 1, steps)
            rows += [(k % 3, k % 5, k, i + 1, feat, float(s[i]), float(s[i + 1]), float(p[i])) for i in range(steps)]
    return V.error_columns(spark.createDataFrame(rows, KEYS))


def test_error_columns(spark):
    e = V.error_columns(forecast(spark, [10, 11, 9, 9], [2, -1, 0.5])).orderBy("step").collect()
    assert [r.true_res for r in e] == [1, -2, 0] and [r.pred_state for r in e] == [12, 11, 11.5]
    assert [r.err_state for r in e] == [1, 2, 2.5] and [r.err_res for r in e] == [1, 1, 0.5]
    absolute = V.error_columns(forecast(spark, [10, 11], [-2]), absolute=True).head()
    assert absolute.err_state == 3 and absolute.err_res == 3


def test_horizon_averages_to_overall_mae(spark):
    e = random_errors(spark)
    by_step = V.error_by_horizon(e).where("feat = 'a'").collect()
    overall = e.where("feat = 'a'").agg(F.avg(F.abs("err_state"))).head()[0]
    assert sum(r.mean_state for r in by_step) / len(by_step) == pytest.approx(overall)


def test_partials_merge_to_the_whole(spark):
    e = random_errors(spark).withColumn("err_state", F.col("err_state") + 1e6)
    m = V.horizon_moments()
    parts = [m.partial(e.where(F.col("x") == k)) for k in range(6)]
    merged = {(r.step, r.feat): r for r in m.finish(m.merge(*parts)).collect()}
    whole = {(r.step, r.feat): r for r in m.finish(m.partial(e)).collect()}
    assert set(merged) == set(whole)
    for k, r in whole.items():
        assert merged[k].n_state == r.n_state and merged[k].mean_state == pytest.approx(r.mean_state, rel=1e-12)
        assert merged[k].var_state == pytest.approx(r.var_state, rel=1e-3)


def test_moments_of_nothing(spark):
    m = V.Moments(["k"], {"v": F.col("v")})
    df = spark.createDataFrame([(1, None), (2, 3.0)], "k int, v double")
    got = {r.k: r for r in m.finish(m.merge(m.partial(df), m.partial(df))).collect()}
    assert got[1].n_v == 0 and got[1].mean_v is None and got[2].mean_v == 3 and got[2].var_v == 0


def test_efficiency_of_constant_and_flat_series(spark):
    constant = V.sequence_efficiency(V.error_columns(forecast(spark, [5, 5, 5, 5], [0.1, 0.2, -0.1]))).head()
    assert constant.s_idle and constant.r_idle
    assert all(constant[f"{p}_{m}"] is None for p in "sr" for m in ("cc", "kge", "nse", "nnse"))
    assert constant.s_mae == pytest.approx((0.1 + 0.3 + 0.2) / 3)
    flat = V.sequence_efficiency(V.error_columns(forecast(spark, [5, 6, 8, 7], [0, 0, 0]))).head()
    assert flat.s_cc == 0 and not flat.s_idle and flat.s_kge is not None
    perfect = V.sequence_efficiency(V.error_columns(forecast(spark, [5, 6, 8, 7], [1, 2, -1]))).head()
    assert perfect.s_cc == pytest.approx(1) and perfect.s_nse == 1 and perfect.s_nnse == 1
    assert perfect.s_kge == pytest.approx(1) and perfect.r_kge == pytest.approx(1)
    zero_mean = V.sequence_efficiency(V.error_columns(forecast(spark, [5, 6, 5, 6, 5], [1, 2, -1, 0]))).head()
    assert zero_mean.r_kge is None and zero_mean.r_cc is not None


def test_efficiency_brute_force(spark):
    e = random_errors(spark)
    rows = e.where("init = 4 AND feat = 'b'").orderBy("step").collect()
    y, p = np.array([r.true_state for r in rows]), np.array([r.pred_state for r in rows])
    got = V.sequence_efficiency(e).where("init = 4 AND feat = 'b'").head()
    r = np.corrcoef(y, p)[0, 1]
    nse = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    kge = 1 - math.sqrt((r - 1) ** 2 + (p.std() / y.std() - 1) ** 2 + (p.mean() / y.mean() - 1) ** 2)
    assert (got.s_cc, got.s_nse, got.s_kge) == pytest.approx((r, nse, kge))
    assert got.s_nnse == pytest.approx(1 / (2 - nse)) and got.s_mse == pytest.approx(((y - p) ** 2).mean())


def test_efficiency_summary_counts_dropped(spark):
    rows = forecast(spark, [5, 5, 5], [0.1, 0.1]).unionByName(forecast(spark, [5, 6, 8], [1, 1], x=1))
    out = V.efficiency_summary(V.sequence_efficiency(V.error_columns(rows))).head()
    assert (out.n, out.s_dropped, out.r_dropped) == (2, 1, 1)
    assert out.s_rmse == pytest.approx(math.sqrt(out.s_mse_mean))


def test_grid_error_stats(spark):
    got = V.grid_error_stats(V.error_columns(forecast(spark, [10, 11, 9, 9], [2, -1, -3]))).head()
    assert got.state_error_max == 2 and got.state_bias_final == -1 and got.res_error_max == 3
    assert got.state_error_mean == pytest.approx((1 + 2 + 1) / 3)


def test_grid_axes_agree_with_single_sets(spark):
    e = random_errors(spark)
    both = V.grid_stats_axes(e, {"e": "err_state"}, sets=V.AXIS_SETS)
    one = V.grid_stats_axes(e, {"e": "err_state"}, keep=["y", "x"])
    a = {(r.y, r.x, r.feat): r.mean_e for r in both.where("kept = 'pixel'").collect()}
    b = {(r.y, r.x, r.feat): r.mean_e for r in one.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert both.where("kept = 'all'").count() == e.count()


def test_error_by_time_limit_and_counts(spark):
    e = random_errors(spark).withColumn("t", F.timestamp_seconds(F.lit(1577923200) + F.col("init") * 3600))
    out = V.error_by_time(e, horizon_limit=4).collect()
    for axis in ("hour", "day"):
        assert sum(r.n for r in out if r.axis == axis) == 20 * 2 * 4


def test_histogram_counts_and_nulls(spark):
    df = spark.createDataFrame([(0.5, 0.5, 1.0), (None, 0.5, 1.0), (float("nan"), 0.1, 1.0), (9.0, -9.0, 4.0), (1.0, 0.0, None)],
                               "a double, b double, c double")
    got = V.joint_histogram(df, ("a", 0, 1, 4), ("b", 0, 1, 4), "c").collect()
    assert {(r.b1, r.b2): (r.n, r.cov_sum) for r in got} == {(2, 2): (1, 1.0), (3, 0): (2, 4.0)}
    assert sum(r.n for r in V.histogram_nd(df, [("b", 0, 1, 4)]).collect()) == 5
    e = random_errors(spark)
    assert V.joint_histogram(e, ("true_state", 0, 40, 8), ("err_res", -3, 3, 8)).agg(F.sum("n")).head()[0] == e.count()


def test_presets_are_known(spark):
    with pytest.raises(ValueError):
        P.preset("unknown", "soilm_10")
    assert P.preset("true-pred", "rsm_10", 64)["ax1"] == ("true_res", -0.15, 0.25, 64)


def test_information_measures(spark):
    same = spark.createDataFrame([(i, i, 5) for i in range(4)], "b1 int, b2 int, n long")
    got = M.information_measures(same).head()
    assert got.h_y == pytest.approx(math.log(4)) and got.fractional_info == pytest.approx(1) and got.info_loss == pytest.approx(0)
    free = spark.createDataFrame([(i, j, 3) for i in range(4) for j in range(2)], "b1 int, b2 int, n long")
    got = M.information_measures(free, base=2).head()
    assert got.mutual_info == pytest.approx(0, abs=1e-12) and got.h_y == pytest.approx(2) and got.h_joint == pytest.approx(3)
    rng = random.Random(5)
    for _ in range(3):
        rows = [(i, j, rng.randrange(0, 9)) for i in range(5) for j in range(5)]
        r = M.information_measures(spark.createDataFrame(rows, "b1 int, b2 int, n long")).head()
        assert r.mutual_info >= -1e-12 and r.h_joint <= r.h_y + r.h_p + 1e-12
    one = M.information_measures(spark.createDataFrame([(0, 0, 7)], "b1 int, b2 int, n long")).head()
    assert one.h_joint == 0 and one.fractional_info is None


def test_combine_periods_totals(spark):
    e = random_errors(spark).withColumns({"region": F.when(F.col("x") < 2, "w").otherwise("e"), "season": F.lit("cold"),
                                          "period": F.col("y").cast("string")})
    m = V.horizon_moments(["region", "season", "period"])
    out = M.combine_periods(m.partial(e), m)
    whole = {(r.step, r.feat): r for r in V.horizon_moments().finish(V.horizon_moments().partial(e)).collect()}
    top = out.where("region = 'all' AND season = 'all' AND period = 'all'").collect()
    assert len(top) == len(whole)
    for r in top:
        assert r.mean_state == pytest.approx(whole[(r.step, r.feat)].mean_state)
        assert r.var_state == pytest.approx(whole[(r.step, r.feat)].var_state)


def brute_losses(rows, ratio, norm, bias):
    steps = {}
    for r in rows:
        steps.setdefault((r.y, r.x, r.init, r.step), []).append(r)
    res = []
    for group in steps.values():
        loss = np.mean([abs(r.pred_res - r.true_res) / norm[r.feat] for r in group])
        res.append(loss * sum(1 + bias * abs(r.true_res) for r in group))
    state = np.mean([abs(r.pred_state - r.true_state) for r in rows])
    return ratio * np.mean(res) + (1 - ratio) * state


def test_residual_loss(spark):
    e = random_errors(spark)
    norm = {"a": 0.5, "b": 2.0}
    got = V.residual_loss(e, 0.3, norm, 1.5).head().loss
    assert got == pytest.approx(brute_losses(e.collect(), 0.3, norm, 1.5))
    falling = V.error_columns(forecast(spark, [5, 4, 4], [1, 1]))
    assert V.residual_loss(falling, 1.0, ignore_constant=True).head().residual_loss == pytest.approx((2 + 0) / 2)
    assert V.residual_loss(falling, 1.0, ignore_constant=True, literal_constant=True).head().residual_loss == 0


def test_snow_loss_ignores_negative_guess_at_zero(spark):
    e = V.error_columns(forecast(spark, [0, 0, 0, 2], [-1, 1, 1]))
    got = V.snow_loss(e).head()
    assert got.n_ignored == 1 and got.loss == pytest.approx((0 + 1 + 1) / 3)


def test_gridhist_reports_saturation(spark):
    df = spark.createDataFrame([(0, 0, v) for v in (-5.0, 0.0, 9.99, 10.0, 11.0)], "y int, x int, v double").withColumn(
        "t", F.lit("2020-06-01").cast("timestamp"))
    got = {r.bin: r for r in ST.gridhist_monthly(df, {"v": (0, 10)}, 5).collect()}
    assert got[0].n == 2 and got[0].n_under == 1 and got[4].n == 3 and got[4].n_over == 1


def test_period_frames(spark):
    rows = [(0, 0, s, float(s * s)) for s in range(7)]
    df = spark.createDataFrame(rows, "y int, x int, step int, v double").withColumn("t", F.timestamp_seconds(F.col("step") * 3600))
    out = {(r.period, r.feat): r for r in ST.period_frames(df.withColumn("f", F.col("v")), 3, ["v", "f"], ["f"]).collect()}
    assert set(p for p, _ in out) == {0, 1}
    assert out[(1, "v")].sum_or_diff == 25 - 9 and out[(1, "f")].sum_or_diff == 9 + 16 + 25
    assert out[(0, "v")].std == pytest.approx(np.std([0, 1, 4]))
    kept = ST.period_frames(df, 3, ["v"], keep_incomplete=True).where("period = 2").head()
    assert kept.n == 1 and kept.sum_or_diff == 0 and kept.std == 0


def test_range_histogram_of_constant(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 1.0)], "feat string, t double, p double")
    got = ST.range_histogram(df, "t", "p", 11).collect()
    assert {(r.feat, r.source, r.bin) for r in got} == {("b", "truth", 0), ("b", "pred", 10)}


def test_scale_fitted_on_training_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scales = ST.fit_scale(train, ["a", "b"])
    out = ST.apply_scale(spark.createDataFrame([(5.0, 5.0)], "a double, b double"), scales, ["a", "b"]).head()
    assert out.a == 3.0 and out.b is None


def test_linear_fit(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 7.0), ("b", 1.0, 2.0), ("b", 1.0, 4.0),
                                ("c", 1.0, 2.0), ("c", 2.0, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in ST.linear_fit(df, "x", "y", 10, ["k"]).collect()}
    assert (got["a"].slope, got["a"].intercept, got["a"].r2, got["a"].predicted) == pytest.approx((2, 1, 1, 21))
    assert got["b"].slope is None and got["b"].r2 is None
    assert got["c"].slope == 0 and got["c"].r2 == 1


def test_best_epoch_takes_the_first(spark):
    df = spark.createDataFrame([("m", 0, None), ("m", 1, 2.0), ("m", 2, 1.0), ("m", 3, 1.0)], "model string, epoch int, loss double")
    got = M.best_epoch(df, "loss").head()
    assert (got.best, got.epoch) == (1.0, 2)


def test_model_rank_puts_missing_last(spark):
    df = spark.createDataFrame([("a", "f", 0.5, 1.0), ("b", "f", None, 0.5), ("c", "f", 0.9, None)],
                               "model string, feat string, fractional_info double, mae double")
    got = {r.model: (r.rank_information, r.rank_mae) for r in M.model_rank(df).collect()}
    assert got == {"a": (2, 2), "b": (3, 1), "c": (1, 3)}


def test_same_result_for_any_number_of_partitions(spark, sf):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = V.error_by_horizon(fx.errors(spark, sf)).select(
                "step", "feat", "n_state", *[F.round(c, 8).alias(c) for c in ("mean_state", "var_res")])
            results.append(sorted(map(tuple, out.collect())))
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
