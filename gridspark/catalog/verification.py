"""Verification operators (error columns, error by lead time, clock and class, histograms, efficiency, losses)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import merging as M
from ..operators import presets as P
from ..operators import verification as V
from .registry import ERRORS, PARAMS, SCORED, STATIC, bin_sql, query, r6, settled, with_views



def sql_r6(**cols: str) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in cols.items())


@query("d11_error_by_horizon", with_views(ERRORS, body=f"""
SELECT step, feat, step AS forecast_hour, count(*) AS n_state,
  {sql_r6(mean_state='avg(abs(err_state))', var_state='var_pop(abs(err_state))',
          mean_res='avg(abs(err_res))', var_res='var_pop(abs(err_res))')}
FROM fx_err GROUP BY step, feat"""))
def error_by_horizon(spark, sf):
    out = V.error_by_horizon(fx.errors(spark, sf))
    return out.select("step", "feat", "forecast_hour", "n_state",
                      *r6("mean_state", "var_state", "mean_res", "var_res"))


@query("d12_error_by_time", with_views(ERRORS, body="""
, k AS (SELECT feat, hour(t + INTERVAL 30 MINUTE) AS h, dayofyear(t) - 1 AS d, err_state, err_res FROM fx_err WHERE step <= 18)
SELECT 'hour' AS axis, CAST(h AS INT) AS bin, feat, round(sum(err_state), 4) AS sum_state, round(sum(err_res), 4) AS sum_res,
  count(*) AS n FROM k GROUP BY h, feat UNION ALL
SELECT 'day', CAST(d AS INT), feat, round(sum(err_state), 4), round(sum(err_res), 4), count(*) FROM k GROUP BY d, feat""".lstrip()))
def error_by_time(spark, sf):
    out = V.error_by_time(fx.errors(spark, sf), horizon_limit=18)
    return out.select("axis", "bin", "feat", settled("sum_state", 4).alias("sum_state"),
                      settled("sum_res", 4).alias("sum_res"), "n")


@query("d13_error_by_class", with_views(ERRORS, STATIC, body="""
, m AS (SELECT y, x, init, feat, avg(abs(err_state)) AS s, avg(abs(err_res)) AS r FROM fx_err GROUP BY 1, 2, 3, 4)
SELECT int_veg, int_soil, feat, round(sum(s), 4) AS sum_state, round(sum(r), 4) AS sum_res, count(*) AS n,
  round(avg(s), 6) AS mean_state, round(avg(r), 6) AS mean_res FROM m JOIN fx_static USING (y, x) GROUP BY 1, 2, 3""".lstrip()))
def error_by_class(spark, sf):
    out = V.error_by_class(fx.errors(spark, sf), fx.static(spark, sf), absolute=True)
    return out.select("int_veg", "int_soil", "feat", settled("sum_state", 4).alias("sum_state"),
                      settled("sum_res", 4).alias("sum_res"), "n", *r6("mean_state", "mean_res"))


def _hist_sql(a1, a2, cov=None, where="feat = 'soilm_10'"):
    cols = f", round(sum({cov}), 3) AS cov_sum, round(avg({cov}), 5) AS cov_mean" if cov else ""
    return (f"SELECT * FROM (SELECT {bin_sql(*a1)} AS b1, {bin_sql(*a2)} AS b2, count(*) AS n{cols} FROM fx_err WHERE {where} "
            f"AND ({a1[0]}) IS NOT NULL AND ({a2[0]}) IS NOT NULL GROUP BY 1, 2) q")


def _rounded(df):
    return df.withColumns({c: settled(c, d) for c, d in (("cov_sum", 3), ("cov_mean", 5)) if c in df.columns})


@query("d14_joint_histogram", with_views(ERRORS, body=_hist_sql(
    ("true_state", 2, 50, 48), ("tmp * spfh", 0, 10, 40), "abs(err_state)", "feat IS NOT NULL")))
def joint_histogram(spark, sf):
    rows = fx.errors(spark, sf, carry=("tmp", "spfh"))
    return _rounded(V.joint_histogram(rows, ("true_state", 2, 50, 48), ("tmp * spfh", 0, 10, 40), "err_state", absolute=True))


@query("d14_histogram_nd", with_views(ERRORS, body=f"""
SELECT feat, {bin_sql('true_state', 2, 50, 8)} AS b1, {bin_sql('tmp', 230, 330, 8)} AS b2, {bin_sql('err_res', -5, 5, 8)} AS b3,
  count(*) AS n FROM fx_err GROUP BY 1, 2, 3, 4"""))
def histogram_nd(spark, sf):
    rows = fx.errors(spark, sf, carry=("tmp",))
    return V.histogram_nd(rows, [("true_state", 2, 50, 8), ("tmp", 230, 330, 8), ("err_res", -5, 5, 8)], ["feat"])


_WET = "CASE WHEN apcp > 0.01 THEN {} / apcp END"
_PRESETS = {
    "d15_hist_true_pred": ("true-pred", ("true_res", -0.5, 1.5, 64), ("pred_res", -0.5, 1.5, 64), None),
    "d16_hist_saturation_error": ("saturation-error", ("true_state", 2, 50, 64), ("err_res", -20, 20, 64), None),
    "d17_hist_infiltration": ("infiltration", (_WET.format("true_res"), -0.4, 1.5, 64), (_WET.format("pred_res"), -0.4, 1.5, 64), "true_state"),
    "d18_hist_state_increment": ("state-increment", ("true_state", 2, 50, 64), ("true_res", -0.5, 1.5, 64), "err_res"),
    "d19_hist_humidity_temp": ("humidity-temp", ("spfh", 0, 0.03, 64), ("tmp", 230, 330, 64), "err_res"),
    "d20_hist_snow_temp": ("snow-temp", ("weasd", 0, 250, 64), ("tmp", 230, 330, 64), "err_res"),
    "d20_hist_snow_increment": ("snow-increment", ("weasd", 0, 250, 64), ("true_res", -0.5, 1.5, 64), "err_res"),
}


def _preset_query(name, preset):
    def run(spark, sf):
        rows = fx.errors(spark, sf, feats=("soilm_10",), carry=("tmp", "spfh", "apcp", "weasd"))
        return _rounded(P.hist_preset(rows, preset, "soilm_10", 64))
    run.__name__ = preset.replace("-", "_")
    return run


for _name, (_preset, _a1, _a2, _cov) in _PRESETS.items():
    query(_name, with_views(ERRORS, body=_hist_sql(_a1, _a2, _cov)))(_preset_query(_name, _preset))


def _eff_sql(y, p, k):
    mse = f"avg(({p} - {y}) * ({p} - {y}))"
    nse = f"(1 - {mse} / nullif(var_pop({y}), 0))"
    kge = (f"(1 - sqrt(pow(corr({y}, {p}) - 1, 2) + pow(stddev_pop({p}) / nullif(stddev_pop({y}), 0) - 1, 2) "
           f"+ pow(avg({p}) / nullif(avg({y}), 0) - 1, 2)))")
    return {f"{k}_mae": f"avg(abs({p} - {y}))", f"{k}_mse": mse, f"{k}_cc": f"corr({y}, {p})", f"{k}_nse": nse,
            f"{k}_nnse": f"1 / (2 - {nse})", f"{k}_kge": kge}


_EFF = {**_eff_sql("true_state", "pred_state", "s"), **_eff_sql("true_res", "pred_res", "r")}
# KGE of increments divides by a mean near zero; its size makes fewer decimals comparable.
_DIGITS = {"r_kge": 2, "s_mse": 4, "r_mse": 4}
SEQUENCES = "seqs AS (SELECT y, x, init, feat, " + ", ".join(f"{e} AS {n}" for n, e in _EFF.items()) + \
    " FROM fx_err GROUP BY 1, 2, 3, 4)"


@query("d21_sequence_efficiency", with_views(ERRORS, SEQUENCES, body="SELECT y, x, init, feat, " + ", ".join(
    f"round({n}, {_DIGITS.get(n, 6)}) AS {n}" for n in _EFF if n != "r_kge") + ", round(1 / (2 - r_kge), 6) AS r_nkge FROM seqs"))
def sequence_efficiency(spark, sf):
    out = V.sequence_efficiency(fx.errors(spark, sf))
    return out.select("y", "x", "init", "feat", *[
        settled(n, _DIGITS.get(n, 6)).alias(n) for n in _EFF if n != "r_kge"],
        settled(1 / (2 - F.col("r_kge")), 6).alias("r_nkge"))


@query("d22_efficiency_summary", with_views(ERRORS, SEQUENCES, body="SELECT feat, count(*) AS n, CAST(0 AS BIGINT) AS s_dropped, "
       "CAST(0 AS BIGINT) AS r_dropped, round(sqrt(avg(s_mse)), 6) AS s_rmse, round(sqrt(avg(r_mse)), 6) AS r_rmse, " + ", ".join(
    f"round(avg({n}), 4) AS {n}_mean, round(var_pop({n}), 4) AS {n}_var" for n in _EFF if n != "r_kge") + " FROM seqs GROUP BY 1"))
def efficiency_summary(spark, sf):
    out = V.efficiency_summary(V.sequence_efficiency(fx.errors(spark, sf)))
    return out.select("feat", "n", "s_dropped", "r_dropped", *r6("s_rmse", "r_rmse"), *[
        settled(f"{n}_{s}", 4).alias(f"{n}_{s}") for n in _EFF if n != "r_kge" for s in ("mean", "var")])


@query("d22_efficiency_summary_constant", with_views(SCORED, body="""
, c AS (SELECT y, x, init, feat, step, pred_res, CASE WHEN (y + x + init) % 5 = 0 THEN 10.0e0 ELSE true_prev END AS true_prev,
          CASE WHEN (y + x + init) % 5 = 0 THEN 10.0e0 ELSE true_state END AS true_state FROM fx_scored),
e AS (SELECT *, first_value(true_prev) OVER w + sum(pred_res) OVER w - true_state AS err FROM c
      WINDOW w AS (PARTITION BY y, x, init, feat ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT y, x, init, feat, avg(abs(err)) AS mae, max(true_state) = min(true_state) AS idle,
        CASE WHEN max(true_state) > min(true_state) THEN 1 - avg(err * err) / var_pop(true_state) END AS nse FROM e GROUP BY 1, 2, 3, 4)
SELECT feat, count(*) AS n, count(*) FILTER (idle) AS s_dropped, count(*) FILTER (idle) AS r_dropped, round(avg(mae), 6) AS s_mae_mean,
  round(avg(nse), 4) AS s_nse_mean FROM s GROUP BY feat""".lstrip()))
def efficiency_summary_constant(spark, sf):
    still = F.expr("(y + x + init) % 5 = 0")
    rows = fx.scored(spark, sf).withColumns({c: F.when(still, F.lit(10.0)).otherwise(F.col(c)) for c in ("true_prev", "true_state")})
    out = V.efficiency_summary(V.sequence_efficiency(V.error_columns(rows)))
    return out.select("feat", "n", "s_dropped", "r_dropped", *r6("s_mae_mean"), settled("s_nse_mean", 4).alias("s_nse_mean"))


# Sequences whose mean increment is far from zero, so that KGE of increments can be compared as such.
DRIFTED = SCORED + """,
fx_drift AS (
  SELECT y, x, init, step, t, feat, true_prev + 60.0e0 * (step - 1) AS true_prev, true_state + 60.0e0 * step AS true_state,
         pred_res + 55.0e0 AS pred_res FROM fx_scored)""" + ERRORS.removeprefix(SCORED).replace("FROM fx_scored", "FROM fx_drift")


def drifted(spark, sf):
    step = F.col("step")
    rows = fx.scored(spark, sf).withColumns({
        "true_prev": F.col("true_prev") + 60 * (step - 1), "true_state": F.col("true_state") + 60 * step,
        "pred_res": F.col("pred_res") + 55})
    return V.error_columns(rows)


@query("d21_sequence_efficiency_drift", with_views(DRIFTED, SEQUENCES, body="SELECT y, x, init, feat, " + ", ".join(
    f"round({n}, 4) AS {n}" for n in _EFF) + " FROM seqs"))
def sequence_efficiency_drift(spark, sf):
    out = V.sequence_efficiency(drifted(spark, sf))
    return out.select("y", "x", "init", "feat", *[settled(n, 4).alias(n) for n in _EFF])


@query("d22_efficiency_summary_drift", with_views(DRIFTED, SEQUENCES, body="SELECT feat, count(*) AS n, " + ", ".join(
    f"round(avg({n}), 4) AS {n}_mean, round(var_pop({n}), 4) AS {n}_var" for n in _EFF) + " FROM seqs GROUP BY 1"))
def efficiency_summary_drift(spark, sf):
    out = V.efficiency_summary(V.sequence_efficiency(drifted(spark, sf)))
    return out.select("feat", "n", *[settled(f"{n}_{s}", 4).alias(f"{n}_{s}") for n in _EFF for s in ("mean", "var")])


@query("d24_grid_error_stats_drift", with_views(DRIFTED, body=f"""
SELECT init, y, x, feat, round({_EFF['s_kge']}, 4) AS state_kge, round({_EFF['r_kge']}, 4) AS res_kge,
  round({_EFF['r_cc']}, 4) AS res_pearson FROM fx_err GROUP BY init, y, x, feat"""))
def grid_error_stats_drift(spark, sf):
    return V.grid_error_stats(drifted(spark, sf)).select(
        "init", "y", "x", "feat", *[settled(c, 4).alias(c) for c in ("state_kge", "res_kge", "res_pearson")])


def _axes_sql(label, keys):
    cols = ", ".join((k if k in keys else f"CAST(NULL AS INT) AS {k}") for k in ("init", "y", "x", "step"))
    return (f"SELECT '{label}' AS kept, {cols}, feat, count(*) AS n_e, round(avg(err_state), 5) AS mean_e, "
            f"round(var_pop(err_state), 5) AS var_e, round(avg(true_state * 2), 5) AS mean_d FROM fx_err GROUP BY "
            + ", ".join([*keys, "feat"]))


@query("d23_grid_stats_axes", with_views(ERRORS, body="SELECT * FROM (" + " UNION ALL ".join(
    _axes_sql(k, [c for c in v]) for k, v in V.AXIS_SETS.items()) + ") q"))
def grid_stats_axes(spark, sf):
    out = V.grid_stats_axes(fx.errors(spark, sf), {"e": "err_state", "d": "true_state * 2"}, sets=V.AXIS_SETS)
    return out.select("kept", "init", "y", "x", "step", "feat", "n_e", *[
        settled(c, 5).alias(c) for c in ("mean_e", "var_e", "mean_d")])


@query("d23_grid_stats_pixel", with_views(ERRORS, body="""
SELECT y, x, feat, count(*) AS n_e, round(avg(abs(err_res)), 6) AS mean_e, round(var_pop(abs(err_res)), 6) AS var_e
FROM fx_err GROUP BY 1, 2, 3"""))
def grid_stats_pixel(spark, sf):
    out = V.grid_stats_axes(fx.errors(spark, sf), {"e": "abs(err_res)"}, keep=["y", "x"])
    return out.select("y", "x", "feat", "n_e", *r6("mean_e", "var_e"))


@query("d24_grid_error_stats", with_views(ERRORS, body=f"""
SELECT init, y, x, feat, {sql_r6(
    state_error_max='max(abs(err_state))', state_error_mean='avg(abs(err_state))',
    state_error_stdev='stddev_pop(abs(err_state))', state_kge=_EFF['s_kge'], state_pearson=_EFF['s_cc'],
    state_bias_final='arg_max(err_state, step)', res_error_max='max(abs(err_res))',
    res_error_mean='avg(abs(err_res))', res_error_stdev='stddev_pop(abs(err_res))',
    res_nkge='1 / (2 - ' + _EFF['r_kge'] + ')', res_pearson=_EFF['r_cc'])}
FROM fx_err GROUP BY init, y, x, feat"""))
def grid_error_stats(spark, sf):
    out = V.grid_error_stats(fx.errors(spark, sf)).withColumn("res_nkge", 1 / (2 - F.col("res_kge"))).drop("res_kge")
    return out.select("init", "y", "x", "feat", *r6(*[c for c in out.columns if c.startswith(("state_", "res_"))]))


@query("d25_merge_partials", with_views(ERRORS, body=f"""
SELECT step, feat, count(*) AS n_state, {sql_r6(mean_state='avg(abs(err_state))', var_state='var_pop(abs(err_state))',
  mean_res='avg(abs(err_res))', var_res='var_pop(abs(err_res))')} FROM fx_err GROUP BY step, feat"""))
def merge_partials(spark, sf):
    m = V.horizon_moments(["tile"])
    parts = m.partial(fx.errors(spark, sf).withColumn("tile", F.col("x") % 4))
    merged = V.horizon_moments().merge(parts.drop("tile"))
    return m.finish(merged).select("step", "feat", "n_state", *r6("mean_state", "var_state", "mean_res", "var_res"))


@query("d25_merge_counts", with_views(ERRORS, body=f"""
SELECT {bin_sql('true_res', -0.5, 1.5, 32)} AS b1, {bin_sql('pred_res', -0.5, 1.5, 32)} AS b2, count(*) AS n
FROM fx_err GROUP BY 1, 2"""))
def merge_counts(spark, sf):
    parts = V.joint_histogram(fx.errors(spark, sf), ("true_res", -0.5, 1.5, 32), ("pred_res", -0.5, 1.5, 32), by=["y"])
    return M.merge_partials(parts.where("y < 5").drop("y"), parts.where("y >= 5").drop("y"), by=["b1", "b2"], add=["n"])


_PERIODS = """
, tagged AS (SELECT *, CASE WHEN y % 2 = 0 THEN 'n' ELSE 's' END AS region,
    CASE WHEN quarter(t) IN (1, 4) THEN 'cold' ELSE 'warm' END AS season, CAST(year(t) AS VARCHAR) AS period FROM fx_err)"""


@query("d26_combine_periods", with_views(ERRORS, body=_PERIODS.lstrip() + f"""
SELECT coalesce(region, 'all') AS region, coalesce(season, 'all') AS season, coalesce(period, 'all') AS period, step, feat,
  count(*) AS n_state, {sql_r6(mean_state='avg(abs(err_state))', var_state='var_pop(abs(err_state))', mean_res='avg(abs(err_res))')}
FROM tagged GROUP BY GROUPING SETS ((region, season, period, step, feat), (region, season, step, feat), (region, step, feat), (step, feat))"""))
def combine_periods(spark, sf):
    from ..functions.expressions import quarter_season
    tagged = fx.errors(spark, sf).withColumns({
        "region": F.when(F.col("y") % 2 == 0, "n").otherwise("s"), "season": quarter_season(F.quarter("t")),
        "period": F.year("t").cast("string")})
    m = V.horizon_moments(["region", "season", "period"])
    return M.combine_periods(m.partial(tagged), m).select(
        "region", "season", "period", "step", "feat", "n_state", *r6("mean_state", "var_state", "mean_res"))


@query("d27_information_measures", with_views(ERRORS, body=f"""
, h AS (SELECT feat, {bin_sql('true_res', -40, 40, 128)} AS b1, {bin_sql('pred_res', -40, 40, 128)} AS b2, count(*) AS n
        FROM fx_err GROUP BY 1, 2, 3),
t AS (SELECT feat, sum(n) AS nn FROM h GROUP BY 1),
hj AS (SELECT feat, -sum(n / nn * ln(n / nn)) AS v FROM h JOIN t USING (feat) GROUP BY 1),
hy AS (SELECT feat, -sum(c / nn * ln(c / nn)) AS v FROM (SELECT feat, b1, sum(n) AS c FROM h GROUP BY 1, 2) q JOIN t USING (feat) GROUP BY 1),
hp AS (SELECT feat, -sum(c / nn * ln(c / nn)) AS v FROM (SELECT feat, b2, sum(n) AS c FROM h GROUP BY 1, 2) q JOIN t USING (feat) GROUP BY 1)
SELECT feat, {sql_r6(h_y='hy.v', h_p='hp.v', h_joint='hj.v', mutual_info='hy.v + hp.v - hj.v', info_loss='hj.v - hp.v',
  fractional_info='(hy.v + hp.v - hj.v) / hj.v')} FROM hj JOIN hy USING (feat) JOIN hp USING (feat)""".lstrip()))
def information_measures(spark, sf):
    hist = V.joint_histogram(fx.errors(spark, sf), ("true_res", -40, 40, 128), ("pred_res", -40, 40, 128), by=["feat"])
    return M.information_measures(hist, ["feat"]).select(
        "feat", *r6("h_y", "h_p", "h_joint", "mutual_info", "info_loss", "fractional_info"))


@query("d28_error_by_change", with_views(ERRORS, body=f"""
SELECT {bin_sql('true_res', -0.5, 1.5, 64)} AS b2, round(sum(abs(err_res)), 3) AS cov_sum, count(*) AS n,
  round(avg(abs(err_res)), 6) AS mean FROM fx_err WHERE feat = 'soilm_10' GROUP BY 1"""))
def error_by_change(spark, sf):
    rows = fx.errors(spark, sf, feats=("soilm_10",))
    hist = P.hist_preset(rows, "state-increment", "soilm_10", 64, absolute=True)
    return M.marginal_error(hist, "b2").select("b2", settled("cov_sum", 3).alias("cov_sum"), "n", *r6("mean"))


@query("d28_error_by_temperature", with_views(ERRORS, body=f"""
SELECT {bin_sql('tmp', 230, 330, 64)} AS b2, round(sum(abs(err_res)), 3) AS cov_sum, count(*) AS n,
  round(avg(abs(err_res)), 6) AS mean FROM fx_err WHERE feat = 'soilm_10' GROUP BY 1"""))
def error_by_temperature(spark, sf):
    rows = fx.errors(spark, sf, feats=("soilm_10",), carry=("tmp", "spfh"))
    hist = P.hist_preset(rows, "humidity-temp", "soilm_10", 64, absolute=True)
    return M.marginal_error(hist, "b2").select("b2", settled("cov_sum", 3).alias("cov_sum"), "n", *r6("mean"))


@query("d37_residual_loss", with_views(ERRORS, body="""
, k AS (SELECT y, x, init, step, avg(abs(err_res) / CASE feat WHEN 'soilm_10' THEN 0.32e0 ELSE 0.25e0 END) AS r,
          sum(1 + 2.5e0 * abs(true_res)) AS w, sum(abs(err_state)) AS s, count(*) AS n, max(abs(true_res)) AS c
        FROM fx_err GROUP BY 1, 2, 3, 4)
SELECT round(avg(CASE WHEN c < 1e-8 THEN 0 ELSE r * w END), 4) AS residual_loss, round(sum(s) / sum(n), 4) AS state_loss,
  round(0.6e0 * avg(CASE WHEN c < 1e-8 THEN 0 ELSE r * w END) + 0.4e0 * sum(s) / sum(n), 4) AS loss FROM k""".lstrip()))
def residual_loss(spark, sf):
    out = V.residual_loss(fx.errors(spark, sf), 0.6, {"soilm_10": 0.32, "soilm_40": 0.25}, 2.5, ignore_constant=True)
    return out.select(*[settled(c, 4).alias(c) for c in ("residual_loss", "state_loss", "loss")])


@query("d38_snow_loss", with_views(ERRORS, body="""
, k AS (SELECT y, x, init, step, avg(err_res * err_res / 0.09e0) AS r, sum((1 + abs(true_res)) / 0.3e0) AS w,
          bool_and(true_res = 0 AND true_state - 20 < 1e-4 AND pred_res < 0) AS quiet
        FROM fx_err WHERE feat = 'soilm_10' GROUP BY 1, 2, 3, 4)
SELECT round(avg(CASE WHEN quiet THEN 0 ELSE r * w END), 3) AS loss, CAST(count_if(quiet) AS BIGINT) AS n_ignored FROM k""".lstrip()))
def snow_loss(spark, sf):
    out = V.snow_loss(fx.errors(spark, sf, feats=("soilm_10",)), 20.0, {"soilm_10": 0.3}, 1.0, use_mse=True)
    return out.select(settled("loss", 3).alias("loss"), "n_ignored")
