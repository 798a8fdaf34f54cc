"""Verification of predictions that span several steps, and in another unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import vocab
from ..operators import samples as S
from ..operators import scoring as C
from ..operators import verification as V
from ..plans.sequence_verification import score
from .registry import DYNAMIC, PARAMS, bin_sql, query, r6, settled, with_views

_FEATS = ["soilm_10", "soilm_40"]
_SPEC = S.SampleSpec(2, 24, _FEATS, ["tmp"], _FEATS)
_BY = ["y", "x", "init"]


def _errors(spark, sf, c, **kw):
    rows = S.grid_sample_rows(fx.dynamic(spark, sf), 2, 24, 24, first=2).withColumn("pos", F.col("lead") + 1)
    samples = S.to_arrays(rows, _SPEC, _BY)
    return score(samples, C.coarsened(C.damped_trend([0, 1], 0.5), c), _SPEC, _BY, inputs=["tmp"], coarseness=c, **kw)


def _views(c: int, state: str = "v", prev: str = "a", change: str = "{}") -> str:
    """Scored coarse rows and their errors; `state`, `prev` and `change` convert."""
    def one(feat):
        return f"""SELECT y, x, init, h // {c} AS step, t, tm AS tmp, '{feat}' AS feat, {{depth_{feat}}} AS depth, a_{feat} AS a, {feat} AS v,
    first_value(d_{feat}) OVER (PARTITION BY y, x, init ORDER BY h) * pow(0.5e0, h // {c}) AS p, h FROM cw"""
    union = " UNION ALL ".join(one(f) for f in _FEATS).format(**{f"depth_{f}": repr(float(vocab.layer_depth(f))) + "::DOUBLE" for f in _FEATS})
    lags = ", ".join(f"lag({f}, {c}) OVER w AS a_{f}, lag({f}, 1) OVER w - lag({f}, 2) OVER w AS d_{f}" for f in _FEATS)
    return f"""
c0 AS (SELECT *, CAST(floor((step - 2) / 24.0) AS INT) AS init, CAST((step - 2) % 24 + 1 AS INT) AS h, {lags}
       FROM fx_dynamic WINDOW w AS (PARTITION BY y, x ORDER BY step)),
cw AS (SELECT *, avg(tmp) OVER (PARTITION BY y, x, init ORDER BY h ROWS BETWEEN {c - 1} PRECEDING AND CURRENT ROW) AS tm,
       count(*) OVER (PARTITION BY y, x, init) AS n FROM c0 WHERE step >= 2 QUALIFY n = 24),
cs AS (SELECT * FROM ({union}) u WHERE h % {c} = 0),
ck AS (SELECT y, x, init, step, t, tmp, feat, {prev} AS true_prev, {state} AS true_state, {change.format('p')} AS pred_res FROM cs
       {'JOIN fx_params USING (y, x)' if 'porosity' in state else ''}),
ce AS (SELECT *, true_state - true_prev AS true_res, first_value(true_prev) OVER w + sum(pred_res) OVER w AS pred_state
       FROM ck WINDOW w AS (PARTITION BY y, x, init, feat ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fx_err AS (SELECT *, pred_state - true_state AS err_state, pred_res - true_res AS err_res FROM ce)"""


def _horizon_sql(c: int) -> str:
    return f"""
SELECT step, feat, CAST(step * {c} AS INT) AS forecast_hour, count(*) AS n_state, round(avg(abs(err_state)), 6) AS mean_state,
  round(avg(abs(err_res)), 6) AS mean_res, round(var_pop(abs(err_state)), 6) AS var_state FROM fx_err GROUP BY step, feat"""


def _horizon(errors, c):
    return V.error_by_horizon(errors, c).select("step", "feat", "forecast_hour", "n_state", *r6("mean_state", "mean_res", "var_state"))


for _c in (1, 3, 6):
    @query(f"d11_error_by_horizon_coarse_{_c}", with_views(DYNAMIC, _views(_c), body=_horizon_sql(_c)))
    def error_by_horizon(spark, sf, c=_c):
        return _horizon(_errors(spark, sf, c), c)


@query("d11_error_by_horizon_converted", with_views(DYNAMIC, PARAMS, _views(
    3, state="(v / depth / 1000 - wiltingp) / (porosity - wiltingp)", prev="(a / depth / 1000 - wiltingp) / (porosity - wiltingp)",
    change="{} / depth / 1000 / (porosity - wiltingp)"), body=_horizon_sql(3)))
def error_by_horizon_converted(spark, sf):
    return _horizon(_errors(spark, sf, 3, convert="soilm_to_rsm", params=fx.static_params(spark, sf), keys=["y", "x"]), 3)


_AX = (("true_state", 5.0, 45.0, 8), ("tmp", 230.0, 330.0, 10))


@query("d14_joint_histogram_coarse", with_views(DYNAMIC, _views(3), body=f"""
SELECT {bin_sql(*_AX[0])} AS b1, {bin_sql(*_AX[1])} AS b2, count(*) AS n, round(sum(err_res), 3) AS cov_sum FROM fx_err
WHERE feat = 'soilm_10' GROUP BY 1, 2"""))
def joint_histogram(spark, sf):
    out = V.joint_histogram(_errors(spark, sf, 3).where("feat = 'soilm_10'"), *_AX, covariate="err_res")
    return out.select("b1", "b2", "n", settled("cov_sum", 3).alias("cov_sum"))


@query("d21_sequence_efficiency_coarse", with_views(DYNAMIC, _views(6), body="""
SELECT y, x, init, feat, round(avg(abs(err_state)), 6) AS s_mae, round(avg(err_res * err_res), 6) AS r_mse,
  round(1 - avg(err_state * err_state) / var_pop(true_state), 4) AS s_nse FROM fx_err GROUP BY 1, 2, 3, 4"""))
def sequence_efficiency(spark, sf):
    out = V.sequence_efficiency(_errors(spark, sf, 6))
    return out.select(*_BY, "feat", *r6("s_mae", "r_mse"), settled("s_nse", 4).alias("s_nse"))


@query("d23_grid_stats_axes_coarse", with_views(DYNAMIC, _views(6), body="""
SELECT y, x, step, feat, count(*) AS n_e, round(avg(err_state), 6) AS mean_e, round(var_pop(err_state), 5) AS var_e
FROM fx_err GROUP BY 1, 2, 3, 4"""))
def grid_stats_axes(spark, sf):
    out = V.grid_stats_axes(_errors(spark, sf, 6), {"e": "err_state"}, keep=["y", "x", "step"])
    return out.select("y", "x", "step", "feat", "n_e", *r6("mean_e"), settled("var_e", 5).alias("var_e"))
