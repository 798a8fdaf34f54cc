"""Pixel-wise statistics, histograms, frames, summaries over pixels and classes, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import vocab
from ..functions import expressions as E
from ..functions import features as X
from ..functions import lookups as L
from ..operators import joins as J
from ..operators import merging as M
from ..operators import sketches as K
from ..operators import statistics as ST
from ..operators.integrity import union_tiles
from ..operators.selection import valid_pixels
from ..sources.exports import scale_frames
from .registry import DYNAMIC, ERRORS, PARAMS, STATIC, TEXTURE, VEGETATION, bin_sql, query, r6, settled, with_views



_STATS = "round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std"


def long_sql(feats, source="fx_dynamic", keep="y, x, step, t"):
    return "lf AS (" + " UNION ALL ".join(
        f"SELECT {keep}, '{f}' AS feat, {f} AS v FROM {source}" for f in feats) + ")"


@query("d1_gridstats_monthly", with_views(DYNAMIC, PARAMS, """
src AS (SELECT d.*, (soilm_10 / 0.1e0 / 1000 - wiltingp) / (porosity - wiltingp) AS rsm_10 FROM fx_dynamic d
        JOIN fx_params USING (y, x) WHERE m_valid)""", long_sql(["tmp", "apcp", "soilm_10", "rsm_10"], "src"), body=f"""
SELECT CAST(month(t) AS INT) AS month, y, x, feat, {_STATS.format(v='v')} FROM lf GROUP BY 1, 2, 3, 4"""))
def gridstats_monthly(spark, sf):
    static = fx.static_params(spark, sf)
    rows = J.join_static(fx.dynamic(spark, sf), static.where("m_valid"), feats=["porosity", "wiltingp"])
    rows = X.derive_feats(rows, vocab.RECIPES, ["rsm_10"])
    out = ST.gridstats_monthly(rows, ["tmp", "apcp", "soilm_10", "rsm_10"])
    return out.select("month", "y", "x", "feat", *r6("min", "max", "mean", "std"))


@query("d2_gridstats_year_month", with_views(DYNAMIC, long_sql(["tmp", "soilm_40"]), body=f"""
SELECT CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month, y, x, feat, {_STATS.format(v='v')}
FROM lf GROUP BY 1, 2, 3, 4, 5"""))
def gridstats_year_month(spark, sf):
    out = ST.gridstats_year_month(fx.dynamic(spark, sf), ["tmp", "soilm_40"])
    return out.select("year", "month", "y", "x", "feat", *r6("min", "max", "mean", "std"))


_BOUNDS = {"tmp": (240, 320), "soilm_10": (2, 40), "apcp": (0, 4.5)}


def hist_sql(bins=16):
    parts = [f"SELECT y, x, CAST(month(t) AS INT) AS month, '{f}' AS feat, {bin_sql(f, lo, hi, bins)} AS bin, "
             f"CASE WHEN {f} < {lo} THEN 1 ELSE 0 END AS u, CASE WHEN {f} > {hi} THEN 1 ELSE 0 END AS o FROM fx_dynamic"
             for f, (lo, hi) in _BOUNDS.items()]
    return ("hist AS (SELECT month, y, x, feat, bin, count(*) AS n, CAST(sum(u) AS BIGINT) AS n_under, "
            "CAST(sum(o) AS BIGINT) AS n_over FROM (" + " UNION ALL ".join(parts) + ") q GROUP BY 1, 2, 3, 4, 5)")


@query("d3_gridhist_monthly", with_views(DYNAMIC, hist_sql(), body="SELECT * FROM hist"))
def gridhist_monthly(spark, sf):
    return ST.gridhist_monthly(fx.dynamic(spark, sf), _BOUNDS, 16)


@query("d4_gridstats_collect", with_views(DYNAMIC, long_sql(["tmp", "lai"]), body=f"""
SELECT CAST(month(t) AS INT) AS month, y, x, feat, {_STATS.format(v='v')} FROM lf GROUP BY 1, 2, 3, 4"""))
def gridstats_collect(spark, sf):
    from .relations import _TILES, local_tiles
    rows = local_tiles(fx.dynamic(spark, sf))
    regions = [ST.gridstats_monthly(rows.where(F.col("tile") == t), ["tmp", "lai"], ["tile", "y", "x"])
               for t in ("nw", "ne", "sw", "se")]
    tiles = spark.sql(f"SELECT * FROM {_TILES} AS t(tile, off_y, off_x)")
    out = J.global_index(union_tiles(*regions), tiles)
    return out.select("month", "y", "x", "feat", *r6("min", "max", "mean", "std"))


@query("d5_gridstats_bulk", with_views(DYNAMIC, long_sql(["tmp", "soilm_10"]), """
gs AS (SELECT month(t) AS m, y, x, feat, min(v) AS a, max(v) AS b, avg(v) AS c, stddev_pop(v) AS d FROM lf GROUP BY 1, 2, 3, 4)""",
body="""SELECT y, x, feat, round(min(a), 6) AS min, round(max(b), 6) AS max, round(avg(c), 6) AS mean, round(avg(d), 6) AS std
FROM gs GROUP BY 1, 2, 3"""))
def gridstats_bulk(spark, sf):
    out = ST.gridstats_bulk(ST.gridstats_monthly(fx.dynamic(spark, sf), ["tmp", "soilm_10"]))
    return out.select("y", "x", "feat", *r6("min", "max", "mean", "std"))


@query("d6_hist_totals", with_views(DYNAMIC, STATIC, hist_sql(), body="""
, b AS (SELECT feat, int_soil, bin, CAST(sum(n) AS BIGINT) AS n FROM hist JOIN fx_static USING (y, x) GROUP BY 1, 2, 3)
SELECT feat, int_soil, bin, n, round(n / sum(n) OVER (PARTITION BY feat, int_soil), 6) AS frequency,
  round(CASE feat WHEN 'tmp' THEN 240 + (bin + 0.5e0) * 5 WHEN 'soilm_10' THEN 2 + (bin + 0.5e0) * 2.375e0
        ELSE (bin + 0.5e0) * 0.28125e0 END, 6) AS center FROM b""".lstrip()))
def hist_totals(spark, sf):
    hist = ST.gridhist_monthly(fx.dynamic(spark, sf), _BOUNDS, 16)
    by_soil = J.join_static(hist, fx.static(spark, sf), feats=["int_soil"])
    out = ST.hist_centers(ST.hist_totals(by_soil, ["feat", "int_soil"], normalize=True), _BOUNDS, 16)
    return out.select("feat", "int_soil", "bin", "n", *r6("frequency", "center"))


@query("d6_hist_relative_moisture", with_views(DYNAMIC, PARAMS, hist_sql(), body="""
SELECT int_soil, bin, CAST(sum(n) AS BIGINT) AS n,
  round(((2 + (bin + 0.5e0) * 2.375e0) / 0.1e0 / 1000 - min(wiltingp)) / (min(porosity) - min(wiltingp)), 6) AS center
FROM hist JOIN fx_params USING (y, x) WHERE feat = 'soilm_10' GROUP BY 1, 2"""))
def hist_relative_moisture(spark, sf):
    hist = ST.gridhist_monthly(fx.dynamic(spark, sf), {"soilm_10": _BOUNDS["soilm_10"]}, 16)
    totals = ST.hist_totals(J.join_static(hist, fx.static(spark, sf), feats=["int_soil"]), ["int_soil"])
    out = ST.relative_center(L.texture_params(totals), "soilm_10", 2, 40, 16)
    return out.select("int_soil", "bin", "n", *r6("center"))


@query("d7_hist_difference", with_views(DYNAMIC, body=f"""
SELECT bin, CAST(sum(s) AS BIGINT) AS n, 'liquid' AS feat FROM (
  SELECT {bin_sql('apcp', 0, 15, 16)} AS bin, 1 AS s FROM fx_dynamic UNION ALL
  SELECT {bin_sql('weasd / 10', 0, 15, 16)}, -1 FROM fx_dynamic) q GROUP BY bin"""))
def hist_difference(spark, sf):
    rows = fx.dynamic(spark, sf).withColumn("asnow", F.col("weasd") / 10)
    hist = ST.hist_totals(ST.gridhist_monthly(rows, {"apcp": (0, 15), "asnow": (0, 15)}, 16), ["feat"])
    return ST.hist_difference(hist, "apcp", "asnow", "liquid")


@query("d8_norm_coeffs", with_views(DYNAMIC, long_sql(["tmp", "apcp", "soilm_100"]), body=f"""
SELECT feat, {_STATS.format(v='v')}, (SELECT count(*) FROM fx_dynamic WHERE apcp = 0 AND weasd = 0) AS n_zero
FROM lf GROUP BY feat"""))
def norm_coeffs(spark, sf):
    rows = fx.dynamic(spark, sf)
    zero = ST.all_zero_rows(rows, ["apcp", "weasd"])
    out = ST.norm_coeffs(rows, ["tmp", "apcp", "soilm_100"])
    return out.select("feat", *r6("min", "max", "mean", "std"), zero.select("n_zero").scalar().alias("n_zero"))


@query("d8_norm_coeffs_pixel", with_views(DYNAMIC, long_sql(["tmp", "apcp"]), body=f"""
SELECT y, x, feat, {_STATS.format(v='v')} FROM lf GROUP BY 1, 2, 3"""))
def norm_coeffs_pixel(spark, sf):
    return ST.norm_coeffs(fx.dynamic(spark, sf), ["tmp", "apcp"], ["y", "x"]).select(
        "y", "x", "feat", *r6("min", "max", "mean", "std"))


_PERIOD = """
SELECT y, x, period, CAST(count(*) AS BIGINT) AS n, feat, round(avg(v), 6) AS mean, round(min(v), 6) AS min,
  round(max(v), 6) AS max, round(stddev_pop(v), 6) AS std,
  round(CASE WHEN feat = 'apcp' THEN sum(v) ELSE arg_max(v, step) - arg_min(v, step) END, 6) AS sum_or_diff
FROM (SELECT *, CAST(floor(step / 24.0) AS BIGINT) AS period FROM lf) q GROUP BY y, x, period, feat"""


@query("d9_period_frames", with_views(DYNAMIC, long_sql(["tmp", "apcp", "soilm_10"]), body=_PERIOD + " HAVING count(*) = 24"))
def period_frames(spark, sf):
    out = ST.period_frames(fx.dynamic(spark, sf), 24, ["tmp", "apcp", "soilm_10"])
    return out.select("y", "x", "period", "n", "feat", *r6("mean", "min", "max", "std", "sum_or_diff"))


@query("d9_period_frames_incomplete", with_views(DYNAMIC, long_sql(["tmp", "apcp"]), body=_PERIOD))
def period_frames_incomplete(spark, sf):
    out = ST.period_frames(fx.dynamic(spark, sf), 24, ["tmp", "apcp"], keep_incomplete=True)
    return out.select("y", "x", "period", "n", "feat", *r6("mean", "min", "max", "std", "sum_or_diff"))


_FB = """
, p AS (SELECT y, x, CAST(floor(step / 24.0) AS BIGINT) AS period, feat, avg(v) AS mean, max(v) AS max FROM lf
        GROUP BY 1, 2, 3, 4 HAVING count(*) = 24)"""


@query("d10_frame_bounds", with_views(DYNAMIC, long_sql(["tmp", "soilm_10"]), body=_FB.lstrip() + """
SELECT feat, 'mean' AS metric, round(min(mean), 6) AS lo, round(max(mean), 6) AS hi FROM p GROUP BY 1 UNION ALL
SELECT feat, 'max', round(min(max), 6), round(max(max), 6) FROM p GROUP BY 1"""))
def frame_bounds(spark, sf):
    frames = ST.period_frames(fx.dynamic(spark, sf), 24, ["tmp", "soilm_10"])
    return ST.frame_bounds(frames, ["mean", "max"]).select("feat", "metric", *r6("lo", "hi"))


@query("b33_scale_frames", with_views(DYNAMIC, long_sql(["tmp", "soilm_10"]), body=_FB.lstrip() + """
SELECT y, x, period, feat, round((mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w), 6) AS scaled
FROM p WINDOW w AS (PARTITION BY feat)"""))
def scaled_frames(spark, sf):
    frames = ST.period_frames(fx.dynamic(spark, sf), 24, ["tmp", "soilm_10"])
    out = scale_frames(frames, ST.frame_bounds(frames, ["mean"]), "mean")
    return out.select("y", "x", "period", "feat", *r6("scaled"))


@query("d29_seasonal_means", with_views(DYNAMIC, long_sql(["tmp", "soilm_10"]), body="""
SELECT CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) IN (3, 4, 5) THEN 'MAM'
  WHEN month(t) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, y, x, feat, round(avg(v), 6) AS mean
FROM lf GROUP BY 1, 2, 3, 4"""))
def seasonal_means(spark, sf):
    return M.seasonal_means(fx.dynamic(spark, sf), ["tmp", "soilm_10"]).select("season", "y", "x", "feat", *r6("mean"))


@query("d30_time_series_means_all", with_views(DYNAMIC, long_sql(["tmp", "lai"]), body="""
SELECT 'all' AS key, epoch(t)::BIGINT AS t, feat, round(avg(v), 6) AS mean FROM lf GROUP BY t, feat"""))
def time_series_means_all(spark, sf):
    out = M.time_series_means(fx.dynamic(spark, sf), ["tmp", "lai"])
    return out.select("key", F.unix_timestamp("t").alias("t"), "feat", *r6("mean"))


@query("d30_time_series_means_texture", with_views(DYNAMIC, STATIC, long_sql(["tmp"]), body="""
SELECT key, CAST(month(t) AS INT) AS month, feat, round(avg(m), 6) AS mean FROM (
  SELECT CAST(int_soil AS VARCHAR) AS key, t, feat, avg(v) AS m FROM lf JOIN fx_static USING (y, x) GROUP BY 1, 2, 3) q
GROUP BY 1, 2, 3"""))
def time_series_means_texture(spark, sf):
    out = M.time_series_means(fx.dynamic(spark, sf), ["tmp"], "texture", fx.static(spark, sf), monthly=True)
    return out.select("key", "month", "feat", *r6("mean"))


@query("d30_time_series_means_elev", with_views(DYNAMIC, STATIC, long_sql(["tmp"]), body="""
SELECT key, epoch(t)::BIGINT AS t, feat, round(avg(v), 6) AS mean FROM lf JOIN fx_static USING (y, x)
JOIN (VALUES (0, 2000, '0-2000'), (1000, 6000, '1000-6000'), (6000, 99999, '6000-99999')) b(lo, hi, key) ON elev >= lo AND elev < hi
GROUP BY 1, 2, 3"""))
def time_series_means_elev(spark, sf):
    out = M.time_series_means(fx.dynamic(spark, sf), ["tmp"], "elev", fx.static(spark, sf),
                              [(0, 2000), (1000, 6000), (6000, 99999)])
    return out.select("key", F.unix_timestamp("t").alias("t"), "feat", *r6("mean"))


@query("d31_ensemble_spread", with_views(ERRORS, STATIC, body="""
SELECT int_soil, step, feat, round(avg(pred_state), 6) AS mean, round(stddev_pop(pred_state), 6) AS std
FROM fx_err JOIN fx_static USING (y, x) GROUP BY 1, 2, 3"""))
def ensemble_spread(spark, sf):
    out = M.ensemble_spread(fx.errors(spark, sf), "pred_state", "texture", fx.static(spark, sf))
    return out.select("int_soil", "step", "feat", *r6("mean", "std"))


@query("d31_ensemble_spread_all", with_views(ERRORS, body="""
SELECT step, feat, round(avg(true_state), 6) AS mean, round(stddev_pop(true_state), 6) AS std FROM fx_err GROUP BY 1, 2"""))
def ensemble_spread_all(spark, sf):
    return M.ensemble_spread(fx.errors(spark, sf), "true_state").select("step", "feat", *r6("mean", "std"))


@query("d32_class_counts", with_views(STATIC, body="""
SELECT r_name AS region, int_veg, int_soil, count(*) AS n FROM fx_static f JOIN supplier s ON s_suppkey = y * 10 + x
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3
UNION ALL SELECT 'all', int_veg, int_soil, count(*) FROM fx_static GROUP BY 2, 3"""))
def class_counts(spark, sf):
    s, n, r = (fx.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    named = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.expr("CAST(floor(s_suppkey / 10) AS INT)").alias("y"), F.expr("CAST(s_suppkey % 10 AS INT)").alias("x"),
        F.col("r_name").alias("region"))
    return M.class_counts(fx.static(spark, sf).join(named, ["y", "x"]), "region")


@query("d33_class_params_table", with_views(PARAMS, body="""
SELECT int_soil, round(avg(porosity), 6) AS porosity, round(avg(wiltingp), 6) AS wiltingp, round(avg(elev), 6) AS elev
FROM fx_params WHERE m_valid GROUP BY 1"""))
def class_params_table(spark, sf):
    rows = fx.static_params(spark, sf).where("m_valid")
    return M.class_params_table(rows, ["porosity", "wiltingp", "elev"]).select(
        "int_soil", *r6("porosity", "wiltingp", "elev"))


@query("d34_greenness_by_class", with_views(DYNAMIC, STATIC, VEGETATION, body="""
, g AS (SELECT int_veg, CAST(month(t) AS INT) AS month, lai / 7 AS g, lai_lo + lai / 7 * (lai_hi - lai_lo) AS l
        FROM fx_dynamic JOIN fx_static USING (y, x) JOIN vegdim USING (int_veg))
SELECT int_veg, month, round(avg(g), 6) AS gvf_mean, round(stddev_pop(g), 6) AS gvf_std, round(avg(l), 6) AS lai_mean,
  round(stddev_pop(l), 6) AS lai_std FROM g GROUP BY 1, 2""".lstrip()))
def greenness_by_class(spark, sf):
    rows = J.join_static(fx.dynamic(spark, sf), fx.static(spark, sf), feats=["int_veg"])
    rows = rows.select("int_veg", F.month("t").alias("month"), (F.col("lai") / 7).alias("veg"))
    return M.greenness_by_class(rows).select("int_veg", "month", *r6("gvf_mean", "gvf_std", "lai_mean", "lai_std"))


@query("d35_mae_rmse", with_views(ERRORS, body="""
SELECT feat, init, round(avg(abs(err_state)), 6) AS mae, round(sqrt(avg(err_state * err_state)), 6) AS rmse, count(*) AS n
FROM fx_err GROUP BY 1, 2"""))
def mae_rmse(spark, sf):
    return ST.mae_rmse(fx.errors(spark, sf), "true_state", "pred_state", ["feat", "init"]).select(
        "feat", "init", *r6("mae", "rmse"), "n")


@query("d35_grid_mae", with_views(ERRORS, body="""
SELECT y, x, feat, round(avg(e), 6) AS mae, count(*) AS n_samples FROM (
  SELECT y, x, init, feat, avg(abs(err_state)) AS e FROM fx_err GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3"""))
def grid_mae(spark, sf):
    return ST.grid_mae(fx.errors(spark, sf), "true_state", "pred_state", ["init"]).select(
        "y", "x", "feat", *r6("mae"), "n_samples")


@query("d36_range_histogram", with_views(ERRORS, body="""
, r AS (SELECT feat, least(min(true_res), min(pred_res)) AS lo, greatest(max(true_res), max(pred_res)) AS hi FROM fx_err GROUP BY 1),
v AS (SELECT feat, 'truth' AS source, true_res AS v FROM fx_err UNION ALL SELECT feat, 'pred', pred_res FROM fx_err)
SELECT feat, source, CAST(round_even((v - lo) / (hi - lo) * 255, 0) AS INT) AS bin, count(*) AS n FROM v JOIN r USING (feat)
GROUP BY 1, 2, 3""".lstrip()))
def range_histogram(spark, sf):
    return ST.range_histogram(fx.errors(spark, sf), "true_res", "pred_res", 256)


@query("d8_quantile_bounds", with_views(DYNAMIC, long_sql(["tmp", "apcp", "soilm_10"]), body="""

SELECT feat, count(*) AS n, round(min(v), 6) AS lo, round(max(v), 6) AS hi, TRUE AS near FROM lf GROUP BY feat"""))
def quantile_bounds(spark, sf):
    """Ends and number of values from sketches of four tiles; `near` says that the quantiles are within the stated rank error."""
    feats = ["tmp", "apcp", "soilm_10"]
    rows = fx.dynamic(spark, sf).withColumn("tile", F.col("x") % 4)
    sketches = K.merge_sketches(K.quantile_sketches(rows, feats, ["tile"]).drop("tile"))
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    found = K.quantiles(sketches, {"lo": 0.0, "hi": 1.0, **{f"q{i}": q for i, q in enumerate(shares)}})
    one = F.array(*[F.struct(F.lit(f).alias("feat"), F.col(f).cast("double").alias("v")) for f in feats])
    long = rows.select(F.explode(one).alias("_e")).select("_e.*").join(F.broadcast(found), "feat")
    ranks = long.groupBy("feat").agg(F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), *[
        c for i in range(len(shares)) for c in (F.avg((F.col("v") < F.col(f"q{i}")).cast("int")).alias(f"b{i}"),
                                                F.avg((F.col("v") <= F.col(f"q{i}")).cast("int")).alias(f"u{i}"))])
    near = E.all_of([(F.col(f"b{i}") <= q + K.rank_error()) & (F.col(f"u{i}") >= q - K.rank_error()) for i, q in enumerate(shares)])
    return ranks.select("feat", "n", *r6("lo", "hi"), near.alias("near"))


@query("d3_gridhist_proposed", with_views(DYNAMIC, long_sql(["tmp", "soilm_10"]), body="""
, b AS (SELECT feat, min(v) AS lo, max(v) AS hi FROM lf GROUP BY feat)
SELECT feat, CAST(least(floor((v - lo) / (hi - lo) * 32), 31) AS INT) AS bin, count(*) AS n, CAST(0 AS BIGINT) AS n_under, CAST(0 AS BIGINT) AS n_over
FROM lf JOIN b USING (feat) GROUP BY 1, 2""".lstrip()))
def gridhist_proposed(spark, sf):
    """Exact counts within bounds that one pass of sketches proposes, here those of all values."""
    rows = fx.dynamic(spark, sf)
    bounds = K.proposed_bounds(K.quantile_sketches(rows, ["tmp", "soilm_10"]), 0.0)
    return K.counts_within(rows, bounds, 32)


@query("d39_linear_fit", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  round(regr_slope(l_extendedprice, l_quantity) * 50875 + regr_intercept(l_extendedprice, l_quantity), 2) AS predicted
FROM lineitem GROUP BY 1""")
def linear_fit(spark, sf):
    fit = ST.linear_fit(fx.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 50875, ["l_returnflag"])
    return fit.select("l_returnflag", settled("slope", 6).alias("slope"), settled("intercept", 4).alias("intercept"),
                      settled("r2", 6).alias("r2"), settled("predicted", 2).alias("predicted"))


@query("d40_best_epoch", """
WITH h AS (SELECT l_returnflag AS model, CAST(l_linenumber AS INT) AS epoch, avg(l_tax) AS loss FROM lineitem GROUP BY 1, 2)
SELECT model, round(min(loss), 6) AS best, arg_min(epoch, loss) AS epoch FROM h GROUP BY 1""")
def best_epoch(spark, sf):
    history = fx.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("epoch")).agg(F.avg("l_tax").alias("loss"))
    return M.best_epoch(history, "loss").select("model", *r6("best"), "epoch")


@query("d40_metric_curves", """
WITH h AS (SELECT l_returnflag AS model, CAST(l_linenumber AS INT) AS epoch, avg(l_tax) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1, 2)
SELECT model, epoch, 'loss' AS metric, round(a, 6) AS value FROM h UNION ALL
SELECT model, epoch, 'val_loss', round(b, 6) FROM h WHERE epoch > 1""")
def metric_curves(spark, sf):
    history = fx.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("epoch")).agg(
        F.avg("l_tax").alias("loss"), F.avg("l_discount").alias("val_loss"))
    history = history.withColumn("val_loss", F.when(F.col("epoch") > 1, F.col("val_loss")))
    return M.metric_curves(history, ["loss", "val_loss"]).select("model", "epoch", "metric", *r6("value"))


def _scaled_sql(feat: str) -> str:
    """Scaled by window totals of the training rows, so that no join is left."""
    v = f"CASE WHEN t < TIMESTAMP '2021-01-01' THEN {feat} END"
    return f"round(({feat} - avg({v}) OVER ()) / stddev_pop({v}) OVER (), 6) AS {feat}"


@query("d41_fit_scale_apply", with_views(DYNAMIC, body=f"SELECT y, x, step, {_scaled_sql('tmp')}, {_scaled_sql('soilm_10')} FROM fx_dynamic"))
def fit_scale_apply(spark, sf):
    rows = fx.dynamic(spark, sf)
    feats = ["tmp", "soilm_10"]
    scales = ST.fit_scale(rows.where(F.col("t") < F.lit("2021-01-01").cast("timestamp")), feats)
    return ST.apply_scale(rows, scales, feats).select("y", "x", "step", *r6(*feats))
