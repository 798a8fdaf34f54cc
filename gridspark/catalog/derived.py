"""Projections, derived columns, conversions, lookups and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import vocab
from ..functions import expressions as E
from ..functions import features as X
from ..functions import lookups as L
from ..operators import samples as S
from ..operators import selection as Q
from ..operators import verification as V
from ..operators.joins import join_static
from .registry import ARRAY, DYNAMIC, ERRORS, PARAMS, SCORED, STATIC, TEXTURE, VEGETATION, query, r6, settled, with_views



@query("b1_project_feats", with_views(DYNAMIC, body="""
SELECT y, x, step, round(weasd, 6) AS weasd, round(sqrt(ugrd * ugrd + vgrd * vgrd), 6) AS windmag,
       round(tmp, 6) AS tmp FROM fx_dynamic"""))
def project_feats(spark, sf):
    out = X.project_feats(fx.dynamic(spark, sf), ["weasd", "windmag", "tmp"], vocab.RECIPES, ["y", "x", "step"])
    return out.select("y", "x", "step", *r6("weasd", "windmag", "tmp"))


@query("b2_derive_feats", with_views(DYNAMIC, PARAMS, body="""
SELECT y, x, step,
  round((soilm_10 / 0.1e0 / 1000 - wiltingp) / (porosity - wiltingp), 6) AS rsm_10,
  round((soilm_40 / 0.3e0 / 1000 - wiltingp) / (porosity - wiltingp), 6) AS rsm_40,
  round((soilm_100 / 0.6e0 / 1000 - wiltingp) / (porosity - wiltingp), 6) AS rsm_100,
  round((soilm_200 / 1.0e0 / 1000 - wiltingp) / (porosity - wiltingp), 6) AS rsm_200,
  round(((soilm_10 + soilm_40 + soilm_100 + soilm_200) / 2000 - wiltingp) / (porosity - wiltingp), 6) AS rsm_fc,
  round(soilm_10 + soilm_40 + soilm_100 + soilm_200, 6) AS soilm_fc,
  round(sqrt(ugrd * ugrd + vgrd * vgrd), 6) AS windmag, round(1 - exp(-0.5e0 * lai), 6) AS fcover
FROM fx_dynamic JOIN fx_params USING (y, x)"""))
def derive_feats(spark, sf):
    rows = join_static(fx.dynamic(spark, sf), fx.static_params(spark, sf), feats=["porosity", "wiltingp"])
    out = X.derive_feats(rows, vocab.RECIPES)
    return out.select("y", "x", "step", *r6(*vocab.RECIPES))


@query("b3_convert_units", with_views(ERRORS, PARAMS, body="""
, k AS (SELECT y, x, init, step, CASE WHEN feat = 'soilm_10' THEN 0.1e0 ELSE 0.3e0 END AS d, feat,
               true_state, pred_state, pred_res, porosity - wiltingp AS room, wiltingp
        FROM fx_err JOIN fx_params USING (y, x))
SELECT y, x, init, step, feat, round((true_state / d / 1000 - wiltingp) / room, 6) AS rsm,
       round(pred_res / d / 1000 / room, 6) AS rsm_res, round(true_state, 5) AS soilm_again FROM k""".lstrip()))
def convert_units(spark, sf):
    rows = join_static(fx.errors(spark, sf), fx.static_params(spark, sf), feats=["porosity", "wiltingp"])
    parts = []
    for feat in ("soilm_10", "soilm_40"):
        one = rows.where(F.col("feat") == feat).withColumns({"rsm": F.col("true_state"), "rsm_res": F.col("pred_res")})
        one = X.convert_units(one, "soilm_to_rsm", {"rsm": feat}, {"rsm_res": ("pred_state", feat)})
        again = X.convert_units(one.withColumn("soilm_again", F.col("rsm")), "rsm_to_soilm", {"soilm_again": feat})
        parts.append(again)
    out = parts[0].unionByName(parts[1])
    return out.select("y", "x", "init", "step", "feat", *r6("rsm", "rsm_res"),
                      settled("soilm_again", 5).alias("soilm_again"))


@query("b4_alt_source", with_views(SCORED, body="""
SELECT y, x, init, step, round(tmp, 6) AS tmp, round(true_state, 6) AS soilm_10
FROM fx_scored WHERE feat = 'soilm_10'"""))
def alt_source(spark, sf):
    rows = S.grid_sample_rows(fx.dynamic(spark, sf), 1, 24, 24, first=1).withColumn("pos", F.col("lead"))
    spec = S.SampleSpec(1, 24, ["tmp"], ["tmp"], ["soilm_10"])
    samples = S.to_arrays(rows, spec, ["y", "x", "init"])
    filled = S.alt_source(samples, ["soilm_10"])
    return S.to_long(filled, ["y", "x", "init"]).select(
        "y", "x", "init", (F.col("pos") + 1).alias("step"), *r6("tmp", "soilm_10"))


_C = vocab.DYNAMIC_COEFFS


@query("b5_normalize", with_views(DYNAMIC, body=f"""
SELECT y, x, step, round((tmp - {_C['tmp'][2]!r}) / {_C['tmp'][3]!r}, 6) AS tmp,
       round((soilm_10 - {_C['soilm_10'][2]!r}) / {_C['soilm_10'][3]!r}, 6) AS soilm_10,
       round(unscaled, 6) AS unscaled FROM (SELECT *, lai * 2 AS unscaled FROM fx_dynamic) q"""))
def normalize(spark, sf):
    rows = fx.dynamic(spark, sf).withColumn("unscaled", F.col("lai") * 2)
    out = X.normalize(rows, X.gaussian_coeffs(), ["tmp", "soilm_10", "unscaled"])
    return out.select("y", "x", "step", *r6("tmp", "soilm_10", "unscaled"))


@query("b5_denormalize", with_views(SCORED, body=f"""
SELECT y, x, init, step, round(true_state * {_C['soilm_10'][3]!r} + {_C['soilm_10'][2]!r}, 6) AS soilm_10,
       round(pred_res * {_C['soilm_10'][3]!r}, 6) AS pred_res FROM fx_scored WHERE feat = 'soilm_10'"""))
def denormalize(spark, sf):
    rows = fx.scored(spark, sf, feats=("soilm_10",)).withColumnRenamed("true_state", "soilm_10")
    out = X.denormalize(rows, X.gaussian_coeffs(), ["soilm_10"], {"pred_res": "soilm_10"})
    return out.select("y", "x", "init", "step", *r6("soilm_10", "pred_res"))


@query("b6_one_hot", with_views(STATIC, body="""
SELECT y, x, i AS position, CAST(CASE WHEN i < 14 THEN i = int_veg ELSE i - 14 = int_soil END AS INT) AS value
FROM fx_static, (SELECT CAST(range AS INT) AS i FROM range(0, 27)) r"""))
def one_hot(spark, sf):
    rows = fx.static(spark, sf).withColumn("v", E.one_hot(("int_veg", 14), ("int_soil", 13)))
    return rows.select("y", "x", F.posexplode("v").alias("position", "value"))


@query("b7_one_hot_decode", with_views(STATIC, body="SELECT y, x, int_veg FROM fx_static"))
def one_hot_decode(spark, sf):
    rows = fx.static(spark, sf).withColumn("v", E.one_hot(("int_veg", 14)))
    return rows.select("y", "x", E.one_hot_decode("v").alias("int_veg"))


@query("b8_filter_static_all", with_views(STATIC, body="""
SELECT y, x, int_veg, int_soil FROM fx_static
WHERE m_valid AND int_veg IN (7, 8, 9, 10) AND elev >= 500"""))
def filter_static_all(spark, sf):
    out = Q.filter_static_all(fx.static(spark, sf), [
        "m_valid", F.col("int_veg").isin(7, 8, 9, 10), "elev >= 500"])
    return out.select("y", "x", "int_veg", "int_soil")


def event_samples(spark, sf):
    """Array-form samples whose label is the relative moisture of the top layer."""
    rows = join_static(fx.dynamic(spark, sf), fx.static_params(spark, sf), feats=["porosity", "wiltingp"])
    rows = X.derive_feats(rows, vocab.RECIPES, ["rsm_10"]).withColumnRenamed("rsm_10", "state")
    rows = S.grid_sample_rows(rows, 1, 24, 24, first=1).withColumn("pos", F.col("lead"))
    spec = S.SampleSpec(1, 24, ["tmp"], ["tmp", "spfh"], ["state"])
    samples = S.to_arrays(rows, spec, ["y", "x", "init"])
    return samples.join(fx.static_params(spark, sf).select("y", "x", "pct_sand", "pct_silt", "pct_clay"), ["y", "x"])


_EVENT = """
, r AS (SELECT s.y, s.x, s.init, s.step, s.tmp, s.spfh, (true_state / 0.1e0 / 1000 - wiltingp) / (porosity - wiltingp) AS v,
               (true_prev / 0.1e0 / 1000 - wiltingp) / (porosity - wiltingp) AS pv, pct_sand, pct_silt, pct_clay
        FROM fx_scored s JOIN fx_params USING (y, x) WHERE feat = 'soilm_10')"""


@query("b9_filter_samples", with_views(SCORED, PARAMS, body=_EVENT.lstrip() + """
SELECT y, x, init FROM r GROUP BY y, x, init
HAVING (bool_or(pct_sand > 0.55e0) OR bool_or(pct_clay > 0.3e0)) AND bool_or(tmp > 325) AND bool_and(tmp > 231)
   AND bool_and(v < 1e9)"""))
def filter_samples(spark, sf):
    out = Q.filter_samples(
        event_samples(spark, sf), static_any=["pct_sand > 0.55D", "pct_clay > 0.3D"],
        horizon_all=["exists(horizon, s -> s.tmp > 325)", "forall(horizon, s -> s.tmp > 231)"],
        pred_all=["forall(pred, s -> s.state < 1e9D)"])
    return out.select("y", "x", "init")


@query("b10_sample_events", with_views(SCORED, PARAMS, body=_EVENT.lstrip() + """
SELECT y, x, init, bool_or(tmp > 270 AND tmp < 276 AND spfh > 0.003e0 AND spfh < 0.006e0) AS freeze,
  bool_or(tmp > 300 AND tmp < 310 AND spfh > 0.02e0 AND spfh < 0.03e0) AS hot,
  bool_or(pv > 0.85e0 AND pv < 0.95e0 AND v - pv > 0.075e0 AND v - pv < 0.25e0) AS wet_rain,
  bool_or(pct_sand > 0.55e0) AS sandy, bool_or(pct_silt > 0.35e0) AS silty, bool_or(pct_clay > 0.3e0) AS clayey
FROM r GROUP BY y, x, init"""))
def sample_events(spark, sf):
    out = Q.flag_events(event_samples(spark, sf), Q.SAMPLE_EVENTS)
    return out.select("y", "x", "init", *Q.SAMPLE_EVENTS)


@query("b10_sample_events_texture", with_views(SCORED, PARAMS, body=_EVENT.lstrip() + """
SELECT DISTINCT y, x, init FROM r WHERE pct_sand > 0.55e0 OR pct_silt > 0.35e0 OR pct_clay > 0.3e0"""))
def sample_events_texture(spark, sf):
    return Q.sample_events(event_samples(spark, sf), "texture").select("y", "x", "init")


@query("b11_valid_pixels", with_views(DYNAMIC, STATIC, body="""
SELECT y, x, step, round(tmp, 6) AS tmp FROM fx_dynamic JOIN fx_static USING (y, x) WHERE m_valid"""))
def valid_pixels(spark, sf):
    return Q.valid_pixels(fx.dynamic(spark, sf), fx.static(spark, sf)).select("y", "x", "step", *r6("tmp"))


@query("b11_mask_conflicts", with_views(STATIC, body="""
SELECT y, x FROM fx_static WHERE m_valid <> (int_soil <> 4)"""))
def mask_conflicts(spark, sf):
    masks = fx.static(spark, sf).select("y", "x", "m_valid")
    other = fx.static(spark, sf).select("y", "x", (F.col("int_soil") != 4).alias("m_valid"))
    return Q.mask_conflicts(masks.unionByName(other))


@query("b11_mask_conflicts_missing", with_views(STATIC, body="""
SELECT y, x FROM fx_static WHERE x = 7 OR m_valid <> (int_soil <> 4)"""))
def mask_conflicts_missing(spark, sf):
    masks = fx.static(spark, sf).select("y", "x", "m_valid")
    other = fx.static(spark, sf).where("x <> 7").select("y", "x", (F.col("int_soil") != 4).alias("m_valid"))
    return Q.mask_conflicts(masks.unionByName(other), inputs=2)


@query("b12_select_domain_radius", with_views(STATIC, body="""
SELECT y, x FROM fx_static WHERE sqrt(pow(lat - 25.3e0, 2) + pow(lon + 124.6e0, 2)) < 0.4e0"""))
def select_domain_radius(spark, sf):
    return Q.select_domain(fx.static(spark, sf), "radius", at=(25.3, -124.6), radius=0.4).select("y", "x")


@query("b12_select_domain_bbox", with_views(STATIC, body="""
SELECT y, x FROM fx_static WHERE lat BETWEEN 25.1 AND 26.0 AND lon BETWEEN -124.8 AND -124.2"""))
def select_domain_bbox(spark, sf):
    return Q.select_domain(fx.static(spark, sf), "bbox", bbox=((25.1, 26.0), (-124.8, -124.2))).select("y", "x")


@query("b12_select_domain_point", with_views(DYNAMIC, STATIC, body="""
SELECT y, x, step, round(tmp, 6) AS tmp FROM fx_dynamic JOIN (
  SELECT y, x FROM fx_static ORDER BY sqrt(pow(lat - 25.55e0, 2) + pow(lon + 124.3e0, 2)), y, x LIMIT 1) p USING (y, x)"""))
def select_domain_point(spark, sf):
    pixel = Q.select_domain(fx.static(spark, sf), "point", at=(25.55, -124.3))
    return Q.select_pixels(fx.dynamic(spark, sf), pixel).select("y", "x", "step", *r6("tmp"))


@query("b13_bbox_index_bounds", with_views(STATIC, body="""
SELECT min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM fx_static
WHERE lat BETWEEN 25.1 AND 26.0 AND lon BETWEEN -124.8 AND -124.2"""))
def bbox_index_bounds(spark, sf):
    return Q.bbox_index_bounds(fx.static(spark, sf), ((25.1, 26.0), (-124.8, -124.2)))


@query("b14_select_pixels", with_views(DYNAMIC, STATIC, body="""
SELECT y, x, count(*) AS n, round(avg(tmp), 6) AS tmp FROM fx_dynamic
WHERE (y, x) IN (SELECT (y, x) FROM fx_static WHERE elev > 8000) GROUP BY y, x"""))
def select_pixels(spark, sf):
    listed = fx.static(spark, sf).where("elev > 8000")
    rows = Q.select_pixels(fx.dynamic(spark, sf), listed)
    return rows.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), settled(F.avg("tmp"), 6).alias("tmp"))


@query("b15_select_tile_bounds", with_views(DYNAMIC, body="""
SELECT y, x, step FROM fx_dynamic
WHERE (x < 5 AND y >= 2 AND y < 6) OR (x >= 5 AND y < 3 AND x >= 6 AND x < 9) OR (x >= 5 AND y >= 8)"""))
def select_tile_bounds(spark, sf):
    rows = fx.dynamic(spark, sf).withColumn("tile", F.when(F.col("x") < 5, "west").otherwise("east"))
    bounds = spark.sql("SELECT * FROM VALUES ('west', 2, 6, CAST(NULL AS INT), CAST(NULL AS INT)), "
                       "('east', NULL, 3, 6, 9), ('east', 8, NULL, NULL, NULL) AS b(tile, y0, y1, x0, x1)")
    return Q.select_tile_bounds(rows, bounds).select("y", "x", "step")


@query("b16_time_slice", with_views(DYNAMIC, body="""
SELECT y, x, step FROM fx_dynamic
WHERE t >= TIMESTAMP '2020-03-01 05:00:00' AND t < TIMESTAMP '2021-06-01 00:00:00'"""))
def time_slice(spark, sf):
    rows = fx.dynamic(spark, sf).withColumn("year", F.year("t"))
    out = Q.time_slice(rows, "2020-03-01 05:00:00", "2021-06-01 00:00:00", partitioned=True)
    return out.select("y", "x", "step")


@query("b16_time_slice_orders", """
SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1""")
def time_slice_orders(spark, sf):
    rows = fx.table(spark, sf, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    out = Q.time_slice(rows, "1996-02-01", "1998-01-01")
    return out.groupBy(F.year("t").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("b17_grid_subset", with_views(DYNAMIC, body="""
SELECT y, x, step FROM fx_dynamic WHERE y >= 1 AND y < 4 AND x = 2 AND step < 100"""))
def grid_subset(spark, sf):
    return Q.grid_subset(fx.dynamic(spark, sf), y=(1, 4), x=2, step=(None, 100)).select("y", "x", "step")


@query("b18_add_feature", with_views(STATIC, body="""
SELECT y, x, int_veg, round(elev * 2, 6) AS relief FROM fx_static"""))
def add_feature(spark, sf):
    base = fx.static(spark, sf)
    other = base.select("y", "x", (F.col("elev") * 2).alias("relief"))
    return Q.add_feature(base, other, "relief", ["y", "x"]).select("y", "x", "int_veg", *r6("relief"))


def series_catalog(spark, sf):
    """One catalog row per pixel and feature."""
    spans = fx.dynamic(spark, sf).groupBy("y", "x").agg(
        F.min("t").alias("t0"), F.count(F.lit(1)).cast("int").alias("size"))
    feats = F.array(*[F.struct(F.lit(f).alias("flabel"), F.lit(m).alias("mlabel"))
                      for f, m in (("tmp", "raw"), ("soilm_10", "raw"), ("soilm_10", "daily"))])
    return spans.select("y", "x", "t0", "size", F.lit(fx.STEP_SECONDS).alias("dt"), F.explode(feats).alias("_f")).select(
        "_f.*", "y", "x", "t0", "dt", "size")


_CATALOG = """
, spans AS (SELECT y, x, min(t) AS t0, CAST(count(*) AS INT) AS size, 29 * 3600 AS dt FROM fx_dynamic GROUP BY y, x),
cat AS (SELECT * FROM spans, (VALUES ('tmp', 'raw'), ('soilm_10', 'raw'), ('soilm_10', 'daily')) f(flabel, mlabel))"""


@query("b19_series_search", with_views(DYNAMIC, STATIC, body=_CATALOG.lstrip() + """
SELECT flabel, mlabel, y, x, size FROM cat JOIN fx_static s USING (y, x)
WHERE flabel = 'soilm_10' AND t0 <= TIMESTAMP '2020-02-01'
  AND epoch(t0) + dt::BIGINT * size >= epoch(TIMESTAMP '2021-12-20') AND y BETWEEN 1 AND 8 AND x BETWEEN 0 AND 7
  AND s.int_soil = 5"""))
def series_search(spark, sf):
    out = Q.series_search(series_catalog(spark, sf), flabel="soilm_10", time_range=("2020-02-01", "2021-12-20"),
                          yrange=(1, 8), xrange=(0, 7), static=fx.static(spark, sf), static_equal={"int_soil": 5})
    return out.select("flabel", "mlabel", "y", "x", "size")


@query("b19_series_search_grouped", with_views(DYNAMIC, body=_CATALOG.lstrip() + """
SELECT y, x, CAST(count(*) AS INT) AS n_series FROM cat WHERE mlabel = 'raw' GROUP BY y, x"""))
def series_search_grouped(spark, sf):
    out = Q.series_search(series_catalog(spark, sf), mlabel="raw", group_pixels=True)
    return out.select("y", "x", F.size("series").alias("n_series"))


@query("b20_texture_fractions", with_views(STATIC, TEXTURE, body="""
SELECT y, x, s.cls, CASE WHEN s.cls = 0 THEN 0e0 ELSE coalesce(pct_sand, 0) END AS pct_sand,
  CASE WHEN s.cls = 0 THEN 0e0 ELSE coalesce(pct_silt, 0) END AS pct_silt,
  CASE WHEN s.cls = 0 THEN 0e0 ELSE coalesce(pct_clay, 0) END AS pct_clay
FROM (SELECT y, x, (int_soil * 3) % 20 AS cls FROM fx_static) s LEFT JOIN tex ON tex.int_soil = s.cls"""))
def texture_fractions(spark, sf):
    rows = fx.static(spark, sf).select("y", "x", F.expr("(int_soil * 3) % 20").alias("cls"))
    return L.texture_fractions(rows, "cls")


@query("b21_texture_class", with_views(PARAMS, body="SELECT y, x, int_soil AS cls FROM fx_params"))
def texture_class(spark, sf):
    rows = fx.static_params(spark, sf).withColumn("pct_sand", F.col("pct_sand") + F.lit(0.00005))
    return rows.select("y", "x", L.texture_class("pct_sand", "pct_silt", "pct_clay").alias("cls"))


@query("b22_texture_params", with_views(STATIC, TEXTURE, body="""
SELECT y, x, porosity, wiltingp, vegstress, round((vegstress - wiltingp) / (porosity - wiltingp), 6) AS rsm_stress,
       round((0.3e0 + elev / 100000 - wiltingp) / (porosity - wiltingp), 6) AS rsm_fieldcap
FROM fx_static JOIN tex USING (int_soil)"""))
def texture_params(spark, sf):
    rows = fx.static(spark, sf).withColumn("fieldcap", F.lit(0.3) + F.col("elev") / 100000)
    return L.texture_params(rows).select("y", "x", "porosity", "wiltingp", "vegstress",
                                         *r6("rsm_stress", "rsm_fieldcap"))


@query("b23_lai_from_gvf", with_views(DYNAMIC, STATIC, VEGETATION, body="""
SELECT y, x, step, round(lai_lo + lai / 7 * (lai_hi - lai_lo), 6) AS lai_gvf
FROM fx_dynamic JOIN fx_static USING (y, x) JOIN vegdim USING (int_veg)"""))
def lai_from_gvf(spark, sf):
    rows = join_static(fx.dynamic(spark, sf), fx.static(spark, sf), feats=["int_veg"])
    out = L.lai_from_gvf(rows.withColumn("gvf", F.col("lai") / 7), "gvf")
    return out.select("y", "x", "step", *r6("lai_gvf"))


@query("b24_drainage_class", with_views(STATIC, body=f"""
SELECT y, x, slope_type, drainage FROM (SELECT y, x, (int_soil + y) % 11 AS slope_type FROM fx_static) s
LEFT JOIN (VALUES {', '.join(f'({k}, {v!r}::DOUBLE)' for k, v in vocab.DRAINAGE.items() if k)}) d(slope_type, drainage)
USING (slope_type)"""))
def drainage_class(spark, sf):
    rows = fx.static(spark, sf).select("y", "x", F.expr("(int_soil + y) % 11").alias("slope_type"))
    return L.drainage_class(rows)


@query("b25_coarsen_pred", with_views(SCORED, body="""
SELECT y, x, init, step, feat FROM fx_scored WHERE step % 6 = 0"""))
def coarsen_pred(spark, sf):
    return S.coarsen_pred(fx.scored(spark, sf), 6).select("y", "x", "init", "step", "feat")


@query("b25_coarsen_pred_no_init", with_views(SCORED, body="""
SELECT y, x, init, step - 1 AS offset_step, feat FROM fx_scored WHERE (step - 1) % 6 = 5"""))
def coarsen_pred_no_init(spark, sf):
    rows = fx.scored(spark, sf).withColumn("offset_step", F.col("step") - 1)
    return S.coarsen_pred(rows, 6, "offset_step", include_init=False).select("y", "x", "init", "offset_step", "feat")


@query("b26_coarsen_horizon", with_views(SCORED, body="""
SELECT y, x, init, CAST(ceil(step / 6.0) AS INT) AS step, round(avg(tmp), 6) AS tmp, round(avg(apcp), 6) AS apcp
FROM fx_scored WHERE feat = 'soilm_10' GROUP BY 1, 2, 3, 4"""))
def coarsen_horizon(spark, sf):
    rows = fx.scored(spark, sf, feats=("soilm_10",), carry=("tmp", "apcp"))
    out = S.coarsen_horizon(rows, 6, ["tmp", "apcp"], ["y", "x", "init"], "mean")
    return out.select("y", "x", "init", "step", *r6("tmp", "apcp"))


@query("b26_coarsen_horizon_arrays", with_views(ARRAY, body="""
SELECT sample_id, CAST(floor((i - 1) / 8.0) AS INT) AS position, round(avg(seq[i]::DOUBLE), 6) AS mean,
       round(min(seq[i]::DOUBLE), 6) AS lo, round(max(seq[i]::DOUBLE), 6) AS hi
FROM fx_array, (SELECT CAST(range AS INT) AS i FROM range(1, 33)) r GROUP BY 1, 2"""))
def coarsen_horizon_arrays(spark, sf):
    rows = fx.arrays(spark, sf).withColumn("states", F.slice("seq", 1, 32))
    parts = F.arrays_zip(E.block_reduce("states", 8, "mean").alias("mean"), E.block_reduce("states", 8, "min").alias("lo"),
                         E.block_reduce("states", 8, "max").alias("hi"))
    out = rows.select("sample_id", F.posexplode(parts).alias("position", "_e"))
    return out.select("sample_id", "position", *[settled(f"_e.{c}", 6).alias(c) for c in ("mean", "lo", "hi")])


@query("b27_error_columns", with_views(ERRORS, body=f"""
SELECT y, x, init, step, feat, round(true_res, 6) AS true_res, round(pred_state, 6) AS pred_state,
       round(err_state, 6) AS err_state, round(err_res, 6) AS err_res FROM fx_err"""))
def error_columns(spark, sf):
    return fx.errors(spark, sf).select("y", "x", "init", "step", "feat",
                                       *r6("true_res", "pred_state", "err_state", "err_res"))


@query("b27_error_columns_arrays", with_views(ARRAY, body="""
, s AS (SELECT sample_id, i, seq[1]::DOUBLE + sum(seq[32 + i]::DOUBLE) OVER (PARTITION BY sample_id ORDER BY i) AS pred,
               seq[i + 1]::DOUBLE AS truth
        FROM fx_array, (SELECT CAST(range AS INT) AS i FROM range(1, 32)) r)
SELECT sample_id, i AS step, round(pred - truth, 5) AS err_state FROM s""".lstrip()))
def error_columns_arrays(spark, sf):
    rows = fx.arrays(spark, sf).select(
        "sample_id", F.slice("seq", 2, 31).alias("truth"),
        E.accumulate(F.get("seq", F.lit(0)), F.slice("seq", 33, 31)).alias("pred"))
    errs = F.zip_with("pred", "truth", lambda p, y: p - y)
    return rows.select("sample_id", F.posexplode(errs).alias("_p", "e")).select(
        "sample_id", (F.col("_p") + 1).alias("step"), settled("e", 5).alias("err_state"))


@query("b28_time_parts", """
SELECT event_id, CAST(hour(ts + INTERVAL 30 MINUTE) AS INT) AS hour, CAST(dayofyear(ts) - 1 AS INT) AS day,
  CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter,
  CASE WHEN month(ts) IN (12, 1, 2) THEN 'DJF' WHEN month(ts) IN (3, 4, 5) THEN 'MAM'
       WHEN month(ts) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season
FROM events""")
def time_parts(spark, sf):
    t = F.col("ts").cast("timestamp")
    return fx.table(spark, sf, "events").select(
        "event_id", E.hour_of_day(t).alias("hour"), E.day_of_year(t).alias("day"), F.month(t).alias("month"),
        F.quarter(t).alias("quarter"), E.season(t).alias("season"))


@query("b29_functional_feature", with_views(ERRORS, body="""
SELECT y, x, init, step, feat, round(CASE WHEN apcp > 0.01 THEN true_res / apcp END, 6) AS infil,
  round(CASE WHEN apcp > 0.01 THEN pred_res / apcp ELSE 0 END, 6) AS infil_pred,
  round(tmp * spfh, 6) AS product FROM fx_err"""))
def functional_feature(spark, sf):
    rows = fx.errors(spark, sf, carry=("apcp", "tmp", "spfh")).withColumns({
        "infil": E.infiltration("true_res", "apcp"), "infil_pred": E.infiltration("pred_res", "apcp", otherwise=0.0)})
    out = X.add_expression(rows, "product", "tmp * spfh")
    return out.select("y", "x", "init", "step", "feat", *r6("infil", "infil_pred", "product"))


@query("b30_relative_error", with_views(ERRORS, body="""
SELECT y, x, feat, round(avg(err_state) / nullif(avg(true_state), 0), 6) AS relative FROM fx_err GROUP BY y, x, feat"""))
def relative_error(spark, sf):
    means = fx.errors(spark, sf).groupBy("y", "x", "feat").agg(
        F.avg("err_state").alias("e"), F.avg("true_state").alias("s"))
    return means.select("y", "x", "feat", settled(E.relative_error("e", "s"), 6).alias("relative"))


@query("b31_step_labels", with_views(DYNAMIC, body="""
SELECT y, x, CAST(floor(step / 24.0) AS BIGINT) AS period, CAST(floor((epoch(min(t)) + epoch(max(t))) / 2) AS BIGINT) AS mid
FROM fx_dynamic GROUP BY 1, 2, 3"""))
def step_labels(spark, sf):
    spans = fx.dynamic(spark, sf).groupBy("y", "x", F.floor(F.col("step") / 24).alias("period")).agg(
        F.min("t").alias("a"), F.max("t").alias("b"))
    return spans.select("y", "x", "period", F.unix_timestamp(V.period_midpoint("a", "b")).alias("mid"))


@query("b32_drop_bad_series", with_views(DYNAMIC, body="""
, marked AS (SELECT y, x, step, CASE WHEN x = 2 THEN 9999.0 ELSE soilm_200 END AS v FROM fx_dynamic),
bad AS (SELECT y, x FROM marked GROUP BY y, x
        HAVING bool_and(v = 9999) OR bool_or(v > 459.85 AND v <> 9999))
SELECT m.y, m.x, step, round(v, 6) AS v FROM marked m LEFT JOIN bad b ON m.y = b.y AND m.x = b.x WHERE b.y IS NULL""".lstrip()))
def drop_bad_series(spark, sf):
    rows = fx.dynamic(spark, sf).withColumn("v", F.when(F.col("x") == 2, F.lit(9999.0)).otherwise(F.col("soilm_200")))
    return Q.drop_bad_series(rows, "v", 459.85).select("y", "x", "step", *r6("v"))


@query("b33_minmax_scale", with_views(DYNAMIC, body="""
SELECT y, x, step, round(least(greatest((tmp - 250) / 60e0, 0), 1), 6) AS tmp,
  coalesce(round(CASE WHEN apcp > 0 THEN least(greatest(apcp / 5, 0), 1) END, 6), -1) AS apcp FROM fx_dynamic"""))
def minmax_scale(spark, sf):
    wet = F.when(F.col("apcp") > 0, F.col("apcp"))
    return fx.dynamic(spark, sf).select(
        "y", "x", "step", settled(E.minmax_scale("tmp", 250, 310), 6).alias("tmp"),
        settled(E.minmax_scale(wet, 0, 5, null_fill=-1), 6).alias("apcp"))


@query("h_units_metadata", f"""
SELECT feat, unit, long_name FROM (VALUES {', '.join(f"('{k}', '{u}', '{n}')" for k, (u, n) in vocab.UNITS.items())})
  u(feat, unit, long_name) JOIN (SELECT DISTINCT 'soilm_' || CASE l_linenumber % 4 WHEN 0 THEN '10' WHEN 1 THEN '40'
  WHEN 2 THEN '100' ELSE '200' END AS feat FROM lineitem) l USING (feat)""")
def units_metadata(spark, sf):
    layers = fx.table(spark, sf, "lineitem").select(F.expr(
        "'soilm_' || CASE l_linenumber % 4 WHEN 0 THEN '10' WHEN 1 THEN '40' WHEN 2 THEN '100' ELSE '200' END").alias("feat"))
    return layers.distinct().join(F.broadcast(L.units_dim(spark)), "feat")
