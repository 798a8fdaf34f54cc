"""Joins, top-k, order, unions and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import expressions as E
from ..operators import integrity as N
from ..operators import joins as J
from ..operators import nearest
from ..operators import selection as Q
from ..operators import verification as V
from ..operators.merging import information_measures
from .registry import DYNAMIC, ERRORS, SCORED, STATIC, bin_sql, query, r6, settled, with_views



@query("c1_join_forcing_model", with_views(DYNAMIC, body="""
SELECT y, x, step, round(tmp, 6) AS tmp, round(soilm_10, 6) AS soilm_10 FROM fx_dynamic WHERE apcp = 0 AND tmp > 240"""))
def join_forcing_model(spark, sf):
    rows = fx.dynamic(spark, sf)
    forcing = rows.where("apcp = 0").select("y", "x", "t", "step", "tmp")
    model = rows.where("tmp > 240").select("y", "x", "t", "soilm_10")
    return J.join_forcing_model(forcing, model).select("y", "x", "step", *r6("tmp", "soilm_10"))


@query("c2_join_static", with_views(DYNAMIC, STATIC, body="""
SELECT y, x, step, int_soil, round(elev, 6) AS elev FROM fx_dynamic JOIN fx_static USING (y, x)"""))
def join_static(spark, sf):
    out = J.join_static(fx.dynamic(spark, sf), fx.static(spark, sf), feats=["int_soil", "elev"])
    return out.select("y", "x", "step", "int_soil", *r6("elev"))


@query("c3_join_sample_prediction", with_views(SCORED, body="""
SELECT y, x, init, step, feat, round(true_state, 6) AS true_state, round(pred_res, 6) AS pred_res FROM fx_scored"""))
def join_sample_prediction(spark, sf):
    rows = fx.scored(spark, sf)
    keys = ["y", "x", "init", "step", "feat"]
    out = J.join_sample_prediction(rows, rows, keys, ["true_state"], ["pred_res"])
    return out.select(*keys, *r6("true_state", "pred_res"))


@query("c4_nearest_time", """
WITH p AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-01', INTERVAL 17 HOUR)) AS asked
           FROM (SELECT DISTINCT user_id FROM events) u),
e AS (SELECT DISTINCT user_id, ts FROM events),
lo AS (SELECT p.user_id, p.asked, e.ts FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.asked >= e.ts),
hi AS (SELECT p.user_id, p.asked, e.ts FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.asked <= e.ts)
SELECT lo.user_id, epoch(lo.asked)::BIGINT AS asked,
  epoch_us(CASE WHEN hi.ts IS NULL THEN lo.ts WHEN lo.ts IS NULL THEN hi.ts
           WHEN epoch_us(lo.asked) - epoch_us(lo.ts) <= epoch_us(hi.ts) - epoch_us(lo.asked) THEN lo.ts ELSE hi.ts END) AS ts
FROM lo JOIN hi USING (user_id, asked)""")
def nearest_time(spark, sf):
    events = fx.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    axis = F.sequence(F.lit("2023-12-31").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"),
                      F.expr("INTERVAL 17 HOURS"))
    pivots = events.select("user_id").distinct().select("user_id", F.explode(axis).alias("asked"))
    out = J.nearest_time(events, pivots, "ts", "asked", ["user_id"])
    return out.select("user_id", F.unix_timestamp("asked").alias("asked"), F.unix_micros("ts").alias("ts"))


@query("c5_window_interval_join", """
WITH i AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28', INTERVAL 37 HOUR)) AS init)
SELECT epoch(init)::BIGINT AS init, event_id FROM i JOIN events
  ON ts >= init - INTERVAL 24 HOUR AND ts < init + INTERVAL 48 HOUR""")
def window_interval_join(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    axis = F.sequence(F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-28").cast("timestamp"),
                      F.expr("INTERVAL 37 HOURS"))
    inits = spark.range(1).select(F.explode(axis).alias("init_time"))
    out = J.window_interval_join(rows, inits, 24 * 3600, 48 * 3600)
    return out.select(F.unix_timestamp("init_time").alias("init"), "event_id")


@query("c6_overlapping_tiles", with_views(DYNAMIC, body="""
SELECT y, q FROM (SELECT y, CAST(floor(step / 100.0) AS BIGINT) AS q, min(t) AS a, max(t) AS b FROM fx_dynamic GROUP BY 1, 2) s
WHERE b >= TIMESTAMP '2020-09-01' AND a < TIMESTAMP '2021-02-01'"""))
def overlapping_tiles(spark, sf):
    spans = fx.dynamic(spark, sf).groupBy("y", F.floor(F.col("step") / 100).alias("q")).agg(
        F.min("t").alias("t_begin"), F.max("t").alias("t_end"))
    return J.overlapping_tiles(spans, "2020-09-01", "2021-02-01").select("y", "q")


@query("c7_semi_pixels", with_views(DYNAMIC, STATIC, body="""
SELECT y, x, step FROM fx_dynamic WHERE (y, x) IN (SELECT (y, x) FROM fx_static WHERE int_veg = 3)"""))
def semi_pixels(spark, sf):
    listed = fx.static(spark, sf).where("int_veg = 3")
    return Q.select_pixels(fx.dynamic(spark, sf), listed).select("y", "x", "step")


@query("c8_missing_times", """
WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS t FROM events),
s AS (SELECT user_id, min(t) AS a, max(t) AS b FROM h GROUP BY user_id),
e AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM s)
SELECT user_id, epoch(t)::BIGINT AS t FROM e ANTI JOIN h USING (user_id, t)""")
def missing_times(spark, sf):
    hours = fx.table(spark, sf, "events").select(
        "user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t")).distinct()
    spans = hours.groupBy("user_id").agg(F.min("t").alias("begin"), F.max("t").alias("end"))
    return J.missing_times(hours, spans, keys=["user_id"]).select("user_id", F.unix_timestamp("t").alias("t"))


@query("c9_class_combinations", with_views(STATIC, body="""
SELECT v.int_veg, s.int_soil, count(f.y) AS n FROM (SELECT DISTINCT int_veg FROM fx_static) v
CROSS JOIN (SELECT DISTINCT int_soil FROM fx_static) s LEFT JOIN fx_static f
  ON f.int_veg = v.int_veg AND f.int_soil = s.int_soil GROUP BY 1, 2"""))
def class_combinations(spark, sf):
    return J.class_combinations(fx.static(spark, sf))


_TILES = "VALUES ('nw', 0, 0), ('ne', 0, 5), ('sw', 5, 0), ('se', 5, 5)"


def local_tiles(rows):
    """Tile-local indices for a mosaic of 5 x 5 pixel tiles, the last row of tiles being open-ended."""
    name = F.concat(F.when(F.col("y") < 5, "n").otherwise("s"), F.when(F.col("x") < 5, "w").otherwise("e"))
    return rows.withColumns({
        "tile": name, "y": F.when(F.col("y") < 5, F.col("y")).otherwise(F.col("y") - 5), "x": F.col("x") % 5})


@query("c10_global_index", with_views(DYNAMIC, body="SELECT y, x, step FROM fx_dynamic"))
def global_index(spark, sf):
    tiles = spark.sql(f"SELECT * FROM {_TILES} AS t(tile, off_y, off_x)")
    return J.global_index(local_tiles(fx.dynamic(spark, sf)), tiles).select("y", "x", "step")


@query("c11_join_results", with_views(ERRORS, body=f"""
, h AS (SELECT feat, {bin_sql('true_res', -40, 40, 16)} AS b1, {bin_sql('pred_res', -40, 40, 16)} AS b2, count(*) AS n
        FROM fx_err WHERE feat = 'soilm_10' GROUP BY 1, 2, 3),
t AS (SELECT sum(n) AS nn FROM h),
e AS (SELECT -sum(n / nn * ln(n / nn)) AS hj FROM h, t)
SELECT 'fn' AS model, feat, round(avg(abs(err_state)), 6) AS mae,
  CASE WHEN feat = 'soilm_10' THEN (SELECT round(hj, 6) FROM e) END AS h_joint, 24 AS horizon
FROM fx_err GROUP BY feat""".lstrip()))
def join_results(spark, sf):
    errors = fx.errors(spark, sf).withColumn("model", F.lit("fn"))
    efficiency = errors.groupBy("model", "feat").agg(F.avg(F.abs("err_state")).alias("mae"))
    hist = V.joint_histogram(errors.where("feat = 'soilm_10'"), ("true_res", -40, 40, 16), ("pred_res", -40, 40, 16),
                             by=["model", "feat"])
    info = information_measures(hist, ["model", "feat"]).select("model", "feat", "h_joint")
    config = errors.groupBy("model").agg(F.max("step").alias("horizon"))
    return J.join_results(efficiency, info, config).select("model", "feat", *r6("mae", "h_joint"), "horizon")


# --- order and top-k ------------------------------------------------------------------------------

@query("f1_shuffle_samples", with_views(SCORED, body="""
SELECT y, x, init, h FROM (SELECT DISTINCT y, x, init, md5('7:' || y || ':' || x || ':' || init) AS h FROM fx_scored) s
ORDER BY h, y, x, init"""))
def shuffle_samples(spark, sf):
    keys = ["y", "x", "init"]
    samples = fx.scored(spark, sf).select(*keys).distinct()
    return Q.shuffle_samples(samples, 7, keys).withColumn("h", E.hash_order(7, *keys))


@query("f2_limit_per_block", with_views(SCORED, body="""
SELECT y, x, init FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('7:' || y || ':' || x || ':' || init), y, x, init) AS r
  FROM (SELECT DISTINCT y, x, init FROM fx_scored) s) q WHERE r <= 5"""))
def limit_per_block(spark, sf):
    keys = ["y", "x", "init"]
    samples = fx.scored(spark, sf).select(*keys).distinct()
    return Q.limit_per_block(samples, ["y"], 5, 7, keys)


@query("f3_nearest_pixel", with_views(STATIC, body="""
SELECT y, x, round(sqrt(pow(lat - 25.55e0, 2) + pow(lon + 124.3e0, 2)), 6) AS dist FROM fx_static ORDER BY dist, y, x LIMIT 1"""))
def nearest_pixel(spark, sf):
    return Q.nearest_pixel(fx.static(spark, sf), (25.55, -124.3)).select("y", "x", *r6("dist"))


@query("f3_nearest_pixels", with_views(STATIC, body="""
, points AS (SELECT c_custkey, 24.5e0 + (c_custkey * 7919 % 10007) / 1000.0e0 AS lat, -125.5e0 + (c_custkey * 104729 % 10009) / 5000.0e0 AS lon FROM customer),
d AS (SELECT c_custkey, y, x, sqrt((s.lat - p.lat) * (s.lat - p.lat) + (s.lon - p.lon) * (s.lon - p.lon)) AS dist FROM points p, fx_static s)
SELECT c_custkey, y, x, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, y, x) = 1""".lstrip()))
def nearest_pixels(spark, sf):
    """The nearest pixel of each customer's place."""
    points = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey", "24.5D + (c_custkey * 7919 % 10007) / 1000.0D AS lat", "-125.5D + (c_custkey * 104729 % 10009) / 5000.0D AS lon")
    return nearest.nearest_pixels(fx.static(spark, sf), points).select("c_custkey", "y", "x", *r6("dist"))


@query("f4_top_class_combos", with_views(STATIC, body="""
SELECT int_veg, int_soil, count(*) AS n FROM fx_static GROUP BY 1, 2 ORDER BY n DESC, int_veg, int_soil LIMIT 8"""))
def top_class_combos(spark, sf):
    counts = fx.static(spark, sf).groupBy("int_veg", "int_soil").agg(F.count(F.lit(1)).alias("n"))
    return Q.top_class_combos(counts, 8, ties=["int_veg", "int_soil"])


@query("f5_chrono_sort", with_views(DYNAMIC, body="""
SELECT y, epoch(min(t))::BIGINT AS begin, count(*) AS n FROM fx_dynamic GROUP BY y ORDER BY begin, y"""))
def chrono_sort(spark, sf):
    spans = fx.dynamic(spark, sf).groupBy("y").agg(
        F.unix_timestamp(F.min("t")).alias("begin"), F.count(F.lit(1)).alias("n"))
    return Q.chrono_sort(spans, "begin", "y")


# --- sets and integrity ---------------------------------------------------------------------------

@query("g1_union_tiles", with_views(DYNAMIC, body="SELECT y, x, step FROM fx_dynamic"))
def union_tiles(spark, sf):
    rows = fx.dynamic(spark, sf).select("y", "x", "step")
    return N.union_tiles(*[rows.where(F.col("y") % 3 == k) for k in range(3)])


@query("g2_mosaic", with_views(DYNAMIC, body="SELECT y, x, round(avg(tmp), 6) AS tmp FROM fx_dynamic GROUP BY y, x"))
def mosaic(spark, sf):
    means = local_tiles(fx.dynamic(spark, sf)).groupBy("tile", "y", "x").agg(F.avg("tmp").alias("tmp"))
    parts = [means.where(F.col("tile") == t) for t in ("nw", "ne", "sw", "se")]
    tiles = spark.sql(f"SELECT * FROM {_TILES} AS t(tile, off_y, off_x)")
    return J.global_index(N.union_tiles(*parts), tiles).select("y", "x", *r6("tmp"))


@query("g3_distinct_classes", with_views(STATIC, body="SELECT DISTINCT int_veg, int_soil FROM fx_static WHERE m_valid"))
def distinct_classes(spark, sf):
    return N.distinct_classes(fx.static(spark, sf).where("m_valid"), "int_veg", "int_soil")


@query("g4_common_keys", """
SELECT DISTINCT l_suppkey AS key FROM lineitem WHERE l_quantity > 49 INTERSECT
SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal > 3000""")
def common_keys(spark, sf):
    a = fx.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("key"))
    b = fx.table(spark, sf, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("key"))
    return N.common_keys(a, b, "key")


@query("g5_duplicates", """
SELECT l_suppkey, l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicates(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").cast("string").alias("day"))
    return N.duplicates(rows, "l_suppkey", "day")


@query("g6_label_differences", """
WITH a AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45),
b AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT k, v, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) l UNION ALL
SELECT k, v, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) r""")
def label_differences(spark, sf):
    def labels(flag):
        rows = fx.table(spark, sf, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 45))
        return rows.select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("v")).distinct()
    a, b = labels("A"), labels("R")
    N.schema_uniform(a, b)
    return N.label_differences(a, b, ["k", "v"])
