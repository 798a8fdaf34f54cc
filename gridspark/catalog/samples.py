"""Samples, windows, batches, splits, and order along series."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import expressions as E
from ..operators import integrity as N
from ..operators import joins as J
from ..operators import merging as M
from ..operators import generators as GN
from ..operators import samples as S
from ..operators import verification as V
from .registry import ARRAY, DYNAMIC, ERRORS, SCORED, STATIC, bin_sql, query, r6, settled, with_views


def array_sum(column, field=None):
    part = (lambda v: v.cast("double")) if field is None else (lambda v: v[field].cast("double"))
    return F.aggregate(column, F.lit(0.0), lambda s, v: s + part(v))


@query("e1_sliding_windows", with_views(DYNAMIC, body="""
, w AS (SELECT y, x, step, sum(tmp) OVER v AS total, first_value(soilm_10) OVER v AS oldest, count(*) OVER v AS n
        FROM fx_dynamic WINDOW v AS (PARTITION BY y, x ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT y, x, step, round(total, 4) AS total, round(oldest, 6) AS oldest FROM w WHERE n = 12""".lstrip()))
def sliding_windows(spark, sf):
    out = S.sliding_windows(fx.dynamic(spark, sf), 12, ["tmp", "soilm_10"])
    return out.select("y", "x", "step", settled(array_sum("window", "tmp"), 4).alias("total"),
                      settled(F.get("window", F.lit(0))["soilm_10"]).alias("oldest"))


_SPEC = S.SampleSpec(window=12, horizon=24, window_feats=["tmp", "apcp", "soilm_10"], horizon_feats=["tmp", "apcp"],
                     pred_feats=["soilm_10"], static_feats=["elev"], static_int={"int_veg": 14}, separation=31,
                     max_offset=20, seed=11)

_STARTS = """
, len AS (SELECT y, x, max(step) + 1 AS len FROM fx_dynamic GROUP BY 1, 2),
off AS (SELECT y, x, len, ('0x' || substr(md5('11:' || y || ':' || x), 1, 8))::BIGINT % 20 AS off FROM len),
starts AS (SELECT y, x, k AS sample, CAST(k * 31 + off AS BIGINT) AS start FROM (
  SELECT *, unnest(range(0, CAST(floor((len - 36 - 20) / 31.0) AS BIGINT))) AS k FROM off WHERE len >= 56 + 31) q)"""


@query("e2_sample_starts", with_views(DYNAMIC, body=_STARTS.lstrip() + "\nSELECT y, x, sample, start FROM starts"))
def sample_starts(spark, sf):
    return S.sample_starts(fx.dynamic(spark, sf), _SPEC)


_CUT = """
, cut AS (SELECT s.y, s.x, s.sample, d.step - s.start AS pos, d.tmp, d.apcp, d.soilm_10, d.t
  FROM {starts} s JOIN fx_dynamic d ON d.y = s.y AND d.x = s.x AND d.step >= s.start AND d.step < s.start + 36),
flat AS (SELECT y, x, sample, sum(tmp) FILTER (pos < 12) AS w, sum(apcp) FILTER (pos >= 12) AS h,
  sum(soilm_10) FILTER (pos >= 11) AS p, min(soilm_10) FILTER (pos = 11) AS init, min(t) AS t0 FROM cut GROUP BY 1, 2, 3)
SELECT y, x, sample, round(w, 4) AS w, round(h, 4) AS h, round(p, 4) AS p, round(init, 6) AS init,
  epoch(t0)::BIGINT AS t0, round(elev, 6) AS elev, int_veg FROM flat JOIN fx_static USING (y, x)"""


def _flat_samples(samples):
    return samples.select(
        "y", "x", "sample", settled(array_sum("window", "tmp"), 4).alias("w"),
        settled(array_sum("horizon", "apcp"), 4).alias("h"), settled(array_sum("pred", "soilm_10"), 4).alias("p"),
        settled(F.get("pred", F.lit(0))["soilm_10"]).alias("init"), F.unix_timestamp(F.get("time", F.lit(0))).alias("t0"),
        settled(F.col("static.elev")).alias("elev"), E.one_hot_decode("static_int").alias("int_veg"))


@query("e2_make_samples", with_views(DYNAMIC, STATIC, body=_STARTS.lstrip() + _CUT.format(starts="starts")))
def make_samples(spark, sf):
    return _flat_samples(S.make_samples(fx.dynamic(spark, sf), fx.static(spark, sf), _SPEC))


@query("j3_user_generator", with_views(DYNAMIC, STATIC, body=_STARTS.lstrip() + _CUT.format(starts="starts")))
def user_generator(spark, sf):
    """The samples of E2 from a generator that sees the rows one by one, in blocks of 256 steps."""
    rows = GN.generated_samples(fx.dynamic(spark, sf), _SPEC, {"t": "timestamp", "tmp": "double", "apcp": "double", "soilm_10": "double"}, block=256)
    return _flat_samples(S.to_arrays(rows, _SPEC, ["y", "x", "sample"], fx.static(spark, sf)))


@query("e2_make_samples_limited", with_views(DYNAMIC, STATIC, body=_STARTS.lstrip() + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('11:' || y || ':' || x || ':' || sample), y, x, sample) AS r
             FROM starts), chosen AS (SELECT * FROM ranked WHERE r <= 40)""" + _CUT.format(starts="chosen")))
def make_samples_limited(spark, sf):
    return _flat_samples(S.make_samples(fx.dynamic(spark, sf), fx.static(spark, sf), _SPEC, limit=(["y"], 40)))


@query("e3_grid_samples", with_views(DYNAMIC, body="""
, g AS (SELECT d.y, d.x, i.i AS init, d.step - (20 + i.i * 48) + 1 AS lead, d.tmp, d.soilm_10 FROM fx_dynamic d
        JOIN (SELECT CAST(range AS INT) AS i FROM range(0, 9)) i ON d.step >= 20 + i.i * 48 - 12 AND d.step < 20 + i.i * 48 + 36)
SELECT y, x, init, round(sum(tmp) FILTER (lead <= 0), 4) AS window_tmp, round(sum(soilm_10) FILTER (lead >= 0), 4) AS pred_soilm,
  count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING count(*) = 48""".lstrip()))
def grid_samples(spark, sf):
    rows = S.grid_sample_rows(fx.dynamic(spark, sf), 12, 36, 48, first=20, final=20 + 48 * 9 + 5)
    pick = lambda cond, c: F.sum(F.when(F.expr(cond), F.col(c)))
    return rows.groupBy("y", "x", "init").agg(
        settled(pick("lead <= 0", "tmp"), 4).alias("window_tmp"),
        settled(pick("lead >= 0", "soilm_10"), 4).alias("pred_soilm"), F.count(F.lit(1)).alias("n"))


@query("e3_grid_samples_arrays", with_views(SCORED, body="""
SELECT y, x, init, round(sum(tmp), 4) AS h, round(min(true_prev) FILTER (step = 1) + sum(true_state), 4) AS p
FROM fx_scored WHERE feat = 'soilm_10' GROUP BY 1, 2, 3"""))
def grid_samples_arrays(spark, sf):
    rows = S.grid_sample_rows(fx.dynamic(spark, sf), 1, 24, 24, first=1).withColumn("pos", F.col("lead"))
    out = S.to_arrays(rows, S.SampleSpec(1, 24, ["tmp"], ["tmp"], ["soilm_10"]), ["y", "x", "init"])
    return out.select("y", "x", "init", settled(array_sum("horizon", "tmp"), 4).alias("h"),
                      settled(array_sum("pred", "soilm_10"), 4).alias("p"))


_BATCH = """
SELECT b AS batch, y, x, count(*) AS n, round(sum(tmp), 4) AS total FROM fx_dynamic,
  (SELECT range AS b FROM range(0, 40)) r WHERE step BETWEEN 5 AND 500 AND step >= 5 + b * 24 AND step < 5 + b * 24 + 30
GROUP BY 1, 2, 3"""


@query("e4_series_batches", with_views(DYNAMIC, body=_BATCH))
def series_batches(spark, sf):
    out = S.series_batches(fx.dynamic(spark, sf), 24, 30, 5, 500, ["tmp"])
    return out.select("batch", "y", "x", F.size("rows").cast("bigint").alias("n"),
                      settled(array_sum("rows", "tmp"), 4).alias("total"))


@query("e4_series_batches_full", with_views(DYNAMIC, body=_BATCH + " HAVING count(*) = 30"))
def series_batches_full(spark, sf):
    out = S.series_batches(fx.dynamic(spark, sf), 24, 30, 5, 500, ["tmp"], include_residual=False)
    return out.select("batch", "y", "x", F.size("rows").cast("bigint").alias("n"),
                      settled(array_sum("rows", "tmp"), 4).alias("total"))


@query("e5_partition_sequences", with_views(DYNAMIC, body="""
SELECT y, x, CAST(floor(step / 36.0) AS BIGINT) AS seq, round(sum(soilm_40), 4) AS total,
  epoch(min(t) FILTER (step % 36 = 12))::BIGINT AS pivot_time FROM fx_dynamic GROUP BY 1, 2, 3 HAVING count(*) = 36"""))
def partition_sequences(spark, sf):
    out = S.partition_sequences(fx.dynamic(spark, sf), 36, 12, ["soilm_40"])
    return out.select("y", "x", "seq", settled(array_sum("rows", "soilm_40"), 4).alias("total"),
                      F.unix_timestamp("pivot_time").alias("pivot_time"))


@query("e6_cycle_split", with_views(DYNAMIC, body="""
, w AS (SELECT y, x, step, tmp, step % 140 AS place, CAST(floor(step / 140.0) AS BIGINT) AS cycle, sum(tmp) OVER (
          PARTITION BY y, x ORDER BY step ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS total FROM fx_dynamic WHERE step < 560)
SELECT y, x, step, cycle, CASE WHEN place < 80 THEN 'train' WHEN place < 115 THEN 'validate' ELSE 'test' END AS role,
  round(total, 4) AS total FROM w WHERE (place >= 10 AND place < 70) OR (place >= 80 AND place < 105) OR (place >= 115 AND place < 140)""".lstrip()))
def cycle_split(spark, sf):
    out = S.cycle_split(fx.dynamic(spark, sf), 60, 25, 25, 10, 4, ["tmp"])
    return out.select("y", "x", "step", "cycle", "role", settled(array_sum("window", "tmp"), 4).alias("total"))


@query("e7_increments", with_views(DYNAMIC, body="""
SELECT y, x, step, round(lead(soilm_10) OVER (PARTITION BY y, x ORDER BY step) - soilm_10, 6) AS res_soilm_10 FROM fx_dynamic"""))
def increments(spark, sf):
    return S.increments(fx.dynamic(spark, sf), "soilm_10").select("y", "x", "step", *r6("res_soilm_10"))


@query("e7_accumulate", with_views(SCORED, body="""
SELECT y, x, init, step, feat, round(true_state, 6) AS state FROM fx_scored"""))
def accumulate(spark, sf):
    rows = fx.scored(spark, sf).withColumn("res", F.col("true_state") - F.col("true_prev"))
    out = S.accumulate(rows, "res", "true_prev", ["y", "x", "init", "feat"])
    return out.select("y", "x", "init", "step", "feat", *r6("state"))


@query("e7_increments_arrays", with_views(ARRAY, body="""
SELECT sample_id, CAST(i - 1 AS INT) AS position, round(seq[i + 1]::DOUBLE - seq[i]::DOUBLE, 6) AS v
FROM fx_array, (SELECT range AS i FROM range(1, 64)) r"""))
def increments_arrays(spark, sf):
    return fx.arrays(spark, sf).select("sample_id", F.posexplode(E.increments("seq")).alias("position", "v")).select(
        "sample_id", "position", *r6("v"))


@query("e8_split_train_val", with_views(SCORED, body="""
, c AS (SELECT DISTINCT y, CAST(floor(init / 2.0) AS BIGINT) AS chunk FROM fx_scored),
o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('5:' || y || ':' || chunk), chunk) AS rn FROM c)
SELECT s.y, s.x, s.init, CASE WHEN (rn - 1) % 3 = 0 THEN 'validate' ELSE 'train' END AS split
FROM (SELECT DISTINCT y, x, init, CAST(floor(init / 2.0) AS BIGINT) AS chunk FROM fx_scored) s JOIN o USING (y, chunk)""".lstrip()))
def split_train_val(spark, sf):
    samples = fx.scored(spark, sf).select("y", "x", "init").distinct().withColumn("chunk", F.floor(F.col("init") / 2))
    return S.split_train_val(samples, ["y"], "chunk", 3, 5).select("y", "x", "init", "split")


@query("e9_cadence_check", with_views(DYNAMIC, body="""
, k AS (SELECT y, x, t, epoch(t)::BIGINT - lag(epoch(t)::BIGINT) OVER (PARTITION BY y, x ORDER BY t) AS gap
        FROM fx_dynamic WHERE apcp = 0)
SELECT y, x, epoch(t)::BIGINT AS t, gap AS gap_seconds FROM k WHERE gap <> 29 * 3600""".lstrip()))
def cadence_check(spark, sf):
    dry = fx.dynamic(spark, sf).where("apcp = 0")
    out = N.cadence_check(dry, fx.STEP_SECONDS)
    return out.select("y", "x", F.unix_timestamp("t").alias("t"), "gap_seconds")


@query("e9_cadence_check_events", """
WITH k AS (SELECT user_id, ts, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, epoch_us(ts) AS ts, gap AS gap_seconds FROM k WHERE gap <> 3600""")
def cadence_check_events(spark, sf):
    rows = fx.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = N.cadence_check(rows, 3600, ["user_id"], "ts", chunk_seconds=7 * 86400)
    return out.select("user_id", F.unix_micros("ts").alias("ts"), "gap_seconds")


@query("e9_block_gaps", """
WITH b AS (SELECT l_linenumber AS block, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem GROUP BY 1),
d AS (SELECT block, epoch(a)::BIGINT - lag(epoch(z)::BIGINT) OVER (ORDER BY a, block) AS delta_seconds FROM b)
SELECT block, delta_seconds FROM d WHERE delta_seconds < 0 OR delta_seconds > 7200""")
def block_gaps(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("block"), F.col("l_shipdate").cast("timestamp").alias("t"))
    return N.block_gaps(rows, "block", 7200)


@query("e10_split_on_reset", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS pos FROM lineitem),
f AS (SELECT *, CASE WHEN l_linenumber < lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY pos) THEN 1 ELSE 0 END AS r FROM p)
SELECT l_orderkey, l_linenumber, CAST(sum(r) OVER (PARTITION BY l_orderkey ORDER BY pos) AS BIGINT) AS run FROM f""")
def split_on_reset(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").withColumn(
        "pos", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return N.split_on_reset(rows, "pos", "l_linenumber", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "run")


@query("e10_split_on_reset_tiles", with_views(DYNAMIC, body="""
, f AS (SELECT y, x, step, CASE WHEN apcp < lag(apcp) OVER (PARTITION BY y, x ORDER BY step) THEN 1 ELSE 0 END AS r FROM fx_dynamic)
SELECT y, x, step, CAST(sum(r) OVER (PARTITION BY y, x ORDER BY step) AS BIGINT) AS run FROM f""".lstrip()))
def split_on_reset_tiles(spark, sf):
    return N.split_on_reset(fx.dynamic(spark, sf), "step", "apcp", ["y", "x"], block=64).select("y", "x", "step", "run")


@query("e11_model_rank", with_views(ERRORS, body=f"""
, m AS (SELECT y AS model, feat, avg(abs(err_state)) AS mae, avg(abs(err_res)) AS info FROM fx_err GROUP BY 1, 2)
SELECT model, feat, rank() OVER (PARTITION BY feat ORDER BY info DESC) AS rank_information,
  rank() OVER (PARTITION BY feat ORDER BY mae) AS rank_mae FROM m""".lstrip()))
def model_rank(spark, sf):
    scores = fx.errors(spark, sf).groupBy(F.col("y").alias("model"), "feat").agg(
        F.avg(F.abs("err_state")).alias("mae"), F.avg(F.abs("err_res")).alias("fractional_info"))
    out = M.model_rank(scores)
    return out.select("model", "feat", F.col("rank_information").cast("bigint").alias("rank_information"),
                      F.col("rank_mae").cast("bigint").alias("rank_mae"))


@query("e12_align_steps", with_views(SCORED, body="""
SELECT y, x, init, step, round(true_state, 6) AS soilm_10, round(pred_res, 6) AS pred_res FROM fx_scored
WHERE feat = 'soilm_10' AND step <= 20"""))
def align_steps(spark, sf):
    labels = S.grid_sample_rows(fx.dynamic(spark, sf), 1, 24, 24, first=1).select(
        "y", "x", "init", F.col("lead").alias("step"), "soilm_10")
    predictions = fx.scored(spark, sf, feats=("soilm_10",)).where("step <= 20").select("y", "x", "init", "step", "pred_res")
    out = J.align_steps(labels, predictions, ["y", "x", "init"])
    return out.select("y", "x", "init", "step", *r6("soilm_10", "pred_res"))


@query("e13_window_target", with_views(DYNAMIC, body="""
, w AS (SELECT y, x, step, sum(tmp) OVER b AS total, count(*) OVER b AS nb, sum(soilm_10) OVER f AS ahead, count(*) OVER f AS nf
  FROM fx_dynamic WINDOW b AS (PARTITION BY y, x ORDER BY step ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY y, x ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))
SELECT y, x, step, round(total, 4) AS total, round(ahead, 4) AS ahead FROM w WHERE nb = 24 AND nf = 12""".lstrip()))
def window_target(spark, sf):
    out = S.window_target(fx.dynamic(spark, sf), 24, 12, ["tmp"], "soilm_10")
    return out.select("y", "x", "step", settled(array_sum("window", "tmp"), 4).alias("total"),
                      settled(array_sum("target"), 4).alias("ahead"))


@query("e13_window_target_difference", with_views(DYNAMIC, body="""
, w AS (SELECT y, x, step, count(*) OVER (PARTITION BY y, x ORDER BY step ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS nb,
  lead(soilm_10) OVER p - soilm_10 AS d FROM fx_dynamic WINDOW p AS (PARTITION BY y, x ORDER BY step))
SELECT y, x, step, round(d, 6) AS d FROM w WHERE nb = 6 AND d IS NOT NULL""".lstrip()))
def window_target_difference(spark, sf):
    out = S.window_target(fx.dynamic(spark, sf), 6, 1, ["tmp"], "soilm_10", difference=True)
    return out.select("y", "x", "step", settled(F.get("target", F.lit(0))).alias("d"))


@query("e14_random_split", with_views(SCORED, body="""
SELECT y, x, init, CASE WHEN ('0x' || substr(md5('3:' || y || ':' || x || ':' || init), 1, 8))::BIGINT / 4294967296.0e0 < 0.7e0
  THEN 'train' ELSE 'validate' END AS split FROM (SELECT DISTINCT y, x, init FROM fx_scored) s"""))
def random_split(spark, sf):
    samples = fx.scored(spark, sf).select("y", "x", "init").distinct()
    return S.random_split(samples, 0.7, 3, ["y", "x", "init"])


@query("e14_period_split", with_views(DYNAMIC, body="""
SELECT y, x, step, CASE WHEN t < TIMESTAMP '2020-09-01' THEN 'train' ELSE 'validate' END AS split FROM fx_dynamic
WHERE (t >= TIMESTAMP '2020-04-01' AND t < TIMESTAMP '2020-09-01') OR (t >= TIMESTAMP '2021-04-01' AND t < TIMESTAMP '2021-09-01')"""))
def period_split(spark, sf):
    out = S.period_split(fx.dynamic(spark, sf), ("2020-04-01", "2020-09-01"), ("2021-04-01", "2021-09-01"))
    return out.select("y", "x", "step", "split")
