"""Samples, windows and frames over series with missing and repeated steps: only what is whole may come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import integrity as N
from ..operators import samples as S
from ..operators import statistics as ST
from .registry import DYNAMIC, GAPPED, STATIC, query, r6, settled, with_views
from .samples import array_sum


def _once(before: int, after: int) -> str:
    frame = f"(PARTITION BY y, x ORDER BY step RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"count(*) OVER {frame} = {before + after + 1} AND count(DISTINCT step) OVER {frame} = {before + after + 1}"


@query("e1_sliding_windows_gaps", with_views(DYNAMIC, GAPPED, body=f"""
, w AS (SELECT y, x, step, {_once(4, 0)} AS whole,
          sum(tmp) OVER (PARTITION BY y, x ORDER BY step RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS total FROM fx_gapped)
SELECT y, x, step, round(total, 4) AS total FROM w WHERE whole""".lstrip()))
def sliding_windows(spark, sf):
    out = S.sliding_windows(fx.gapped(spark, sf), 5, ["tmp"])
    return out.select("y", "x", "step", settled(array_sum("window", "tmp"), 4).alias("total"))


@query("e13_window_target_gaps", with_views(DYNAMIC, GAPPED, body=f"""
, w AS (SELECT y, x, step, {_once(3, 2)} AS whole,
          sum(tmp) OVER (PARTITION BY y, x ORDER BY step RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS total,
          sum(soilm_10) OVER (PARTITION BY y, x ORDER BY step RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ahead FROM fx_gapped)
SELECT y, x, step, round(total, 4) AS total, round(ahead, 4) AS ahead FROM w WHERE whole""".lstrip()))
def window_target(spark, sf):
    out = S.window_target(fx.gapped(spark, sf), 4, 2, ["tmp"], "soilm_10")
    return out.select("y", "x", "step", settled(array_sum("window", "tmp"), 4).alias("total"),
                      settled(array_sum("target"), 4).alias("ahead"))


@query("e7_increments_gaps", with_views(DYNAMIC, GAPPED, body=f"""
, w AS (SELECT y, x, step, soilm_10, {_once(0, 1)} AS whole,
          max(soilm_10) OVER (PARTITION BY y, x ORDER BY step RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS ahead FROM fx_gapped)
SELECT y, x, step, round(CASE WHEN whole THEN ahead - soilm_10 END, 6) AS res_soilm_10 FROM w""".lstrip()))
def increments(spark, sf):
    return S.increments(fx.gapped(spark, sf), "soilm_10").select("y", "x", "step", *r6("res_soilm_10"))


@query("e6_cycle_split_gaps", with_views(DYNAMIC, GAPPED, body=f"""
, w AS (SELECT y, x, step, step % 22 AS place, CAST(floor(step / 22.0) AS BIGINT) AS cycle, {_once(2, 0)} AS whole,
          sum(tmp) OVER (PARTITION BY y, x ORDER BY step RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS total
        FROM fx_gapped WHERE step < 660)
SELECT y, x, step, cycle, CASE WHEN place < 12 THEN 'train' WHEN place < 18 THEN 'validate' ELSE 'test' END AS role,
  round(total, 4) AS total FROM w WHERE whole AND ((place >= 2 AND place < 10) OR (place >= 12 AND place < 16) OR place >= 18)""".lstrip()))
def cycle_split(spark, sf):
    out = S.cycle_split(fx.gapped(spark, sf), 8, 4, 4, 2, 30, ["tmp"])
    return out.select("y", "x", "step", "cycle", "role", settled(array_sum("window", "tmp"), 4).alias("total"))


@query("e3_grid_samples_gaps", with_views(DYNAMIC, GAPPED, body="""
, g AS (SELECT y, x, CAST(floor((step - 1) / 6.0) AS INT) AS init, step, tmp FROM fx_gapped WHERE step >= 1)
SELECT y, x, init, round(sum(tmp), 4) AS total FROM g GROUP BY 1, 2, 3 HAVING count(*) = 6 AND count(DISTINCT step) = 6""".lstrip()))
def grid_samples(spark, sf):
    rows = S.grid_sample_rows(fx.gapped(spark, sf), 2, 4, 6, first=3)
    return rows.groupBy("y", "x", "init").agg(settled(F.sum("tmp"), 4).alias("total"))


@query("e2_make_samples_gaps", with_views(DYNAMIC, GAPPED, STATIC, body="""
, len AS (SELECT y, x, max(step) + 1 AS len FROM fx_gapped GROUP BY 1, 2),
off AS (SELECT y, x, len, ('0x' || substr(md5('4:' || y || ':' || x), 1, 8))::BIGINT % 3 AS off FROM len),
starts AS (SELECT y, x, k AS sample, k * 7 + off AS start FROM (
  SELECT *, unnest(range(0, CAST(floor((len - 8) / 7.0) AS BIGINT))) AS k FROM off WHERE len >= 15) q)
SELECT s.y, s.x, s.sample, round(sum(tmp) FILTER (step < start + 2), 4) AS w, round(sum(soilm_10) FILTER (step >= start + 1), 4) AS p
FROM starts s JOIN fx_gapped d ON d.y = s.y AND d.x = s.x AND d.step >= s.start AND d.step < s.start + 5
JOIN fx_static t ON t.y = s.y AND t.x = s.x GROUP BY 1, 2, 3 HAVING count(*) = 5 AND count(DISTINCT step) = 5""".lstrip()))
def make_samples(spark, sf):
    spec = S.SampleSpec(2, 3, ["tmp"], ["tmp"], ["soilm_10"], ["elev"], separation=7, max_offset=3, seed=4)
    out = S.make_samples(fx.gapped(spark, sf), fx.static(spark, sf), spec)
    return out.select("y", "x", "sample", settled(array_sum("window", "tmp"), 4).alias("w"),
                      settled(array_sum("pred", "soilm_10"), 4).alias("p"))


@query("e4_series_batches_gaps", with_views(DYNAMIC, GAPPED, body="""
SELECT CAST(floor((step - 1) / 5.0) AS BIGINT) AS batch, y, x, round(sum(tmp), 4) AS total FROM fx_gapped
WHERE step BETWEEN 1 AND 200 GROUP BY 1, 2, 3 HAVING count(*) = 5 AND count(DISTINCT step) = 5"""))
def series_batches(spark, sf):
    out = S.series_batches(fx.gapped(spark, sf), 5, 5, 1, 200, ["tmp"], include_residual=False)
    return out.select("batch", "y", "x", settled(array_sum("rows", "tmp"), 4).alias("total"))


@query("e5_partition_sequences_gaps", with_views(DYNAMIC, GAPPED, body="""
SELECT y, x, CAST(floor(step / 6.0) AS BIGINT) AS seq, round(sum(soilm_40), 4) AS total FROM fx_gapped
GROUP BY 1, 2, 3 HAVING count(*) = 6 AND count(DISTINCT step) = 6"""))
def partition_sequences(spark, sf):
    out = S.partition_sequences(fx.gapped(spark, sf), 6, 2, ["soilm_40"])
    return out.select("y", "x", "seq", settled(array_sum("rows", "soilm_40"), 4).alias("total"))


@query("d9_period_frames_gaps", with_views(DYNAMIC, GAPPED, body="""
SELECT y, x, CAST(floor(step / 6.0) AS BIGINT) AS period, count(*) AS n, round(avg(tmp), 6) AS mean, round(max(tmp), 6) AS max
FROM fx_gapped GROUP BY 1, 2, 3 HAVING count(*) = 6 AND count(DISTINCT step) = 6"""))
def period_frames(spark, sf):
    out = ST.period_frames(fx.gapped(spark, sf), 6, ["tmp"])
    return out.select("y", "x", "period", "n", *r6("mean", "max"))


@query("e10_split_on_reset_gaps", with_views(DYNAMIC, GAPPED, body="""
, f AS (SELECT y, x, step, apcp, CASE WHEN apcp < lag(apcp) OVER (PARTITION BY y, x ORDER BY step, apcp) THEN 1 ELSE 0 END AS r FROM fx_gapped)
SELECT y, x, step, CAST(sum(r) OVER (PARTITION BY y, x ORDER BY step, apcp, r DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f""".lstrip()))
def split_on_reset(spark, sf):
    return N.split_on_reset(fx.gapped(spark, sf), "step", "apcp", ["y", "x"], block=8).select("y", "x", "step", "run")
