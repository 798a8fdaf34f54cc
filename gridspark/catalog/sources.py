"""Scans, inventories, sinks and exports. Sinks write under spark.checkpoint.dir and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import vocab
from ..operators import statistics as ST
from ..sources import exports as EX
from ..sources import grids as G
from ..sources import inventory as I
from ..sources import sinks as SK
from .registry import DYNAMIC, ERRORS, STATIC, query, r6, settled, with_views



@query("a1_scan_dynamic", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'""")
def scan_dynamic(spark, sf):
    return G.scan_dynamic(
        spark, f"{sf}/lineitem.parquet", ["l_quantity", "l_discount"],
        keys=("l_suppkey", "l_orderkey", "l_linenumber"), period=("1997-01-01", "1998-01-01"), t="l_shipdate")


@query("a2_scan_static", """
SELECT s_suppkey, s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM supplier""")
def scan_static(spark, sf):
    return G.scan_static(spark, f"{sf}/supplier.parquet", ["s_nationkey", "s_acctbal"], keys=["s_suppkey"])


@query("a3_record_map", with_views(DYNAMIC, body="""
SELECT y, x, step, round(tmp, 6) AS tmp, round(spfh, 6) AS spfh, round(apcp, 6) AS apcp FROM fx_dynamic"""))
def record_map(spark, sf):
    records = F.array(*[F.struct(F.lit(n).alias("record"), F.col(c).cast("double").alias("value"))
                        for n, c in ((1, "tmp"), (2, "spfh"), (10, "apcp"), (77, "lai"))])
    rows = fx.dynamic(spark, sf).select("y", "x", "step", F.explode(records).alias("_r")).select("y", "x", "step", "_r.*")
    wanted = {n: vocab.FORCING_RECORDS[n] for n in (1, 2, 10)}
    return G.record_map(rows, wanted, ["y", "x", "step"]).select("y", "x", "step", *r6("tmp", "spfh", "apcp"))


@query("a4_mask_fill", with_views(DYNAMIC, STATIC, body="""
SELECT y, x, step, CASE WHEN m_valid THEN round(tmp, 6) ELSE 9999 END AS filled,
       CASE WHEN m_valid THEN round(tmp, 6) END AS again FROM fx_dynamic JOIN fx_static USING (y, x)"""))
def mask_fill(spark, sf):
    rows = fx.dynamic(spark, sf).join(fx.static(spark, sf).select("y", "x", "m_valid"), ["y", "x"])
    out = G.mask_fill(rows.withColumn("filled", F.col("tmp")), "m_valid", ["filled"])
    out = G.unfill(out.withColumn("again", F.col("filled")), ["again"])
    return out.select("y", "x", "step", *r6("filled", "again"))


@query("a5_crop_flip", with_views(DYNAMIC, body="""
SELECT CAST(996 - (y - 1) AS INT) AS y, CAST(x - 2 AS INT) AS x, step FROM fx_dynamic
WHERE y BETWEEN 1 AND 997 AND x BETWEEN 2 AND 8"""))
def crop_flip(spark, sf):
    return G.crop_flip(fx.dynamic(spark, sf), (1, 2), (2, 1), 1000, 10).select("y", "x", "step")


@query("a6_assign_tiles", with_views(DYNAMIC, body="""
SELECT y, x, step, printf('y%03d-%03d_x%03d-%03d', y // 4 * 4, least(y // 4 * 4 + 4, 1000), x // 3 * 3, least(x // 3 * 3 + 3, 10)) AS tile,
  CAST(y % 4 AS INT) AS tile_y, CAST(x % 3 AS INT) AS tile_x FROM fx_dynamic"""))
def assign_tiles(spark, sf):
    return G.assign_tiles(fx.dynamic(spark, sf), 4, 3, 1000, 10).select("y", "x", "step", "tile", "tile_y", "tile_x")


_PATHS = ("'data/timegrid_' || CAST(year(l_shipdate) AS {s}) || 'q' || CAST(quarter(l_shipdate) AS {s}) || '_y' || "
          "CAST(100 + l_suppkey AS {s}) || '-' || CAST(200 + l_suppkey AS {s}) || '_x154-308.parquet'")


@query("a7_parse_tile_path", """
SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS quarter,
  CAST(100 + l_suppkey AS INT) AS y0, CAST(200 + l_suppkey AS INT) AS y1, 154 AS x0, 308 AS x1, count(*) AS n
FROM lineitem GROUP BY ALL""")
def parse_tile_path(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.expr(_PATHS.format(s="STRING")).alias("path"))
    cols = ["year", "quarter", "y0", "y1", "x0", "x1"]
    return G.parse_tile_path(rows).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("a8_select_partitions", with_views(DYNAMIC, body="""
SELECT CAST(year(t) AS INT) AS year, CAST(quarter(t) AS INT) AS quarter, CASE WHEN y < 5 THEN 'n' ELSE 's' END AS region,
  count(*) AS n FROM fx_dynamic WHERE y < 5 AND quarter(t) IN (1, 4) AND year(t) = 2020 GROUP BY 1, 2, 3"""))
def select_partitions(spark, sf):
    rows = G.with_calendar(fx.dynamic(spark, sf)).withColumn("region", F.when(F.col("y") < 5, "n").otherwise("s"))
    path = SK.scratch_dir(spark, "partitions")
    SK.write_table(rows.select("y", "x", "step", "year", "quarter", "region"), path, ("region", "year", "quarter"))
    picked = G.select_partitions(SK.read_table(spark, path), ["n"], ["cold"], (2020, 2021))
    return picked.groupBy("year", "quarter", "region").agg(F.count(F.lit(1)).alias("n"))


@query("a9_audit_inventory", """
SELECT epoch(e.t)::BIGINT AS t, l.length, CASE WHEN l.length IS NULL THEN 'missing' ELSE 'small' END AS status
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS t) e
LEFT JOIN (SELECT date_trunc('hour', ts) AS t, CAST(sum(length(props)) AS BIGINT) AS length FROM events GROUP BY 1) l
  ON e.t = l.t WHERE l.length IS NULL OR l.length < 90""")
def audit_inventory(spark, sf):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t")
    listing = fx.table(spark, sf, "events").groupBy(hour).agg(F.sum(F.length("props")).alias("length"))
    expected = I.expected_times(spark, "2024-01-01", "2024-02-01")
    return I.audit_inventory(expected, listing, 90).select(F.unix_timestamp("t").alias("t"), "length", "status")


@query("a9_size_range", """
SELECT min(length) AS min_bytes, max(length) AS max_bytes, count(*) AS n FROM (
  SELECT CAST(sum(length(props)) AS BIGINT) AS length FROM events GROUP BY date_trunc('hour', ts)) l""")
def size_range(spark, sf):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t")
    return I.size_range(fx.table(spark, sf, "events").groupBy(hour).agg(F.sum(F.length("props")).alias("length")))


@query("a10_parse_inventory_lines", """
SELECT l_linenumber AS record, l_orderkey * 100 AS byte, '95' || l_returnflag AS date, 'TMP' AS name,
  CAST(l_partkey % 256 AS INT) AS param_pds, 105 AS type_pds, 2 AS vert_pds, 0 AS dt_pds, 1 AS t0_pds, 3 AS tf_pds,
  1 AS fcst_pds, '2 m above gnd' AS lvl_str, 'anl' AS mdl_type, CAST(l_suppkey AS INT) AS navg FROM lineitem""")
def parse_inventory_lines(spark, sf):
    return I.parse_inventory_lines(_inventory(spark, sf))


def _inventory(spark, sf):
    text = F.concat_ws(
        ":", F.col("l_linenumber").cast("string"), (F.col("l_orderkey") * 100).cast("string"),
        F.concat(F.lit("d=95"), "l_returnflag"), F.lit("TMP"), F.concat(F.lit("kpds5="), F.col("l_partkey") % 256),
        F.lit("kpds6=105"), F.lit("kpds7=2"), F.lit("TR=0"), F.lit("P1=1"), F.lit("P2=3"), F.lit("TimeU=1"),
        F.lit("2 m above gnd"), F.lit("anl"), F.concat(F.lit("NAve="), F.col("l_suppkey")))
    return fx.table(spark, sf, "lineitem").select(text.alias("value"), "l_linenumber")


@query("a10_inventory_rejects", """
SELECT l_linenumber || ':' || l_orderkey * 100 || ':d=95' || l_returnflag AS line FROM lineitem WHERE l_linenumber = 6
UNION ALL SELECT NULL FROM lineitem WHERE l_linenumber = 7""")
def inventory_rejects(spark, sf):
    cut = F.when(F.col("l_linenumber") == 6, F.substring_index("value", ":", 3)).when(F.col("l_linenumber") < 6, F.col("value"))
    return I.inventory_rejects(_inventory(spark, sf).select(cut.alias("value")))


@query("a11_write_samples", with_views(DYNAMIC, body="""
SELECT y, x, CAST(floor(step / 24.0) AS BIGINT) AS seq, round(sum(soilm_10), 4) AS total FROM fx_dynamic
GROUP BY 1, 2, 3 HAVING count(*) = 24"""))
def write_samples(spark, sf):
    from ..operators.samples import partition_sequences
    samples = partition_sequences(fx.dynamic(spark, sf), 24, 0, ["soilm_10"]).withColumn("tile", F.col("y") % 3)
    path = SK.scratch_dir(spark, "samples")
    SK.write_samples(samples, path, {"steps": 24, "feats": ["soilm_10"]}, ["tile"])
    assert SK.read_params(spark, path)["steps"] == 24
    return SK.read_table(spark, path).select("y", "x", "seq", settled(F.aggregate(
        "rows", F.lit(0.0), lambda s, r: s + r["soilm_10"]), 4).alias("total"))


@query("a11_write_predictions", with_views(ERRORS, body="""
SELECT y, x, init, feat, round(sum(pred_res), 4) AS total, count(*) AS n FROM fx_scored GROUP BY 1, 2, 3, 4"""))
def write_predictions(spark, sf):
    path = SK.scratch_dir(spark, "predictions")
    SK.write_predictions(fx.scored(spark, sf).select("y", "x", "init", "step", "feat", "pred_res"), path,
                         {"rule": "damped"}, ["feat"])
    return SK.read_table(spark, path).groupBy("y", "x", "init", "feat").agg(
        settled(F.sum("pred_res"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("a11_write_gridstats", with_views(DYNAMIC, body="""
SELECT feat, CAST(month(t) AS INT) AS month, y, x, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM (
  SELECT y, x, t, 'tmp' AS feat, tmp AS v FROM fx_dynamic UNION ALL SELECT y, x, t, 'lai', lai FROM fx_dynamic) u
GROUP BY 1, 2, 3, 4"""))
def write_gridstats(spark, sf):
    path = SK.scratch_dir(spark, "gridstats")
    SK.write_gridstats(ST.gridstats_monthly(fx.dynamic(spark, sf), ["tmp", "lai"]), path, {"feats": ["tmp", "lai"]})
    return SK.read_table(spark, path).select("feat", "month", "y", "x", *r6("mean", "max"))


@query("a11_write_grid_errors", with_views(ERRORS, body="""
SELECT y, x, init, feat, round(max(abs(err_state)), 6) AS state_error_max, round(avg(abs(err_res)), 6) AS res_error_mean
FROM fx_err GROUP BY 1, 2, 3, 4"""))
def write_grid_errors(spark, sf):
    from ..operators.verification import grid_error_stats
    path = SK.scratch_dir(spark, "grid-errors")
    SK.write_grid_errors(grid_error_stats(fx.errors(spark, sf)), path)
    return SK.read_table(spark, path).select("y", "x", "init", "feat", *r6("state_error_max", "res_error_mean"))


_FRAMES = """
, f AS (SELECT y, x, CAST(floor(step / 24.0) AS BIGINT) AS period, avg(tmp) AS tmp_mean, sum(apcp) AS apcp_sum,
               min(t) AS t0, max(t) AS t1 FROM fx_dynamic GROUP BY 1, 2, 3 HAVING count(*) = 24)"""


@query("a12_export_period_csv", with_views(DYNAMIC, body=_FRAMES.lstrip() + """
SELECT strftime(min(t0), '%Y%m%d-%H') AS time_start, round(avg(tmp_mean), 4) AS tmp_mean,
       round(avg(apcp_sum), 4) AS apcp_sum_or_diff FROM f WHERE x < 3 GROUP BY period"""))
def export_period_csv(spark, sf):
    frames = ST.period_frames(fx.dynamic(spark, sf), 24, ["tmp", "apcp"])
    pixels = fx.static(spark, sf).where("x < 3")
    path = SK.scratch_dir(spark, "csv")
    EX.export_period_csv(frames, path, [("tmp", "mean"), ("apcp", "sum_or_diff")], pixels, "start")
    out = spark.read.csv(path, header=True, schema="time_start STRING, tmp_mean DOUBLE, apcp_sum_or_diff DOUBLE")
    return out.select("time_start", *[settled(c, 4).alias(c) for c in ("tmp_mean", "apcp_sum_or_diff")])


@query("a13_raster_rows", with_views(DYNAMIC, body=_FRAMES.lstrip() + """
, v AS (SELECT period, y, x, tmp_mean FROM f WHERE tmp_mean > 278 AND y <> 4),
b AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM v),
g AS (SELECT p.period, CAST(yy.range AS INT) AS y, CAST(xx.range AS INT) AS x FROM (SELECT DISTINCT period FROM v) p, b,
      range(0, 1000) yy, range(0, 10) xx WHERE yy.range BETWEEN y0 AND y1 AND xx.range BETWEEN x0 AND x1)
SELECT g.period, g.y, CAST(g.x - x0 AS INT) AS position, round(tmp_mean, 6) AS value FROM g CROSS JOIN b
LEFT JOIN v ON v.period = g.period AND v.y = g.y AND v.x = g.x"""))
def raster_rows(spark, sf):
    frames = ST.period_frames(fx.dynamic(spark, sf), 24, ["tmp"]).where("mean > 278 AND y <> 4")
    rows = EX.raster_rows(frames.select("period", "y", "x", "mean"), "mean", ["period"])
    return rows.select("period", "y", F.posexplode("cells").alias("position", "_v")).select(
        "period", "y", "position", settled("_v", 6).alias("value"))


@query("a14_read_training_history", """
SELECT l_returnflag AS model, CAST(l_linenumber - 1 AS INT) AS epoch, round(avg(l_discount), 6) AS loss,
  CASE WHEN l_linenumber > 1 THEN round(avg(l_tax), 6) END AS val_loss FROM lineitem GROUP BY l_returnflag, l_linenumber""")
def read_training_history(spark, sf):
    curves = fx.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), (F.col("l_linenumber") - 1).alias("epoch")).agg(
        F.avg("l_discount").alias("loss"), F.avg("l_discount").alias("residual_loss"), F.avg("l_tax").alias("val_loss"))
    curves = curves.withColumn("val_loss", F.when(F.col("epoch") > 0, F.col("val_loss"))).withColumn(
        "val_residual_loss", F.col("val_loss"))
    path = SK.scratch_dir(spark, "history")
    columns = ["epoch", "loss", "residual_loss", "val_loss", "val_residual_loss"]
    curves.select("model", *columns).write.partitionBy("model").csv(path, header=True, nullValue="NA")
    return EX.read_training_history(spark, path).select("model", "epoch", *r6("loss", "val_loss"))


@query("a14_read_configs", """
SELECT l_returnflag AS model, count(*) AS window_size FROM lineitem GROUP BY l_returnflag""")
def read_configs(spark, sf):
    configs = fx.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.count(F.lit(1)).alias("window_size"))
    path = SK.scratch_dir(spark, "configs")
    configs.repartition("model").write.partitionBy("model").json(path)
    return EX.read_configs(spark, path, "model STRING, window_size BIGINT").select("model", "window_size")


@query("a15_select_results", with_views(ERRORS, body="""
SELECT feat, 'fn' AS model, step, round(avg(abs(err_state)), 6) AS mean_state FROM fx_err
WHERE y >= 3 AND feat = 'soilm_10' GROUP BY 1, 2, 3"""))
def select_results(spark, sf):
    from ..operators.verification import Moments
    m = Moments(["source", "model", "feat", "eval_type", "err_type", "partial", "step"], {"state": F.abs("err_state")})
    tagged = fx.errors(spark, sf).withColumns({
        "source": F.lit("test"), "model": F.lit("fn"), "eval_type": F.lit("horizon"), "err_type": F.lit("abs"),
        "partial": F.col("y") < 3})
    path = SK.scratch_dir(spark, "results")
    SK.write_results(m.partial(tagged), path)
    picked = EX.select_results(SK.read_table(spark, path), "test", ["fn"], ["soilm_10"], "horizon", "abs")
    return m.finish(picked).select("feat", "model", "step", *r6("mean_state"))
