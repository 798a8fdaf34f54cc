"""Whole samples and adjacent steps, wherever blocks begin; plans that scan, infer and prune as they should."""

import re

import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import blocks as B
from gridspark.operators import integrity as N
from gridspark.operators import samples as S
from gridspark.operators import scoring as C
from gridspark.operators import selection as Q
from gridspark.operators import statistics as ST
from gridspark.plans import grid_verification, sequence_verification
from gridspark.sources import exports as EX
from gridspark.sources import grids as G
from gridspark.sources import inventory as I
from gridspark.sources import sinks as SK


def series(spark, steps, x=0):
    return spark.createDataFrame([(0, x, s, float(s)) for s in steps], "y int, x int, step int, v double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_whole_does_not_depend_on_blocks(spark, block):
    base = list(range(4090, 4106))
    for missing in (4094, 4095, 4096, 4097):
        steps = sorted([s for s in base if s != missing] + [4101])
        out = B.along_blocks(series(spark, steps), ["y", "x"], "step", {}, before=2, after=1, block=block, whole="w")
        got = {r.step for r in out.where("w").collect()}
        want = {s for s in base if all(steps.count(s + d) == 1 for d in (-2, -1, 0, 1))}
        assert got == want and out.count() == len(steps)


@pytest.mark.parametrize("first", [0, 4092])
def test_gap_and_repeat_in_one_sample(spark, first):
    bad = series(spark, [first + s for s in (0, 1, 2, 3, 3, 5)])
    good = series(spark, range(first, first + 6), x=1)
    df = bad.unionByName(good)
    assert {r.x for r in S.grid_sample_rows(df, 2, 4, 6, first=first + 2).collect()} == {1}
    rows = df.withColumn("pos", F.col("step") - first)
    assert {r.x for r in S.to_arrays(rows, S.SampleSpec(2, 4, ["v"], ["v"], ["v"]), ["y", "x"], t="step").collect()} == {1}
    if first % 6 == 0:
        assert {r.x for r in S.partition_sequences(df, 6, 0, ["v"], t="step").collect()} == {1}
        assert {r.x for r in ST.period_frames(df, 6, ["v"], t="step").collect()} == {1}
    assert {r.x for r in S.series_batches(df, 6, 6, first, first + 5, ["v"], include_residual=False).collect()} == {1}
    assert {r.x for r in S.sliding_windows(df, 5, ["v"]).collect()} == {1}
    steps = {(r.x, r.step - first): r.res_v for r in S.increments(df, "v").collect()}
    assert steps[0, 1] == 1 and steps[0, 2] is None and steps[0, 3] is None and steps[1, 4] == 1 and steps[1, 5] is None


@pytest.mark.parametrize("shift", [0, 65524])
def test_resets_over_gaps(spark, shift):
    rows = [(10 + shift, 5), (16 + shift, 3), (17 + shift, 4), (300 + shift, 1)]
    df = spark.createDataFrame(rows, "pos bigint, i int")
    assert [r.run for r in N.split_on_reset(df, "pos", "i").orderBy("pos").collect()] == [0, 1, 1, 2]
    assert [r.run for r in N.split_on_reset(df, "pos", "i", block=2).orderBy("pos").collect()] == [0, 1, 1, 2]


def test_starts_are_listed_in_parts(spark, monkeypatch):
    spec = S.SampleSpec(2, 3, ["v"], ["v"], ["v"])
    df = series(spark, range(50))
    want = S.sample_starts(df, spec).collect()
    monkeypatch.setattr(S, "STARTS_TOGETHER", 7)
    assert sorted(S.sample_starts(df, spec).collect()) == sorted(want) and len(want) == 45


def test_one_scan_for_all_features(spark, sf, tmp_path):
    path = str(tmp_path / "t")
    fx.dynamic(spark, sf).write.parquet(path)
    feats = ["tmp", "soilm_10", "soilm_40", "lai"]
    df = spark.read.parquet(path)
    out = ST.apply_scale(df, ST.fit_scale(df, feats), feats)
    # One pass over the rows, and one subquery however many features there are.
    assert out.collect() and len(set(re.findall(r"Subquery subquery#(\d+)", plan(out)))) == 1
    rows = EX.raster_rows(df.where("step = 3"), "tmp", ["step"])
    assert rows.count() == df.select("y").distinct().count()


def test_one_inference_per_sample(spark, sf):
    spec = S.SampleSpec(4, 12, ["tmp", "soilm_10"], ["tmp", "spfh"], ["soilm_10"], separation=16)
    samples = S.make_samples(fx.dynamic(spark, sf), fx.static(spark, sf), spec)
    seen = spark.sparkContext.accumulator(0)

    def factory():
        import numpy as np

        def predict(w, h, s, i):
            seen.add(len(w))
            return np.zeros((len(w), h.shape[1], 1))
        return predict
    out = sequence_verification.score(samples, factory, spec, ["y", "x", "sample"], inputs=["tmp", "spfh"])
    assert plan(out).count("MapInArrow") == 1
    n = out.count()
    assert seen.value * 12 == n == samples.count() * 12


def test_coarse_plan_needs_whole_steps(spark, sf):
    spec = S.SampleSpec(4, 12, ["tmp", "soilm_10"], ["tmp"], ["soilm_10"], separation=16)
    run = lambda c: sequence_verification.verify_sequences(
        fx.dynamic(spark, sf), fx.static_params(spark, sf), spec, C.coarsened(C.persistence(1), c), ["horizon"], "soilm_10",
        coarseness=c, convert="soilm_to_rsm")["horizon"].collect()
    assert sorted((r.step, r.forecast_hour) for r in run(3)) == [(k, 3 * k) for k in (1, 2, 3, 4)]
    with pytest.raises(Exception, match="not divisible"):
        run(5)


def test_quarters_are_pruned(spark, sf, tmp_path):
    rows = G.with_calendar(fx.dynamic(spark, sf)).withColumn("tile", F.lit("a"))
    path = str(tmp_path / "dyn")
    SK.write_dynamic(rows, path)
    df = spark.read.parquet(f"{path}/data")
    for out in (G.scan_dynamic(spark, f"{path}/data", ["tmp"], period=("2020-04-01", "2020-06-30")),
                Q.time_slice(df, "2020-04-01", "2020-06-30", partitioned=True)):
        filters = re.search(r"PartitionFilters: \[(.*?), PushedFilters", plan(out))[1]
        assert "quarter" in filters and "year" in filters
        files = {f.rsplit("/", 1)[0] for f in (r[0] for r in out.select(F.input_file_name()).distinct().collect())}
        assert {re.search(r"year=\d+/quarter=\d", f)[0] for f in files} == {"year=2020/quarter=2"}
    assert G.scan_dynamic(spark, f"{path}/data", ["tmp"], period=("2020-04-01", "2021-02-01")).count() == rows.where(
        "t >= '2020-04-01' AND t < '2021-02-01'").count()


def test_limits_are_one_path(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("b"), "id").withColumn("b", F.when(F.col("b") < 2, 0).otherwise(1))
    for k in (1, 5, 999, 1000, 1500, 5000):
        got = Q.limit_per_block(df, ["b"], k, 3, ["id"])
        sizes = {r.b: r["count"] for r in got.groupBy("b").count().collect()}
        assert sizes == {0: min(k, 2000), 1: min(k, 1000)} and got.distinct().count() == sum(sizes.values())
    small = {r.id for r in Q.limit_per_block(df, ["b"], 5, 3, ["id"]).collect()}
    assert small <= {r.id for r in Q.limit_per_block(df, ["b"], 1200, 3, ["id"]).collect()}


def test_a_large_partition_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(4000).select(F.lit("a").alias("tile"), "id")
    SK.write_table(df, str(tmp_path / "t"), ["tile"], sort_by=["id"])
    files = list((tmp_path / "t" / "data" / "tile=a").glob("*.parquet"))
    spans = sorted((r.a, r.b) for r in spark.read.parquet(f"{tmp_path}/t/data").groupBy(F.input_file_name()).agg(
        F.min("id").alias("a"), F.max("id").alias("b")).collect())
    assert len(files) == len(spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_misshapen_lines(spark):
    good = "1:100:d=95:TMP:kpds5=11:kpds6=105:kpds7=2:TR=0:P1=1:P2=3:TimeU=1:2 m:anl:NAve=4"
    lines = spark.createDataFrame([(good,), ("1:2:3",), (None,)], "value string")
    assert I.parse_inventory_lines(lines, rejects=True).count() == 1
    assert {r.line for r in I.inventory_rejects(lines).collect()} == {"1:2:3", None}
    with pytest.raises(Exception, match="too few fields"):
        I.parse_inventory_lines(lines).collect()
