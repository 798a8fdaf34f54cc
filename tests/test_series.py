"""Blocks, samples, windows, splits and order along series, against brute force on small frames."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.operators import blocks as B
from gridspark.operators import integrity as N
from gridspark.operators import joins as J
from gridspark.operators import samples as S
from gridspark.operators import selection as Q

T0 = datetime(2020, 1, 1)


def series(spark, lengths, skip=(), double=()):
    """One row per (pixel, hour); `skip` and `double` list (pixel, step) to leave out or repeat."""
    rng = random.Random(4)
    rows = []
    for x, n in enumerate(lengths):
        for s in range(n):
            if (x, s) in skip:
                continue
            for _ in range(2 if (x, s) in double else 1):
                rows.append((0, x, s, T0 + timedelta(hours=s), round(rng.uniform(0, 10), 3)))
    return spark.createDataFrame(rows, "y int, x int, step int, t timestamp, v double")


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_equal_plain_window(spark, block):
    df = series(spark, [40, 1, 5])
    w = Window.partitionBy("y", "x").orderBy("step")
    frame = lambda win: F.sum("v").over(win.rowsBetween(-4, 2))
    want = df.select("x", "step", F.round(frame(w), 6), F.lead("v").over(w)).collect()
    got = B.along_blocks(df, ["y", "x"], "step", {"a": frame, "b": lambda win: F.lead("v").over(win)}, 4, 2, block)
    got = got.select("x", "step", F.round("a", 6), "b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_numbering_in_chunks(spark):
    rows = [(k, d, i) for k, n in (("hot", 300), ("cold", 3)) for i, d in enumerate(sorted(i % 7 for i in range(n)))]
    df = spark.createDataFrame(rows, "k string, d int, i int")
    got = B.numbered_in_chunks(df, ["k"], "d", ["i"]).collect()
    assert len(got) == 303 and all(r.rn == r.i + 1 for r in got)
    totals = B.running_total_in_chunks(df, ["k"], "d", ["i"], F.lit(2), "s").collect()
    assert all(r.s == 2 * (r.i + 1) for r in totals)


def test_split_on_reset_over_block_edges(spark):
    ys = [0, 1, 2, 0, 1, 0, 0, 5, 3, 4, 4, 1]
    df = spark.createDataFrame(list(enumerate(ys)), "pos int, y int")
    want, run = [], 0
    for i, y in enumerate(ys):
        run += i > 0 and y < ys[i - 1]
        want.append(run)
    for block in (1, 2, 5, 100):
        got = N.split_on_reset(df, "pos", "y", block=block).orderBy("pos").collect()
        assert [r.run for r in got] == want


def test_cadence_sees_gaps_longer_than_a_chunk(spark):
    df = series(spark, [30, 30], skip={(0, 5)} | {(1, s) for s in range(3, 25)})
    got = N.cadence_check(df, 3600, chunk_seconds=4 * 3600).collect()
    assert {(r.x, r.t, r.gap_seconds) for r in got} == {
        (0, T0 + timedelta(hours=6), 7200), (1, T0 + timedelta(hours=25), 23 * 3600)}


def test_block_gaps(spark):
    rows = [("a", T0), ("a", T0 + timedelta(hours=5)), ("b", T0 + timedelta(hours=6)), ("c", T0 + timedelta(hours=30)),
            ("c", T0 + timedelta(hours=31)), ("d", T0 + timedelta(hours=30, minutes=30))]
    df = spark.createDataFrame(rows, "b string, t timestamp")
    got = {r.b: r.delta_seconds for r in N.block_gaps(df, "b", 7200).collect()}
    assert got == {"c": 24 * 3600, "d": -1800}


def test_nearest_time_brute_force(spark):
    rng = random.Random(1)
    stamps = [(k, T0 + timedelta(seconds=rng.randrange(0, 20 * 86400))) for k in (1, 1, 1, 2) for _ in range(25)]
    asks = [(k, T0 + timedelta(seconds=rng.randrange(-86400, 22 * 86400))) for k in (1, 2) for _ in range(60)]
    asks += [(1, stamps[0][1]), (3, T0)]
    got = J.nearest_time(spark.createDataFrame(stamps, "k int, t timestamp"),
                         spark.createDataFrame(asks, "k int, p timestamp"), "t", "p", ["k"], 3 * 86400).collect()
    assert len(got) == len(set(asks))
    for r in got:
        mine = [t for k, t in stamps if k == r.k]
        want = min(mine, key=lambda t: (abs(t - r.p), t)) if mine else None
        assert r.t == want


def test_interval_join_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, T0 + timedelta(seconds=rng.randrange(0, 10 * 86400))) for i in range(200)]
    inits = [T0 + timedelta(seconds=rng.randrange(0, 10 * 86400)) for _ in range(15)]
    got = J.window_interval_join(
        spark.createDataFrame(rows, "i int, t timestamp"), spark.createDataFrame([(t,) for t in inits], "init_time timestamp"),
        7200, 86400).collect()
    want = {(i, n) for i, t in rows for n in inits if n - timedelta(hours=2) <= t < n + timedelta(days=1)}
    assert len(got) == len(want) and {(r.i, r.init_time) for r in got} == want


def test_missing_times(spark):
    df = series(spark, [60], skip={(0, 7), (0, 23), (0, 24), (0, 47)})
    spans = df.groupBy("x").agg(F.min("t").alias("begin"), F.max("t").alias("end"))
    got = J.missing_times(df, spans, keys=["x"]).collect()
    assert sorted(r.t for r in got) == [T0 + timedelta(hours=h) for h in (7, 23, 24, 47)]


def test_sample_count():
    assert S.sample_count(0, 10, 24) == 1 and S.sample_count(0, 24, 24) == 1
    assert S.sample_count(0, 47, 24) == 1 and S.sample_count(0, 48, 24) == 2


def test_grid_samples_drop_gaps_and_repeats(spark):
    df = series(spark, [40, 40], skip={(0, 13)}, double={(1, 30)})
    got = S.grid_sample_rows(df, 2, 5, 6, first=4).select("x", "init").distinct().collect()
    whole = defaultdict(set)
    for x in (0, 1):
        for i in range(7):
            span = range(4 + 6 * i - 2, 4 + 6 * i + 5)
            bad = 13 if x == 0 else 30
            if bad not in span and span[-1] < 40:
                whole[x].add(i)
    assert {(r.x, r.init) for r in got} == {(x, i) for x, s in whole.items() for i in s}


def test_grid_samples_overlap(spark):
    df = series(spark, [30])
    rows = S.grid_sample_rows(df, 3, 8, 2, first=3).groupBy("init").agg(
        F.min("step").alias("a"), F.max("step").alias("b"), F.min("lead").alias("l"), F.max("lead").alias("h")).collect()
    assert {(r.init, r.a, r.b) for r in rows} == {(i, 2 * i, 2 * i + 10) for i in range(10)}
    assert all((r.l, r.h) == (-2, 8) for r in rows)


def test_make_samples_brute_force(spark):
    df = series(spark, [50, 33, 12], skip={(0, 20)})
    static = spark.createDataFrame([(0, x, float(x), x) for x in range(3)], "y int, x int, elev double, veg int")
    spec = S.SampleSpec(3, 4, ["v"], ["v"], ["v"], ["elev"], {"veg": 3}, separation=5, max_offset=4, seed=9)
    data = {(r.x, r.step): r.v for r in df.collect()}
    starts = {(r.x, r.sample): r.start for r in S.sample_starts(df, spec).collect()}
    assert {x for x, _ in starts} == {0, 1} and all(0 <= s - 5 * k < 4 for (_, k), s in starts.items())
    assert {k for x, k in starts if x == 0} == set(range((50 - 7 - 4) // 5))
    got = {(r.x, r["sample"]): r for r in S.make_samples(df, static, spec).collect()}
    whole = {key for key, s in starts.items() if all((key[0], s + i) in data for i in range(7))}
    assert set(got) == whole and len(whole) < len(starts)
    for (x, k), r in got.items():
        at = [data[(x, starts[(x, k)] + i)] for i in range(7)]
        assert [e.v for e in r.window] == at[:3] and [e.v for e in r.horizon] == at[3:] and [e.v for e in r.pred] == at[2:]
        assert r.static.elev == x and r.static_int == [int(i == x) for i in range(3)]
        assert r.time == sorted(r.time) and r.time[0] == T0 + timedelta(hours=starts[(x, k)])
    few = S.make_samples(df, static, spec, limit=(["x"], 2)).groupBy("x").count().collect()
    assert all(r["count"] <= 2 for r in few)


def test_sliding_and_targets_at_block_edges(spark, monkeypatch):
    df = series(spark, [25])
    vs = [r.v for r in df.orderBy("step").collect()]
    for block in (2, 6):
        monkeypatch.setattr(B.along_blocks, "__defaults__", (0, 0, block, None))
        rows = S.sliding_windows(df, 4, ["v"]).orderBy("step").collect()
        assert [[e.v for e in r.window] for r in rows] == [vs[i - 3:i + 1] for i in range(3, 25)]
        rows = S.window_target(df, 3, 2, ["v"], "v", difference=True).orderBy("step").collect()
        assert len(rows) == 25 - 2 - 2
        assert rows[0].target == pytest.approx([vs[3] - vs[2], vs[4] - vs[3]])


def test_cycle_roles(spark):
    got = spark.range(24).select(S.cycle_role(F.col("id"), 6, 3, 3, 2).alias("r")).collect()
    one = [None] * 2 + ["train"] * 6 + [None] * 2 + ["validate"] * 3 + [None] * 2 + ["test"] * 3
    assert [r.r for r in got] == (one + one)[:24]


def test_partition_and_batches(spark):
    df = series(spark, [11, 4])
    got = {(r.x, r.seq): r for r in S.partition_sequences(df, 4, 1, ["v"]).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0)} and got[(0, 1)].pivot_time == T0 + timedelta(hours=5)
    sizes = lambda keep: {(r.x, r.batch): len(r.rows) for r in S.series_batches(df, 4, 4, 0, 10, ["v"], keep).collect()}
    assert sizes(True) == {(0, 0): 4, (0, 1): 4, (0, 2): 3, (1, 0): 4}
    assert sizes(False) == {(0, 0): 4, (0, 1): 4, (1, 0): 4}


def test_splits_are_exclusive_and_complete(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("b"), F.floor(F.col("id") / 10).alias("c"))
    out = S.split_train_val(df, ["b"], "c", 4, 1)
    assert out.count() == 3000
    per_chunk = out.groupBy("b", "c").agg(F.count_distinct("split").alias("n"))
    assert per_chunk.where("n > 1").count() == 0
    shares = {(r.b, r.split): r.n for r in out.select("b", "c", "split").distinct().groupBy("b", "split").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert shares[(0, "validate")] == 75 and shares[(0, "train")] == 225
    again = S.split_train_val(df.repartition(7), ["b"], "c", 4, 1)
    assert again.exceptAll(out).count() == 0
    share = S.random_split(df, 0.7, 5, ["id"]).where("split = 'train'").count() / 3000
    assert abs(share - 0.7) < 0.04


def test_limit_per_block_small_and_large(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).alias("b"))
    small = {r.id for r in Q.limit_per_block(df, ["b"], 10, 1, ["id"]).collect()}
    large = {r.id for r in Q.limit_per_block(df, ["b"], 1200, 1, ["id"]).collect()}
    assert len(small) == 20 and len(large) == 2400 and small < large
    # Prefixes past the limit are dropped before the ranking: what is ranked is a few prefixes, not the block.
    plan = Q.limit_per_block(df, ["b"], 10, 1, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_before" in plan and "_prefix" in plan.split("row_number()")[1].split("\n")[0]


def test_limit_is_independent_of_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("b"))
    a = Q.limit_per_block(df.repartition(1), ["b"], 5, 1, ["id"])
    assert a.exceptAll(Q.limit_per_block(df.repartition(13), ["b"], 5, 1, ["id"])).count() == 0


def test_shuffle_is_reproducible(spark):
    df = spark.range(100)
    a = [r.id for r in Q.shuffle_samples(df, 3, ["id"]).collect()]
    assert a == [r.id for r in Q.shuffle_samples(df.repartition(9), 3, ["id"]).collect()] and sorted(a) == list(range(100))
    assert a != [r.id for r in Q.shuffle_samples(df, 4, ["id"]).collect()] and a != sorted(a)


def test_coarsen(spark):
    df = spark.createDataFrame([(1, s, float(s)) for s in range(1, 8)], "k int, step int, v double")
    got = {r.step: r.v for r in S.coarsen_horizon(df, 3, ["v"], ["k"], "max").collect()}
    assert got == {1: 3.0, 2: 6.0}
    assert [r.step for r in S.coarsen_pred(df, 3).orderBy("step").collect()] == [3, 6]
    assert [r.step for r in S.coarsen_pred(df, 3, include_init=False).orderBy("step").collect()] == [2, 5]


def test_add_feature_checks_alignment(spark):
    base = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "y int, x int, a double")
    good = spark.createDataFrame([(0, 0, 5.0), (0, 1, 6.0)], "y int, x int, b double")
    assert {r.b for r in Q.add_feature(base, good, "b", ["y", "x"]).collect()} == {5.0, 6.0}
    with pytest.raises(ValueError):
        Q.add_feature(base, good, "a", ["y", "x"])
    for bad in ([(0, 0, 5.0)], [(0, 0, 5.0), (0, 1, 6.0), (0, 2, 7.0)], [(0, 0, 5.0), (0, 1, 6.0), (0, 1, 6.5)]):
        with pytest.raises(Exception, match="do not match"):
            Q.add_feature(base, spark.createDataFrame(bad, "y int, x int, b double"), "b", ["y", "x"]).collect()


def test_time_slice_bounds(spark):
    df = series(spark, [10])
    assert Q.time_slice(df, "2020-01-01 02:00:00", "2020-01-01 05:00:00", require_bounds=True).count() == 3
    with pytest.raises(Exception, match="not on the axis"):
        Q.time_slice(df, "2020-01-01 02:30:00", "2020-01-01 05:00:00", require_bounds=True).collect()


def test_drop_bad_series(spark):
    rows = [(0, 0, 9999.0), (0, 0, 9999.0), (0, 1, 9999.0), (0, 1, 3.0), (0, 2, 3.0), (0, 2, 5000.0), (0, 3, 1.0)]
    df = spark.createDataFrame(rows, "y int, x int, v double")
    assert {r.x for r in Q.drop_bad_series(df, "v", 1000.0).collect()} == {1, 3}


def test_select_domain_and_bounds(spark):
    static = spark.createDataFrame([(y, x, 30 + y * 0.5, -100 + x * 0.5) for y in range(4) for x in range(4)],
                                   "y int, x int, lat double, lon double")
    near = Q.select_domain(static, "point", at=(30.6, -99.1)).collect()
    assert [(r.y, r.x) for r in near] == [(1, 2)]
    tie = Q.nearest_pixel(static, (30.25, -99.75)).head()
    assert (tie.y, tie.x) == (0, 0)
    bounds = Q.bbox_index_bounds(static, ((30.4, 31.1), (-99.6, -98.9))).head()
    assert (bounds.y0, bounds.y1, bounds.x0, bounds.x1) == (1, 3, 1, 3)
    with pytest.raises(ValueError):
        Q.select_domain(static, "hexagon")


def test_tile_bounds_do_not_repeat_rows(spark):
    df = spark.createDataFrame([("a", y, 0) for y in range(6)] + [("b", 0, 0)], "tile string, y int, x int")
    bounds = spark.sql("SELECT * FROM VALUES ('a', 1, 4, NULL, 3), ('a', 3, NULL, NULL, NULL) AS b(tile, y0, y1, x0, x1)")
    assert sorted(r.y for r in Q.select_tile_bounds(df, bounds).collect()) == [1, 2, 3, 4, 5]


def test_static_join_with_salts(spark):
    df = series(spark, [40, 2])
    static = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "y int, x int, c int")
    plain = J.join_static(df, static).select("x", "step", "c")
    assert plain.exceptAll(J.join_static(df, static, salts=5).select("x", "step", "c")).count() == 0
    assert J.join_static(df, static, salts=5).count() == 42


def test_schema_uniform(spark):
    a = spark.createDataFrame([(1, 2.0)], "a int, b double")
    N.schema_uniform(a, a)
    for other in ("a int", "a int, b float", "b double, a int", "a int, b double, c int"):
        with pytest.raises(N.SchemaMismatch):
            N.schema_uniform(a, spark.createDataFrame([], other))
    assert N.conforms(a, N.STATIC_TYPES)[:1] == ["y int"]


def test_class_combinations_have_empty_pairs(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "int_veg int, int_soil int")
    assert {(r.int_veg, r.int_soil): r.n for r in J.class_combinations(df).collect()} == {
        (1, 5): 2, (1, 6): 0, (2, 5): 0, (2, 6): 1}
