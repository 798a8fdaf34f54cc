"""The bucketed layout: plans without exchanges, equal results, crowded pixels apart."""

import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import joins as J
from gridspark.operators import samples as S
from gridspark.operators import statistics as ST
from gridspark.sources import layout as L

SPEC = S.SampleSpec(window=12, horizon=24, window_feats=["tmp", "soilm_10"], horizon_feats=["tmp"], pred_feats=["soilm_10"],
                    static_feats=["elev"], static_int={"int_veg": 14}, separation=31, max_offset=20, seed=11)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(str([r[c] for c in names]) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark, sf, tmp_path_factory):
    """The table in its layout without and with crowded pixels; one pixel holds a third of the rows in the second."""
    top = str(tmp_path_factory.mktemp("layout"))
    plain = fx.dynamic(spark, sf)
    one = plain.where("y = 0 AND x = 1").withColumns({"y": F.lit(99), "x": F.lit(0)})
    long = one.crossJoin(spark.range(0, 8)).withColumn("step", (F.col("step") + F.col("id") * 1000).cast("int")).withColumn(
        "t", F.timestamp_seconds(F.unix_timestamp("t") + F.col("id") * 1000 * fx.STEP_SECONDS)).drop("id")
    hot = plain.unionByName(long)
    static = fx.static(spark, sf)
    static = static.unionByName(static.where("y = 0 AND x = 1").withColumns({"y": F.lit(99), "x": F.lit(0)}))
    a = L.write_layout(plain, f"{top}/a", 4)
    b = L.write_layout(hot, f"{top}/b", 4, most_rows=1500)
    return {"plain": (plain, a, L.write_layout(static, f"{top}/sa", 4, step=None, like=a)),
            "hot": (hot, b, L.write_layout(static, f"{top}/sb", 4, step=None, like=b)), "static": static}


OPERATORS = {
    "windows": lambda df: S.sliding_windows(df, 6, ["tmp"]).select("y", "x", "step", "window"),
    "increments": lambda df: S.increments(df, "soilm_10"),
    "targets": lambda df: S.window_target(df, 4, 3, ["tmp"], "soilm_10").select("y", "x", "step", "window", "target"),
    "statistics": lambda df: ST.gridstats_monthly(df, ["tmp", "soilm_10"]).select("month", "y", "x", "feat", "min", "max", F.round("mean", 6), F.round("std", 6)),
    "sequences": lambda df: S.partition_sequences(df, 12, 5, ["tmp"]),
    "frames": lambda df: ST.period_frames(df, 24, ["tmp"]).select("y", "x", "period", "min", "max", F.round("mean", 6)),
    "samples": lambda df: S.cut_all_samples(df, SPEC),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_the_layout(made, name):
    for kind in ("plain", "hot"):
        table, laid, _ = made[kind]
        out = laid.map(OPERATORS[name])
        assert rows_of(out) == rows_of(OPERATORS[name](table))
        assert laid.has_crowded == (kind == "hot")
        assert L.exchanges(OPERATORS[name](laid.ordinary)) == []
    assert L.exchanges(OPERATORS[name](made["plain"][0]))


def test_joins_keep_the_layout(made, spark, tmp_path):
    for kind in ("plain", "hot"):
        table, laid, static = made[kind]
        model = L.write_layout(table.where("tmp > 240").select("y", "x", "t", "apcp"), str(tmp_path / kind), 4, step=None, like=laid)
        forcing = lambda df: df.select("y", "x", "t", "tmp")
        out = laid.join(model, lambda a, b: J.join_forcing_model(forcing(a), b))
        assert rows_of(out) == rows_of(J.join_forcing_model(forcing(table), table.where("tmp > 240").select("y", "x", "t", "apcp")))
        own = laid.ordinary.sparkSession
        own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert L.exchanges(J.join_forcing_model(forcing(laid.ordinary), model.ordinary)) == []
        make = lambda d, s: S.make_samples(d, s, SPEC, in_place=True)
        assert L.exchanges(make(laid.ordinary, static.ordinary)) == []
        assert rows_of(laid.join(static, make)) == rows_of(S.make_samples(table, made["static"], SPEC))
        assert L.exchanges(J.join_static(laid.ordinary, static.ordinary)) == []
        own.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        S.make_samples(table, made["static"], SPEC, limit=(["y"], 2), in_place=True)


def test_crowded_pixels_stand_apart(made, spark):
    _, laid, static = made["hot"]
    assert {(r.y, r.x) for r in laid.crowded.select("y", "x").distinct().collect()} == {(99, 0)}
    assert laid.ordinary.where("y = 99").isEmpty() and {(r.y, r.x) for r in static.crowded.collect()} == {(99, 0)}
    # The session the tables were written in keeps its own settings.
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_reopened(made, spark):
    table, laid, _ = made["plain"]
    again = L.open_layout(spark, laid.path)
    assert again.ordinary.rdd.getNumPartitions() == 4 and rows_of(again.ordinary) == rows_of(table)
    spark.sql(f"DROP TABLE {L._table_name(laid.path)}")
    known = L.open_layout(spark, laid.path)
    assert rows_of(known.ordinary) == rows_of(table) and L.exchanges(known.map(OPERATORS["windows"])) == []


def test_odd_tables(spark, tmp_path):
    schema = "y int, x int, step int, v double"
    null = L.write_layout(spark.createDataFrame([(None, 1, 0, 1.0), (None, 1, 1, 2.0), (1, None, 0, 3.0)], schema), str(tmp_path / "n"), 2, most_rows=1)
    assert null.ordinary.count() == 1 and null.crowded.count() == 2
    empty = L.write_layout(spark.createDataFrame([], schema), str(tmp_path / "e"), 2)
    assert empty.map(lambda df: S.increments(df, "v")).count() == 0
    with pytest.raises(ValueError):
        empty.join(L.write_layout(spark.createDataFrame([], schema), str(tmp_path / "f"), 3), lambda a, b: a)


def test_larger_tables_have_more_buckets(spark, sf, monkeypatch):
    from gridspark.catalog import layouts
    monkeypatch.setattr(layouts, "BUCKET_ROWS", 500)
    out = layouts.laid_out(spark, sf)
    assert out.buckets == -(-layouts.fx.dynamic(spark, sf).count() // 500) > layouts.BUCKETS
    assert out.map(lambda df: df).count() == layouts.fx.dynamic(spark, sf).count()
