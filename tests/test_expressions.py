"""Column expressions on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark import vocab
from gridspark.functions import expressions as E
from gridspark.functions import features as X
from gridspark.functions import lookups as L


def values(df):
    return [r[0] for r in df.collect()]


def one(spark, c):
    return spark.range(1).select(c).head()[0]


@pytest.mark.parametrize("value,expected", [
    (0.0, 0), (0.999, 0), (1.0, 1), (9.999, 9), (10.0, 9), (11.0, 9), (-1.0, 0), (float("inf"), 9),
    (float("-inf"), 0), (float("nan"), None), (None, None)])
def test_bin_edges(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v double")
    assert values(df.select(E.bin_index("v", 0, 10, 10))) == [expected]


def test_bin_center(spark):
    assert one(spark, E.bin_center(F.lit(0), 0, 10, 10)) == 0.5


def test_one_hot_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in range(-1, 5)], "c int")
    out = df.select("c", E.one_hot(("c", 4)).alias("v")).select("c", "v", E.one_hot_decode("v").alias("d")).collect()
    assert [r.d for r in out] == [None, 0, 1, 2, 3, None]
    assert out[2].v == [0, 1, 0, 0]
    assert one(spark, E.one_hot((F.lit(1), 2), (F.lit(0), 3))) == [0, 1, 1, 0, 0]


@pytest.mark.parametrize("t,hour", [
    ("2020-05-01 23:29:59", 23), ("2020-05-01 23:30:00", 0), ("2020-05-01 23:31:00", 0), ("2020-05-01 00:10:00", 0)])
def test_hour_rounds_at_half(spark, t, hour):
    assert one(spark, E.hour_of_day(F.lit(t).cast("timestamp"))) == hour


def test_day_of_year_leap(spark):
    assert one(spark, E.day_of_year(F.lit("2020-12-31").cast("timestamp"))) == 365
    assert one(spark, E.day_of_year(F.lit("2021-01-01").cast("timestamp"))) == 0


def test_season(spark):
    got = [one(spark, E.season(F.lit(f"2021-{m:02d}-10").cast("timestamp"))) for m in range(1, 13)]
    assert got == ["DJF"] * 2 + ["MAM"] * 3 + ["JJA"] * 3 + ["SON"] * 3 + ["DJF"]


def test_step_of_rounds_noise(spark):
    for t, step in (("2020-01-01 00:00:00", 0), ("2020-01-01 00:59:30", 1), ("2020-01-01 01:00:20", 1),
                    ("2019-12-31 23:00:00", -1)):
        assert one(spark, E.step_of(F.lit(t).cast("timestamp"), "2020-01-01", 3600)) == step


def test_array_round_trip(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.5, 2.5],), ([7.0],)], "a array<double>")
    back = df.select("a", E.accumulate(F.get("a", F.lit(0)), E.increments("a")).alias("b")).collect()
    assert [r.b for r in back] == [[4.0, 2.5, 2.5], []]


def test_block_reduce_drops_the_tail(spark):
    a = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4, 5)])
    assert one(spark, E.block_reduce(a, 2, "mean")) == [1.5, 3.5]
    assert one(spark, E.block_reduce(a, 2, "max")) == [2.0, 4.0]
    assert one(spark, E.block_reduce(a, 9, "min")) == []
    with pytest.raises(ValueError):
        E.block_reduce(a, 2, "median")


def test_infiltration_threshold(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 0.01), (0.5, 0.02)], "r double, p double")
    assert values(df.select(E.infiltration("r", "p"))) == [None, None, 25.0]
    assert values(df.select(E.infiltration("r", "p", otherwise=0)))[:2] == [0.0, 0.0]


def test_ratio_by_zero_is_null(spark):
    assert one(spark, E.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, E.relative_error(F.lit(1.0), F.lit(0.0))) is None


def test_hash_uniform_is_spread(spark):
    df = spark.range(2000).select(E.hash_uniform(1, "id").alias("u"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u")).head()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.03


def test_texture_lookups(spark):
    df = spark.createDataFrame([(0,), (5,), (13,), (16,), (99,)], "int_soil int")
    out = {r.int_soil: r for r in L.texture_fractions(df).collect()}
    assert out[0].pct_sand == 0 and out[5].pct_silt == 0.85 and out[99].pct_clay == 0
    cls = lambda *f: one(spark, L.texture_class(*[F.lit(float(v)) for v in f]))
    assert cls(0.92, 0.05, 0.03) == 1 and cls(0.92004, 0.05, 0.03) == 1 and cls(0, 0, 0) == 0
    assert cls(0.921, 0.05, 0.03) is None
    params = {r.int_soil: r for r in L.texture_params(df).collect()}
    assert params[13].rsm_stress is None and params[99].porosity is None


def test_every_mineral_texture_is_found(spark):
    dim = L.texture_dim(spark).where("int_soil BETWEEN 1 AND 12")
    got = dim.select("int_soil", L.texture_class("pct_sand", "pct_silt", "pct_clay").alias("c")).collect()
    assert len(got) == 12 and all(r.int_soil == r.c for r in got)


def test_drainage_and_lai(spark):
    df = spark.createDataFrame([(0,), (3,), (8,), (9,)], "slope_type int")
    assert {r.slope_type: r.drainage for r in L.drainage_class(df).collect()} == {0: None, 3: 1.0, 8: None, 9: 0.0}
    veg = spark.createDataFrame([(10, 0.0), (10, 1.0), (10, 0.5)], "int_veg int, veg double")
    assert sorted(r.lai_gvf for r in L.lai_from_gvf(veg, "veg").collect()) == [0.65, pytest.approx(1.645), 2.64]


def test_recipes_reject_nesting_and_unknown(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(X.UnknownFeature):
        X.derive_feats(df, {"c": "a + b", "d": "c * 2"})
    with pytest.raises(X.UnknownFeature):
        X.project_feats(df, ["a", "zzz"])
    out = X.project_feats(df, ["c", "b"], {"c": "a + b"})
    assert out.columns == ["c", "b"] and out.head().c == 3.0
    assert X.recipe_args("1 - exp(-0.5D * lai) + abs(veg)") == {"lai", "veg"}


def test_unit_conversion_round_trip(spark):
    df = spark.createDataFrame([(30.0, 31.5, 1.5, 0.45, 0.05)], "s double, after double, d double, porosity double, wiltingp double")
    rsm = X.convert_units(df.withColumns({"r": F.col("s"), "dr": F.col("d")}), "soilm_to_rsm",
                          {"r": "soilm_10"}, {"dr": ("after", "soilm_10")}).head()
    assert rsm.r == pytest.approx((30 / 0.1 / 1000 - 0.05) / 0.4)
    assert rsm.dr == pytest.approx(1.5 / 0.1 / 1000 / 0.4)
    back = X.convert_units(spark.createDataFrame([(rsm.r, 0.45, 0.05)], "r double, porosity double, wiltingp double"),
                           "rsm_to_soilm", {"r": "soilm_10"}).head()
    assert back.r == pytest.approx(30.0)
    with pytest.raises(ValueError):
        X.convert_units(df, "celsius", {"s": "soilm_10"})


def test_normalize_round_trip(spark):
    df = spark.createDataFrame([(280.0, 3.0)], "tmp double, other double")
    coeffs = X.gaussian_coeffs()
    back = X.denormalize(X.normalize(df, coeffs, ["tmp", "other"]), coeffs, ["tmp", "other"]).head()
    assert back.tmp == pytest.approx(280.0) and back.other == 3.0
    long = spark.createDataFrame([("tmp", 280.0), ("none", 1.0)], "feat string, value double")
    got = {r.feat: r.value for r in X.normalize_long(long, coeffs).collect()}
    mean, std = coeffs["tmp"]
    assert got["tmp"] == pytest.approx((280 - mean) / std) and got["none"] == 1.0


def test_vocabulary_is_consistent():
    assert set(vocab.FORCING_RECORDS.values()) | set(vocab.MODEL_RECORDS.values()) <= set(vocab.UNITS)
    assert all(lo < hi for lo, hi in vocab.HIST_BOUNDS.values())
    assert all(math.isclose(sum(v[2:5]), 1, abs_tol=0.02) for k, v in vocab.TEXTURES.items() if 1 <= k <= 12)
    assert vocab.layer_depth("rsm_fc") == 2.0 and vocab.layer_depth("soilm_100") == 0.6
