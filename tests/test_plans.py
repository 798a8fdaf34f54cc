"""Plans with histograms of the user's own, several domains in one run, and stored results."""

import json

import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import samples as S
from gridspark.operators import scoring as C
from gridspark.operators import verification as V
from gridspark.plans import evaluators as EV
from gridspark.plans import grid_verification as GV
from gridspark.plans import sequence_verification as SV
from gridspark.plans import store as ST
from gridspark.sources import published as PB

SPEC = S.SampleSpec(4, 12, ["tmp", "soilm_10"], ["tmp", "spfh", "apcp"], ["soilm_10"], ["elev"], {"int_veg": 14}, separation=16, max_offset=5)
ELEVATION = EV.Histogram(("elev", 0.0, 10000.0, 12), ("err_state", -30.0, 30.0, 16), "err_res", static=["elev"])
MIXED = EV.Histogram(("tmp - 273", -40.0, 60.0, 10), ("int_soil", 0.0, 16.0, 16), "elev", static=["int_soil", "elev"],
                     where="feat = 'soilm_10' AND step > 3", absolute=True)


def same(a, b, digits=6):
    names = sorted(b.columns)
    flat = lambda df: sorted(str([round(v, digits) if isinstance(v, float) else v for v in (r[c] for c in names)]) for r in df.collect())
    assert sorted(a.columns) == names and flat(a) == flat(b)


def errors_of(spark, sf, static, **options):
    samples = S.make_samples(fx.dynamic(spark, sf), static.where("m_valid"), SPEC)
    return SV.score(samples, C.damped_trend([1], 0.5), SPEC, ["y", "x", "sample"], inputs=["tmp"], **options)


def test_static_and_own_axes(spark, sf):
    static = fx.static_params(spark, sf)
    out = SV.verify_sequences(fx.dynamic(spark, sf), static, SPEC, C.damped_trend([1], 0.5), ["by-elevation", "mixed", "horizon"], "soilm_10",
                              inputs=["tmp"], histograms={"by-elevation": ELEVATION, "mixed": MIXED})
    errors = errors_of(spark, sf, static)
    joined = errors.join(static.select("y", "x", "elev", "int_soil"), ["y", "x"])
    same(out["by-elevation"], V.joint_histogram(joined, ELEVATION.ax1, ELEVATION.ax2, "err_res"))
    same(out["mixed"], V.joint_histogram(joined.where("step > 3"), MIXED.ax1, MIXED.ax2, "elev", absolute=True))
    same(out["horizon"], V.error_by_horizon(errors))
    assert out["mixed"].count() > 10
    with pytest.raises(ValueError, match="unknown"):
        EV.evaluate(errors, ["mixed"], EV.Evaluation(static, "soilm_10"))


@pytest.mark.parametrize("how", ["mean", "min", "max"])
def test_coarse_inputs(spark, sf, how):
    """Inputs of a coarse step are the mean, least or largest of its fine steps, as numpy gives them."""
    static = fx.static_params(spark, sf)
    samples = S.make_samples(fx.dynamic(spark, sf), static.where("m_valid"), SPEC)
    factory = C.coarsened(C.damped_trend([1], 0.5), 4, how)
    rows = SV.score(samples, factory, SPEC, ["y", "x", "sample"], inputs=["tmp"], coarseness=4, reduce_inputs=how).collect()
    fine = {(r.y, r.x, r.sample): [h.tmp for h in r.horizon] for r in samples.select("y", "x", "sample", "horizon").collect()}
    import numpy as np
    reduce = getattr(np, how)
    for r in rows:
        part = fine[r.y, r.x, r.sample][4 * (r.step - 1):4 * r.step]
        assert r.tmp == pytest.approx(float(reduce(part)))
    assert len(rows) == 3 * len(fine)
    with pytest.raises(ValueError):
        SV.score(samples, factory, SPEC, ["y", "x", "sample"], inputs=["tmp"], coarseness=4, reduce_inputs="median")


# --- several domains ------------------------------------------------------------------------------

GRID = S.SampleSpec(3, 12, ["soilm_10"], ["tmp"], ["soilm_10"])
NAMES = ["horizon", "temporal", "by-class", "hist-true-pred", "efficiency", "grid-axes"]
BY_CLASS = EV.Histogram(("int_veg", 0.0, 14.0, 14), ("err_res", -30.0, 30.0, 8), "err_state", static=["int_veg"])


def domains(spark):
    def one(name, tile, start, end):
        tiles = spark.createDataFrame([(tile, None, None, None, None, 0, 5 if tile == "e" else 0)],
                                      "tile string, y0 int, y1 int, x0 int, x1 int, off_y int, off_x int")
        return GV.GridDomain(name, tiles, start, end, 24, fx.STEP_SECONDS)
    return [one("west", "w", "2020-02-01 18:00:00", "2021-03-01 00:00:00"), one("east", "e", "2020-05-01 01:00:00", "2020-12-01 00:00:00"),
            one("late", "w", "2021-06-01 04:00:00", "2021-09-01 00:00:00")]


def tiled(spark, sf):
    rows = fx.dynamic(spark, sf)
    return rows.withColumn("tile", F.when(F.col("x") < 5, "w").otherwise("e")).withColumn("x", F.col("x") % 5)


def test_several_domains_and_their_total(spark, sf, tmp_path):
    rows, static, given = tiled(spark, sf), fx.static(spark, sf), domains(spark)
    setup = dict(histograms={"by-class": BY_CLASS}, bins=32)
    kept = ST.Store(str(tmp_path / "results"), "run", "persistence", params={"window": 3})
    got = GV.verify_domains(rows, static, given, GRID, C.persistence(1), NAMES, "soilm_10", inputs=["tmp"], store=kept, **setup)
    assert set(got) == {"west", "east", "late", "all"}
    for d in given:
        alone = GV.verify_grid(rows, static, d, GRID, C.persistence(1), NAMES, "soilm_10", inputs=["tmp"], **setup)
        for name in NAMES:
            same(got[d.name][name], alone[name])
    every = GV.grid_errors(rows, static, given[0], GRID, C.persistence(1)).withColumn("domain", F.lit("a"))
    for d in given[1:]:
        every = every.unionByName(GV.grid_errors(rows, static, d, GRID, C.persistence(1)).withColumn("domain", F.lit(d.name)))
    same(got["all"]["horizon"], V.error_by_horizon(every))
    same(got["all"]["temporal"], V.error_by_time(every), 5)
    same(got["all"]["efficiency"], V.efficiency_summary(V.sequence_efficiency(every, ["domain", "y", "x", "init"])), 5)
    n = {p: r["by-class"].agg(F.sum("n")).first()[0] for p, r in got.items()}
    assert n["all"] == n["west"] + n["east"] + n["late"] and min(n.values()) > 0
    # What came back is what was stored.
    listed = ST.stored_results(spark, kept.path, source="all")
    assert {r["eval_type"] for r in listed} == set(NAMES) and all(r["model"] == "persistence" for r in listed)
    again, params = kept.load(spark, "soilm_10", "horizon", source="all")
    same(again, got["all"]["horizon"])
    assert params["window"] == 3 and params["source"] == "all" and params["eval_type"] == "horizon"
    with pytest.raises(ValueError):
        GV.verify_domains(rows, static, [given[0], given[0]], GRID, C.persistence(1), ["horizon"], "soilm_10")


# --- stored results -------------------------------------------------------------------------------

def test_stored_results_equal_the_operators(spark, sf, tmp_path):
    static = fx.static_params(spark, sf)
    kept = ST.Store(str(tmp_path / "r"), "val", "trend", params={"spec": "4-12"})
    SV.verify_sequences(fx.dynamic(spark, sf), static, SPEC, C.damped_trend([1], 0.5), ["horizon", "static-combos", "own"], "soilm_10",
                        inputs=["tmp"], histograms={"own": ELEVATION}, store=kept)
    errors = errors_of(spark, sf, static)
    same(kept.load(spark, "soilm_10", "horizon")[0], V.error_by_horizon(errors))
    same(kept.load(spark, "soilm_10", "static-combos")[0], V.error_by_class(errors, static, ["y", "x", "sample"]))
    assert kept.load(spark, "soilm_10", "own")[1] == {"err_type": "bias", "eval_type": "own", "feat": "soilm_10", "model": "trend", "source": "val", "spec": "4-12"}
    assert [r["eval_type"] for r in ST.stored_results(spark, kept.path, models=["trend"], eval_type="own")] == ["own"]
    assert ST.stored_results(spark, kept.path, models=["other"]) == [] and ST.stored_results(spark, str(tmp_path / "none")) == []
    with pytest.raises(PB.NotPublished):
        kept.load(spark, "soilm_10", "efficiency")


def test_a_version_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = lambda v: spark.createDataFrame([(v,)], "v int")
    with pytest.raises(PB.NotPublished):
        PB.read_published(spark, path)
    PB.write_published(table(1), path, {"made": 1})
    # Killed between the data and the parameters, and between the parameters and the publication.
    real = json.dumps
    monkeypatch.setattr(PB.json, "dumps", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        PB.write_published(table(2), path, {"made": 2})
    monkeypatch.setattr(PB.json, "dumps", real)
    PB.stage(table(3), path, {"made": 3})
    df, params = PB.read_published(spark, path)
    assert [r.v for r in df.collect()] == [1] and params == {"made": 1}
    reading = df
    assert PB.write_published(table(4), path, {"made": 4}) == 2
    assert [r.v for r in PB.read_published(spark, path)[0].collect()] == [4] and [r.v for r in reading.collect()] == [1]
    for v in (5, 6):
        PB.write_published(table(v), path, {"made": v})
    df, params = PB.read_published(spark, path)
    assert [r.v for r in df.collect()] == [6] and params == {"made": 6} and len(list((tmp_path / "t" / "published").glob("0*"))) == 2


def test_two_writers(spark, tmp_path):
    """The later publication counts, whichever was staged first."""
    path = str(tmp_path / "t")
    a, b = (PB.stage(spark.createDataFrame([(v,)], "v int"), path, {"made": v}) for v in (1, 2))
    assert (PB.publish(spark, path, b), PB.publish(spark, path, a)) == (1, 2)
    assert PB.read_published(spark, path)[1] == {"made": 1}
