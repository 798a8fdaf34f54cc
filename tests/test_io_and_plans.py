"""Sinks, exports, streams, scoring and the end-to-end plans."""

import json
import shutil
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.functions.features import UnknownFeature
from gridspark.operators import samples as S
from gridspark.operators import scoring as C
from gridspark.operators import verification as V
from gridspark.plans import evaluators, grid_verification, monthly_statistics, sequence_verification
from gridspark.sources import exports as EX
from gridspark.sources import grids as G
from gridspark.sources import inventory as I
from gridspark.sources import sinks as SK
from gridspark.streaming import partials as SP


def test_dynamic_layout_prunes_partitions(spark, sf, tmp_path):
    rows = G.with_calendar(fx.dynamic(spark, sf)).withColumn("tile", F.when(F.col("x") < 5, "w").otherwise("e"))
    path = str(tmp_path / "dyn")
    SK.write_dynamic(rows, path, {"feats": ["tmp"]})
    assert SK.read_params(spark, path) == {"feats": ["tmp"]}
    out = G.scan_dynamic(spark, f"{path}/data", ["tmp"], tiles=["w"], period=("2020-02-01", "2020-03-01"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tile" in plan.split("PartitionFilters:")[1].split("]")[0]
    read = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "tmp" in read and "soilm_10" not in read
    want = rows.where("tile = 'w' AND t >= '2020-02-01' AND t < '2020-03-01'").count()
    assert 0 < out.count() == want
    with pytest.raises(UnknownFeature):
        G.scan_dynamic(spark, f"{path}/data", ["nothing"])


def test_floats_at_the_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1)], "k int, v double")
    SK.write_table(df, str(tmp_path / "t"), floats=True)
    assert dict(SK.read_table(spark, str(tmp_path / "t")).dtypes)["v"] == "float"


def test_fill_round_trip(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (True, float("nan"))], "m boolean, v double")
    out = G.unfill(G.mask_fill(df, "m", ["v"]), ["v"]).collect()
    assert [r.v for r in out] == [1.0, None, None]


def test_static_masks_become_boolean(spark, tmp_path):
    spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0)], "y int, x int, m_valid double").write.parquet(str(tmp_path / "s"))
    assert {r.x: r.m_valid for r in G.scan_static(spark, str(tmp_path / "s")).collect()} == {0: True, 1: False}


def test_tiles_with_a_residual(spark):
    df = spark.createDataFrame([(y, x) for y in (0, 4, 9) for x in (0, 6)], "y int, x int")
    got = {(r.y, r.x): (r.tile, r.tile_y, r.tile_x) for r in G.assign_tiles(df, 4, 5, 10, 7).collect()}
    assert got[(9, 6)] == ("y008-010_x005-007", 1, 1) and got[(0, 0)] == ("y000-004_x000-005", 0, 0)


def test_crop_flip(spark):
    df = spark.createDataFrame([(y, 0) for y in range(5)], "y int, x int")
    assert sorted(r.y for r in G.crop_flip(df, (1, 1), (0, 0), 5, 1).collect()) == [0, 1, 2]


def test_tile_path_without_match(spark):
    df = spark.createDataFrame([("a/timegrid_2018q3_y000-098_x154-308.h5",), ("readme.txt",)], "path string")
    rows = G.parse_tile_path(df).collect()
    assert (rows[0].year, rows[0].quarter, rows[0].y1, rows[0].x0) == (2018, 3, 98, 154) and rows[1].year is None


def test_file_audit(spark, tmp_path):
    for h, size in ((0, 10), (1, 3), (3, 10)):
        (tmp_path / f"f_2020010100_{h:02d}.grb").write_bytes(b"x" * size)
    files = I.list_files(spark, str(tmp_path), "*.grb").withColumn(
        "t", F.timestamp_seconds(F.lit(1577836800) + F.regexp_extract("path", r"_(\d\d)\.grb", 1).cast("int") * 3600))
    got = I.audit_inventory(I.expected_times(spark, "2020-01-01", "2020-01-01 04:00:00"), files, 5).collect()
    assert {(r.t.hour, r.status) for r in got} == {(1, "small"), (2, "missing")}
    sizes = I.size_range(files).head()
    assert (sizes.min_bytes, sizes.max_bytes) == (3, 10)
    assert I.expected_times(spark, "2020-01-01", "2020-01-03 02:00:00").count() == 50


def test_inventory_lines(spark):
    good = "1:0:d=21082315:TMP:kpds5=11:kpds6=105:kpds7=2:TR=0:P1=0:P2=0:TimeU=1:2 m above gnd:anl:NAve=4"
    rows = I.parse_inventory_lines(spark.createDataFrame([(good,), ("junk",)], "value string"), rejects=True).collect()
    assert len(rows) == 1 and rows[0].name == "TMP" and rows[0].navg == 4 and rows[0].lvl_str == "2 m above gnd"


def test_training_history_named_by_file(spark, tmp_path):
    (tmp_path / "net-1_prog.csv").write_text("epoch,loss,residual_loss,val_loss,val_residual_loss\n0,0.5,0.1,NA,NA\n1,0.4,0.1,0.3,0.2\n")
    rows = EX.read_training_history(spark, str(tmp_path)).orderBy("epoch").collect()
    assert [r.model for r in rows] == ["net-1"] * 2 and rows[0].val_loss is None and rows[1].val_loss == 0.3
    (tmp_path / "c.json").write_text(json.dumps({"model": "net-1", "feats": {"window": ["tmp"]}}, indent=1))
    assert EX.read_configs(spark, str(tmp_path / "c.json")).head().feats.window == ["tmp"]


def test_raster_rows_fill_the_box(spark):
    df = spark.createDataFrame([(0, 1, 1, 5.0), (0, 3, 2, 6.0), (1, 2, 3, 7.0)], "p int, y int, x int, v double")
    got = {(r.p, r.y): r.cells for r in EX.raster_rows(df, "v", ["p"]).collect()}
    assert got == {(0, 1): [5.0, None, None], (0, 2): [None] * 3, (0, 3): [None, 6.0, None],
                   (1, 1): [None] * 3, (1, 2): [None, None, 7.0], (1, 3): [None] * 3}


def test_period_table_labels(spark, sf):
    from gridspark.operators.statistics import period_frames
    frames = period_frames(fx.dynamic(spark, sf), 24, ["tmp"])
    for how, label in (("start", "20200101-00"), ("end", "20200128-19"), ("mean", "20200114-21")):
        first = EX.period_table(frames, [("tmp", "mean")], time_reduce=how).orderBy("period").head()
        assert first[f"time_{how}"] == label


# --- scoring --------------------------------------------------------------------------------------

def make(spark, n=5):
    rows = [(k, [(float(k), float(k + 1)), (float(k + 1), float(k + 3))], [(1.0,), (2.0,), (3.0,)],
             [(float(k + 3),)] * 4, (0.5,), [0, 1]) for k in range(n)]
    return spark.createDataFrame(rows, "k int, window array<struct<f:double,s:double>>, horizon array<struct<f:double>>, "
                                       "pred array<struct<s:double>>, static struct<e:double>, static_int array<int>")


PARTS = C.Parts(["f", "s"], ["f"], ["s"], ["e"])


def test_predictor_sees_dense_scaled_arrays(spark):
    def factory():
        def predict(w, h, s, i):
            assert w.shape[1:] == (2, 2) and h.shape[1:] == (3, 1) and s.shape[1:] == (1,) and i.shape[1:] == (2,)
            return h * 1.0 + s[:, None, :] * 0 + i[:, None, 1:] * w[:, -1:, 1:]
        return predict
    scaling = C.Scaling({"s": (1.0, 2.0), "f": (1.0, 1.0)})
    out = {r.k: r for r in C.score_samples(make(spark), factory, ["k"], PARTS, scaling, carry=["pred"]).collect()}
    assert out[2].init_state.s == 5.0 and len(out[2].pred) == 4
    # window state 5 scales to 2; horizon 1, 2, 3 to 0, 1, 2; the output is an increment, so only times 2
    assert [e.s for e in out[2].pred_res] == [4.0, 6.0, 8.0]


def test_rolling_forecast_feeds_itself(spark):
    def factory():
        return lambda w, h, s, i: w[:, -1:, 1:] + h
    out = C.rolling_forecast(make(spark), factory, 3, ["k"], PARTS).where("k = 1").orderBy("step").collect()
    assert [r.pred_state for r in out] == [5.0, 7.0, 10.0]
    with pytest.raises(ValueError):
        C.rolling_forecast(make(spark), factory, 3, ["k"], C.Parts(["s", "f"], ["f"], ["s"]))


def _field(number, payload):
    """Protobuf field: an int as varint, anything else length-delimited."""
    def varint(v):
        out = b""
        while True:
            out += bytes([v & 127 | (128 if v > 127 else 0)])
            v >>= 7
            if not v:
                return out
    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    payload = payload.encode() if isinstance(payload, str) else payload
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def identity_model(path):
    """ONNX file that returns its `horizon` input."""
    dims = b"".join(_field(1, _field(2, d)) for d in ("b", "s", "f"))
    value = lambda name: _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, dims)))
    node = _field(1, "horizon") + _field(2, "out") + _field(4, "Identity")
    graph = _field(1, node) + _field(2, "g") + _field(11, value("horizon")) + _field(12, value("out"))
    path.write_bytes(_field(1, 8) + _field(7, graph) + _field(8, _field(2, 13)))


def test_onnx_predictor(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    identity_model(tmp_path / "m.onnx")
    out = C.score_samples(make(spark), C.onnx_model(str(tmp_path / "m.onnx"), batch=2), ["k"], PARTS).collect()
    assert len(out) == 5 and all([e.s for e in r.pred_res] == [1.0, 2.0, 3.0] for r in out)


def test_damped_trend_and_persistence():
    w = np.array([[[0.0, 1.0], [0.0, 3.0]]])
    h = np.zeros((1, 3, 1))
    assert C.damped_trend([1], 0.5)()(w, h, None, None).ravel().tolist() == [1.0, 0.5, 0.25]
    assert C.persistence(2)()(w, h, None, None).shape == (1, 3, 2)


# --- streams --------------------------------------------------------------------------------------

def test_stream_merge_is_idempotent(spark, tmp_path):
    m = V.Moments(["k"], {"v": F.col("v")})
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    data = [spark.createDataFrame([(i % 2, float(i + j)) for i in range(10)], "k int, v double") for j in (0, 5)]
    data[0].coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("k int, v double").parquet(source)
    SP.stream_merge(stream(), m, out, log).awaitTermination()
    data[1].coalesce(1).write.mode("append").parquet(source)
    SP.stream_merge(stream(), m, out, log).awaitTermination()
    want = {r.k: (r.n_v, r.mean_v, pytest.approx(r.var_v)) for r in m.finish(m.partial(data[0].unionByName(data[1]))).collect()}
    result = lambda: {r.k: (r.n_v, r.mean_v, r.var_v) for r in m.finish(SP.merged_partials(spark, out, m)).collect()}
    assert result() == want
    # A lost commit makes the last batch run again; it overwrites its own folder.
    commits = sorted((tmp_path / "log" / "commits").glob("[0-9]*"))
    lost = tmp_path / "log2"
    shutil.copytree(tmp_path / "log", lost)
    for f in list((lost / "commits").glob(f"*{commits[-1].name}*")):
        f.unlink()
    SP.stream_merge(stream(), m, out, str(lost)).awaitTermination()
    assert result() == want
    SP.compact_partials(spark, out, m, upto=10)
    assert result() == want and len(list((tmp_path / "out").glob("batch=*"))) == 0


@pytest.mark.parametrize("killed", ["before", "after"])
def test_a_killed_fold_counts_nothing_twice(spark, tmp_path, monkeypatch, killed):
    """A crash before the fold is published, or after it but before the batches are removed; then more batches and another fold."""
    m, source, out, log = V.Moments(["k"], {"v": F.col("v")}), *(str(tmp_path / n) for n in ("in", "out", "log"))
    rows = []

    def add(n):
        for _ in range(n):
            rows.append([(i % 2, float(i + len(rows))) for i in range(6)])
            spark.createDataFrame(rows[-1], "k int, v double").coalesce(1).write.mode("append").parquet(source)
            SP.stream_merge(spark.readStream.schema("k int, v double").parquet(source), m, out, log).awaitTermination()

    def result():
        return {r.k: (r.n_v, pytest.approx(r.mean_v), pytest.approx(r.var_v)) for r in m.finish(SP.merged_partials(spark, out, m)).collect()}

    def right():
        every = spark.createDataFrame([r for part in rows for r in part], "k int, v double")
        return {r.k: (r.n_v, r.mean_v, r.var_v) for r in m.finish(m.partial(every)).collect()}
    add(3)
    where, name = (SP.published, "publish") if killed == "before" else (SP, "_drop_folder")
    real = getattr(where, name)
    monkeypatch.setattr(where, name, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        SP.compact_partials(spark, out, m, upto=1)
    monkeypatch.setattr(where, name, real)
    assert result() == right() and len(list((tmp_path / "out").glob("batch=*"))) == 3
    add(1)
    assert result() == right()
    SP.compact_partials(spark, out, m, upto=2)
    assert result() == right() and len(list((tmp_path / "out").glob("batch=*"))) == 1
    SP.compact_partials(spark, out, m, upto=9)
    add(1)
    assert result() == right() and len(list((tmp_path / "out").glob("batch=*"))) == 1


def test_snapshots_keep_the_latest(spark, tmp_path):
    m = V.Moments(["k"], {"v": F.col("v")})
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for j in (0, 1):
        spark.createDataFrame([(1, float(j))], "k int, v double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, v double").parquet(source)
        SP.write_snapshots(SP.stream_error_partials(stream, m), out, log).awaitTermination()
    assert SP.latest_snapshot(spark, out).head().n_v == 2


@pytest.mark.parametrize("kind", ["time", "histogram"])
def test_tallies_replay_and_merge(spark, tmp_path, kind):
    m = V.time_tally() if kind == "time" else V.histogram_tally(("err_state", 0.0, 8.0, 4), ("step", 0.0, 4.0, 2), "err_res", ["feat"])
    schema = "step int, feat string, err_state double, err_res double, t timestamp"
    rows = [(i % 5, "ab"[i % 2], float(i % 7), float(i), datetime(2020, 1, 1 + i % 3, i % 24)) for i in range(40)]
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        SP.stream_merge(stream(), m, out, log).awaitTermination()
    whole = sorted(map(tuple, m.finish(m.partial(spark.createDataFrame(rows, schema))).collect()))
    result = lambda: sorted(map(tuple, m.finish(SP.merged_partials(spark, out, m)).collect()))
    assert result() == whole
    commits = sorted((tmp_path / "log" / "commits").glob("[0-9]*"))
    lost = tmp_path / "log2"
    shutil.copytree(tmp_path / "log", lost)
    for f in list((lost / "commits").glob(f"*{commits[-1].name}*")):
        f.unlink()
    SP.stream_merge(stream(), m, out, str(lost)).awaitTermination()
    assert result() == whole


def test_snapshot_retention(spark, tmp_path):
    m = V.Moments(["k"], {"v": F.col("v")})
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for j in range(4):
        spark.createDataFrame([(1, float(j))], "k int, v double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, v double").parquet(source)
        SP.write_snapshots(SP.stream_error_partials(stream, m), out, log, keep=2).awaitTermination()
    assert SP.latest_snapshot(spark, out).head().n_v == 4 and len(list((tmp_path / "out").glob("batch=*"))) == 2


# --- plans ----------------------------------------------------------------------------------------

def test_monthly_statistics_plan(spark, sf):
    static = fx.static_params(spark, sf)
    out = monthly_statistics.monthly_statistics(fx.dynamic(spark, sf), static, ["tmp", "rsm_10"], bins=16)
    stats = out["stats"].collect()
    assert {r.feat for r in stats} == {"tmp", "rsm_10"} and 3 not in {r.x for r in stats}
    valid = fx.dynamic(spark, sf).where("x <> 3").count()
    assert out["hist"].where("feat = 'rsm_10'").agg(F.sum("n")).head()[0] == valid
    with pytest.raises(UnknownFeature):
        monthly_statistics.monthly_statistics(fx.dynamic(spark, sf), static, ["nothing"])


SPEC = S.SampleSpec(4, 12, ["tmp", "soilm_10"], ["tmp", "spfh", "apcp"], ["soilm_10"], ["elev"], {"int_veg": 14}, separation=16,
                    max_offset=5)


def test_sequence_plan(spark, sf):
    out = sequence_verification.verify_sequences(
        fx.dynamic(spark, sf), fx.static_params(spark, sf), SPEC, C.persistence(1),
        ["horizon", "temporal", "static-combos", "efficiency", "hist-true-pred", "hist-infiltration"], "soilm_10",
        conditions={"horizon_all": ["exists(horizon, s -> s.tmp > 300)"]}, inputs=["apcp"], absolute=True, bins=32)
    horizon = {r.step: r for r in out["horizon"].collect()}
    assert set(horizon) == set(range(1, 13)) and len({r.n_state for r in horizon.values()}) == 1
    assert horizon[1].mean_state == pytest.approx(horizon[1].mean_res)
    n = horizon[1].n_state
    assert out["static-combos"].agg(F.sum("n")).head()[0] == n and out["efficiency"].head().n == n
    assert out["hist-true-pred"].agg(F.sum("n")).head()[0] == 12 * n
    assert {r.b2 for r in out["hist-infiltration"].collect()} == {6}
    with pytest.raises(ValueError):
        evaluators.evaluate(None, ["nothing"], None)


def test_grid_plan_equals_operators(spark, sf):
    rows = fx.dynamic(spark, sf).withColumn("tile", F.when(F.col("x") < 5, "w").otherwise("e")).withColumn("x", F.col("x") % 5)
    tiles = spark.sql("SELECT * FROM VALUES ('w', NULL, NULL, NULL, NULL, 0, 0), ('e', NULL, NULL, 0, 4, 0, 5) "
                      "AS t(tile, y0, y1, x0, x1, off_y, off_x)")
    domain = grid_verification.GridDomain("case", tiles, "2020-02-01 18:00:00", "2021-03-01 00:00:00", 24, fx.STEP_SECONDS)
    spec = S.SampleSpec(3, 12, ["soilm_10"], ["tmp"], ["soilm_10"])
    out = grid_verification.verify_grid(rows, fx.static(spark, sf), domain, spec, C.persistence(1),
                                        ["horizon", "grid-errors", "grid-axes"], "soilm_10")
    errors = out["grid-errors"].collect()
    assert {r.x for r in errors} == {0, 1, 2, 4, 5, 6, 7, 8}
    first = int((26 * 29 + 0) / 29)
    labels = S.grid_sample_rows(fx.dynamic(spark, sf).where("x NOT IN (3, 9)"), 3, 12, 24, first, first + domain.steps)
    want = labels.where("lead >= 1").select("y", "x", "init", "lead").count()
    assert out["horizon"].agg(F.sum("n_state")).head()[0] == want
    assert {r.kept for r in out["grid-axes"].select("kept").distinct().collect()} == set(V.AXIS_SETS)
