"""Event-time frames with late rows, and predictions joined with truth as both arrive."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import statistics as ST
from gridspark.operators import verification as V
from gridspark.streaming import frames as SF
from gridspark.streaming import partials as SP
from gridspark.streaming import truth_join as TJ

ROWS = "y int, x int, step long, t timestamp, tmp double, apcp double"
FEATS = ["tmp", "apcp"]
ORIGIN = datetime(2020, 1, 1, 5)
HOUR = 3600


def row(y, step, value):
    return (y, 0, step, ORIGIN + timedelta(hours=step), float(value), float(value % 3))


def write_parts(spark, parts, schema, path):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def run_frames(spark, tmp_path, source, delay="6 hours", n=4, tag=""):
    stream = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    out, came = str(tmp_path / f"frames{tag}"), str(tmp_path / f"came{tag}")
    options = dict(origin=str(ORIGIN))
    frames = SF.stream_frames(stream(), n, FEATS, HOUR, delay, **options)
    SF.write_frames(frames, out, str(tmp_path / f"log-frames{tag}")).awaitTermination()
    SF.count_arrivals(stream(), n, HOUR, came, str(tmp_path / f"log-came{tag}"), **options).awaitTermination()
    return out, came


def long_rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_shuffled_and_late_rows(spark, tmp_path):
    """Rows up to the delay out of order are framed as in the batch; rows for periods that are out change nothing and are counted."""
    dice = random.Random(7)
    rows = [row(y, s, (7 * s + y) % 11) for s in range(120) for y in range(3)]
    rows.sort(key=lambda r: r[2] + dice.uniform(0, 5))
    # Far behind the last of these parts: rows of y=1 for periods long out, one of a period never seen, one without a time.
    late = [row(1, 8, 5), row(1, 9, 5), row(2, 8, 5), row(7, 20, 5), (1, 0, 3, None, 1.0, 1.0)]
    parts = [rows[i:i + 60] for i in range(0, 300, 60)] + [rows[300:330] + late, rows[330:]]
    source = str(tmp_path / "in")
    write_parts(spark, parts, ROWS, source)
    out, came = run_frames(spark, tmp_path, source)
    published = SF.published(spark, out)
    newest = published.agg(F.max("period")).first()[0]
    assert newest >= 25
    batch = ST.period_frames(spark.createDataFrame(rows, ROWS), 4, FEATS).where(F.col("period") <= newest)
    assert long_rows(SF.whole_frames(published, FEATS)) == long_rows(batch)
    assert published.count() == published.select("y", "x", "period").distinct().count()
    got = {(r.y, r.period): (r.arrived, r.framed, r.late) for r in SF.late_rows(spark, came, out).collect()}
    assert got == {(1, 2): (6, 4, 2), (2, 2): (5, 4, 1), (7, 5): (1, 0, 1), (1, None): (1, 0, 1)}


def test_gaps_and_repeats_are_not_whole(spark, tmp_path):
    rows = [row(0, s, s) for s in range(40) if s != 9] + [row(0, 14, 3)]
    rows.sort(key=lambda r: r[2])
    source = str(tmp_path / "in")
    write_parts(spark, [rows[:20], rows[20:]], ROWS, source)
    out, _ = run_frames(spark, tmp_path, source)
    told = {r.period: (r.n, r.whole) for r in SF.published(spark, out).collect()}
    assert told[2] == (3, False) and told[3] == (5, False) and told[4] == (4, True)
    assert {r.period for r in SF.whole_frames(SF.published(spark, out), FEATS).collect()} == {p for p, (_, w) in told.items() if w}


def test_frames_survive_a_replay(spark, tmp_path):
    """Stopped half way, gone on with more files, and with a lost commit: the same frames and the same late rows."""
    rows = [row(y, s, (5 * s + y) % 13) for s in range(80) for y in range(2)]
    source = str(tmp_path / "in")
    write_parts(spark, [rows[:60]], ROWS, source)
    run_frames(spark, tmp_path, source)
    write_parts(spark, [rows[60:100] + [row(0, 1, 1)], rows[100:]], ROWS, source)
    out, came = run_frames(spark, tmp_path, source)
    want = long_rows(SF.published(spark, out).drop("t_start", "t_end")), long_rows(SF.late_rows(spark, came, out))
    assert want[0] and want[1]
    for log in ("log-frames", "log-came"):
        commits = sorted((tmp_path / log / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
        shutil.copytree(tmp_path / log, tmp_path / f"{log}-lost")
        for f in (tmp_path / f"{log}-lost" / "commits").glob(f"*{commits[-1].name}*"):
            f.unlink()
        shutil.copytree(tmp_path / {"log-frames": "frames", "log-came": "came"}[log], tmp_path / {"log-frames": "frames-lost", "log-came": "came-lost"}[log])
    out, came = run_frames(spark, tmp_path, source, tag="-lost")
    assert (long_rows(SF.published(spark, out).drop("t_start", "t_end")), long_rows(SF.late_rows(spark, came, out))) == want


@pytest.mark.parametrize("n", [1, 24, 63, 64, 150, 2000])
def test_masks_tell_whole_periods(spark, n):
    """Periods of one mask, several, and so many steps that a set is kept."""
    steps = [s for s in range(3 * n) if s != n + n // 2] + [2 * n]
    df = spark.createDataFrame([(0, 0, s, ORIGIN + timedelta(hours=s), float(s), 0.0) for s in steps], ROWS)
    out = ST.period_frames(df, n, ["tmp"]).collect()
    assert [(r.period, r.n) for r in out] == [(0, n)]


# --- predictions and truth ------------------------------------------------------------------------

SAID = "y int, x int, init int, issued timestamp, step int, feat string, t timestamp, pred_res double, pred_state double"
SEEN = "y int, x int, feat string, t timestamp, true_prev double, true_state double"
HORIZON = 6


def forecasts(days):
    """Hourly truth of two pixels and a forecast of six steps every six hours."""
    truth = [(y, 0, "a", ORIGIN + timedelta(hours=s), float((3 * s + y) % 17), float((3 * s + 3 + y) % 17))
             for s in range(1, 24 * days + 1) for y in range(2)]
    said = [(y, 0, i, ORIGIN + timedelta(hours=HORIZON * i), k, "a", ORIGIN + timedelta(hours=HORIZON * i + k), 0.5 * k, float(i % 5 + k))
            for i in range(24 * days // HORIZON) for k in range(1, HORIZON + 1) for y in range(2)]
    return said, truth


def streams(spark, tmp_path, said, truth, parts):
    paths = str(tmp_path / "said"), str(tmp_path / "seen")
    cut = lambda rows: [rows[i * len(rows) // parts:(i + 1) * len(rows) // parts] for i in range(parts)]
    write_parts(spark, cut(said), SAID, paths[0])
    write_parts(spark, cut(truth), SEEN, paths[1])
    return [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p) for s, p in zip((SAID, SEEN), paths)]


def test_partials_of_two_streams_equal_the_batch(spark, tmp_path):
    said, truth = forecasts(6)
    m = V.horizon_moments()
    batch = TJ.score_arriving(spark.createDataFrame(said, SAID), spark.createDataFrame(truth, SEEN), HORIZON * HOUR, "1 hour")
    assert batch.count() == len(said)
    want = long_rows(m.finish(m.partial(batch)))
    scored = TJ.score_arriving(*streams(spark, tmp_path, said, truth, 6), HORIZON * HOUR, "12 hours")
    out = str(tmp_path / "out")
    query = SP.stream_merge(scored, m, out, str(tmp_path / "log"))
    query.awaitTermination()
    assert long_rows(m.finish(SP.merged_partials(spark, out, m))) == want
    # Rows of the newest part and of the delay and horizon before it: never a sum over the stream's length.
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    a_day = 2 * 24 * 2
    assert len(held) >= 6 and max(held) <= 3 * a_day < len(said) + len(truth)


def test_predictions_without_truth(spark, tmp_path):
    """Those whose truth does not come follow once they expire; the truth of a hot pixel's other times is not taken for it."""
    said, truth = forecasts(4)
    gone = {truth[40][:4], truth[41][:4], truth[75][:4]}
    scored = TJ.score_arriving(*streams(spark, tmp_path, said, [r for r in truth if r[:4] not in gone], 4), HORIZON * HOUR, "1 hour", unmatched=True)
    out = str(tmp_path / "out")
    SP.write_batches(scored, lambda b: b, out, str(tmp_path / "log")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    missing = {(r.y, r.x, r.feat, r.t) for r in rows if r.true_state is None}
    assert missing == gone and all(r.err_state is None and r.err_res is None for r in rows if r.true_state is None)
    known = {r[:4]: r for r in truth}
    for r in rows:
        if r.true_state is not None:
            assert (r.true_prev, r.true_state) == known[r.y, r.x, r.feat, r.t][4:]
            assert r.err_state == pytest.approx(r.pred_state - r.true_state) and r.err_res == pytest.approx(r.pred_res - r.true_res)


def test_the_join_equals_error_by_horizon(spark, sf):
    errors = fx.errors(spark, sf)
    joined = TJ.score_arriving(TJ.issued_predictions(errors, fx.STEP_SECONDS),
                               errors.select("y", "x", "feat", "t", "true_prev", "true_state"), fx.HORIZON * fx.STEP_SECONDS, "1 day")
    m = V.horizon_moments()
    assert long_rows(m.finish(m.partial(joined))) == long_rows(m.finish(m.partial(errors)))


def test_larger_tables_arrive_in_more_ranges_of_several_files(spark, monkeypatch):
    """As many files a trigger as a range has, so a trigger reads one range, and ranges follow each other in time."""
    from gridspark.catalog import streams
    from gridspark.sources.sinks import scratch_dir
    monkeypatch.setattr(streams, "PART_ROWS", 1000)
    monkeypatch.setattr(streams, "FILE_ROWS", 500)
    rows = spark.range(6000).select(F.timestamp_seconds(F.col("id") * 60).alias("t"), "id")
    seen, where = [], scratch_dir(spark, "arriving-state")

    def look(batch, _):
        seen.append(batch.agg(F.min("id"), F.max("id"), F.count("id")).first())
    streams.arriving(rows, "t", "arriving-test").writeStream.foreachBatch(look).option(
        "checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 6 and sum(n for _, _, n in seen) == 6000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_blocks_give_the_rows_of_the_join(spark):
    """Missing and repeated truth, repeated predictions, null keys, times and values, other columns, times before 1970."""
    said, truth = forecasts(4)
    back = lambda r, at: (*r[:at], r[at] - timedelta(days=20_000), *r[at + 1:])
    said = said[::2] + said[:40] + [back(back(r, 3), 6) for r in said[:60]] + [
        (None, 0, 1, ORIGIN, 1, "a", ORIGIN, 1.0, 1.0), (0, 0, 1, ORIGIN, 1, "a", None, 1.0, 1.0), (0, 0, 1, None, 1, "a", ORIGIN, 1.0, 1.0),
        (0, 0, 1, ORIGIN, 1, None, ORIGIN + timedelta(hours=1), 1.0, 1.0), (0, 0, None, ORIGIN, 1, "a", ORIGIN + timedelta(hours=1), None, 1.0),
        (0, 0, 1, ORIGIN, 9, "a", ORIGIN + timedelta(hours=9), 1.0, 1.0), (0, 0, 1, ORIGIN, 0, "a", ORIGIN - timedelta(hours=1), 1.0, 1.0)]
    truth = [t for t in truth if t[3].hour % 5] + truth[:50] + [back(t, 3) for t in truth[:30]] + [
        (None, 0, "a", ORIGIN, 1.0, 1.0), (0, 0, "a", ORIGIN - timedelta(hours=1), 1.0, None), (0, 0, "a", None, 1.0, 1.0)]
    said = spark.createDataFrame(said, SAID)
    seen = spark.createDataFrame(truth, SEEN).withColumn("more", F.struct(F.array("true_prev", "y").alias("a"), F.col("feat").alias("b")))
    rows = lambda **kw: sorted(map(str, TJ.score_arriving(said, seen, HORIZON * HOUR, "1 hour", carry=["more"], **kw).collect()))
    want = rows()
    assert len(want) > 200
    for hours in (1, 5, 6, 100):
        assert rows(block_seconds=hours * HOUR) == want
    with pytest.raises(ValueError, match="no truth"):
        rows(block_seconds=HOUR, unmatched=True)


def test_packs_are_bounded_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(TJ, "PACK_ROWS", 70)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
        out = TJ.packed(rows, ["k"], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    assert max(len(r.v) for r in out) < 100 and all(v % 3 == r.k for r in out for v in r.v)
    assert sorted(v for r in out for v in r.v) == list(range(5000))


def test_blocks_of_two_streams_wait_in_few_rows(spark, tmp_path):
    """The partials of the batch from a state that counts blocks, not rows; it expires."""
    said, truth = forecasts(12)
    m = V.horizon_moments()
    batch = TJ.score_arriving(spark.createDataFrame(said, SAID), spark.createDataFrame(truth, SEEN), HORIZON * HOUR, "1 hour")
    scored = TJ.score_arriving(*streams(spark, tmp_path, said, truth, 6), HORIZON * HOUR, "12 hours", block_seconds=HORIZON * HOUR)
    out = str(tmp_path / "out")
    query = SP.stream_merge(scored, m, out, str(tmp_path / "log"))
    query.awaitTermination()
    rounded = lambda rows: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in long_rows(m.finish(rows))]
    assert rounded(SP.merged_partials(spark, out, m)) == rounded(m.partial(batch))
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    # Two pixels, a block a quarter of a day; at most two days, the delay, the horizon and a block wait, on each side in two rows a block.
    assert len(held) >= 6 and max(held) <= 2 * 2 * 2 * 4 * 3 < (len(said) + len(truth)) / 10


def test_error_by_horizon_of_streams_keeps_blocks(spark, sf, monkeypatch):
    """The registered query keeps less than a quarter of the rows that come in any of its triggers."""
    import __spark_entry__
    queries, merge = [], SP.stream_merge
    monkeypatch.setattr(SP, "stream_merge", lambda *a: queries.append(merge(*a)) or queries[0])
    assert __spark_entry__.queries()["c3_stream_join_truth"](spark, sf).count() == 48
    told = [p for p in queries[0].recentProgress if p["stateOperators"]]
    assert max(o["numRowsTotal"] for p in told for o in p["stateOperators"]) < max(p["numInputRows"] for p in told) / 4


@pytest.mark.parametrize("kept", [True, False])
def test_ranges_are_written_in_one_pass(spark, monkeypatch, kept):
    """Not a pass over the table for each range; where a file system keeps no times, another over the written files."""
    from pyspark.sql import DataFrameWriter

    from gridspark.catalog import streams
    from gridspark.sources.sinks import scratch_dir
    monkeypatch.setattr(streams, "PART_ROWS", 1000)
    monkeypatch.setattr(streams, "FILE_ROWS", 500)
    if not kept:
        monkeypatch.setattr(streams, "in_order", lambda *_: False)
    writes, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: writes.append(path) or write(self, path, *a, **k))
    rows = spark.range(20_000).select(F.timestamp_seconds(F.col("id") * 7919 % 20_011).alias("t"), "id")
    stream = streams.arriving(rows, "t", "arriving-test")
    assert len(writes) == (1 if kept else 21)
    seen = []
    stream.writeStream.foreachBatch(lambda b, _: seen.append(b.agg(F.min("t"), F.max("t"), F.count("id")).first())).option(
        "checkpointLocation", scratch_dir(spark, "arriving-state")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 20 and sum(n for _, _, n in seen) == 20_000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_ranges_stay_bounded_where_times_are_few(spark, monkeypatch):
    """Three times of 20,000 rows, no rows at all: triggers of some 1,000 rows in the order of time, and nothing is lost."""
    from gridspark.catalog import streams
    from gridspark.sources.sinks import scratch_dir
    monkeypatch.setattr(streams, "PART_ROWS", 1000)
    monkeypatch.setattr(streams, "FILE_ROWS", 500)
    rows = spark.range(20_000).select(F.timestamp_seconds(F.col("id") % 3).alias("t"), "id")
    for table, n in ((rows, 20_000), (rows.where("id < 0"), 0)):
        seen = []
        streams.arriving(table, "t", "arriving-test").writeStream.foreachBatch(
            lambda b, _: seen.append(b.agg(F.min("t"), F.max("t"), F.count("id")).first())).option(  # noqa: B023
            "checkpointLocation", scratch_dir(spark, "arriving-state")).trigger(availableNow=True).start().awaitTermination()
        assert sum(k for _, _, k in seen) == n and (not n or len(seen) == 20 and max(k for _, _, k in seen) < 2000)
        assert all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))
