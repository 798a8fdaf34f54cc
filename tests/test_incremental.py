"""Recomputing only what changed."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import user_aggregates as U
from gridspark.operators import verification as V
from gridspark.plans import incremental as I
from gridspark.sources import published

EVALUATORS = {
    "horizon": (V.horizon_moments, ["step", "feat"]),
    "temporal": (lambda by: V.time_tally(by=by), ["axis", "bin", "feat"]),
    "ranks": (lambda by: U.StateAggregate([*by, "feat"], U.RankCorrelation("true_res", "pred_res", -40.0, 40.0, 24)), ["feat"]),
}


def rows_of(df):
    names = sorted(df.columns)
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in names)]) for r in df.collect())


@pytest.fixture
def tiles(spark, sf, tmp_path):
    """Error rows in six tile files, in folders by half of the grid, one with a blank and a plus in its name."""
    errors = fx.errors(spark, sf).withColumn("tile", (F.col("x") % 6).cast("int")).cache()
    top = tmp_path / "tiles"

    def put(tile, change=0.0):
        out = tmp_path / f"made-{tile}-{time.time_ns()}"
        errors.where(F.col("tile") == tile).withColumn("err_res", F.col("err_res") + change).drop("tile").coalesce(1).write.parquet(str(out))
        folder = top / f"half={tile % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        name = folder / (f"tile {tile}+a.parquet" if tile == 3 else f"tile-{tile}.parquet")
        shutil.copy(next(out.glob("part-*.parquet")), name)
        return name
    for tile in range(6):
        put(tile)
    yield str(top), put
    errors.unpersist()


def full(spark, top, name):
    make, keys = EVALUATORS[name]
    work = make([])
    return rows_of(work.finish(work.merge(work.partial(spark.read.parquet(top)), by=keys)))


@pytest.mark.parametrize("name", EVALUATORS)
def test_one_changed_tile_is_read(spark, tiles, tmp_path, name):
    top, put = tiles
    make, keys = EVALUATORS[name]
    kept = I.Incremental(spark, top, str(tmp_path / "kept"), make, keys)
    assert len(kept.refresh().read) == 6
    first = full(spark, top, name)
    assert rows_of(kept.totals()) == first
    assert kept.refresh() == I.Refreshed([], [], 6)
    changed = put(2, 5.0)
    os.utime(changed, (time.time() + 10, time.time() + 10))
    # Only that file is in the plan of what is read.
    assert len(kept.scan([f"file:{changed}"]).inputFiles()) == 1
    did = kept.refresh()
    assert [os.path.basename(p) for p in did.read] == ["tile-2.parquet"] and did.kept == 5 and did.dropped == []
    assert rows_of(kept.totals()) == full(spark, top, name)
    assert name == "ranks" or rows_of(kept.totals()) != first
    # Gone and new files.
    os.remove(os.path.join(top, "half=1", "tile 3+a.parquet"))
    assert [os.path.basename(p) for p in kept.refresh().dropped] == ["tile 3+a.parquet"]
    assert rows_of(kept.totals()) == full(spark, top, name)
    put(3)
    assert [os.path.basename(p) for p in kept.refresh().read] == ["tile 3+a.parquet"]
    assert rows_of(kept.totals()) == full(spark, top, name)
    assert kept.compact() == 3 and rows_of(kept.totals()) == full(spark, top, name) and kept.refresh().kept == 6
    assert len(list((tmp_path / "kept" / "runs").iterdir())) == 1


def test_a_killed_refresh_changes_nothing(spark, tiles, tmp_path, monkeypatch):
    top, put = tiles
    make, keys = EVALUATORS["horizon"]
    kept = I.Incremental(spark, top, str(tmp_path / "kept"), make, keys)
    with pytest.raises(published.NotPublished):
        kept.totals()
    kept.refresh()
    before = rows_of(kept.totals())
    os.utime(put(4, 9.0), (time.time() + 10, time.time() + 10))
    real = published.publish
    monkeypatch.setattr(published, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        kept.refresh()
    assert rows_of(kept.totals()) == before
    monkeypatch.setattr(published, "publish", real)
    assert len(kept.refresh().read) == 1 and rows_of(kept.totals()) == full(spark, top, "horizon") != before
