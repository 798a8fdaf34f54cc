"""Tile files chosen by their names before they are opened."""

import shutil

import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.sources import archive as A


@pytest.fixture(scope="module")
def tiles(spark, sf, tmp_path_factory):
    """Two boxes over six quarters, a file each, in folders by year, next to files that are no tiles."""
    top = tmp_path_factory.mktemp("archive")
    rows = fx.dynamic(spark, sf).select("y", "x", "t", "tmp").withColumns({"_y": F.year("t"), "_q": F.quarter("t"), "_b": (F.col("x") >= 5).cast("int")}).cache()
    written = {}
    for r in rows.select("_y", "_q", "_b").distinct().where("_y < 2022").collect():
        part = rows.where((F.col("_y") == r._y) & (F.col("_q") == r._q) & (F.col("_b") == r._b)).select("y", "x", "t", "tmp")
        out = top / f"made-{r._y}-{r._q}-{r._b}"
        part.coalesce(1).write.parquet(str(out))
        folder = top / "in" / str(r._y)
        folder.mkdir(parents=True, exist_ok=True)
        name = folder / f"timegrid_{r._y}q{r._q}_y000-098_x{5 * r._b:03d}-{5 * r._b + 4:03d}.parquet"
        shutil.copy(next(out.glob("part-*.parquet")), name)
        written[r._y, r._q, r._b] = part.count()
    shutil.copy(name, top / "in" / "notes.parquet")
    yield str(top / "in"), written
    rows.unpersist()


def test_a_quarter_opens_its_files(spark, tiles):
    path, written = tiles
    df = A.scan_archive(spark, path, "year = 2020 AND quarter = 3")
    assert len(df.inputFiles()) == 2 and all("2020q3" in f for f in df.inputFiles())
    assert df.count() == written[2020, 3, 0] + written[2020, 3, 1]
    assert {(r.year, r.quarter) for r in df.select("year", "quarter").distinct().collect()} == {(2020, 3)}
    box = A.scan_archive(spark, path, (F.col("x0") >= 5) & (F.col("year") == 2021), feats=["tmp", "t"])
    assert len(box.inputFiles()) == sum(k[0] == 2021 and k[2] == 1 for k in written) and box.columns == ["tmp", "t", *A.FIELDS]
    assert box.count() == sum(n for k, n in written.items() if k[0] == 2021 and k[2] == 1)
    plan = box.where("tmp > 280")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tmp), GreaterThan(tmp,280.0)]" in plan and "y:int" not in plan.split("ReadSchema")[1]


def test_whole_archive_and_names(spark, tiles):
    path, written = tiles
    assert A.scan_archive(spark, path).count() == sum(written.values())
    files = A.tile_files(spark, path).collect()
    assert len(files) == len(written) + 1 and sum(f.year is None for f in files) == 1
    with pytest.raises(A.NoTiles):
        A.scan_archive(spark, path, "year = 1999")
