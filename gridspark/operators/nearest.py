"""The nearest pixel of many points at once: a grid of cells, searched in growing rings.

Pixels and points are put in square cells. A point looks at the pixels of its own cell and the rings around it, which is a join on
the cell. What it finds is the nearest for sure if it is no farther than the edge of the square it has searched; otherwise the
point goes on with a square of twice the width. Points that share a place are searched once. Nothing is compared with
everything: a point meets the pixels of a few cells, and there are about as many cells as pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import PIXEL
from ..session import cut_lineage

#: Pixels a cell holds on the average.
PER_CELL = 4


def _cell(value: Column, low: float, size: float) -> Column:
    return F.floor((value - F.lit(low)) / F.lit(size))


def cell_size(pixels: DataFrame, per_cell: int = PER_CELL) -> tuple[float, float, float, float, float] | None:
    """Width of a cell and the box of all pixels (lat and lon from, lat and lon to); None without pixels."""
    b = pixels.agg(F.min("lat").alias("a0"), F.max("lat").alias("a1"), F.min("lon").alias("o0"), F.max("lon").alias("o1"),
                   F.count(F.lit(1)).alias("n")).first()
    if not b.n:
        return None
    high, wide = b.a1 - b.a0, b.o1 - b.o0
    # A line of pixels has no area; then cells go along it.
    size = (high * wide * per_cell / b.n) ** 0.5 or max(high, wide) * per_cell / b.n or 1.0
    return size, b.a0, b.o0, b.a1, b.o1


def nearest_pixels(pixels: DataFrame, points: DataFrame, keys: Sequence[str] = PIXEL, per_cell: int = PER_CELL) -> DataFrame:
    """Each row of `points` (lat, lon and any other columns) with its nearest pixel: keys, pixel_lat, pixel_lon, dist.

    Distances are in degrees, as in `selection.nearest_pixel`; ties go to the first in the order of the keys. Points and pixels
    with a null or NaN coordinate have no pixel and are none. Points may lie far outside the pixels' box.
    """
    there = pixels.where(_known("lat", "lon")).select(*keys, F.col("lat").cast("double").alias("pixel_lat"), F.col("lon").cast("double").alias("pixel_lon"))
    box = cell_size(there.select(F.col("pixel_lat").alias("lat"), F.col("pixel_lon").alias("lon")), per_cell)
    places = points.where(_known("lat", "lon")).select(F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon")).distinct()
    found = there.limit(0).select(F.lit(0.0).alias("_lat"), F.lit(0.0).alias("_lon"), *keys, "pixel_lat", "pixel_lon", F.lit(0.0).alias("dist"))
    if box is not None:
        found = _search(there, places, keys, *box)
    same = F.col("lat").cast("double").eqNullSafe(F.col("_lat")) & F.col("lon").cast("double").eqNullSafe(F.col("_lon"))
    clash = [c for c in (*keys, "pixel_lat", "pixel_lon", "dist") if c in points.columns]
    return points.drop(*clash).join(found, same, "left").drop("_lat", "_lon")


def _known(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
    return out


def _search(there: DataFrame, places: DataFrame, keys: Sequence[str], size: float, a0: float, o0: float, a1: float, o1: float) -> DataFrame:
    cells = cut_lineage(there.withColumns({"_a": _cell(F.col("pixel_lat"), a0, size), "_o": _cell(F.col("pixel_lon"), o0, size)}))
    # A place outside the box begins at the cell of the box next to it.
    lat, lon = (F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, lo, hi in (("_lat", a0, a1), ("_lon", o0, o1)))
    left = cut_lineage(places.withColumns({"_pa": _cell(lat, a0, size), "_po": _cell(lon, o0, size)}))
    out, radius, widest = None, 1, max(a1 - a0, o1 - o0) / size + 1
    while True:
        def span(c: str, limit: float) -> Column:
            last = F.floor(F.lit(limit / size))
            return F.sequence(F.greatest(F.col(c) - radius, F.lit(0).cast("bigint")), F.least(F.col(c) + radius, last))
        around = left.withColumn("_a", F.explode(span("_pa", a1 - a0))).withColumn("_o", F.explode(span("_po", o1 - o0)))
        near = around.join(cells, ["_a", "_o"])
        dist = F.sqrt((F.col("pixel_lat") - F.col("_lat")) * (F.col("pixel_lat") - F.col("_lat"))
                      + (F.col("pixel_lon") - F.col("_lon")) * (F.col("pixel_lon") - F.col("_lon")))
        best = near.groupBy("_lat", "_lon").agg(F.min(F.struct(dist.alias("dist"), *keys, "pixel_lat", "pixel_lon")).alias("_best"))
        # Nothing outside the searched square is nearer than its edge; sides at the end of the box have nothing behind them.
        edges = []
        for place, cell, low, high in (("_lat", "_pa", a0, a1), ("_lon", "_po", o0, o1)):
            below = F.lit(low) + (F.col(cell) - radius) * F.lit(size)
            above = F.lit(low) + (F.col(cell) + radius + 1) * F.lit(size)
            edges += [F.when(below <= F.lit(low), F.lit(float("inf"))).otherwise(F.col(place) - below),
                      F.when(above > F.lit(high), F.lit(float("inf"))).otherwise(above - F.col(place))]
        sure = cut_lineage(left.join(best, ["_lat", "_lon"], "left").withColumn(
            "_sure", F.coalesce(F.col("_best.dist") < F.least(*edges), F.lit(False)) if radius <= widest else F.lit(True)))
        done = sure.where("_sure").select("_lat", "_lon", *[F.col(f"_best.{k}").alias(k) for k in keys], "_best.pixel_lat", "_best.pixel_lon", "_best.dist")
        out = done if out is None else out.unionByName(done)
        left = sure.where("NOT _sure").select("_lat", "_lon", "_pa", "_po")
        if left.isEmpty():
            return out
        radius *= 2
