"""Reading and arranging gridded tables: scans, records, masks, cropping, tiles, partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import PIXEL, vocab
from ..functions import expressions as E
from ..functions.features import UnknownFeature


def scan_dynamic(spark: SparkSession, path: str, feats: Sequence[str], keys: Sequence[str] = ("tile", *PIXEL, "t"),
                 tiles: Sequence[str] | None = None, period: tuple[str, str] | None = None, fill: float | None = None,
                 t: str = "t") -> DataFrame:
    """Pixel-hour rows of the features needed; tile, year and quarter reach the reader as partition filters."""
    df = spark.read.parquet(path)
    missing = [c for c in (*keys, *feats) if c not in df.columns]
    if missing:
        raise UnknownFeature(f"not stored: {missing}")
    if tiles is not None:
        df = df.where(F.col("tile").isin(*tiles))
    if period is not None:
        lo, hi = (F.lit(b).cast("timestamp") for b in period)
        df = df.where((F.col(t) >= lo) & (F.col(t) < hi))
        df = prune_calendar(df, *period)
    out = df.select(*keys, *feats)
    return unfill(out, feats, fill) if fill is not None else out


def prune_calendar(df: DataFrame, start: str, end: str) -> DataFrame:
    """The redundant predicate on the partition columns `year` and, if there is one, `quarter` for times in [start, end)."""
    if "year" not in df.columns:
        return df
    years = int(start[:4]), int(end[:4])
    out = df.where(F.col("year").between(*years))
    if "quarter" not in df.columns:
        return out
    first, last = (4 * int(b[:4]) + (int(b[5:7] or 1) - 1) // 3 for b in (start, end))
    # Written as comparisons of the two columns, so that the reader can prune partitions by them.
    return out.where((F.col("year") * 4 + F.col("quarter") - 1).between(first, last))


def scan_static(spark: SparkSession, path: str, feats: Sequence[str] | None = None, keys: Sequence[str] = PIXEL
                ) -> DataFrame:
    """Static grid; masks stored as 0/1 numbers come back as Booleans."""
    df = spark.read.parquet(path)
    if feats is not None:
        df = df.select(*keys, *feats)
    masks = [f.name for f in df.schema if f.name.startswith("m_") and f.dataType.simpleString() != "boolean"]
    return df.withColumns({m: F.col(m) != 0 for m in masks}) if masks else df


def record_map(df: DataFrame, mapping: Mapping[int, str], keys: Sequence[str] = (*PIXEL, "t"), record: str = "record",
               value: str = "value") -> DataFrame:
    """Rows of (keys, record number, value) -> one labelled column per mapped record, in mapping order."""
    wanted = df.where(F.col(record).isin(*mapping))
    picks = [F.first(F.when(F.col(record) == number, F.col(value)), ignorenulls=True).alias(label)
             for number, label in mapping.items()]
    return wanted.groupBy(*keys).agg(*picks)


def mask_fill(df: DataFrame, mask: str | Column, feats: Sequence[str], fill: float = vocab.FILL) -> DataFrame:
    """Write the fill value where the mask is not set."""
    return df.withColumns({f: F.when(E.col(mask), F.col(f)).otherwise(F.lit(fill)) for f in feats})


def unfill(df: DataFrame, feats: Sequence[str], fill: float = vocab.FILL) -> DataFrame:
    """Fill value and NaN -> null."""
    return df.withColumns({f: F.nullif(F.nanvl(F.col(f).cast("double"), F.lit(float(fill))), F.lit(float(fill)))
                           for f in feats})


def crop_flip(df: DataFrame, crop_y: tuple[int, int], crop_x: tuple[int, int], height: int, width: int) -> DataFrame:
    """Cut margins off a height x width grid, then turn the vertical axis around."""
    (y0, y1), (x0, x1) = crop_y, crop_x
    rows = height - y0 - y1
    return (
        df.where(F.col("y").between(y0, height - y1 - 1) & F.col("x").between(x0, width - x1 - 1))
        .withColumns({"y": (F.lit(rows - 1) - (F.col("y") - y0)).cast("int"), "x": (F.col("x") - x0).cast("int")})
    )


def assign_tiles(df: DataFrame, ny: int, nx: int, height: int, width: int) -> DataFrame:
    """Regular tiles with a smaller last one where the grid does not divide; adds tile and its local indices."""
    ty, tx = F.floor(F.col("y") / ny), F.floor(F.col("x") / nx)
    def span(name, index, size, total):
        return F.format_string(f"{name}%03d-%03d", index * size, F.least((index + 1) * size, F.lit(total)))
    return df.withColumns({
        "tile": F.concat_ws("_", span("y", ty, ny, height), span("x", tx, nx, width)),
        "tile_y": (F.col("y") - ty * ny).cast("int"), "tile_x": (F.col("x") - tx * nx).cast("int")})


def parse_tile_path(df: DataFrame, path: str | Column = "path") -> DataFrame:
    """Year, quarter and pixel bounds from names like timegrid_2018q3_y000-098_x154-308."""
    pattern = r"([^/_]+)_(\d{4})q(\d)_y(\d+)-(\d+)_x(\d+)-(\d+)"
    part = lambda i: F.regexp_extract(E.col(path), pattern, i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("int")
    return df.withColumns({"year": number(2), "quarter": number(3), "y0": number(4), "y1": number(5),
                           "x0": number(6), "x1": number(7)})


def with_calendar(df: DataFrame, t: str = "t") -> DataFrame:
    """Partition columns of the pixel-hour table."""
    return df.withColumns({"year": F.year(t), "quarter": F.quarter(t)})


def select_partitions(df: DataFrame, regions: Sequence[str] | None = None, seasons: Sequence[str] | None = None,
                      years: tuple[int, int] | None = None, region: str = "region") -> DataFrame:
    """Blocks of the regions, season groups (quarters 1, 4 cold; 2, 3 warm) and half-open year range asked for.

    All three test partition columns, so unwanted files are never opened.
    """
    if regions is not None:
        df = df.where(F.col(region).isin(*regions))
    if seasons is not None:
        quarters = sorted({q for s in seasons for q in {"cold": (1, 4), "warm": (2, 3)}[s]})
        df = df.where(F.col("quarter").isin(*quarters))
    if years is not None:
        df = df.where(F.col("year").between(years[0], years[1] - 1))
    return df
