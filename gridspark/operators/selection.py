"""Row selection by surface class, place, time, sample content and catalog entry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import PIXEL
from ..functions import expressions as E


# --- pixels ---------------------------------------------------------------------------------------

def filter_static_all(static: DataFrame, conditions: Sequence[str | Column]) -> DataFrame:
    """Pixels that meet every condition."""
    return static.where(E.all_of(conditions))


def valid_pixels(df: DataFrame, static: DataFrame, keys: Sequence[str] = PIXEL, mask: str = "m_valid") -> DataFrame:
    """Rows of pixels the mask marks as valid."""
    return df.join(static.where(F.col(mask)).select(*keys), list(keys), "left_semi")


def mask_conflicts(masks: DataFrame, keys: Sequence[str] = PIXEL, mask: str = "m_valid", inputs: int | None = None) -> DataFrame:
    """Pixels whose mask differs between inputs; the inputs are uniform if there are none.

    With the number of `inputs`, pixels that one of them does not have are reported too.
    """
    found = masks.groupBy(*keys).agg(F.min(mask).alias("lo"), F.max(mask).alias("hi"), F.count(F.lit(1)).alias("n"))
    differs = F.col("lo") != F.col("hi")
    return found.where(differs if inputs is None else F.coalesce(differs, F.lit(False)) | (F.col("n") < inputs)).select(*keys)


def nearest_pixel(static: DataFrame, at: tuple[float, float], keys: Sequence[str] = PIXEL) -> DataFrame:
    """The pixel closest to a (lat, lon) point; ties go to the first in row-major order."""
    return (
        static.select(*keys, "lat", "lon", E.distance("lat", "lon", at).alias("dist"))
        .orderBy("dist", *keys).limit(1)
    )


def select_domain(static: DataFrame, strategy: str, at: tuple[float, float] | None = None,
                  radius: float | None = None, bbox: tuple[tuple[float, float], tuple[float, float]] | None = None,
                  keys: Sequence[str] = PIXEL) -> DataFrame:
    """Pixels nearest to a point, within a radius in degrees of it, or inside a lat/lon box."""
    if strategy == "point":
        return static.join(nearest_pixel(static, at, keys).select(*keys), list(keys), "left_semi")
    if strategy == "radius":
        return static.where(E.distance("lat", "lon", at) < F.lit(float(radius)))
    if strategy == "bbox":
        (lat0, lat1), (lon0, lon1) = bbox
        return static.where(F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1))
    raise ValueError("strategy must be point, radius or bbox")


def bbox_index_bounds(static: DataFrame, bbox: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """Half-open y and x index range enclosing a lat/lon box."""
    inside = select_domain(static, "bbox", bbox=bbox)
    return inside.agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"),
                      F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def select_pixels(df: DataFrame, pixels: DataFrame, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Rows of the listed pixels."""
    return df.join(pixels.select(*keys), list(keys), "left_semi")


def select_tile_bounds(df: DataFrame, bounds: DataFrame, tile: str = "tile") -> DataFrame:
    """Rows inside the pixel bounds a domain sets for their tile; a null bound is open, ends are exclusive.

    The tile is an equality key, so this is an ordinary hash join with the bounds as an extra condition.
    A tile may carry several boxes; their overlap must not repeat a row, hence the semi join.
    """
    b = bounds.select(F.col(tile).alias("_tile"), "y0", "y1", "x0", "x1")
    inside = (
        (F.col(tile) == F.col("_tile"))
        & (F.col("y") >= F.coalesce("y0", F.lit(0))) & (F.col("x") >= F.coalesce("x0", F.lit(0)))
        & (F.col("y1").isNull() | (F.col("y") < F.col("y1"))) & (F.col("x1").isNull() | (F.col("x") < F.col("x1")))
    )
    return df.join(b, inside, "left_semi")


def grid_subset(df: DataFrame, **coords: int | tuple[int | None, int | None]) -> DataFrame:
    """Subset by coordinate name: a number keeps one index, a pair keeps the half-open range."""
    for name, want in coords.items():
        if isinstance(want, tuple):
            lo, hi = want
            if lo is not None:
                df = df.where(F.col(name) >= lo)
            if hi is not None:
                df = df.where(F.col(name) < hi)
        else:
            df = df.where(F.col(name) == want)
    return df


# --- time -----------------------------------------------------------------------------------------

def time_slice(df: DataFrame, start: str, end: str, t: str = "t", partitioned: bool = False,
               require_bounds: bool = False) -> DataFrame:
    """Rows in [start, end). With `partitioned`, the year and quarter partition columns get the redundant predicate too.

    `require_bounds` makes a bound that is absent from the axis an error when the rows are read.
    """
    t0, t1 = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    out = df
    if partitioned:
        from ..sources.grids import prune_calendar
        out = prune_calendar(out, start, end)
    if require_bounds:
        found = df.where(F.col(t).isin(t0, t1)).agg(F.count_distinct(t).alias("n"))
        checked = F.when(found.scalar() == 2, t0).otherwise(
            F.raise_error(F.lit("time bound not on the axis")).cast("timestamp"))
        return out.where((F.col(t) >= checked) & (F.col(t) < t1))
    return out.where((F.col(t) >= t0) & (F.col(t) < t1))


# --- samples --------------------------------------------------------------------------------------

def filter_samples(samples: DataFrame, static_any: Sequence[str] = (), horizon_all: Sequence[str] = (),
                   pred_all: Sequence[str] = ()) -> DataFrame:
    """Samples that meet one of the static conditions and all horizon and label conditions.

    Horizon and label conditions are SQL over the array columns, mostly `exists(horizon, s -> ...)`.
    """
    return samples.where(E.any_of(static_any) & E.all_of(horizon_all) & E.all_of(pred_all))


# --- fixed values: canned conditions and their thresholds. `horizon` elements carry tmp and spfh, `pred` elements the relative moisture `state`.
SAMPLE_EVENTS = {
    "freeze": "exists(horizon, s -> s.tmp > 270 AND s.tmp < 276 AND s.spfh > 0.003D AND s.spfh < 0.006D)",
    "hot": "exists(horizon, s -> s.tmp > 300 AND s.tmp < 310 AND s.spfh > 0.02D AND s.spfh < 0.03D)",
    "wet_rain": "exists(zip_with(slice(pred, 1, size(pred) - 1), slice(pred, 2, size(pred) - 1), "
                "(a, b) -> named_struct('s', a.state, 'd', b.state - a.state)), "
                "p -> p.s > 0.85D AND p.s < 0.95D AND p.d > 0.075D AND p.d < 0.25D)",
    "sandy": "pct_sand > 0.55D",
    "silty": "pct_silt > 0.35D",
    "clayey": "pct_clay > 0.3D",
}


def sample_events(samples: DataFrame, event: str) -> DataFrame:
    """Samples in which a canned event happens; `texture` takes any of the three textures."""
    if event == "texture":
        return samples.where(E.any_of([SAMPLE_EVENTS[k] for k in ("sandy", "silty", "clayey")]))
    return samples.where(F.expr(SAMPLE_EVENTS[event]))


def flag_events(samples: DataFrame, events: Iterable[str]) -> DataFrame:
    """One Boolean column per canned event."""
    return samples.withColumns({e: F.expr(SAMPLE_EVENTS[e]) for e in events})


# --- features and series --------------------------------------------------------------------------

def add_feature(df: DataFrame, other: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Add a column held in another table with the same coordinates; the keys must match one to one.

    A duplicate name is an error at once. A key missing on either side or repeated in `other` is an error
    when the rows are read.
    """
    if name in df.columns:
        raise ValueError(f"feature {name} exists already")
    keys = list(keys)
    right = other.groupBy(*keys).agg(F.first(name).alias(name), F.count(F.lit(1)).alias("_copies"))
    joined = df.withColumn("_left", F.lit(True)).join(right, keys, "full_outer")
    aligned = F.col("_left") & (F.col("_copies") == 1)
    checked = F.when(aligned, F.col(name)).otherwise(
        F.raise_error(F.lit(f"coordinates of {name} do not match")).cast(other.schema[name].dataType))
    return joined.withColumn(name, checked).drop("_left", "_copies")


def series_search(catalog: DataFrame, flabel: str | None = None, mlabel: str | None = None,
                  time_range: tuple[str, str] | None = None, yrange: tuple[int, int] | None = None,
                  xrange: tuple[int, int] | None = None, static: DataFrame | None = None,
                  static_equal: Mapping[str, object] | None = None, group_pixels: bool = False) -> DataFrame:
    """Search a catalog of series (flabel, mlabel, y, x, t0, dt seconds, size); all limits are inclusive.

    With `group_pixels`, one row per pixel with its series. The catalog holds a handful of series for each
    pixel, so the list stays small; the values are not carried along.
    """
    out = catalog
    if flabel is not None:
        out = out.where(F.col("flabel") == flabel)
    if mlabel is not None:
        out = out.where(F.col("mlabel") == mlabel)
    if time_range is not None:
        lo, hi = (F.unix_timestamp(F.lit(b).cast("timestamp")) for b in time_range)
        begin = F.unix_timestamp("t0")
        out = out.where((begin <= lo) & (begin + F.col("dt").cast("bigint") * F.col("size") >= hi))
    for name, limits in (("y", yrange), ("x", xrange)):
        if limits is not None:
            out = out.where(F.col(name).between(*limits))
    usable = {k: v for k, v in (static_equal or {}).items() if static is not None and k in static.columns}
    if usable:
        chosen = static.where(E.all_of([F.col(k) == F.lit(v) for k, v in usable.items()]))
        out = out.join(chosen.select(*PIXEL), list(PIXEL), "left_semi")
    if group_pixels:
        entry = F.struct("flabel", "mlabel", "t0", "dt", "size")
        out = out.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(entry)).alias("series"))
    return out


def drop_bad_series(df: DataFrame, feat: str, limit: float, fill: float = 9999.0, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Drop the series of pixels that hold nothing but fill, or any value above the plausible limit.

    The list of bad pixels comes from an aggregate by pixel, a layout that adaptive execution would keep for the join and not
    split. It is dealt anew, so the join gets exchanges of its own and a hot pixel is split by its size.
    """
    v = F.col(feat)
    only_fill = F.count_if(v != F.lit(fill)) == 0
    implausible = F.count_if((v > F.lit(limit)) & (v != F.lit(fill))) > 0
    bad = df.groupBy(*keys).agg((only_fill | implausible).alias("_bad")).where("_bad").select(*keys)
    return df.join(bad.hint("rebalance"), list(keys), "left_anti")


# --- top-k and order ------------------------------------------------------------------------------

def top_class_combos(counts: DataFrame, k: int, count: str = "n", ties: Sequence[str] = ()) -> DataFrame:
    """The k largest class combinations."""
    return counts.orderBy(F.desc(count), *ties).limit(k)


def limit_per_block(df: DataFrame, block: Sequence[str], k: int, seed: int | str, keys: Sequence[str]) -> DataFrame:
    """At most k rows of each block, chosen by a reproducible hash.

    Rows are counted by hash prefix; prefixes that begin past the k-th row are dropped before anything is ranked, and the
    others are ranked prefix by prefix, so no block is ranked in one task, whatever k is.
    """
    hashed = df.withColumn("_h", E.hash_order(seed, *keys)).withColumn("_prefix", F.substring("_h", 1, 3))
    earlier = Window.partitionBy(*block).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*block, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    begun = counts.select(*block, "_prefix", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).where(F.col("_before") < k)
    inside = Window.partitionBy(*block, "_prefix").orderBy("_h", *keys)
    ranked = hashed.join(begun, [*block, "_prefix"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside))
    return ranked.where(F.col("_rank") <= k).select(*df.columns)


def shuffle_samples(df: DataFrame, seed: int | str, keys: Sequence[str]) -> DataFrame:
    """Reproducible global shuffle: a range-partitioned sort by hash."""
    return df.withColumn("_h", E.hash_order(seed, *keys)).orderBy("_h", *keys).drop("_h")


def chrono_sort(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)
