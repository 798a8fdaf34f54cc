"""Quantiles in one pass: mergeable sketches with a stated rank error, and the bounds and histograms they give.

A sketch holds a bounded sample of weighted values, however many it has seen, and sketches of tiles, periods or batches merge into
the sketch of all. The rank it gives for a value is off by at most `rank_error(k)` of all values, in 99 cases of 100; least and
largest value and the number of values are exact. Bounds for histograms come from the one pass that makes the sketches; the counts
within them are then exact, by `statistics.gridhist_monthly` or `counts_within`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import _long

#: Size of a sketch; its error falls nearly as fast as this grows.
K = 400
#: Quantiles that a histogram reads from a sketch; each adds its share to the error.
RUNGS = 2000


def rank_error(k: int = K) -> float:
    """Largest error of a rank as a share of all values, with a probability of 0.99."""
    return 2.296 / k ** 0.9021


def count_error(k: int = K) -> float:
    """The same for the values between two bounds."""
    return 2.446 / k ** 0.9433


def quantile_sketches(df: DataFrame, feats: Sequence[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(by, feat, n, sketch): partials that `merge_sketches` adds. Features are sketched side by side, in one pass.

    Nulls and NaN are left out; a feature without values has n 0 and a null sketch.
    """
    aggs = []
    for f in feats:
        v = F.col(f).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"{f}__n"), F.kll_sketch_agg_double(v, k).alias(f"{f}__sketch")]
    out = _long(df.groupBy(*by).agg(*aggs), by, feats, ["n", "sketch"])
    return out.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merge_sketches(*partials: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Sketches of all rows of partials with the same (by, feat)."""
    rows = reduce(DataFrame.unionByName, partials)
    out = rows.groupBy(*by, "feat").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return out.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def quantile(share: float) -> Column:
    """The value with this share of the values at or below it; 0 and 1 are the least and the largest, exactly."""
    return F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))))


def quantiles(sketches: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """Named quantiles of each sketch."""
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *[quantile(q).alias(n) for n, q in shares.items()])


def proposed_bounds(sketches: DataFrame, outside: float = 0.001) -> dict[str, tuple[float, float]]:
    """Bounds by feature that leave out about this share of the values on either side; 0 takes all.

    One row a feature comes to the driver. A feature of one value alone gets bounds one apart; one without values gets none.
    """
    rows = quantiles(sketches, {"lo": outside, "hi": 1 - outside}).where("lo IS NOT NULL").collect()
    return {r.feat: (r.lo, r.hi if r.hi > r.lo else r.lo + 1.0) for r in rows}


def counts_within(df: DataFrame, bounds: Mapping[str, tuple[float, float]], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Exact counts by (by, feat, bin) within bounds; the end bins say how many were under or over them."""
    from .statistics import _binned
    return _binned(df, by, bounds, bins).groupBy(*by, "feat", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == -1).alias("n_under"), F.count_if(F.col("side") == 1).alias("n_over"))


def sketched_histogram(sketches: DataFrame, bins: int, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Counts by (by, feat, source, bin) from sketches alone, with no further pass: `n_about`, and `n_error`, how far it may be off.

    The range is that of all sources of a feature together, and values go to the nearest of `bins` places on it, as in
    `statistics.range_histogram`. `sketches` has a column source.
    """
    ends = sketches.groupBy(*by, "feat").agg(F.min(quantile(0)).alias("lo"), F.max(quantile(1)).alias("hi"))
    rows = sketches.join(ends, [*by, "feat"]).where("sketch IS NOT NULL AND hi > lo")
    # The sketch is read as a ladder of quantiles: the rank of an edge is the share of its rungs at or below it.
    ladder = F.kll_sketch_get_quantile_double("sketch", F.lit([i / RUNGS for i in range(RUNGS + 1)]))
    width = (F.col("hi") - F.col("lo")) / (bins - 1)
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + (i - F.lit(0.5)) * width)
    at = rows.withColumn("_ladder", ladder).withColumn("_upto", F.transform(edges, lambda e: F.size(F.filter("_ladder", lambda q: q <= e)) / (RUNGS + 1)))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.when(i == bins - 1, F.lit(1.0)).otherwise(
        F.get(F.col("_upto"), i + 1)) - F.when(i == 0, F.lit(0.0)).otherwise(F.get(F.col("_upto"), i)))
    off = count_error(k) + 2 / RUNGS
    return at.select(*by, "feat", "source", "n", F.posexplode(shares).alias("bin", "_share")).select(
        *by, "feat", "source", "bin", F.round(F.col("_share") * F.col("n")).cast("bigint").alias("n_about"),
        F.ceil(F.col("n") * F.lit(off)).alias("n_error"))


def sketches_by_source(df: DataFrame, sources: Mapping[str, str], feat: str = "feat", by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(by, feat, source, n, sketch) of several columns of a long table, side by side in one pass."""
    out = quantile_sketches(df.withColumnRenamed(feat, "_feat"), list(sources.values()), [*by, "_feat"], k)
    name = F.lit(None).cast("string")
    for s, c in sources.items():
        name = F.when(F.col("feat") == c, F.lit(s)).otherwise(name)
    return out.withColumn("source", name).select(*by, F.col("_feat").alias("feat"), "source", "n", "sketch")
