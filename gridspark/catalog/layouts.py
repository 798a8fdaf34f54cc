"""Queries on the pixel-hour table in its bucketed layout; the SQL is that of the same query on the plain table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import joins as J
from ..operators import samples as S
from ..operators import statistics as ST
from ..session import cut_lineage
from ..sources import layout as L
from ..sources.sinks import scratch_dir
from . import relations, samples, statistics  # noqa: F401  the queries whose SQL is taken
from .registry import CHECKS, QUERIES, settled, r6
from .samples import _SPEC, _flat_samples, array_sum

#: Buckets at least, and rows of a bucket, about.
BUCKETS, BUCKET_ROWS = 8, 500_000


def buckets(n: int) -> int:
    """Buckets for a table of `n` rows: a bucket is one task's work, so there are more of them in a larger table."""
    return max(BUCKETS, -(-n // BUCKET_ROWS))


def like(name: str):
    """Register a query that gives the rows of query `name`."""
    def keep(fn):
        QUERIES[f"{name}_layout"] = fn
        CHECKS[f"{name}_layout"] = CHECKS[name]
        return fn
    return keep


def laid_out(spark: SparkSession, sf: str) -> L.Layout:
    """The pixel-hour table in its layout; the longest tenth of the series counts as crowded."""
    rows = cut_lineage(fx.dynamic(spark, sf))
    sizes = rows.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))
    most, n = sizes.agg(F.percentile_approx("n", 0.9), F.sum("n")).first()
    return L.write_layout(rows, scratch_dir(spark, "layout"), buckets(n or 0), most_rows=most or 1)


@like("e1_sliding_windows")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = laid_out(spark, sf).map(lambda df: S.sliding_windows(df, 12, ["tmp", "soilm_10"]))
    return out.select("y", "x", "step", settled(array_sum("window", "tmp"), 4).alias("total"),
                      settled(F.get("window", F.lit(0))["soilm_10"]).alias("oldest"))


@like("e2_make_samples")
def make_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = laid_out(spark, sf)
    static = L.write_layout(fx.static(spark, sf), scratch_dir(spark, "static"), BUCKETS, step=None, like=rows)
    return _flat_samples(rows.join(static, lambda d, s: S.make_samples(d, s, _SPEC, in_place=True)))


@like("e7_increments")
def increments(spark: SparkSession, sf: str) -> DataFrame:
    return laid_out(spark, sf).map(lambda df: S.increments(df, "soilm_10")).select("y", "x", "step", *r6("res_soilm_10"))


@like("c1_join_forcing_model")
def join_forcing_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(fx.dynamic(spark, sf))
    forcing = L.write_layout(rows.where("apcp = 0").select("y", "x", "t", "step", "tmp"), scratch_dir(spark, "forcing"), buckets(rows.count()), most_rows=500)
    model = L.write_layout(rows.where("tmp > 240").select("y", "x", "t", "soilm_10"), scratch_dir(spark, "model"), BUCKETS, step=None, like=forcing)
    return forcing.join(model, J.join_forcing_model).select("y", "x", "step", *r6("tmp", "soilm_10"))


@like("d2_gridstats_year_month")
def gridstats_year_month(spark: SparkSession, sf: str) -> DataFrame:
    out = laid_out(spark, sf).map(lambda df: ST.gridstats_year_month(df, ["tmp", "soilm_40"]))
    return out.select("year", "month", "y", "x", "feat", *r6("min", "max", "mean", "std"))
