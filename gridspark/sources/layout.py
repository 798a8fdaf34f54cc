"""A pixel-hour table laid out once for many jobs: bucketed by pixel, with crowded pixels apart.

`write_layout` deals the rows by a hash of the pixel once and stores one sorted file a bucket. All rows of a pixel are then read by
one task, so windows along time, aggregates that keep the pixel and joins of two tables with one layout need no exchange. That
would be wrong for a pixel with a large share of the rows: pixels of more than `most_rows` rows stand in a second table, dealt by
pixel and time, on which the operators run with their usual exchanges. `Layout.map` and `Layout.join` run an operator on
both and put the results together.

Tables of one layout share buckets and crowded pixels: give the first one as `like` when the second is written.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import PIXEL
from ..operators.blocks import DEFAULT_BLOCK
from ..session import configure

#: Rows of a pixel that one task may hold, some 45 years of hours.
MOST_ROWS = 400_000


@dataclass(frozen=True)
class Layout:
    """An opened layout: rows of ordinary pixels, in buckets, and rows of crowded ones."""

    path: str
    keys: tuple[str, ...]
    buckets: int
    ordinary: DataFrame
    crowded: DataFrame
    has_crowded: bool

    def map(self, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """`operator` on the whole table, for operators whose groups and windows keep the pixel."""
        out = operator(self.ordinary)
        return out.unionByName(operator(self.crowded)) if self.has_crowded else out

    def join(self, other: Layout, operator: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """`operator` on two tables of one layout, for operators whose joins keep the pixel."""
        if (self.keys, self.buckets) != (other.keys, other.buckets):
            raise ValueError(f"{self.path} and {other.path} are not dealt alike")
        out = operator(self.ordinary, other.ordinary)
        if self.has_crowded or other.has_crowded:
            out = out.unionByName(operator(self.crowded, other.crowded))
        return out


def write_layout(df: DataFrame, path: str, buckets: int, keys: Sequence[str] = PIXEL, step: str | None = "step",
                 most_rows: int = MOST_ROWS, like: Layout | None = None) -> Layout:
    """Store `df` below `path` and open it; the folder must not exist. `step` is the column rows of a pixel are sorted by, if any.

    Pixels are counted first (one aggregate), unless `like` names those that are crowded. Only their keys are held against the
    rows, at most one for every `most_rows` rows. Rows with a null key are kept; they count as one pixel.
    """
    spark, keys = df.sparkSession, tuple(keys)
    if like is not None:
        keys, buckets = like.keys, like.buckets
        crowd = spark.read.parquet(f"{like.path}/pixels")
    else:
        crowd = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_rows).select(*keys)
    crowd.write.mode("errorifexists").parquet(f"{path}/pixels")
    crowd = spark.read.schema(crowd.schema).parquet(f"{path}/pixels")
    marked = crowd.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    has_crowded = not crowd.isEmpty()
    ordinary = df.join(marked, same, "left_anti") if has_crowded else df
    crowded = df.join(marked, same, "left_semi") if has_crowded else df.limit(0)
    order = [*keys, *([step] if step else [])]
    # Dealt by the hash that numbers the buckets, so each bucket is one file of one task.
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (ordinary.repartition(buckets, *keys).sortWithinPartitions(*order).write.mode("errorifexists").option("path", f"{path}/ordinary")
     .bucketBy(buckets, *keys).sortBy(*order).format("parquet").saveAsTable(name))
    if step:
        crowded = crowded.repartition(*keys, F.floor(F.col(step) / F.lit(DEFAULT_BLOCK))).sortWithinPartitions(*order)
    crowded.write.mode("errorifexists").parquet(f"{path}/crowded")
    told = json.dumps({"keys": keys, "buckets": buckets, "order": order, "crowded": has_crowded, "schema": df.schema.json()})
    spark.range(1).select(F.lit(told).alias("layout")).write.mode("errorifexists").json(f"{path}/layout")
    return open_layout(spark, path)


def _table_name(path: str) -> str:
    return f"layout_{hashlib.md5(path.encode()).hexdigest()}"


def open_layout(spark: SparkSession, path: str) -> Layout:
    """Open a stored layout, in this or another application.

    Its frames belong to a session of their own, next to `spark`, in which a join may keep a layout by some of its keys. That
    is safe for these tables only: no pixel among the ordinary ones is large. The table's name is entered in the catalog where
    it is not known.
    """
    from pyspark.sql.types import StructType
    told = json.loads(spark.read.json(f"{path}/layout").first()["layout"])
    own = spark.newSession()
    configure(own)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes"):
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    schema = StructType.fromJson(json.loads(told["schema"]))
    name, quoted = _table_name(path), lambda names: ", ".join(f"`{n}`" for n in names)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    own.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({quoted(told['keys'])}) "
            f"SORTED BY ({quoted(told['order'])}) INTO {told['buckets']} BUCKETS LOCATION '{path}/ordinary'")
    return Layout(path, tuple(told["keys"]), told["buckets"], own.table(name), own.read.schema(schema).parquet(f"{path}/crowded"), told["crowded"])


def exchanges(df: DataFrame) -> list[str]:
    """The shuffles in the plan of `df`, outermost first, as the plan prints them; broadcasts do not count."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" +-:*()0123456789") for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
