"""Unions, duplicates and uniformity of inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import PIXEL
from .blocks import running_total_in_chunks


class SchemaMismatch(ValueError):
    pass


def schema_differences(*inputs: DataFrame) -> list[str]:
    """How later inputs differ from the first in labels, order or types; empty when uniform."""
    first = [(f.name, f.dataType.simpleString()) for f in inputs[0].schema]
    out = []
    for i, df in enumerate(inputs[1:], start=1):
        this = [(f.name, f.dataType.simpleString()) for f in df.schema]
        out += [f"input {i}: missing {n} {t}" for n, t in first if (n, t) not in this]
        out += [f"input {i}: extra {n} {t}" for n, t in this if (n, t) not in first]
        if sorted(first) == sorted(this) and first != this:
            out.append(f"input {i}: other column order")
    return out


def schema_uniform(*inputs: DataFrame) -> None:
    """Raise unless all inputs have the same labels, order and types. No job is run."""
    found = schema_differences(*inputs)
    if found:
        raise SchemaMismatch("; ".join(found))


def label_differences(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of label or bounds tables present on one side only."""
    left, right = a.select(*columns), b.select(*columns)
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    only_right = right.exceptAll(left).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def union_tiles(*tiles: DataFrame) -> DataFrame:
    """Stack tiles in space or time after checking that they are uniform."""
    schema_uniform(*tiles)
    return reduce(DataFrame.unionByName, tiles)


def distinct_classes(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def common_keys(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cadence_check(df: DataFrame, dt_seconds: int, keys: Sequence[str] = PIXEL, t: str = "t",
                  chunk_seconds: int = 30 * 86400) -> DataFrame:
    """Steps that do not follow the previous one by `dt_seconds`, with the gap found.

    Rows are compared inside time chunks; the last row of a chunk is handed to the next non-empty chunk
    through a table with one row per chunk, so gaps of any length are seen and no series is gathered.
    """
    rows = df.select(*keys, F.col(t).alias("_t")).withColumn(
        "_chunk", F.floor(F.unix_timestamp("_t") / F.lit(chunk_seconds)))
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    edges = (
        rows.groupBy(*keys, "_chunk").agg(F.max("_t").alias("_last"))
        .select(*keys, "_chunk", F.lag("_last").over(over_chunks).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_t")
    local = rows.withColumn("_prev", F.lag("_t").over(inside))
    joined = local.join(edges, [*keys, "_chunk"])
    prev = F.coalesce("_prev", "_carry")
    gap = F.unix_timestamp("_t") - F.unix_timestamp(prev)
    return (
        joined.select(*keys, F.col("_t").alias(t), gap.alias("gap_seconds"))
        .where(F.col("gap_seconds") != F.lit(dt_seconds))
    )


def block_gaps(df: DataFrame, block: str, max_delta_seconds: int, t: str = "t") -> DataFrame:
    """Consecutive time blocks that overlap or lie more than `max_delta_seconds` apart.

    One row per block is left after the first aggregate, so the unpartitioned order is over blocks only.
    """
    spans = df.groupBy(block).agg(F.min(t).alias("begin"), F.max(t).alias("end"))
    w = Window.orderBy("begin", block)
    delta = F.unix_timestamp("begin") - F.unix_timestamp(F.lag("end").over(w))
    return (
        spans.select(block, delta.alias("delta_seconds"))
        .where((F.col("delta_seconds") < 0) | (F.col("delta_seconds") > max_delta_seconds))
    )


def split_on_reset(df: DataFrame, pos: str, index: str, keys: Sequence[str] = (), block: int = 65536,
                   out: str = "run") -> DataFrame:
    """Number the runs of a concatenated list; a new run begins where the index falls.

    The list is cut into chunks by position. Each chunk gets the last index of the chunk before it that has rows, through a
    table with one row per chunk, so gaps between positions do not matter. Rows of one position are ordered by their index.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(block)))
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    edges = (
        rows.groupBy(*keys, "_chunk").agg(F.max(F.struct(pos, index)).alias("_last"))
        .select(*keys, "_chunk", F.lag(F.col("_last")[index]).over(over_chunks).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos, index)
    flagged = rows.withColumns({"_prev": F.lag(index).over(inside), "_nth": F.row_number().over(inside)})
    flagged = flagged.join(edges, [*keys, "_chunk"])
    before = F.when(F.col("_nth") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    flagged = flagged.withColumn("_reset", (F.col(index) < before).cast("int")).drop("_prev", "_nth", "_carry")
    out_df = running_total_in_chunks(
        flagged, list(keys), "_chunk", [pos, index, F.desc("_reset")], F.coalesce("_reset", F.lit(0)).cast("bigint"), out)
    return out_df.drop("_reset", "_chunk")


STATIC_TYPES = T.StructType([
    T.StructField("y", T.IntegerType(), False), T.StructField("x", T.IntegerType(), False),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("m_valid", T.BooleanType()),
    T.StructField("int_veg", T.IntegerType()), T.StructField("int_soil", T.IntegerType()),
])


def conforms(df: DataFrame, expected: T.StructType) -> list[str]:
    """Expected fields that are missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name} {f.dataType.simpleString()}" for f in expected if have.get(f.name) != f.dataType]
