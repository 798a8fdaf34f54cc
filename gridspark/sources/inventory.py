"""File and record inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and modification time of files, without reading their content."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(path).select("path", "length", "modificationTime")
    )


def expected_times(spark: SparkSession, start: str, end: str, step_seconds: int = 3600) -> DataFrame:
    """Every expected time in [start, end), one task-sized day at a time."""
    t0, t1 = F.unix_timestamp(F.lit(start).cast("timestamp")), F.unix_timestamp(F.lit(end).cast("timestamp"))
    day = step_seconds * 24
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((t1 - t0 - 1) / F.lit(day)))).alias("d"))
    steps = days.select(F.explode(F.sequence(
        t0 + F.col("d") * day, F.least(t0 + (F.col("d") + 1) * day, t1) - 1, F.lit(step_seconds).cast("bigint")
    )).alias("s"))
    return steps.select(F.timestamp_seconds("s").alias("t"))


def audit_inventory(expected: DataFrame, listing: DataFrame, min_bytes: int, t: str = "t", length: str = "length"
                    ) -> DataFrame:
    """Expected files that are missing or smaller than the threshold."""
    found = listing.select(t, F.col(length).alias("length"))
    status = F.when(F.col("length").isNull(), "missing").when(F.col("length") < min_bytes, "small")
    return expected.join(found, t, "left").withColumn("status", status).where("status IS NOT NULL")


def size_range(listing: DataFrame, length: str = "length") -> DataFrame:
    return listing.agg(F.min(length).alias("min_bytes"), F.max(length).alias("max_bytes"),
                       F.count(F.lit(1)).alias("n"))


# Inventory line fields: position, column, type; `key=value` fields keep the value.
INVENTORY_FIELDS = (
    (0, "record", "int"), (1, "byte", "bigint"), (2, "date", "string"), (3, "name", "string"),
    (4, "param_pds", "int"), (5, "type_pds", "int"), (6, "vert_pds", "int"), (7, "dt_pds", "int"),
    (8, "t0_pds", "int"), (9, "tf_pds", "int"), (10, "fcst_pds", "int"), (11, "lvl_str", "string"),
    (12, "mdl_type", "string"), (13, "navg", "int"),
)


def _misshapen(value: str | Column) -> Column:
    return F.coalesce(F.size(F.split(E.col(value), ":")) < len(INVENTORY_FIELDS), F.lit(True))


def inventory_rejects(lines: DataFrame, value: str | Column = "value") -> DataFrame:
    """The raw lines that have too few fields, null lines among them."""
    return lines.where(_misshapen(value)).select(E.col(value).alias("line"))


def parse_inventory_lines(lines: DataFrame, value: str | Column = "value", rejects: bool = False) -> DataFrame:
    """`:`-separated record inventory lines -> typed columns.

    A line with too few fields is an error when it is read; with `rejects` such lines are left to `inventory_rejects`.
    """
    fields = F.split(E.col(value), ":")
    bad = _misshapen(value)
    rows = lines.where(~bad) if rejects else lines
    def field(i, kind):
        found = F.element_at(F.split(F.get(fields, F.lit(i)), "="), -1).cast(kind)
        return found if rejects else F.when(bad, F.raise_error(F.concat(
            F.lit("inventory line with too few fields: "), F.coalesce(E.col(value), F.lit("null")))).cast(kind)).otherwise(found)
    return rows.select(*[field(i, kind).alias(name) for i, name, kind in INVENTORY_FIELDS])
