"""Grid-shaped views of the synthetic tables, so that every operator can be checked on them.

A supplier is a pixel (ten per grid row) and its line items in date order are the steps, 29 hours apart.
Steps are numbered per (pixel, ship day) with a running count over the days, so a supplier that holds a
large share of all line items is spread over its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lookups import texture_dim
from .operators.blocks import numbered_in_chunks
from .operators.samples import grid_sample_rows, long_labels
from .operators.verification import error_columns

FIRST = "2020-01-01 00:00:00"
STEP_SECONDS = 29 * 3600
HORIZON = 24
FEATS = {
    "tmp": "230 + (l_orderkey % 1000) / 10.0D",
    "spfh": "(l_orderkey % 300) / 10000.0D",
    "apcp": "CASE WHEN l_quantity > 40 THEN l_quantity / 10 ELSE 0.0D END",
    "ugrd": "l_discount * 100 - 5",
    "vgrd": "l_tax * 100 - 4",
    "lai": "(l_partkey % 70) / 10.0D",
    "soilm_10": "4 + (l_partkey % 390) / 10.0D",
    "soilm_40": "8 + (l_orderkey * 7 % 1150) / 10.0D",
    "soilm_100": "12 + (l_partkey * 11 % 2250) / 10.0D",
    "soilm_200": "20 + (l_orderkey * 13 % 4400) / 10.0D",
    "weasd": "CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0D END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables that pixel rows and the other queries of the catalog come from; the text operators have their own.
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the files of `TABLES`, as far as they are there."""
    total = 0
    for name in TABLES:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(place):
            total += files.getContentSummary(place).getLength()
    return total


_PREPARED: dict[str, str] = {}


def prepare(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the pixel-hour table the way a production one is kept: spread and sorted by pixel and step.

    From then on `dynamic` reads it instead of numbering the line items again.
    """
    dynamic(spark, sf_dir).repartitionByRange("y", "x", "step").sortWithinPartitions("y", "x", "step").write.parquet(path)
    _PREPARED[sf_dir] = path


def dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel-hour table: y, x, step, t and eleven features."""
    if sf_dir in _PREPARED:
        return spark.read.parquet(_PREPARED[sf_dir])
    items = table(spark, sf_dir, "lineitem").withColumns({
        "y": F.expr("CAST(floor(l_suppkey / 10) AS INT)"), "x": F.expr("CAST(l_suppkey % 10 AS INT)"),
        "_day": F.to_date("l_shipdate")})
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = numbered_in_chunks(items, ["y", "x"], "_day", order, "_rn")
    step = (F.col("_rn") - 1).cast("int")
    first = F.unix_timestamp(F.lit(FIRST).cast("timestamp"))
    return rows.select(
        "y", "x", step.alias("step"), F.timestamp_seconds(first + (F.col("_rn") - 1) * F.lit(STEP_SECONDS)).alias("t"),
        *[F.expr(e).alias(f) for f, e in FEATS.items()])


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel-hour table with steps missing and steps repeated, next to each other in places."""
    rows = dynamic(spark, sf_dir).where("(step * 7 + x * 3 + y) % 13 <> 5")
    return rows.unionByName(rows.where("(step + y) % 17 = 3"))


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell properties; one grid column in ten is invalid."""
    return table(spark, sf_dir, "supplier").select(
        F.expr("CAST(floor(s_suppkey / 10) AS INT)").alias("y"), F.expr("CAST(s_suppkey % 10 AS INT)").alias("x"),
        F.expr("25 + floor(s_suppkey / 10) * 0.125D").alias("lat"),
        F.expr("-125 + (s_suppkey % 10) * 0.125D").alias("lon"),
        F.expr("s_suppkey % 10 <> 3").alias("m_valid"),
        F.expr("CAST(s_nationkey % 14 AS INT)").alias("int_veg"),
        F.expr("CAST(1 + s_suppkey % 12 AS INT)").alias("int_soil"), F.abs("s_acctbal").alias("elev"))


def static_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell properties with soil fractions and parameters."""
    return static(spark, sf_dir).join(F.broadcast(texture_dim(spark)), "int_soil")


def scored(spark: SparkSession, sf_dir: str, feats: tuple[str, ...] = ("soilm_10", "soilm_40"),
           carry: tuple[str, ...] = ()) -> DataFrame:
    """24-step forecasts of a damped-trend rule, one per 24 steps, for verification operators."""
    rows = grid_sample_rows(dynamic(spark, sf_dir), 1, HORIZON, HORIZON, first=1)
    labels = long_labels(rows, feats, carry=("t", *carry))
    rule = F.lit(0.8) * (F.col("true_state") - F.col("true_prev")) + (F.col("step") % 5 - 2) * F.lit(0.05)
    return labels.withColumn("pred_res", rule)


def errors(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    return error_columns(scored(spark, sf_dir, **kwargs))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed 64-element arrays: 32 states, then 32 increments."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").alias("cls"),
        F.transform("embedding", lambda v: v.cast("double")).alias("seq"))
