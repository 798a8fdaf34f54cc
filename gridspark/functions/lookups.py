"""Class dimension tables and the lookups that use them.

Every table here has a fixed number of rows (at most 17 classes), so broadcasting it is safe at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from .expressions import col, ratio


def _inline(spark: SparkSession, columns: list[tuple[str, str]], rows) -> DataFrame:
    """Literal table known to the optimizer with its exact size."""
    def literal(v, kind):
        if v is None:
            return f"CAST(NULL AS {kind})"
        return f"CAST('{v}' AS {kind})" if kind == "STRING" else f"CAST({v!r} AS {kind})"
    body = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(row, columns)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS dim({', '.join(n for n, _ in columns)})")


def texture_dim(spark: SparkSession) -> DataFrame:
    columns = [("int_soil", "INT"), ("texture", "STRING"), ("texture_short", "STRING"), ("pct_sand", "DOUBLE"),
               ("pct_silt", "DOUBLE"), ("pct_clay", "DOUBLE"), ("porosity", "DOUBLE"), ("wiltingp", "DOUBLE"),
               ("vegstress", "DOUBLE")]
    return _inline(spark, columns, [(k, *v) for k, v in vocab.TEXTURES.items()])


def vegetation_dim(spark: SparkSession) -> DataFrame:
    columns = [("int_veg", "INT"), ("vegetation", "STRING"), ("lai_lo", "DOUBLE"), ("lai_hi", "DOUBLE"),
               ("rsmin", "DOUBLE")]
    return _inline(spark, columns, [(k, *v) for k, v in vocab.VEGETATION.items()])


def drainage_dim(spark: SparkSession) -> DataFrame:
    return _inline(spark, [("slope_type", "INT"), ("drainage", "DOUBLE")], list(vocab.DRAINAGE.items()))


def units_dim(spark: SparkSession) -> DataFrame:
    return _inline(spark, [("feat", "STRING"), ("unit", "STRING"), ("long_name", "STRING")],
                   [(k, *v) for k, v in vocab.UNITS.items()])


def texture_fractions(df: DataFrame, int_soil: str = "int_soil", fill: float = 0.0) -> DataFrame:
    """Soil class -> sand, silt and clay fractions; `fill` for class 0 and for unknown classes."""
    dim = texture_dim(df.sparkSession).where("int_soil <> 0").select(
        F.col("int_soil").alias(int_soil), "pct_sand", "pct_silt", "pct_clay")
    out = df.join(F.broadcast(dim), int_soil, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(float(fill))) for c in ("pct_sand", "pct_silt", "pct_clay")})


def texture_class(sand: Column | str, silt: Column | str, clay: Column | str, tolerance: float = 1e-4) -> Column:
    """Fractions -> soil class within a tolerance (0 where all fractions vanish), null where nothing matches.

    The twelve mineral textures are a constant array, so no join of any kind is needed.
    """
    table = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(v[2]).alias("sand"), F.lit(v[3]).alias("silt"), F.lit(v[4]).alias("clay"))
        for k, v in vocab.TEXTURES.items() if k <= 12
    ])
    near = lambda a, b: F.abs(col(a) - b) < F.lit(tolerance)
    hits = F.filter(table, lambda r: near(sand, r["sand"]) & near(silt, r["silt"]) & near(clay, r["clay"]))
    return F.get(hits, F.lit(0))["k"]


def texture_params(df: DataFrame, int_soil: str = "int_soil") -> DataFrame:
    """Soil class -> porosity, wilting point, vegetation stress, and that stress as relative moisture.

    With a `fieldcap` column also the relative field capacity.
    """
    dim = texture_dim(df.sparkSession).select(
        F.col("int_soil").alias(int_soil), "porosity", "wiltingp", "vegstress")
    out = df.join(F.broadcast(dim), int_soil, "left")
    room = F.col("porosity") - F.col("wiltingp")
    out = out.withColumn("rsm_stress", ratio(F.col("vegstress") - F.col("wiltingp"), room))
    if "fieldcap" in df.columns:
        out = out.withColumn("rsm_fieldcap", ratio(F.col("fieldcap") - F.col("wiltingp"), room))
    return out


def lai_from_gvf(df: DataFrame, greenness: str, int_veg: str = "int_veg") -> DataFrame:
    """Leaf area index from greenness between the bounds of the vegetation class."""
    dim = vegetation_dim(df.sparkSession).select(F.col("int_veg").alias(int_veg), "lai_lo", "lai_hi")
    lai = F.col("lai_lo") + F.col(greenness) * (F.col("lai_hi") - F.col("lai_lo"))
    return df.join(F.broadcast(dim), int_veg, "left").withColumn("lai_gvf", lai).drop("lai_lo", "lai_hi")


def drainage_class(df: DataFrame, slope_type: str = "slope_type") -> DataFrame:
    """Slope type -> drainage; null for unknown types and for type 0, which marks no slope class."""
    dim = drainage_dim(df.sparkSession).where("slope_type <> 0").withColumnRenamed("slope_type", slope_type)
    return df.join(F.broadcast(dim), slope_type, "left")
