"""An archive of tile files whose names tell what they hold: fields of the name choose the files before any is opened.

The files are listed, their names parsed by `grids.parse_tile_path`, and a condition on the fields leaves those to read. One scan then
reads these files alone, wherever Spark's readers can reach them, with column pruning and row filters as usual; each row
gets its file's fields.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grids import parse_tile_path

#: What a tile file's name tells.
FIELDS = ("year", "quarter", "y0", "y1", "x0", "x1")


class NoTiles(FileNotFoundError):
    """No file of the archive meets the condition."""


def plain_path(path: Column) -> Column:
    """A file's path as a listing and a scan both give it: one slash behind the scheme, no escapes."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")


def listed_path(path: Column) -> Column:
    """`plain_path` of a path that is not escaped, as the listing of files has it."""
    return plain_path(F.replace(path, F.lit("%"), F.lit("%25")))


def tile_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(input, size, modified and the name's fields) of the archive's files; fields are null where a name is none of a tile."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = files.select(listed_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return parse_tile_path(named).withColumnRenamed("path", "input")


def scan_archive(spark: SparkSession, path: str, where: Column | str | None = None, feats: Sequence[str] | None = None,
                 schema: str | T.StructType | None = None, glob: str = "*.parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of the tile files whose name's fields meet `where`, with these fields; files of other names are left out.

    The chosen files' names come to the driver, as they do in every scan. Without `schema` one file's is taken.
    """
    wanted = tile_files(spark, path, glob).where(F.col("year").isNotNull())
    if where is not None:
        wanted = wanted.where(where)
    names = wanted.select("input", *FIELDS).collect()
    if not names:
        raise NoTiles(f"{path}: {where}")
    reader = spark.read.options(**(options or {}))
    rows = (reader.schema(schema) if schema is not None else reader).parquet(*sorted(r.input for r in names))
    rows = rows.select(*(feats if feats is not None else ["*"]), plain_path(F.col("_metadata.file_path")).alias("_input"))
    told = spark.createDataFrame([tuple(r) for r in names], T.StructType([T.StructField("_input", T.StringType()), *[wanted.schema[f] for f in FIELDS]]))
    clash = [f for f in FIELDS if f in rows.columns]
    return rows.drop(*clash).join(told, "_input").drop("_input")
