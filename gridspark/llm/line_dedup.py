"""Line deduplication by the spread of lines over sites: HyperLogLog sketches per line, exact counts near the threshold.

Free style; built-in functions do all of it. A line is what stands between line feeds, without surrounding white space. Lines
whose smallest and largest site agree are on one site and need no sketch. The others' sketches are made and merged by
aggregation; where the estimate is close to the threshold, distinct sites are counted exactly. Lines on enough sites are
boilerplate and are removed wherever they stand, with their line feed.

Defined results. Null text: empty, with one empty line. Empty lines are never removed. A null site counts as a site of its own.
Repeated rows and equal ids are told apart by site and text; repeated rows are cleaned alike. An empty table gives no rows.
Rows keep their columns; those added replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, text_column, written

SITES = 10
#: log2 of a sketch's registers; its standard error is 1.04 / sqrt(2^LOG_K), and six of them make the band that is counted.
LOG_K = 10
BAND = 6 * 1.04 / 2 ** (LOG_K / 2)


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(line) hashes of `lines` (line, site) that stand on at least `sites` distinct sites."""
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("about"))
    sure = sketched.where(F.col("about") > sites * (1 + BAND)).select("line")
    near = sketched.where(F.col("about").between(sites * (1 - BAND), sites * (1 + BAND))).select("line")
    # Reduced to distinct sites before the exchange by line, so a common line is a row a site.
    pairs = lines.select("line", "site").distinct()
    counted = (pairs.join(near, "line", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") >= sites).select("line"))
    return sure.unionByName(counted)


def without(parts: Column, gone: Column) -> Column:
    """The array without the places in `gone`, which is sorted: the runs between them, put together, each element copied once."""
    def runs(p: Column, g: Column) -> Column:
        def run(k: Column) -> Column:
            after = F.when(k == 0, F.lit(-1)).otherwise(F.get(g, k - 1))
            upto = F.when(k == F.size(g), F.size(p)).otherwise(F.get(g, k))
            return F.slice(p, after + 2, upto - after - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(g)), run))
    return bound(parts, lambda p: bound(gone, lambda g: runs(p, g)))


def dedup_lines(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """Every row of `docs` with its cleaned text in `text`, and n_lines and n_removed."""
    rows = docs.withColumn("__line_text", text_column()).withColumn("__line_key", F.xxhash64("doc_id", site, "__line_text"))
    cut = rows.select(F.col("__line_key").alias("key"), F.xxhash64(site).alias("site"), F.posexplode(F.split("__line_text", "\n", -1)).alias("place", "_line"))
    bare = F.regexp_replace("_line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    lines = cut.withColumn("_line", bare).where("_line <> ''").select("key", "place", "site", F.xxhash64("_line").alias("line"))
    spread = lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("line")
    # Dealt anew, so that the join has exchanges of its own and a common line is split by its size.
    several = written(lines.join(spread.hint("rebalance"), "line"), "lines")
    gone = (several.join(written(boilerplate(several, sites), "boilerplate"), "line")
            .groupBy(F.col("key").alias("__line_of")).agg(F.collect_set("place").alias("__line_gone")))
    joined = rows.join(gone, F.col("__line_key") == F.col("__line_of"), "left")
    parts = F.split("__line_text", "\n", -1)
    hit = F.col("__line_gone").isNotNull()
    return (joined.withColumn("n_lines", F.size(parts).cast("bigint"))
            .withColumn("n_removed", F.when(hit, F.size("__line_gone")).otherwise(F.lit(0)).cast("bigint"))
            .withColumn("text", F.when(hit, F.array_join(without(parts, F.array_sort("__line_gone")), "\n")).otherwise(F.col("__line_text")))
            .drop("__line_text", "__line_key", "__line_of", "__line_gone"))
