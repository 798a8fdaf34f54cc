"""Work along the time axis without ever gathering one series in one task.

A pixel may hold any share of all rows, so no window here is partitioned by the pixel alone. Series are cut
into blocks of bounded length; what a row needs from the neighbouring block comes either as copied edge rows
(`spread_to_blocks`) or as one summary row per block (`numbered_in_chunks`, `running_total_in_chunks`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def spread_to_blocks(df: DataFrame, step: str, block: int = DEFAULT_BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """Copy each row to every block whose own rows look at it.

    A block owns the steps [b*block, (b+1)*block). Its rows look `before` steps back and `after` steps ahead.
    Adds `_block` and `_core`; keep only `_core` rows once the window functions are done.
    """
    s = F.col(step)
    first = F.floor((s - F.lit(after)) / F.lit(block))
    last = F.floor((s + F.lit(before)) / F.lit(block))
    own = F.floor(s / F.lit(block))
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_core", F.col("_block") == own)


def along_blocks(df: DataFrame, keys: Sequence[str], step: str, columns: dict[str, "callable"], before: int = 0,
                 after: int = 0, block: int = DEFAULT_BLOCK, whole: str | None = None) -> DataFrame:
    """Add window columns along a series; `columns` maps a name to a function of the ordered window.

    `whole` names a column that tells whether each of the steps from `before` back to `after` ahead occurs exactly once, so
    that counted rows are adjacent steps. It does not depend on where a block begins.
    """
    w = Window.partitionBy(*keys, "_block").orderBy(step)
    out = spread_to_blocks(df, step, block, before, after)
    if whole is not None:
        here = F.count(F.lit(1)).over(w.rangeBetween(-before, after)) == before + after + 1
        if before + after:
            out = out.withColumn("_follows", (F.col(step) - F.lag(step).over(w) == 1).cast("int"))
            here &= F.sum("_follows").over(w.rowsBetween(1 - before, after)) == before + after
        out = out.withColumn(whole, F.coalesce(here, F.lit(False))).drop("_follows")
    out = out.withColumns({name: build(w) for name, build in columns.items()})
    return out.where("_core").drop("_block", "_core")


def numbered_in_chunks(df: DataFrame, keys: Sequence[str], chunk: str, order_by: Sequence[str | Column],
                       out: str = "rn") -> DataFrame:
    """`row_number() OVER (PARTITION BY keys ORDER BY chunk, order_by)` with no key held in one task.

    `chunk` must be non-null, rise with the order, and split a hot key (a date, a hash prefix). Rows are
    numbered inside (keys, chunk); the rows in earlier chunks come from a count per (keys, chunk).
    """
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, chunk, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(*order_by)
    numbered = df.withColumn("_local", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*keys, chunk])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_before", "_local")
    )


def running_total_in_chunks(df: DataFrame, keys: Sequence[str], chunk: str, order_by: Sequence[str | Column],
                            value: Column, out: str) -> DataFrame:
    """Running sum in order, built from sums per chunk plus the running sum inside the chunk."""
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
        .select(*keys, chunk, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_local", F.sum(value).over(inside))
        .join(totals, [*keys, chunk])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_before", "_local")
    )
