"""Mixing to target weights: budgets down a tree of domains, languages and sources, then a token prefix of seeded epochs.

Native: DataFrame functions only.

A node's budget is shared among its children by weight. No child gets more than it can give (its tokens times the largest
number of epochs); what it cannot take is shared among its siblings, and only what no sibling can take goes back to the level
above, since a parent's own limit is the sum of its children's. The shares have a closed form: with the siblings in order of
limit / weight, those at their limit come first, and the level of the rest follows from running sums.

A leaf with budget B and A tokens gives its B div A whole epochs and a prefix of the next one, in the order of
md5(seed:epoch:doc_id). The prefix ends at a hash, found from sums per hash range and one range's rows, so no leaf is ordered
in one task and no text is moved.

Defined results. Null levels are named `none`. Null texts have no tokens. Equal ids of a leaf share their hash and stay or go
together. The prefix is the longest whose tokens do not exceed what is left of the budget; rows without tokens count as
nothing. Nodes without a declared weight have weight 1; those of weight 0 get nothing. An empty table gives no rows. Rows keep
their columns; `epoch` and the levels are added and replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_column, written

#: Rows of the leaves' table that are broadcast at most, some 100 bytes each.
BROADCAST_ROWS = 200_000
#: Rows of one hash range.
RANGE_ROWS = 1024


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("bigint")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1)).cast("bigint")


def share(nodes: DataFrame, parent: Sequence[str], order: str) -> DataFrame:
    """Adds `share`, the whole tokens each node gets of its parent's `budget`, from `weight` and `limit`."""
    ratio = F.col("limit") / F.col("weight")
    taking = nodes.withColumn("_ratio", F.when(F.col("weight") > 0, ratio)).withColumn("_takes", F.col("weight") > 0)
    ordered = Window.partitionBy(*parent, "_takes").orderBy("_ratio", order)
    before = F.coalesce(F.sum("limit").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = taking.withColumn("_level", F.when(F.col("_takes"), (F.col("budget") - before) / rest))
    # Every node past the first that is below its limit is below it too, and the first has the largest level.
    top = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.partitionBy(*parent, "_takes"))
    part = F.when(~F.col("_takes"), F.lit(0)).when(top.isNull(), F.col("limit")).otherwise(
        F.least(F.col("limit"), F.floor(top * F.col("weight"))))
    return level.withColumn("share", F.greatest(F.lit(0), part).cast("bigint")).drop("_ratio", "_takes", "_level")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], total: Column, epochs: int) -> DataFrame:
    """(levels..., tokens, n, budget) of every leaf from (levels..., tokens, n)."""
    nodes = leaves.withColumn("limit", F.col("tokens") * F.lit(epochs))
    budget = None
    for depth, level in enumerate(levels):
        own, parent = list(levels[:depth + 1]), list(levels[:depth])
        children = nodes.groupBy(*own).agg(F.sum("limit").alias("limit")).withColumn("weight", _weight(level, weights.get(level, {})))
        if budget is None:
            children = children.withColumn("_root", F.lit(0)).withColumn("budget", total.cast("bigint"))
            budget = share(children, ["_root"], level).select(*own, F.col("share").alias("budget"))
        else:
            budget = share(children.join(budget, parent), parent, level).select(*own, F.col("share").alias("budget"))
    return leaves.join(budget, list(levels))


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], fraction: float = 0.8,
        epochs: int = 4, seed: int = 17) -> DataFrame:
    """Rows of `docs` in the chosen mixture, once for each epoch they are in, with `epoch` (from 0) and the levels.

    `levels` names the tree's levels from the top and says how a row's are computed; `weights` gives whole numbers by level and
    name. The total budget is `fraction` of all tokens.
    """
    names = list(levels)
    inner = {n: f"__mix_{n}" for n in names}
    # Node names are whole paths' parts: the same language under two domains is two nodes.
    named = docs.withColumns({inner[n]: F.coalesce(c.cast("string"), F.lit("none")) for n, c in levels.items()})
    keys = [inner[n] for n in names]
    slim = written(named.select(*keys, "doc_id", token_count(text_column()).alias("tokens")), "mix")
    leaves = slim.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    tree = budgets(leaves, keys, {inner[k]: v for k, v in weights.items()}, F.lit(int(total * fraction)), epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    digits = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / RANGE_ROWS + 1.0) / 4)).cast("int")
    tree = written(tree.withColumn("whole", whole).withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens"))
                   .withColumn("digits", digits).select(*keys, "whole", "left", "digits"), "leaves")
    small = tree.count() <= BROADCAST_ROWS
    tree = F.broadcast(tree) if small else tree

    rows = (slim.join(tree, keys).where(F.col("left") > 0).withColumn("h", order_key(F.col("whole"), seed))
            .withColumn("range", F.left("h", F.col("digits"))))
    ranges = rows.groupBy(*keys, "range").agg(F.sum("tokens").alias("n"), F.max("h").alias("h"), F.first("left").alias("left"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("range"))
    ranges = ranges.withColumn("upto", upto)
    ends = ranges.groupBy(*keys).agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("h"))).alias("inside"),
                                     F.min(F.when(F.col("upto") > F.col("left"), F.struct("range", (F.col("upto") - F.col("n")).alias("before")))).alias("cut"))
    cut = ends.where("cut IS NOT NULL").select(*keys, F.col("cut.range").alias("range"), F.col("cut.before").alias("before"))
    # Rows of one hash, those of equal or null ids, are summed before they meet: they stay or go together.
    one = (rows.join(cut, [*keys, "range"]).groupBy(*keys, "range", "h")
           .agg(F.sum("tokens").alias("tokens"), F.first("before").alias("before"), F.first("left").alias("left")))
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy(*keys, "range").orderBy("h"))
    last = (one.withColumn("_run", running).where(F.col("_run") <= F.col("left")).groupBy(*keys).agg(F.max("h").alias("partly")))
    stops = tree.join(ends.join(last, keys, "left").select(*keys, F.greatest("inside", "partly").alias("stop")), keys, "left")
    stops = written(stops.select(*keys, F.col("whole").alias("__mix_whole"), F.col("stop").alias("__mix_stop")), "stops")
    stops = F.broadcast(stops) if small else stops

    at = F.explode(F.sequence(F.lit(0), F.col("__mix_whole")))
    chosen = named.join(stops, keys).withColumn("__mix_epoch", at).where(
        (F.col("__mix_epoch") < F.col("__mix_whole")) | (order_key(F.col("__mix_whole"), seed) <= F.col("__mix_stop")))
    return (chosen.withColumn("epoch", F.col("__mix_epoch")).withColumns({n: F.col(inner[n]) for n in names})
            .drop("__mix_epoch", "__mix_whole", "__mix_stop", *keys))
