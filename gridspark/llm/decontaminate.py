"""Benchmark decontamination: a prefix-filtered join of document words with windows of benchmark items.

Native: DataFrame functions only.

An item's windows are its runs of ten words (a shorter item is one window). A window's shingles of three words are ordered by
rarity over all documents. A window is found whole or not at all, so of its shingles one is necessary: the rarest, its prefix.
Documents are joined on prefixes; the place of the shingle gives the place of the window, which has to lie inside the text
(position and length bounds); what is left is verified word by word on the text.

Defined results. Null text, or one without words: no words, no hits. Items with a null id hit words but are not listed;
repeated items count once. Repeated rows and equal ids are told apart by their text. Empty tables give no rows or no hits.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, text_column, written

WINDOW, SHINGLE = 10, 3
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles or windows broadcast at once, some 100 bytes each; more are joined in several passes.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _BETWEEN), "")


def shingle_places(w: Column, width: int) -> Column:
    """Hashes of `width` consecutive words, by place."""
    return F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(width)]))
    ).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """Distinct windows: window (its words joined), len, w (its words), items (the ids of those that hold it, as text)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(text_column()).alias("w")).where(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (length - 1))), lambda i: F.slice(F.col("w"), i, length))
    return (w.select("item_id", F.explode(cut).alias("w")).groupBy("w").agg(F.collect_set("item_id").alias("items"))
            .select(F.array_join("w", " ").alias("window"), F.size("w").alias("len"), "w", "items"))


def window_shingles(windows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(window, len, gram, width, offset): all shingles of each window; a window of fewer words is one shingle."""
    places = shingle_places(F.col("w"), 1)
    for k in range(2, width + 1):
        places = F.when(F.col("len") >= k, shingle_places(F.col("w"), k)).otherwise(places)
    return windows.select("window", "len", F.least("len", F.lit(width)).alias("width"),
                          F.posexplode(places).alias("offset", "gram"))


def find_windows(docs: DataFrame, windows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Candidates per distinct (doc_id, text), by prefix join and bounds.

    Key columns, `_found`, an array of (start, len, window), and `_who`, an array of (window, items) with each of these windows once.
    """
    grams = written(window_shingles(windows, width), "grams")
    sizes = grams.agg(F.count_distinct("gram").alias("n"), F.count_distinct("window").alias("m"), F.collect_set("width").alias("widths")).first()
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), words(F.col("text")).alias("w"))
    widths = sorted(sizes["widths"])
    places = F.concat(*[shingle_places(F.col("w"), k) for k in widths]) if widths else F.array().cast("array<bigint>")
    # A place in the joined arrays tells the width it came from: the arrays follow each other.
    counts = [F.greatest(F.lit(0), F.size("w") - (k - 1)) for k in widths]
    found = rows.select("doc_id", "_h", F.size("w").alias("n_words"), F.array(*counts).cast("array<int>").alias("_counts"),
                        F.posexplode(places).alias("_place", "gram"))
    passes = max(1, math.ceil(sizes["n"] / BROADCAST_ROWS))
    wanted = grams.select("gram", F.lit(True).alias("_wanted")).distinct()
    parts = [found.join(F.broadcast(wanted.where(F.pmod("gram", F.lit(passes)) == i)), "gram") for i in range(passes)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    place, width_at = F.col("_place"), F.lit(None).cast("int")
    taken, at = F.lit(0), F.lit(None).cast("int")
    for i, k in enumerate(widths):
        here = (place >= taken) & (place < taken + F.col("_counts")[i])
        at, width_at = F.when(here, place - taken).otherwise(at), F.when(here, F.lit(k)).otherwise(width_at)
        taken = taken + F.col("_counts")[i]
    hits = written(hits.select("doc_id", "_h", "n_words", "gram", at.alias("at"), width_at.alias("width")), "postings")
    # Rarity over all documents; a shingle that no document has rules its window out.
    seen = hits.groupBy("gram", "width").agg(F.count(F.lit(1)).alias("seen"))
    ranked = grams.join(seen, ["gram", "width"], "left").withColumn("_rank", F.row_number().over(
        Window.partitionBy("window").orderBy(F.coalesce("seen", F.lit(0)), "offset")))
    prefix = ranked.where("_rank = 1 AND seen > 0").select("gram", "width", "offset", "len", "window")
    if sizes["m"] <= BROADCAST_ROWS:
        prefix = F.broadcast(prefix)
    start = F.col("at") - F.col("offset")
    fitting = (hits.join(prefix, ["gram", "width"]).withColumn("start", start)
               .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))))
    # Repeated rows give the same candidates twice; a set keeps one.
    fitting = written(fitting.select("doc_id", "_h", "start", "len", "window").distinct(), "candidates")
    # Ids of items, as many as a window may have, go to a document once a window and not with each place.
    holders = windows.select("window", "items")
    who = (fitting.select("doc_id", "_h", "window").distinct().join(holders, "window")
           .groupBy("doc_id", "_h").agg(F.collect_list(F.struct("window", "items")).alias("_who")))
    found = fitting.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", "len", "window")).alias("_found"))
    same = found["doc_id"].eqNullSafe(who["doc_id"]) & (found["_h"] == who["_h"])
    return found.join(who, same).select(found["doc_id"], found["_h"], "_found", "_who")


def covered(spans: Column) -> Column:
    """Places covered by an array of (start, len, ...) in ascending order of the start."""
    begin = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))

    def step(acc, s):
        stop = s["start"] + s["len"]
        return F.struct(F.greatest(acc["to"], stop).alias("to"),
                        (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(s["start"], acc["to"]))).alias("n"))
    return F.aggregate(spans, begin, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """Every row of `docs` with n_words, spans (array of start, len, window that occur), n_hit and items, the ids that hold them.

    Rows keep their columns; those added replace columns of the same name.
    """
    rows = docs.withColumn("__dc_text", text_column()).withColumn("__dc_h", F.xxhash64("__dc_text"))
    found = find_windows(rows.select("doc_id", F.col("__dc_text").alias("text")), item_windows(items, length))
    found = found.select(F.col("doc_id").alias("__dc_id"), F.col("_h").alias("__dc_key"), F.col("_found").alias("__dc_found"), F.col("_who").alias("__dc_who"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__dc_id")) & (F.col("__dc_h") == F.col("__dc_key")), "left")
    joined = joined.withColumn("__dc_w", words(F.col("__dc_text")))
    true = F.filter("__dc_found", lambda c: F.array_join(F.slice(F.col("__dc_w"), c["start"] + 1, c["len"]), " ") == c["window"])
    none = F.array().cast("array<struct<start:int,len:int,window:string>>")
    joined = joined.withColumn("n_words", F.size("__dc_w").cast("bigint")).withColumn(
        "spans", F.when(F.col("__dc_found").isNull(), none).otherwise(F.array_sort(true)))
    # Windows that were candidates only are few, mostly none.
    refuted = F.array_except(F.transform("__dc_who", lambda x: x["window"]), F.transform("spans", lambda x: x["window"]))
    who = F.filter("__dc_who", lambda x: ~F.array_contains("__dc_refuted", x["window"]))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(who, lambda x: x["items"]))))
    return (joined.withColumn("n_hit", covered(F.col("spans")).cast("bigint")).withColumn("__dc_refuted", refuted)
            .withColumn("items", F.when(F.col("__dc_who").isNull(), F.array().cast("array<string>")).otherwise(items))
            .drop("__dc_text", "__dc_h", "__dc_id", "__dc_key", "__dc_found", "__dc_who", "__dc_w", "__dc_refuted"))


def hit_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
