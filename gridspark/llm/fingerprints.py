"""Document fingerprints: threshold-scaled sketches of word shingles.

Native: DataFrame functions only.

A sketch keeps every hash of five consecutive words that lies below a fixed fraction of the hash range, so sketches of any two
texts, however unequal, are samples under one threshold: unions of sketches are sketches of unions, and shares of common
hashes estimate Jaccard likeness and containment. A text none of whose hashes lies below keeps its smallest hash, so that a
short text still has a fingerprint; `merged` drops it where others are below.

Defined results. Null or empty text: an empty fingerprint; its likeness is 1 to an empty one and 0 to any other. A text of
fewer than five words is one shingle. Documents are ordered by (doc_id, text hash), null ids first; repeated rows follow each
other, each with the next row as its next document. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_column

WORDS, FRACTION = 5, 0.25
_LOWEST = -(2**63)


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """Hashes of every k consecutive words of a text, repeats included."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # The array is bound once as a lambda's argument; written twice it would be split twice a shingle.
    def hashes(w):
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)),
                           lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(k)]))
        return (F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
                .otherwise(F.array().cast("array<bigint>")))
    return F.flatten(F.transform(F.array(words), hashes))


def sketch(text: Column, k: int = WORDS, fraction: float = FRACTION) -> Column:
    """Ascending distinct hashes below the threshold, or the smallest one of all."""
    limit = _LOWEST + int(fraction * 2**64)
    def keep(h):
        low = F.filter(h, lambda x: x < F.lit(limit))
        return F.when((F.size(low) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(F.array_sort(F.array_distinct(low)))
    return F.element_at(F.transform(F.array(shingle_hashes(text, k)), keep), 1)


def merged(sketches: Column, fraction: float = FRACTION) -> Column:
    """The sketch of all texts of an array of sketches."""
    limit = _LOWEST + int(fraction * 2**64)
    every = F.array_sort(F.array_distinct(F.flatten(sketches)))
    low = F.filter(every, lambda x: x < F.lit(limit))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(every, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketched texts."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common.cast("double") / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second one has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def shown(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, per_block: int = 512, blocks_together: int = 4096, **columns: Column) -> DataFrame:
    """(doc_id, text, columns..., next): each document with the next one's text and columns in id order, the last with the first's.

    Documents meet in blocks of neighbouring ids by one exchange; blocks pass their first document on to the block before, over
    a window of at most `blocks_together` blocks and then over one row for as many blocks.
    """
    ids = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    low, width = ids["low"] or 0, max(1, ((ids["high"] or 0) - (ids["low"] or 0) + 1) * per_block // max(1, ids["n"]))
    block = F.coalesce(F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("bigint"), F.lit(-1))
    rows = (docs.select("doc_id", text_column().alias("text"), block.alias("_block")).repartition("_block")
            .select("*", F.xxhash64("text").alias("_h"), *[c.alias(n) for n, c in columns.items()]))
    own = F.struct("text", *columns)
    # The columns are computed for the first documents alone.
    firsts = rows.groupBy("_block").agg(F.min_by("text", F.struct("doc_id", "_h")).alias("text")).select(
        "_block", F.struct("text", *[c.alias(n) for n, c in columns.items()]).alias("_first"))
    group = F.floor(F.col("_block") / blocks_together)
    firsts = firsts.withColumn("_group", group).withColumn(
        "_after", F.lead("_first").over(Window.partitionBy("_group").orderBy("_block")))
    groups = firsts.groupBy("_group").agg(F.min_by("_first", "_block").alias("_first"))
    order = Window.orderBy("_group")
    groups = groups.select("_group", F.coalesce(F.lead("_first").over(order), F.first("_first").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_then"))
    passed = firsts.join(groups, "_group").select("_block", F.coalesce("_after", "_then").alias("_then"))
    inside = Window.partitionBy("_block").orderBy("doc_id", "_h")
    return (rows.withColumn("_lead", F.lead(own).over(inside)).join(passed, "_block")
            .select("doc_id", "text", *columns, F.coalesce("_lead", "_then").alias("next")))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.left(text, F.char_length(text) - n), F.left(following, n))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's sketch, that of its edited text, and their likeness among themselves and to the next document's."""
    rows = with_next(docs, sketch=sketch(F.col("text"))).select(
        "doc_id", "text", "sketch", "next.sketch", edited(F.col("text"), F.col("next.text")).alias("edited"))
    rows = rows.toDF("doc_id", "text", "sketch", "next_sketch", "edited").withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "edited", "sketch", "edited_sketch",
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def fingerprint_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        shown(F.col("sketch")).alias("fingerprint"), shown(F.col("edited_sketch")).alias("edited_fingerprint"),
                        "near_edited", "near_next")
