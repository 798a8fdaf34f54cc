"""Evaluator partials kept up to date from a stream of scored rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.verification import Moments, Tally
from ..sources import published

Partials = Moments | Tally


def stream_error_partials(scored_stream: DataFrame, moments: Partials) -> DataFrame:
    """Running partials of a stream; the state holds one row per group, whatever the volume."""
    return moments.partial(scored_stream)


def write_snapshots(partials: DataFrame, path: str, checkpoint: str, once: bool = True, keep: int = 2) -> StreamingQuery:
    """Write the whole result after each trigger to its own folder, named by the trigger's number.

    The newest `keep` folders stay: a reader that has begun on the one before the last can end its work.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        _drop_folder(batch.sparkSession, f"{path}/batch={batch_id - keep:012d}")
    writer = partials.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of partials, if there is one, through the file system it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    newest = df.select(F.max("batch").alias("b"))
    return df.where(F.col("batch") == newest.scalar()).drop("batch")


def write_batches(rows: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True,
                  mode: str = "append") -> StreamingQuery:
    """Store `work` of every micro-batch in a folder of its own; a replayed batch overwrites itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
    writer = rows.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_merge(scored_stream: DataFrame, moments: Partials, path: str, checkpoint: str, once: bool = True
                 ) -> StreamingQuery:
    """Store the partials of every micro-batch in its own folder; a replayed batch overwrites itself.

    The stream keeps no state: `merged_partials` adds up what is stored.
    """
    return write_batches(scored_stream, moments.partial, path, checkpoint, once)


def _folded(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """What batches were folded into, and the number of the last of them; None and -1 if none were."""
    try:
        fold, told = published.read_published(spark, f"{path}/_folds")
        return fold, told["upto"]
    except published.NotPublished:
        return None, -1


def merged_partials(spark: SparkSession, path: str, moments: Partials) -> DataFrame:
    """All stored batches added up: those that were folded, and the later ones."""
    fold, upto = _folded(spark, path)
    if fold is None:
        return moments.merge(spark.read.parquet(path).drop("batch"))
    later = [n for n in _batches(spark, path) if n > upto]
    if not later:
        return moments.merge(fold)
    return moments.merge(fold, spark.read.parquet(path).where(F.col("batch") > upto).drop("batch"))


def _batches(spark: SparkSession, path: str) -> list[int]:
    place, fs = published.folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def compact_partials(spark: SparkSession, path: str, moments: Partials, upto: int) -> None:
    """Fold the batches up to number `upto`, which must be done, into one table that `merged_partials` reads instead of them.

    The fold is written beside the batches and published whole; from then on readers take it and leave out the batches it
    holds, so a crash before or after counts nothing twice and loses nothing. Then the batches' folders are removed; what a
    crash leaves of them is removed by the next call. The fold before stays for readers at work on it.
    """
    fold, before = _folded(spark, path)
    numbers = _batches(spark, path)
    new = [n for n in numbers if before < n <= upto]
    if new and (fold is not None or len(new) > 1):
        rows = spark.read.parquet(path).where((F.col("batch") > before) & (F.col("batch") <= upto)).drop("batch")
        published.write_published(moments.merge(*([fold] if fold is not None else []), rows), f"{path}/_folds", {"upto": new[-1]})
        before = new[-1]
    for n in numbers:
        if n <= before:
            _drop_folder(spark, f"{path}/batch={n:012d}")
