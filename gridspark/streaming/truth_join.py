"""Predictions scored as the truth arrives: a join of two streams whose state expires.

A prediction is known when it is issued and waits for the truth of its valid time, at most the horizon away. So a prediction can
be forgotten once truth is past its issue time plus the horizon, and a true value once predictions are issued after it. Both
follow from the watermarks and the time range in the join's condition. Keys are pixel, feature and valid time, so that a pixel
with most of the rows is spread over its times.

A row that waits costs far more than its values: each is a key and a count in the state, read again at every trigger. With
`block_seconds`, rows of one key that come in the same trigger wait together, a block of time in one row with lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import PIXEL

#: Rows that a task gathers at most before it packs them.
PACK_ROWS = 250_000


def score_arriving(predictions: DataFrame, truth: DataFrame, horizon_seconds: int, delay: str, keys: Sequence[str] = PIXEL,
                   carry: Sequence[str] = (), unmatched: bool = False, block_seconds: int | None = None) -> DataFrame:
    """Error rows of predictions (keys, init, issued, step, feat, t, pred_res, pred_state) and truth (keys, feat, t, true_prev, true_state).

    `pred_state` is the state predicted for the valid time `t`, as in `error_columns`. With `unmatched`, predictions
    whose truth did not come in time follow with null truth and errors once they expire. Rows may be `delay` late on either side;
    later ones are dropped. Works on tables too, where nothing expires.

    `block_seconds`, some ten to fifty steps, gives the same rows from a state of packed rows (not with `unmatched`). A prediction
    then waits a block longer, and a true value is only dropped if those of its block that came with it are late too.
    """
    if block_seconds is not None:
        if unmatched:
            raise ValueError("blocks do not tell which of their predictions had no truth")
        return _score_blocks(predictions, truth, horizon_seconds, delay, keys, carry, block_seconds)
    said = predictions.withWatermark("issued", delay)
    seen = truth.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("feat").alias("_feat"), F.col("t").alias("_t"),
                        "true_prev", "true_state", *carry).withWatermark("_t", delay)
    near = (F.col("_t") == F.col("t")) & (F.col("_t") >= F.col("issued")) & (
        F.col("_t") <= F.col("issued") + F.expr(f"INTERVAL {int(horizon_seconds)} SECONDS"))
    for k in (*keys, "feat"):
        near &= F.col(k) == F.col(f"_{k}")
    return _error_rows(said.join(seen, near, "left_outer" if unmatched else "inner"), keys, carry)


def _error_rows(both: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    return both.select(
        *keys, "init", "issued", "step", "feat", "t", *carry, "true_prev", "true_state", "pred_res", "pred_state",
        (F.col("true_state") - F.col("true_prev")).alias("true_res"), (F.col("pred_state") - F.col("true_state")).alias("err_state"),
        (F.col("pred_res") - (F.col("true_state") - F.col("true_prev"))).alias("err_res"))


def _score_blocks(predictions: DataFrame, truth: DataFrame, horizon_seconds: int, delay: str, keys: Sequence[str],
                  carry: Sequence[str], block_seconds: int) -> DataFrame:
    """The rows of the inner join: blocks of predictions meet blocks of truth, then each prediction its valid time."""
    after = lambda seconds: F.col("issued") + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    said = packed(predictions.withColumn("_block", _block("t", block_seconds)), [*keys, "feat", "_block", "init", "issued"],
                  ["step", "t", "pred_res", "pred_state"])
    said = said.withColumnsRenamed({c: f"_{c}s" for c in ("step", "t", "pred_res", "pred_state")}).withWatermark("issued", delay)
    true = ["true_prev", "true_state", *carry]
    seen = truth.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("feat").alias("_feat"),
                        _block("t", block_seconds).alias("_in"), F.col("t").alias("_seen"), *true)
    seen = packed(seen, [*[f"_{k}" for k in keys], "_feat", "_in"], ["_seen", *true])
    seen = seen.withColumnsRenamed({c: f"_{c}s" for c in true}).withColumn("_until", F.array_max("_seen")).withWatermark("_until", delay)
    # The last time of a block is not before its other times, and less than a block after them.
    near = (F.col("_block") == F.col("_in")) & (F.col("_until") >= F.col("issued")) & (
        F.col("_until") <= after(horizon_seconds + block_seconds))
    for k in (*keys, "feat"):
        near &= F.col(k) == F.col(f"_{k}")
    pairs = said.join(seen, near).select("*", F.posexplode("_ts").alias("_i", "t")).select("*", F.posexplode("_seen").alias("_j", "_t"))
    both = pairs.where(
        (F.col("_t") == F.col("t")) & (F.col("_t") >= F.col("issued")) & (F.col("_t") <= after(horizon_seconds)))
    return _error_rows(both.select(
        *keys, "init", "issued", "feat", "t", *[F.get(f"_{c}s", F.col("_i")).alias(c) for c in ("step", "pred_res", "pred_state")],
        *[F.get(f"_{c}s", F.col("_j")).alias(c) for c in true]), keys, carry)


def _block(t: str, seconds: int) -> Column:
    """Where the block of a time begins, in microseconds."""
    return F.unix_micros(t) - F.pmod(F.unix_micros(t), F.lit(int(seconds) * 1_000_000))


def packed(rows: DataFrame, by: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Rows of equal `by` as one row with a list of each of `lists`, in a stream those of one trigger.

    Stateless: what a task gathers is bounded, so a group may come in several rows.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in by] + [T.StructField(c, T.ArrayType(kinds[c])) for c in lists])
    by, lists, most = list(by), list(lists), PACK_ROWS

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        places = table.select(by).append_column("_at", pa.array(np.arange(len(table))))
        groups = places.group_by(by, use_threads=False).aggregate([("_at", "list")]).combine_chunks()
        at = groups["_at_list"].chunk(0)
        columns = [groups[c] for c in by] + [pa.ListArray.from_arrays(at.offsets, table[c].chunk(0).take(at.values)) for c in lists]
        yield from pa.table(columns, [*by, *lists]).to_batches(max_chunksize=10_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= most:
                yield from pack(held)
                held, n = [], 0
        if held:
            yield from pack(held)

    return rows.select(*by, *lists).repartition(*by).mapInArrow(work, schema)


def issued_predictions(errors: DataFrame, step_seconds: int, keys: Sequence[str] = PIXEL) -> DataFrame:
    """The predictions' part of a table of error rows, with the time they were issued."""
    issued = F.timestamp_seconds(F.unix_timestamp("t") - F.col("step") * F.lit(step_seconds))
    return errors.select(*keys, "init", issued.alias("issued"), "step", "feat", "t", "pred_res", "pred_state")
