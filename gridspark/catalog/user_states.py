"""User aggregates with a state of their own, in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..operators import user_aggregates as U
from ..sources.sinks import scratch_dir
from ..streaming import partials as P
from .registry import ERRORS, bin_sql, query, r6, with_views
from .scoring import scored_stream

_LO, _HI, _BINS = -40.0, 40.0, 48


def _rank_sql(source: str, by: str, a: str, b: str, bins: int) -> str:
    return f"""
, k AS (SELECT {by}, {bin_sql(a, _LO, _HI, bins)} AS ba, {bin_sql(b, _LO, _HI, bins)} AS bb FROM {source}),
r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY ba) + (count(*) OVER (PARTITION BY {by}, ba) - 1) / 2.0e0 AS ra,
        rank() OVER (PARTITION BY {by} ORDER BY bb) + (count(*) OVER (PARTITION BY {by}, bb) - 1) / 2.0e0 AS rb FROM k)
SELECT {by}, count(*) AS n, round(corr(ra, rb), 6) AS rank_cc FROM r GROUP BY {by}"""


@query("j2_user_state", with_views(ERRORS, body=_rank_sql("fx_err", "step, feat", "true_res", "pred_res", _BINS).lstrip()))
def user_state(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation by lead step; partials of four tiles, merged."""
    errors = fx.errors(spark, sf).selectExpr("x % 4 AS tile", "step", "feat", "true_res", "pred_res")
    measure = U.RankCorrelation("true_res", "pred_res", _LO, _HI, _BINS)
    tiles = U.StateAggregate(["tile", "step", "feat"], measure)
    whole = U.StateAggregate(["step", "feat"], measure, fan_in=4)
    return whole.finish(whole.merge(tiles.partial(errors))).select("step", "feat", "n", *r6("rank_cc"))


_EVENTS = "WITH e AS (SELECT event_type AS feat, CAST(hour(ts) AS INT) - 12 AS h, value - 20 AS err_state FROM events)"


@query("j2_user_state_stream", _EVENTS + _rank_sql("e", "feat", "err_state", "h", 24))
def user_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same evaluator over streamed batches, whose partials are stored and merged."""
    stream = scored_stream(spark, sf).selectExpr("feat", "step - 12 AS h", "err_state")
    measure = U.StateAggregate(["feat"], U.RankCorrelation("err_state", "h", _LO, _HI, 24))
    path, checkpoint = scratch_dir(spark, "states"), scratch_dir(spark, "stream-log")
    P.stream_merge(stream, measure, path, checkpoint).awaitTermination()
    return measure.finish(P.merged_partials(spark, path, measure)).select("feat", "n", *r6("rank_cc"))
