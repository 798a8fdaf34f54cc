"""Aggregates of the user's own that are no sums: a state object a group, packed into one binary column.

The counterpart of `Moments` for evaluators that keep something else: the same `partial`, `merge` and `finish`, so partials of tiles,
periods and streamed batches combine alike. A user gives an `Evaluator`. A state is made from the rows of a group in one Arrow
batch, so nothing is gathered before it is small; states are then merged in a tree, at most `FAN_IN` of them in one task at a
time, however many a group has. A packed state may take `STATE_BYTES`: one that grows with its rows is refused, not spilled into failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

FAN_IN = 64
STATE_BYTES = 1 << 20
#: Rows of Arrow batches that are grouped together.
ROWS_TOGETHER = 50_000
#: States of a task that may be open, as if each were as large as allowed.
OPEN_BYTES = 256 << 20


class Evaluator(Protocol):
    """What the user writes. Merging must not depend on order or grouping."""

    columns: Sequence[str]
    result: str

    def add(self, state: Any, rows: pd.DataFrame) -> Any:
        """The state with `rows`, the evaluator's columns; the state of no rows is None."""

    def merge(self, a: Any, b: Any) -> Any:
        """The state of the rows of both."""

    def pack(self, state: Any) -> bytes: ...

    def unpack(self, packed: bytes) -> Any: ...

    def finish(self, state: Any) -> tuple:
        """Values of the result columns, which `result` names with their types."""


class StateTooLarge(ValueError):
    """A packed state is larger than allowed."""


def _packed(evaluator: Evaluator, state: Any, limit: int) -> bytes:
    packed = evaluator.pack(state)
    if len(packed) > limit:
        raise StateTooLarge(f"a state of {len(packed)} bytes; at most {limit} are allowed")
    return packed


@dataclass(frozen=True)
class StateAggregate:
    """An evaluator per group of `keys`, as mergeable partials (keys, state)."""

    keys: Sequence[str]
    evaluator: Evaluator
    state_bytes: int = STATE_BYTES
    fan_in: int = FAN_IN

    def partial(self, df: DataFrame) -> DataFrame:
        """One row per group and task, or more where a task has many groups; no exchange. Null keys are groups of their own."""
        keys, evaluator, limit = list(self.keys), self.evaluator, self.state_bytes
        # A row without any column could not carry its number.
        chosen = df.select(*keys, *[F.col(c).alias(f"_v_{c}") for c in evaluator.columns], F.lit(1).alias("_row"))
        schema = T.StructType([*[chosen.schema[k] for k in keys], T.StructField("state", T.BinaryType())])
        arrow = _arrow_schema(chosen, keys)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_: dict[tuple, Any] = {}

            def handed_on() -> pa.RecordBatch:
                columns = [pa.array([k[i] for k in open_], arrow.field(name).type) for i, name in enumerate(keys)]
                states = pa.array([_packed(evaluator, s, limit) for s in open_.values()], pa.binary())
                open_.clear()
                return pa.record_batch([*columns, states], schema=arrow)
            for batch in _larger(batches):
                values = pd.DataFrame({c: batch.column(f"_v_{c}").to_pandas() for c in evaluator.columns}, index=range(batch.num_rows))
                names = [batch.column(k) for k in keys]
                for rows in _groups(names, batch.num_rows):
                    key = tuple(c[int(rows[0])].as_py() for c in names)
                    open_[key] = evaluator.add(open_.get(key), values.iloc[rows].reset_index(drop=True))
                if len(open_) * limit > OPEN_BYTES:
                    yield handed_on()
            if open_:
                yield handed_on()
        return chosen.mapInArrow(fold, schema)

    def merge(self, *partials: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
        """One row per group; `by` may name fewer keys than the partials have.

        Each round merges groups of at most about `fan_in` states. Rounds are as many as the fullest group needs; rows are stored
        between them, so that a lost executor repeats one round, and with the same groups.
        """
        keys = list(self.keys if by is None else by)
        rows = cut_lineage(reduce(DataFrame.unionByName, partials).select(*keys, "state"))
        while True:
            most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 1
            if most == 1:
                return rows
            groups = -(-most // self.fan_in)
            share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
            dealt = rows.withColumn("_share", share if groups > 1 else F.lit(0).cast("bigint"))
            rows = cut_lineage(dealt.groupBy(*keys, "_share").applyInArrow(self._merger(rows, keys), rows.schema))

    def _merger(self, rows: DataFrame, keys: list[str]) -> Callable[[pa.Table], pa.Table]:
        evaluator, limit, arrow = self.evaluator, self.state_bytes, _arrow_schema(rows, keys)

        def merge(table: pa.Table) -> pa.Table:
            states = (evaluator.unpack(x) for x in table.column("state").to_pylist())
            whole = _packed(evaluator, reduce(evaluator.merge, states), limit)
            head = table.slice(0, 1)
            return pa.table([*[head.column(k).cast(arrow.field(k).type) for k in keys], pa.array([whole], pa.binary())], schema=arrow)
        return merge

    def finish(self, merged: DataFrame) -> DataFrame:
        """Result columns of merged partials, next to their keys."""
        keys = [c for c in merged.columns if c != "state"]
        evaluator = self.evaluator
        results = T.StructType.fromDDL(evaluator.result)
        schema = T.StructType([*[merged.schema[k] for k in keys], *results])
        names = results.names
        arrow = pa.schema([*[f for f in _arrow_schema(merged, keys) if f.name != "state"], *_arrow_fields(results)])

        def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [evaluator.finish(evaluator.unpack(x)) for x in batch.column("state").to_pylist()]
                columns = [pa.array([v[i] for v in values], arrow.field(n).type) for i, n in enumerate(names)]
                yield pa.record_batch([*[batch.column(k).cast(arrow.field(k).type) for k in keys], *columns], schema=arrow)
        return merged.mapInArrow(done, schema)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Partial, merge and finish in one go."""
        return self.finish(self.merge(self.partial(df)))


def _arrow_fields(schema: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    return list(to_arrow_schema(schema))


def _arrow_schema(df: DataFrame, keys: Sequence[str]) -> pa.Schema:
    return pa.schema([*_arrow_fields(T.StructType([df.schema[k] for k in keys])), pa.field("state", pa.binary())])


def _larger(batches: Iterator[pa.RecordBatch], rows: int = ROWS_TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches put together to at least so many rows, as work a group is dear."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _groups(columns: list[pa.Array], n: int) -> list[np.ndarray]:
    """The rows of each group of equal keys, null equal to null."""
    if not columns:
        return [np.arange(n)]
    codes = pd.DataFrame({i: c.dictionary_encode().indices.to_pandas() for i, c in enumerate(columns)}).fillna(-1)
    return list(codes.groupby(list(codes.columns), sort=False).indices.values())


# --- a rank-based evaluator -----------------------------------------------------------------------

@dataclass(frozen=True)
class RankCorrelation:
    """Rank correlation of truth and prediction, both in saturating bins, so that a state has at most bins x bins counts.

    Equal bins share their mean rank. Rows with a null or NaN on either side are left out; the correlation is null where one
    side is in one bin only.
    """

    truth: str
    pred: str
    lo: float
    hi: float
    bins: int = 64
    result: str = "n bigint, rank_cc double"

    @property
    def columns(self) -> Sequence[str]:
        return (self.truth, self.pred)

    def _binned(self, v: pd.Series) -> np.ndarray:
        v = v.to_numpy(dtype=float)
        return np.minimum(np.floor((np.clip(v, self.lo, self.hi) - self.lo) / (self.hi - self.lo) * self.bins), self.bins - 1)

    def add(self, state, rows: pd.DataFrame):
        a, b = self._binned(rows[self.truth]), self._binned(rows[self.pred])
        ok = ~(np.isnan(a) | np.isnan(b))
        cells, counts = np.unique((a[ok] * self.bins + b[ok]).astype(np.int64), return_counts=True)
        return (cells, counts.astype(np.int64)) if state is None else self.merge(state, (cells, counts))

    def merge(self, a, b):
        cells, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        counts = np.zeros(len(cells), np.int64)
        np.add.at(counts, where, np.concatenate([a[1], b[1]]))
        return cells, counts

    def pack(self, state) -> bytes:
        return np.concatenate(state).astype("<i8").tobytes()

    def unpack(self, packed: bytes):
        both = np.frombuffer(packed, "<i8")
        return both[:len(both) // 2], both[len(both) // 2:]

    def finish(self, state) -> tuple:
        cells, counts = state
        n = int(counts.sum())

        def centred(bins: np.ndarray) -> np.ndarray:
            size = np.bincount(bins, counts, self.bins)
            rank = np.cumsum(size) - size + (size + 1) / 2
            return rank[bins] - (n + 1) / 2
        x, y = centred(cells // self.bins), centred(cells % self.bins)
        spread = float((counts * x * x).sum()) * float((counts * y * y).sum())
        return n, (float((counts * x * y).sum()) / spread ** 0.5 if spread > 0 else None)
