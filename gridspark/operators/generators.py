"""Row generators of the user's own, run over ordered groups of rows as table functions.

For what the built-in forms cannot express: a generator sees the rows of one group one after the other, keeps what it likes between
them, and gives any number of rows at any of them and at the end. Spark deals and sorts the rows and makes a fresh
generator for each group. Python runs row by row here, so this is the slow path; use `samples` where its operators do.

A group is one task's work. `blocks` cuts long series into blocks of bounded length with copied edge rows, so a generator that
looks a known number of steps back and ahead works on a pixel of any length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import PIXEL
from .blocks import DEFAULT_BLOCK, spread_to_blocks
from .samples import SampleSpec, _floor_div, _offset


class Generator(Protocol):
    """What the user writes; made without arguments for each group."""

    def push(self, row: Any) -> Iterable[tuple]:
        """Rows that come out when `row` has been seen."""

    def finish(self) -> Iterable[tuple]:
        """Rows that come out after the last one."""


def generate(df: DataFrame, factory: Callable[[], Generator], schema: str | T.StructType, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that generators give over `df`, one generator for each group, in ascending `order`.

    What comes out has the columns of `schema` alone; a generator puts the group's keys into its rows if they are wanted. Rows
    that are equal in `order` come in any sequence. Null keys are groups of their own.
    """
    class Run:
        def __init__(self):
            self.generator = factory()

        def eval(self, row):
            yield from self.generator.push(row)

        def terminate(self):
            yield from self.generator.finish()
    return F.udtf(Run, returnType=schema)(df.asTable().partitionBy(*group).orderBy(*order))


def generate_in_blocks(df: DataFrame, factory: Callable[[], Generator], schema: str | T.StructType, before: int = 0, after: int = 0,
                       keys: Sequence[str] = PIXEL, step: str = "step", block: int = DEFAULT_BLOCK) -> DataFrame:
    """`generate` over blocks of a series. Rows carry `_core`: false for the `before` and `after` steps copied from the neighbours.

    A generator that answers for core rows alone gives each result once.
    """
    return generate(spread_to_blocks(df, step, block, before, after), factory, schema, [*keys, "_block"], [step])


def sample_generator(spec: SampleSpec, columns: Sequence[str], keys: Sequence[str] = PIXEL, step: str = "step") -> Callable[[], Generator]:
    """The samples of `samples.cut_samples` as a generator: rows of (keys, sample, pos, columns...).

    It runs in blocks with `spec.length - 1` steps copied from the block ahead, over rows with `_first_offset` and `_starts`
    (`with_starts`), and holds the rows of one sample at a time. A sample belongs to the block its first step is in. Samples with a
    missing or repeated step are left out.
    """
    length, separation = spec.length, spec.separation

    class Samples:
        def __init__(self):
            # What one row costs does not depend on the length of a sample, unless the row ends one.
            self.rows, self.steps, self.run = deque(), deque(), 0

        def push(self, row):
            here = row[step]
            last = self.steps[-1] if self.steps else None
            # A sample ends when a later step comes: until then its last step may be repeated.
            if here != last:
                if self.run >= length:
                    yield from self.finish()
                self.run = self.run + 1 if last is not None and here == last + 1 else 1
            else:
                self.run = 0
            while self.steps and self.steps[0] <= here - length:
                self.steps.popleft()
                self.rows.popleft()
            self.steps.append(here)
            self.rows.append(row)

        def finish(self):
            # The last `length` steps occur once each.
            if self.run < length:
                return
            at = self.steps[-1] - length + 1 - self.rows[-1]["_first_offset"]
            if at < 0 or at % separation or at // separation >= self.rows[-1]["_starts"] or not self.rows[0]["_core"]:
                return
            for pos, r in enumerate(self.rows):
                yield (*[r[k] for k in keys], at // separation, pos, *[r[c] for c in columns])
    return Samples


def with_starts(df: DataFrame, spec: SampleSpec, keys: Sequence[str] = PIXEL, step: str = "step") -> DataFrame:
    """`df` with the pixel's offset of the first sample and its number of starts."""
    lengths = df.groupBy(*keys).agg((F.max(step) + 1).alias("_len"))
    room = _floor_div(F.col("_len") - F.lit(spec.length + spec.max_offset), spec.separation)
    return df.join(lengths, list(keys)).withColumns({"_first_offset": _offset(spec, keys), "_starts": room}).drop("_len")


def generated_samples(df: DataFrame, spec: SampleSpec, types: Mapping[str, str], keys: Sequence[str] = PIXEL, step: str = "step",
                      block: int = DEFAULT_BLOCK) -> DataFrame:
    """Long form of all samples by `sample_generator`; `types` names the columns carried and their types."""
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["sample bigint", "pos int"] + [f"{c} {t}" for c, t in types.items()])
    rows = with_starts(df.select(*keys, step, *types), spec, keys, step)
    return generate_in_blocks(rows, sample_generator(spec, list(types), keys, step), schema, 0, spec.length - 1, keys, step, block)
