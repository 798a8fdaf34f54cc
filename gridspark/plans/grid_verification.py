"""Verification at common init times over a named domain of tiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import PIXEL
from ..functions.expressions import step_of
from ..operators import samples as S
from ..operators import scoring as C
from ..operators import selection as Q
from ..operators.joins import global_index
from ..session import cut_lineage
from .evaluators import Evaluation, evaluate, evaluate_parts
from .sequence_verification import score
from .store import Store


@dataclass(frozen=True)
class GridDomain:
    """A set of tiles (tile, y0, y1, x0, x1, off_y, off_x), a period of init times and their spacing in steps."""

    name: str
    tiles: DataFrame
    start: str
    end: str
    frequency: int
    step_seconds: int = 3600

    def span(self, before: int, after: int) -> tuple[str, str]:
        """Time range that holds all windows and horizons."""
        at = lambda s: datetime.fromisoformat(s)
        step = timedelta(seconds=self.step_seconds)
        return str(at(self.start) - before * step), str(at(self.end) + after * step)

    @property
    def steps(self) -> int:
        span = datetime.fromisoformat(self.end) - datetime.fromisoformat(self.start)
        return int(span.total_seconds() // self.step_seconds)


def domain_rows(dynamic: DataFrame, static: DataFrame, domain: GridDomain, window: int, horizon: int,
                mask: str = "m_valid", t: str = "t") -> DataFrame:
    """Rows of the domain's valid pixels in global indices, with steps counted from the first init time."""
    rows = Q.time_slice(dynamic, *domain.span(window + 1, horizon + 1), t=t, partitioned="year" in dynamic.columns)
    rows = Q.select_tile_bounds(rows, domain.tiles)
    rows = global_index(rows, domain.tiles.select("tile", "off_y", "off_x").distinct())
    rows = Q.valid_pixels(rows, static, mask=mask)
    return rows.withColumn("step", step_of(t, domain.start, domain.step_seconds))


def grid_errors(dynamic: DataFrame, static: DataFrame, domain: GridDomain, spec: S.SampleSpec, factory: C.Factory,
                scaling: C.Scaling = C.Scaling(), inputs: Sequence[str] = (), coarseness: int = 1, convert: str | None = None,
                reduce_inputs: str = "mean") -> DataFrame:
    """Scored rows of every valid pixel of a domain at each init time. The initial state of a sample is its last window step."""
    rows = domain_rows(dynamic, static, domain, spec.window, spec.horizon)
    rows = S.grid_sample_rows(rows, spec.window, spec.horizon, domain.frequency, 0, domain.steps)
    rows = rows.withColumn("pos", F.col("lead") + F.lit(spec.window - 1))
    by = [*PIXEL, "init"]
    samples = S.to_arrays(rows, spec, by, static if spec.static_feats or spec.static_int else None)
    return score(samples, factory, spec, by, scaling, inputs, coarseness, convert, static, reduce_inputs=reduce_inputs)


def verify_grid(dynamic: DataFrame, static: DataFrame, domain: GridDomain, spec: S.SampleSpec, factory: C.Factory,
                evaluators: Sequence[str], feat: str, scaling: C.Scaling = C.Scaling(), inputs: Sequence[str] = (),
                reuse: bool = True, coarseness: int = 1, convert: str | None = None, reduce_inputs: str = "mean",
                store: Store | None = None, **setup) -> dict[str, DataFrame]:
    """Score every valid pixel of a domain at each init time and evaluate; with `store` the results are kept under its name.

    Tiles are a column, so results of the whole domain come out of one aggregate; there are no partial files
    to merge.
    """
    errors = grid_errors(dynamic, static, domain, spec, factory, scaling, inputs, coarseness, convert, reduce_inputs)
    if reuse:
        errors = cut_lineage(errors)
    results = evaluate(errors, evaluators, Evaluation(static, feat, [*PIXEL, "init"], coarseness=coarseness, **setup))
    return results if store is None else store.keep(results, feat, source=domain.name)


def verify_domains(dynamic: DataFrame, static: DataFrame, domains: Sequence[GridDomain], spec: S.SampleSpec, factory: C.Factory,
                   evaluators: Sequence[str], feat: str, scaling: C.Scaling = C.Scaling(), inputs: Sequence[str] = (),
                   coarseness: int = 1, convert: str | None = None, reduce_inputs: str = "mean", store: Store | None = None,
                   **setup) -> dict[str, dict[str, DataFrame]]:
    """Several domains and init periods in one run: domain or `all` -> evaluator -> result.

    The domains' scored rows are written once, next to each other. Evaluators whose partials add read them once, and the total is
    the sum of the domains', so a sample of two domains counts twice in it. Init times of different domains are different samples.
    """
    names = [d.name for d in domains]
    if len(set(names)) < len(names) or "all" in names or not names:
        raise ValueError(f"domains need names of their own, other than all: {names}")
    parts = [grid_errors(dynamic, static, d, spec, factory, scaling, inputs, coarseness, convert, reduce_inputs).withColumn("domain", F.lit(d.name))
             for d in domains]
    errors = cut_lineage(reduce(DataFrame.unionByName, parts), partition_by=["domain"])
    found = evaluate_parts(errors, evaluators, Evaluation(static, feat, ["domain", *PIXEL, "init"], coarseness=coarseness, **setup),
                           "domain", names, store=cut_lineage)
    results = {part: {e: found[e][part] for e in evaluators} for part in [*names, "all"]}
    return results if store is None else {part: store.keep(r, feat, source=part) for part, r in results.items()}
