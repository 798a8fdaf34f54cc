"""From a pixel-hour table to verified forecasts on randomly placed samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .. import PIXEL
from ..functions.features import convert_scored
from ..operators import samples as S
from ..operators import scoring as C
from ..operators import selection as Q
from ..operators.verification import error_columns
from ..session import cut_lineage
from .evaluators import Evaluation, evaluate
from .store import Store


def score(samples: DataFrame, factory: C.Factory, spec: S.SampleSpec, by: Sequence[str],
          scaling: C.Scaling = C.Scaling(), inputs: Sequence[str] = (), coarseness: int = 1,
          convert: str | None = None, params: DataFrame | None = None, keys: Sequence[str] = PIXEL,
          reduce_inputs: str = "mean") -> DataFrame:
    """Scored long rows of array samples with their error columns.

    `inputs` are horizon features that evaluators read next to the errors. `coarseness` is the number of steps that one
    predicted step spans; inputs are reduced over them by `reduce_inputs` (mean, min or max). `convert` (rsm_to_soilm or soilm_to_rsm) changes the unit of labels and predictions with the
    porosity and wilting point of `params`.
    """
    parts = C.Parts(spec.window_feats, spec.horizon_feats, spec.pred_feats, spec.static_feats)
    carry = ["pred", "time"] + (["horizon"] if inputs else [])
    scored = C.score_samples(samples, factory, by, parts, scaling, carry=carry)
    rows = C.scored_long(scored, by, spec.pred_feats, spec.window, inputs, coarseness, reduce_inputs)
    if convert is not None:
        rows = convert_scored(rows, params, convert, spec.pred_feats, keys)
    return error_columns(rows, by)


def verify_sequences(dynamic: DataFrame, static: DataFrame, spec: S.SampleSpec, factory: C.Factory,
                     evaluators: Sequence[str], feat: str, scaling: C.Scaling = C.Scaling(),
                     limit: tuple[Sequence[str], int] | None = None, conditions: dict[str, Sequence[str]] | None = None,
                     static_conditions: Sequence[str] = ("m_valid",), inputs: Sequence[str] = (),
                     keys: Sequence[str] = PIXEL, reuse: bool = True, coarseness: int = 1, convert: str | None = None,
                     reduce_inputs: str = "mean", store: Store | None = None, **setup) -> dict[str, DataFrame]:
    """Samples -> scores -> evaluators, with `store` also kept; then the results are those that were stored.

    Static conditions are met before any dynamic row is read; sample conditions before scoring. With
    `reuse`, the scored rows are written once to the checkpoint folder and every evaluator reads them there. A unit
    conversion takes porosity and wilting point from `static`.
    """
    pixels = Q.filter_static_all(static, static_conditions)
    samples = S.make_samples(dynamic, pixels, spec, keys, limit=limit)
    if conditions:
        samples = Q.filter_samples(samples, **conditions)
    by = [*keys, "sample"]
    errors = score(samples, factory, spec, by, scaling, inputs, coarseness, convert, static, keys, reduce_inputs)
    if reuse:
        errors = cut_lineage(errors)
    results = evaluate(errors, evaluators, Evaluation(static, feat, by, coarseness=coarseness, keys=keys, **setup))
    return results if store is None else store.keep(results, feat)
