"""Monthly pixel statistics and histograms of stored and derived features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import PIXEL, vocab
from ..functions.features import UnknownFeature, derive_feats, recipe_args
from ..operators.joins import join_static
from ..operators.statistics import gridhist_monthly, gridstats_monthly


def monthly_statistics(dynamic: DataFrame, static: DataFrame, feats: Sequence[str],
                       recipes: Mapping[str, str] = vocab.RECIPES,
                       bounds: Mapping[str, tuple[float, float]] = vocab.HIST_BOUNDS, bins: int = 512,
                       mask: str = "m_valid", keys: Sequence[str] = PIXEL) -> dict[str, DataFrame]:
    """`stats` and `hist` tables over the valid pixels.

    Derived features bring in only the static columns their recipes read. A feature that is neither stored
    nor derived, or a histogram without bounds, is an error before any job.
    """
    derived = [f for f in feats if f not in dynamic.columns]
    missing = [f for f in derived if f not in recipes] + [f for f in feats if f not in bounds]
    if missing:
        raise UnknownFeature(f"no source, recipe or bounds for {missing}")
    wanted = {a for f in derived for a in recipe_args(recipes[f])} & set(static.columns) - set(dynamic.columns)
    rows = join_static(dynamic, static.where(F.col(mask)), keys, sorted(wanted))
    rows = derive_feats(rows, recipes, derived) if derived else rows
    return {"stats": gridstats_monthly(rows, feats, keys),
            "hist": gridhist_monthly(rows, {f: bounds[f] for f in feats}, bins, keys)}
