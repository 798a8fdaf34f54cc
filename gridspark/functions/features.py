"""Feature selection, recipes, scaling and unit conversion on wide tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from .expressions import col, ratio


class UnknownFeature(ValueError):
    """A feature is neither stored nor given by a recipe."""


def recipe_args(recipe: str) -> set[str]:
    """Column names a recipe reads (identifiers that are not function calls)."""
    return set(re.findall(r"\b[a-zA-Z_]\w*\b(?!\s*\()", re.sub(r"'[^']*'|\b\d[\w.]*", " ", recipe)))


def derive_feats(df: DataFrame, recipes: Mapping[str, str], names: Iterable[str] | None = None) -> DataFrame:
    """Add derived features from SQL recipes over stored columns; a recipe may not use another recipe."""
    wanted = {n: recipes[n] for n in (recipes if names is None else names)}
    stored = {c.lower() for c in df.columns}
    for name, recipe in wanted.items():
        nested = {a for a in recipe_args(recipe) if a in recipes and a.lower() not in stored}
        if nested:
            raise UnknownFeature(f"recipe {name} uses derived features {sorted(nested)}")
    return df.withColumns({n: F.expr(r) for n, r in wanted.items()})


def project_feats(df: DataFrame, out_feats: Sequence[str], recipes: Mapping[str, str] | None = None,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Select features in the order given, stored or derived; unknown ones are an error before any job."""
    recipes = recipes or {}
    missing = [f for f in out_feats if f not in df.columns and f not in recipes]
    if missing:
        raise UnknownFeature(f"neither stored nor derived: {missing}")
    derived = [f for f in out_feats if f not in df.columns]
    out = derive_feats(df, recipes, derived) if derived else df
    return out.select(*keys, *out_feats)


def add_expression(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """Feature given by any expression of the source columns."""
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def normalize(df: DataFrame, coeffs: Mapping[str, tuple[float, float]], feats: Iterable[str]) -> DataFrame:
    """(x - mean) / std per feature; features without coefficients keep (0, 1)."""
    pick = {f: coeffs.get(f, (0.0, 1.0)) for f in feats}
    return df.withColumns({f: (F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, (m, s) in pick.items()})


def denormalize(df: DataFrame, coeffs: Mapping[str, tuple[float, float]], feats: Iterable[str],
                increments: Iterable[str] = ()) -> DataFrame:
    """Inverse of `normalize`; columns in `increments` are differences and only take the scale.

    `increments` may be a mapping from column to the feature whose scale applies.
    """
    pick = {f: coeffs.get(f, (0.0, 1.0)) for f in feats}
    cols = {f: F.col(f) * F.lit(float(s)) + F.lit(float(m)) for f, (m, s) in pick.items()}
    owners = increments if isinstance(increments, Mapping) else {c: c for c in increments}
    for column, feat in owners.items():
        cols[column] = F.col(column) * F.lit(float(coeffs.get(feat, (0.0, 1.0))[1]))
    return df.withColumns(cols)


def gaussian_coeffs(table: Mapping[str, tuple] = vocab.DYNAMIC_COEFFS) -> dict[str, tuple[float, float]]:
    """(mean, std) part of a coefficient table."""
    return {k: (v[-2], v[-1]) for k, v in table.items()}


def _conversion(value: Column, feat: str, direction: str) -> Column:
    depth = F.lit(vocab.layer_depth(feat))
    wilt, room = F.col("wiltingp"), F.col("porosity") - F.col("wiltingp")
    if direction == "rsm_to_soilm":
        return (value * room + wilt) * 1000 * depth
    if direction == "soilm_to_rsm":
        return ratio(value / depth / 1000 - wilt, room)
    raise ValueError("direction must be rsm_to_soilm or soilm_to_rsm")


def convert_units(df: DataFrame, direction: str, states: Mapping[str, str] = {},
                  increments: Mapping[str, tuple[str, str]] = {}) -> DataFrame:
    """Convert soil moisture between area density and relative moisture, using porosity and wilting point.

    `states` maps column -> feature label. `increments` maps column -> (accumulated state column, feature
    label): an increment is the difference of the converted states after and before the step, so with the
    accumulated state at hand neither a window nor a second pass is needed.
    """
    cols = {c: _conversion(F.col(c), feat, direction) for c, feat in states.items()}
    for c, (after, feat) in increments.items():
        cols[c] = (_conversion(F.col(after), feat, direction)
                   - _conversion(F.col(after) - F.col(c), feat, direction))
    return df.withColumns(cols)


def convert_scored(rows: DataFrame, params: DataFrame, direction: str, feats: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Convert scored long rows (feat, true_prev, true_state, pred_res) to the other unit, before errors are taken.

    `params` has porosity and wiltingp by `keys`. The conversion is linear, so an increment takes its slope alone.
    """
    depth = F.lit(None).cast("double")
    for f in feats:
        depth = F.when(F.col("feat") == f, F.lit(float(vocab.layer_depth(f)))).otherwise(depth)
    wilt, room = F.col("wiltingp"), F.col("porosity") - F.col("wiltingp")
    if direction == "rsm_to_soilm":
        state, change = (lambda v: (v * room + wilt) * 1000 * depth), (lambda v: v * room * 1000 * depth)
    elif direction == "soilm_to_rsm":
        state, change = (lambda v: ratio(v / depth / 1000 - wilt, room)), (lambda v: ratio(v / depth / 1000, room))
    else:
        raise ValueError("direction must be rsm_to_soilm or soilm_to_rsm")
    joined = rows.join(params.select(*keys, "porosity", "wiltingp"), list(keys))
    return joined.withColumns({"true_prev": state(F.col("true_prev")), "true_state": state(F.col("true_state")),
                               "pred_res": change(F.col("pred_res"))}).select(*rows.columns)


def unpivot_feats(df: DataFrame, keys: Sequence[str], feats: Sequence[str], name: str = "feat",
                  value: str = "value") -> DataFrame:
    """Wide -> long form, one row per feature."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in feats)
    return df.select(*keys, F.expr(f"stack({len(feats)}, {pairs}) AS ({name}, {value})"))


def coeff_table(spark, coeffs: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Coefficients as a table of fixed size, for long-form scaling."""
    rows = ", ".join(f"('{k}', {float(m)!r}D, {float(s)!r}D)" for k, (m, s) in coeffs.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS coeffs(feat, mean, std)")


def normalize_long(df: DataFrame, coeffs: Mapping[str, tuple[float, float]], value: str = "value",
                   feat: str = "feat") -> DataFrame:
    """`normalize` for (feat, value) rows."""
    table = F.broadcast(coeff_table(df.sparkSession, coeffs).withColumnRenamed("feat", feat))
    mean, std = F.coalesce("mean", F.lit(0.0)), F.coalesce("std", F.lit(1.0))
    return df.join(table, feat, "left").withColumn(value, (col(value) - mean) / std).drop("mean", "std")
