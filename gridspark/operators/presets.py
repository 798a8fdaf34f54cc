"""Joint histograms that are asked for by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import vocab
from .verification import joint_histogram

_WET = "CASE WHEN apcp > 0.01D THEN {} / apcp END"


def preset(name: str, feat: str, bins: int = 128) -> dict:
    """Arguments of `joint_histogram` for a preset and the feature evaluated."""
    bounds = lambda label: (*map(float, vocab.HIST_BOUNDS[label]), bins)
    ratio_bounds = (-0.4, 1.5, bins)
    table = {
        "true-pred": lambda: dict(
            ax1=("true_res", *bounds(f"res_{feat}")), ax2=("pred_res", *bounds(f"res_{feat}"))),
        "saturation-error": lambda: dict(
            ax1=("true_state", *bounds(feat)), ax2=("err_res", *bounds(f"err_res_{feat}"))),
        "infiltration": lambda: dict(
            ax1=(_WET.format("true_res"), *ratio_bounds), ax2=(_WET.format("pred_res"), *ratio_bounds),
            covariate="true_state"),
        "state-increment": lambda: dict(
            ax1=("true_state", *bounds(feat)), ax2=("true_res", *bounds(f"res_{feat}")), covariate="err_res"),
        "humidity-temp": lambda: dict(
            ax1=("spfh", *bounds("spfh")), ax2=("tmp", *bounds("tmp")), covariate="err_res"),
        "snow-temp": lambda: dict(
            ax1=("weasd", *bounds("weasd")), ax2=("tmp", *bounds("tmp")), covariate="err_res"),
        "snow-increment": lambda: dict(
            ax1=("weasd", *bounds("weasd")), ax2=("true_res", *bounds(f"res_{feat}")), covariate="err_res"),
    }
    if name not in table:
        raise ValueError(f"preset must be one of {sorted(table)}")
    return table[name]()


def hist_preset(errors: DataFrame, name: str, feat: str, bins: int = 128, absolute: bool = False) -> DataFrame:
    """Preset histogram of one predicted feature; `errors` also carries the inputs the preset reads."""
    rows = errors.where(errors["feat"] == feat)
    return joint_histogram(rows, absolute=absolute, **preset(name, feat, bins))
