"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """Quotient that is null where the denominator is zero or missing."""
    return F.try_divide(col(num), col(den))


# --- binning --------------------------------------------------------------------------------------

def bin_index(value: Column | str, lo: float, hi: float, bins: int) -> Column:
    """Saturating bin of a value: outside values go to the end bins, null and NaN stay null."""
    v = F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    inside = F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))
    raw = F.floor((inside - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) * F.lit(bins))
    return F.when(v.isNotNull(), F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).cast("int")


def bin_center(index: Column | str, lo: float, hi: float, bins: int) -> Column:
    return F.lit(float(lo)) + (col(index) + F.lit(0.5)) * F.lit((float(hi) - float(lo)) / bins)


# --- categoricals ---------------------------------------------------------------------------------

def one_hot(*classes: tuple[Column | str, int]) -> Column:
    """0/1 vector of one or more (class column, size) pairs, concatenated in order."""
    def vector(c: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == c).cast("int"))
    parts = [vector(col(c), size) for c, size in classes]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def one_hot_decode(vector: Column | str) -> Column:
    """Class of a 0/1 vector; null where no element is set."""
    position = F.array_position(col(vector), F.lit(1))
    return F.when(position > 0, position - 1).cast("int")


# --- calendar -------------------------------------------------------------------------------------

def hour_of_day(t: Column | str) -> Column:
    """Hour rounded at the half hour, so that float noise around the full hour does no harm."""
    return F.hour(col(t) + F.expr("INTERVAL 30 MINUTES"))


def day_of_year(t: Column | str) -> Column:
    """Zero-based day of the year, 0..365."""
    return F.dayofyear(col(t)) - 1


def season(t: Column | str) -> Column:
    m = F.month(col(t))
    return (
        F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")
    )


def quarter_season(q: Column | str) -> Column:
    """Season group of a calendar quarter: 1, 4 are cold; 2, 3 are warm."""
    return F.when(col(q).isin(1, 4), "cold").when(col(q).isin(2, 3), "warm")


def step_of(t: Column | str, first: str, step_seconds: int) -> Column:
    """Index of a time stamp on a regular axis starting at `first`."""
    seconds = F.unix_timestamp(col(t).cast("timestamp")) - F.unix_timestamp(F.lit(first).cast("timestamp"))
    return F.floor((seconds + F.lit(step_seconds // 2)) / F.lit(step_seconds)).cast("bigint")


# --- arrays ---------------------------------------------------------------------------------------

def increments(states: Column | str) -> Column:
    """Forward differences of an array: element i is `a[i+1] - a[i]`."""
    a = col(states)
    head = F.slice(a, F.lit(1), F.size(a) - 1)
    tail = F.slice(a, F.lit(2), F.size(a) - 1)
    return F.zip_with(tail, head, lambda later, earlier: later - earlier)


def accumulate(initial: Column | str, steps: Column | str) -> Column:
    """Running sum of an array of increments on top of an initial state."""
    def push(acc, step):
        return F.named_struct(
            F.lit("state"), acc["state"] + step,
            F.lit("out"), F.concat(acc["out"], F.array(acc["state"] + step)),
        )
    start = F.named_struct(
        F.lit("state"), col(initial).cast("double"), F.lit("out"), F.array().cast("array<double>")
    )
    return F.aggregate(F.transform(col(steps), lambda v: v.cast("double")), start, push, lambda acc: acc["out"])


def block_reduce(values: Column | str, size: int, how: str = "mean") -> Column:
    """Reduce every full block of `size` array elements to its min, mean or max."""
    a = F.transform(col(values), lambda v: v.cast("double"))
    reducers = {
        "min": lambda b: F.array_min(b),
        "max": lambda b: F.array_max(b),
        "mean": lambda b: F.aggregate(b, F.lit(0.0), lambda s, v: s + v) / F.lit(float(size)),
    }
    if how not in reducers:
        raise ValueError(f"how must be one of {sorted(reducers)}")
    count = F.floor(F.size(a) / F.lit(size)).cast("int")
    blocks = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(blocks, lambda i: reducers[how](F.slice(a, i * size + 1, F.lit(size))))


def array_mean(values: Column | str) -> Column:
    a = F.transform(col(values), lambda v: v.cast("double"))
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v, lambda s: F.try_divide(s, F.size(a)))


# --- pseudo-random order --------------------------------------------------------------------------

def hash_order(seed: int | str, *keys: Column | str) -> Column:
    """Reproducible pseudo-random sort key of a row, the same for any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def hash_int(seed: int | str, *keys: Column | str) -> Column:
    """First 32 bits of the hash as a non-negative integer."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    """Reproducible uniform number in [0, 1)."""
    return hash_int(seed, *keys) / F.lit(4294967296.0)


# --- small derived quantities ---------------------------------------------------------------------

def infiltration(increment: Column | str, precip: Column | str, threshold: float = 0.01,
                 otherwise: float | None = None) -> Column:
    """Share of precipitation that shows up as a state change; `otherwise` where it hardly rains."""
    wet = F.when(col(precip) > F.lit(threshold), col(increment) / col(precip))
    return wet if otherwise is None else wet.otherwise(F.lit(float(otherwise)))


def relative_error(mean_error: Column | str, mean_state: Column | str) -> Column:
    return ratio(mean_error, mean_state)


def minmax_scale(value: Column | str, lo: Column | str | float, hi: Column | str | float,
                 null_fill: float | None = None) -> Column:
    """Scale to [0, 1], clipped; `null_fill` where there is no value or no range."""
    as_col = lambda b: F.lit(float(b)) if isinstance(b, (int, float)) else col(b)
    lo, hi = as_col(lo), as_col(hi)
    scaled = F.try_divide(col(value) - lo, hi - lo)
    clipped = F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
    return clipped if null_fill is None else F.coalesce(clipped, F.lit(float(null_fill)))


def distance(lat: Column | str, lon: Column | str, at: tuple[float, float]) -> Column:
    """Distance in degrees from a (lat, lon) point."""
    return F.sqrt(F.pow(col(lat) - F.lit(float(at[0])), 2) + F.pow(col(lon) - F.lit(float(at[1])), 2))


def all_of(conditions: Sequence[Column | str]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & (F.expr(c) if isinstance(c, str) else c)
    return out


def any_of(conditions: Sequence[Column | str]) -> Column:
    if not conditions:
        return F.lit(True)
    out = F.lit(False)
    for c in conditions:
        out = out | (F.expr(c) if isinstance(c, str) else c)
    return out
