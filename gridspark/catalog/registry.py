"""Registry of checked queries and the SQL of the fixture views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.expressions import col

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows on the same tables."""
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = _settled_sql(sql)
        return fn
    return keep


# Sums differ in their last bits with the order of addition, so a value half way between two decimals would
# round either way. Both sides add the same tiny amount, well above that noise and below the digits compared.

def settled(value, digits: int = 6) -> Column:
    """Rounded value for comparison."""
    return F.round(col(value) + F.lit(10.0 ** -(digits + 2)), digits)


def r6(*names: str) -> list[Column]:
    return [settled(n).alias(n) for n in names]


def _settled_sql(sql: str) -> str:
    """`round(e, n)` -> `(round((e) + tiny, n) + 0)`; the last part turns a negative zero into zero."""
    out, at = [], 0
    for found in re.finditer(r"\bround\(", sql):
        depth, i, comma = 1, found.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        digits = int(sql[comma + 1:i - 1])
        out += [sql[at:found.start()], "(round((", sql[found.end():comma], f") + {10.0 ** -(digits + 2)!r}::DOUBLE",
                sql[comma:i], " + 0)"]
        at = i
    return "".join(out) + sql[at:]


def _values(columns, rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v!r}"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


DYNAMIC = """
fx_dynamic AS (
  SELECT CAST(floor(l_suppkey / 10) AS INT) AS y, CAST(l_suppkey % 10 AS INT) AS x, step,
         TIMESTAMP '2020-01-01 00:00:00' + INTERVAL '29' HOUR * step AS t,
         230 + (l_orderkey % 1000) / 10.0e0 AS tmp, (l_orderkey % 300) / 10000.0e0 AS spfh,
         CASE WHEN l_quantity > 40 THEN l_quantity / 10 ELSE 0.0e0 END AS apcp,
         l_discount * 100 - 5 AS ugrd, l_tax * 100 - 4 AS vgrd, (l_partkey % 70) / 10.0e0 AS lai,
         4 + (l_partkey % 390) / 10.0e0 AS soilm_10, 8 + (l_orderkey * 7 % 1150) / 10.0e0 AS soilm_40,
         12 + (l_partkey * 11 % 2250) / 10.0e0 AS soilm_100, 20 + (l_orderkey * 13 % 4400) / 10.0e0 AS soilm_200,
         CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0e0 END AS weasd
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey
          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INT) AS step
        FROM lineitem) s)"""

GAPPED = """
fx_gapped AS (
  SELECT * FROM fx_dynamic WHERE (step * 7 + x * 3 + y) % 13 <> 5
  UNION ALL SELECT * FROM fx_dynamic WHERE (step * 7 + x * 3 + y) % 13 <> 5 AND (step + y) % 17 = 3)"""

STATIC = """
fx_static AS (
  SELECT CAST(floor(s_suppkey / 10) AS INT) AS y, CAST(s_suppkey % 10 AS INT) AS x,
         25 + floor(s_suppkey / 10) * 0.125e0 AS lat, -125 + (s_suppkey % 10) * 0.125e0 AS lon,
         CAST(s_suppkey % 10 <> 3 AS BOOLEAN) AS m_valid, CAST(s_nationkey % 14 AS INT) AS int_veg,
         CAST(1 + s_suppkey % 12 AS INT) AS int_soil, abs(s_acctbal) AS elev
  FROM supplier)"""

TEXTURE = "tex AS " + _values(
    "int_soil, texture, texture_short, pct_sand, pct_silt, pct_clay, porosity, wiltingp, vegstress",
    [(k, v[0], v[1], *[None if q is None else float(q) for q in v[2:]]) for k, v in vocab.TEXTURES.items()])
VEGETATION = "vegdim AS " + _values(
    "int_veg, vegetation, lai_lo, lai_hi, rsmin", [(k, *v) for k, v in vocab.VEGETATION.items()])
PARAMS = STATIC + ",\n" + TEXTURE + """,
fx_params AS (SELECT * FROM fx_static JOIN tex USING (int_soil))"""

SCORED = DYNAMIC + """,
fx_wide AS (
  SELECT *, CAST(floor((step - 1) / 24.0e0) AS INT) AS init, CAST((step - 1) % 24 + 1 AS INT) AS h,
         lag(soilm_10) OVER (PARTITION BY y, x ORDER BY step) AS p10,
         lag(soilm_40) OVER (PARTITION BY y, x ORDER BY step) AS p40,
         count(*) OVER (PARTITION BY y, x, CAST(floor((step - 1) / 24.0e0) AS INT)) AS n
  FROM fx_dynamic),
fx_long AS (
  SELECT y, x, init, h, t, tmp, spfh, apcp, weasd, 'soilm_10' AS feat, p10 AS prev, soilm_10 AS v FROM fx_wide
   WHERE p10 IS NOT NULL AND n = 24
  UNION ALL
  SELECT y, x, init, h, t, tmp, spfh, apcp, weasd, 'soilm_40' AS feat, p40 AS prev, soilm_40 AS v FROM fx_wide
   WHERE p40 IS NOT NULL AND n = 24),
fx_scored AS (
  SELECT y, x, init, h AS step, t, tmp, spfh, apcp, weasd, feat, prev AS true_prev, v AS true_state,
         0.8e0 * (v - prev) + (h % 5 - 2) * 0.05e0 AS pred_res
  FROM fx_long)"""

ERRORS = SCORED + """,
fx_state AS (
  SELECT *, true_state - true_prev AS true_res,
         first_value(true_prev) OVER w + sum(pred_res) OVER w AS pred_state
  FROM fx_scored
  WINDOW w AS (PARTITION BY y, x, init, feat ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fx_err AS (SELECT *, pred_state - true_state AS err_state, pred_res - true_res AS err_res FROM fx_state)"""

ARRAY = "fx_array AS (SELECT vec_id AS sample_id, label AS cls, embedding AS seq FROM embeddings)"


def with_views(*views: str, body: str) -> str:
    joined = ",\n".join(v.strip() for v in views)
    return f"WITH {joined}\n{body.strip()}"


def bin_sql(v: str, lo: float, hi: float, n: int) -> str:
    """Saturating bin index in SQL."""
    lo, hi = float(lo), float(hi)
    return (f"CAST(least(greatest(floor((least(greatest({v}, {lo!r}::DOUBLE), {hi!r}::DOUBLE) - ({lo!r}::DOUBLE)) / "
            f"{hi - lo!r}::DOUBLE * {n}), 0), {n - 1}) AS INT)")

