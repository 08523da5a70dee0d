"""Shared SQL of the checks, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foresift.functions.special import ERF_A, ERF_P

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Common table expressions by name; a check's SQL may use any of them.
CTES: dict[str, str] = {
    "ehour_obs": "SELECT event_type AS series_id, date_trunc('hour', ts) AS ds, round(sum(value), 6) AS y FROM events GROUP BY 1, 2",
    "ehour_null": """SELECT g.series_id, g.ds, (row_number() OVER (PARTITION BY g.series_id ORDER BY g.ds) - 1)::BIGINT AS t, o.y
  FROM (SELECT s.series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ds
        FROM (SELECT DISTINCT series_id FROM ehour_obs) s, (SELECT min(ds) AS lo, max(ds) AS hi FROM ehour_obs)) g
  LEFT JOIN ehour_obs o ON g.series_id = o.series_id AND g.ds = o.ds""",
    "ehour": "SELECT series_id, ds, t, coalesce(y, 0.0::DOUBLE) AS y FROM ehour_null",
    "gappy": "SELECT series_id, ds, t, CASE WHEN t % 7 = 0 OR t % 50 < 4 THEN NULL ELSE y END AS y FROM ehour",
    "oday_obs": "SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ds, round(sum(o_totalprice), 6) AS y FROM orders GROUP BY 1, 2",
    "oday": """SELECT g.series_id, g.ds, (row_number() OVER (PARTITION BY g.series_id ORDER BY g.ds) - 1)::BIGINT AS t, coalesce(o.y, 0.0::DOUBLE) AS y
  FROM (SELECT s.series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ds
        FROM (SELECT DISTINCT series_id FROM oday_obs) s, (SELECT min(ds) AS lo, max(ds) AS hi FROM oday_obs)) g
  LEFT JOIN oday_obs o ON g.series_id = o.series_id AND g.ds = o.ds""",
    "pweek_obs": "SELECT l_partkey::VARCHAR AS series_id, date_trunc('week', l_shipdate)::TIMESTAMP AS ds, round(sum(l_quantity), 6) AS y FROM lineitem GROUP BY 1, 2",
    "pweek": """SELECT g.series_id, g.ds, (row_number() OVER (PARTITION BY g.series_id ORDER BY g.ds) - 1)::BIGINT AS t, coalesce(o.y, 0.0::DOUBLE) AS y
  FROM (SELECT s.series_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS ds
        FROM (SELECT DISTINCT series_id FROM pweek_obs) s, (SELECT min(ds) AS lo, max(ds) AS hi FROM pweek_obs)) g
  LEFT JOIN pweek_obs o ON g.series_id = o.series_id AND g.ds = o.ds""",
    "revenue": """SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, date_trunc('week', l_shipdate)::TIMESTAMP AS ds, round(sum(l_extendedprice * (1 - l_discount)), 4) AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4""",
    "splits": """SELECT series_id, (i - 1)::BIGINT AS fold, 0::BIGINT AS tr_lo, te, te + 24 AS ee FROM (
    SELECT series_id, generate_series(greatest(240, n - 24 - 7 * 24), n - 24, 24) AS tes FROM (SELECT series_id, count(*) AS n FROM ehour GROUP BY 1))
  , unnest(tes) WITH ORDINALITY AS u(te, i) WHERE i <= 8""",
    "steps": "SELECT series_id, fold, te, h::BIGINT AS h, te + h - 1 AS t FROM splits, range(1, 25) r(h)",
    "known": """SELECT *, stddev_pop(d) OVER w AS sigma, regr_slope(y, t) OVER w AS slope, avg(y) OVER w AS mid_y, avg(t) OVER w AS mid_t, sqrt(var_pop(y) OVER w) AS spread,
    avg(y) OVER p AS phase_y, avg(t) OVER p AS phase_t
  FROM (SELECT *, y - lag(y, 24) OVER (PARTITION BY series_id ORDER BY t) AS d FROM ehour)
  WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY series_id, t % 24 ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    "at_phase": "SELECT s.*, a.y AS last_y, a.phase_y, a.phase_t FROM steps s JOIN known a ON a.series_id = s.series_id AND a.t = s.te - 24 + (s.h - 1) % 24",
    "at_end": "SELECT s.*, b.sigma, b.slope, b.mid_y, b.mid_t, b.spread FROM at_phase s JOIN known b ON b.series_id = s.series_id AND b.t = s.te - 1",
    "ahead": "SELECT s.*, c.y AS y_true FROM at_end s JOIN ehour c ON c.series_id = s.series_id AND c.t = s.t",
    "fc": """SELECT 'seasonal_naive' AS model, series_id, fold, te, h, t, y_true, last_y AS y_pred,
    last_y - 1.6448536269514715::DOUBLE * sigma * sqrt(ceil(h / 24)) AS lo, last_y + 1.6448536269514715::DOUBLE * sigma * sqrt(ceil(h / 24)) AS hi FROM ahead
  UNION ALL
  SELECT 'trend_profile', series_id, fold, te, h, t, y_true, p, p - 1.6448536269514715::DOUBLE * spread, p + 1.6448536269514715::DOUBLE * spread
  FROM (SELECT *, mid_y + slope * (t - mid_t) + phase_y - (mid_y + slope * (phase_t - mid_t)) AS p FROM ahead)""",
}


def sql(select: str) -> str:
    """A check: the common table expressions that it needs, in order, then the select."""
    need = {k for k in CTES if re.search(rf"\b{k}\b", select)}
    for k in reversed(CTES):
        if k in need:
            need |= {x for x in CTES if x != k and re.search(rf"\b{x}\b", CTES[k])}
    ctes = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in CTES.items() if k in need)
    return (f"WITH {ctes}\n" if ctes else "") + select.strip()


def tied(x: Column, digits: int) -> Column:
    """Rounded, halves away from 0, once the noise of sums beyond nine decimals is gone: engines then agree on what lies halfway."""
    return F.round(x.cast("decimal(30,9)"), digits).cast("double")


def sql_tied(x: str, digits: int) -> str:
    """The same in SQL."""
    return f"round(({x})::DECIMAL(30,9), {digits})::DOUBLE"


def query(name: str, check: str | None = None):
    """Register a query, and its SQL if there is one; ``check`` may use CTES."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if check:
            SQL[name] = check if check.lstrip().upper().startswith("WITH RECURSIVE") else sql(check)
        return fn

    return add


def sql_norm_cdf(x: str) -> str:
    """The approximation of functions.special.norm_cdf in SQL."""
    t = f"(1 / (1 + {ERF_P}::DOUBLE * abs({x}) / sqrt(2)))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})::DOUBLE) * {t})"
    return f"(CASE WHEN {x} >= 0 THEN (2 - {poly} * exp(-({x}) * ({x}) / 2)) / 2 ELSE ({poly} * exp(-({x}) * ({x}) / 2)) / 2 END)"
