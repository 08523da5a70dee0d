"""Queries of hierarchies, data quality and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from foresift.operators import hierarchy, quality
from foresift.plans.common import query, sql_tied, tied
from foresift.sources import panels, store

LEVELS = ["region", "nation", "segment"]
_TREE = """SELECT 'TOTAL' AS node, 0::BIGINT AS level, 'region=' || region || '/nation=' || nation || '/segment=' || segment AS bottom FROM (SELECT DISTINCT region, nation, segment FROM revenue)
  UNION ALL SELECT 'region=' || region, 1, 'region=' || region || '/nation=' || nation || '/segment=' || segment FROM (SELECT DISTINCT region, nation, segment FROM revenue)
  UNION ALL SELECT 'region=' || region || '/nation=' || nation, 2, 'region=' || region || '/nation=' || nation || '/segment=' || segment FROM (SELECT DISTINCT region, nation, segment FROM revenue)
  UNION ALL SELECT 'region=' || region || '/nation=' || nation || '/segment=' || segment, 3, 'region=' || region || '/nation=' || nation || '/segment=' || segment FROM (SELECT DISTINCT region, nation, segment FROM revenue)"""
_BOTTOM = "SELECT 'region=' || region || '/nation=' || nation || '/segment=' || segment AS bottom, ds, y FROM revenue"
_ALL = f"SELECT node, level, ds, sum(y) AS y FROM ({_TREE}) JOIN ({_BOTTOM}) USING (bottom) GROUP BY 1, 2, 3"


def _tree(spark, sf_dir):
    return hierarchy.ancestors(panels.weekly_revenue(spark, sf_dir), LEVELS)


@query("summation_matrix", _TREE)
def summation_matrix(spark, sf_dir):
    return _tree(spark, sf_dir)


@query("hier_nodes", f"SELECT node, level, count(*) AS n_bottom FROM ({_TREE}) GROUP BY 1, 2")
def hier_nodes(spark, sf_dir):
    return _tree(spark, sf_dir).groupBy("node", "level").agg(F.count("*").alias("n_bottom"))


@query("hier_rollup", f"SELECT node, level, ds, round(y, 4) AS y FROM ({_ALL})")
def hier_rollup(spark, sf_dir):
    return hierarchy.aggregate(panels.weekly_revenue(spark, sf_dir), LEVELS).withColumn("y", F.round("y", 4))


_BASE = f"SELECT node, level, ds + INTERVAL 28 DAY AS ds, y * 1.01::DOUBLE ** level AS y_pred FROM ({_ALL})"


def _base(spark, sf_dir):
    """Incoherent base forecasts: the value four weeks before, raised by one percent a level."""
    nodes = hierarchy.aggregate(panels.weekly_revenue(spark, sf_dir), LEVELS)
    return nodes, nodes.select("node", (F.col("ds") + F.expr("INTERVAL 28 DAY")).alias("ds"), (F.col("y") * F.pow(F.lit(1.01), F.col("level").cast("double"))).alias("y_pred"))


@query("recon_bu", f"SELECT t.node, ds, round(sum(y_pred), 2) AS y FROM ({_BASE}) b JOIN ({_TREE}) t ON t.bottom = b.node GROUP BY 1, 2")
def recon_bu(spark, sf_dir):
    _, base = _base(spark, sf_dir)
    return hierarchy.bottom_up(base, _tree(spark, sf_dir)).withColumn("y", F.round("y", 2))


@query("recon_td", f"""SELECT node, ds, {sql_tied('p * y_pred', 2)} AS y FROM (SELECT t.node, sum(s) / (SELECT sum(y) FROM ({_BOTTOM})) AS p FROM ({_TREE}) t
  JOIN (SELECT bottom, sum(y) AS s FROM ({_BOTTOM}) GROUP BY 1) h USING (bottom) GROUP BY 1), (SELECT ds, y_pred FROM ({_BASE}) WHERE node = 'TOTAL')""")  # fmt: skip
def recon_td(spark, sf_dir):
    nodes, base = _base(spark, sf_dir)
    return hierarchy.top_down(base, _tree(spark, sf_dir), nodes).withColumn("y", tied(F.col("y"), 2))


@query("coherence_gap", f"SELECT ds, round(max(abs(o - s)), 3) AS gap FROM (SELECT b.node, b.ds, any_value(b.y_pred) AS o, sum(c.y_pred) AS s FROM ({_BASE}) b JOIN ({_TREE}) t ON t.node = b.node JOIN ({_BASE}) c ON c.node = t.bottom AND c.ds = b.ds GROUP BY 1, 2) GROUP BY 1")
def coherence_gap(spark, sf_dir):
    _, base = _base(spark, sf_dir)
    return hierarchy.coherence_gap(base.withColumnRenamed("y_pred", "y"), _tree(spark, sf_dir)).withColumn("gap", F.round("gap", 3))


def _passes(variance: str, forecasts: str = _BASE, ridge: str = "0.0::DOUBLE", digits: int = 1) -> str:
    """The two passes of hierarchy.tree_reconcile in SQL, for three levels below the total."""
    base = f"SELECT b.*, n_bottom, CASE WHEN b.level = 0 THEN NULL WHEN b.level = 1 THEN 'TOTAL' ELSE regexp_replace(b.node, '/[^/]*$', '') END AS parent, {variance} AS v FROM ({forecasts}) b JOIN (SELECT node, count(*) AS n_bottom FROM ({_TREE}) GROUP BY 1) USING (node)"
    up = [f"base AS MATERIALIZED ({base})", f"l3 AS MATERIALIZED (SELECT node, parent, ds, y_pred / (1 + {ridge} * v) AS m, v / (1 + {ridge} * v) AS var, NULL::DOUBLE AS c, NULL::DOUBLE AS vc FROM base WHERE level = 3)"]
    for k in (2, 1, 0):
        up.append(f"l{k} AS MATERIALIZED (SELECT b.node, b.parent, b.ds, (c / vc + y_pred / v) / (1 / vc + 1 / v) AS m, 1 / (1 / vc + 1 / v) AS var, c, vc FROM base b JOIN (SELECT parent AS node, ds, sum(m) AS c, sum(var) AS vc FROM l{k + 1} GROUP BY 1, 2) x USING (node, ds) WHERE level = {k})")
    down = ["f0 AS MATERIALIZED (SELECT node, ds, m AS y, c, vc FROM l0)"]
    down += [f"f{k} AS MATERIALIZED (SELECT l.node, l.ds, l.m + (p.y - p.c) / p.vc * l.var AS y, l.c, l.vc FROM l{k} l JOIN f{k - 1} p ON p.node = l.parent AND p.ds = l.ds)" for k in (1, 2, 3)]
    every = " UNION ALL ".join(f"SELECT node, ds, round(y, {digits}) AS y FROM f{k}" for k in range(4))
    return f"SELECT * FROM (WITH {', '.join(up + down)} {every})"


def _reconciled(spark, sf_dir, variance):
    _, base = _base(spark, sf_dir)
    tree = _tree(spark, sf_dir).groupBy("node", "level").agg(F.count("*").alias("n_bottom"))
    parent = F.when(F.col("level") == 1, "TOTAL").when(F.col("level") > 1, F.regexp_replace("node", "/[^/]*$", ""))
    rows = store.kept(base.join(tree, "node").withColumn("parent", parent))  # the passes read it twice a level
    return hierarchy.tree_reconcile(rows, variance(), 3).withColumn("y", F.round("y", 1))


@query("recon_ols", _passes("1.0::DOUBLE"))
def recon_ols(spark, sf_dir):
    return _reconciled(spark, sf_dir, lambda: F.lit(1.0))


@query("recon_wls", _passes("n_bottom::DOUBLE"))
def recon_wls(spark, sf_dir):
    return _reconciled(spark, sf_dir, lambda: F.col("n_bottom"))


@query("validate_schema", """SELECT 'value' AS "column", 'nonnull' AS rule, count(*) FILTER (value IS NULL) AS n_bad FROM events UNION ALL SELECT 'value', 'min', count(*) FILTER (value < 1) FROM events
UNION ALL SELECT 'value', 'max', count(*) FILTER (value > 100) FROM events UNION ALL SELECT 'event_type', 'in', count(*) FILTER (event_type NOT IN ('click', 'view')) FROM events UNION ALL SELECT 'absent', 'missing', 1""")  # fmt: skip
def validate_schema(spark, sf_dir):
    spec = {"value": {"nonnull": True, "min": 1, "max": 100}, "event_type": {"in": ["click", "view"]}, "absent": {"nonnull": True}}
    return quality.violations(panels.table(spark, sf_dir, "events"), spec)


_LONG = "SELECT 'value' AS feature, value::DOUBLE AS x, ts FROM events UNION ALL SELECT 'user_id', user_id::DOUBLE, ts FROM events"
_SIDES = f"(SELECT feature, x, ts < TIMESTAMP '2024-01-16' AS ref FROM ({_LONG}))"


def _sides(spark, sf_dir):
    """The events' values and users of the first and the second half of the month."""
    events = panels.table(spark, sf_dir, "events")
    long = events.select("ts", F.col("value").cast("double"), F.col("user_id").cast("double").alias("user_id")).unpivot(["ts"], ["value", "user_id"], "feature", "x")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return long.where(F.col("ts") < cut).select("feature", "x"), long.where(F.col("ts") >= cut).select("feature", "x")


_PSI = f"""SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM (SELECT g.feature, g.bin, greatest(coalesce(n_ref / sum(n_ref) OVER w, 0), 1e-6) AS p, greatest(coalesce(n_cur / sum(n_cur) OVER w, 0), 1e-6) AS q FROM (
  SELECT e.feature, b.bin FROM (SELECT DISTINCT feature FROM {_SIDES}) e, range(10) b(bin)) g LEFT JOIN (
  SELECT s.feature, len(list_filter(edges, lambda e: e <= x)) AS bin, count(*) FILTER (ref) AS n_ref, count(*) FILTER (NOT ref) AS n_cur FROM {_SIDES} s
  JOIN (SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM {_SIDES} WHERE ref GROUP BY 1) USING (feature) GROUP BY 1, 2) n ON n.feature = g.feature AND n.bin = g.bin
  WINDOW w AS (PARTITION BY g.feature)) GROUP BY 1"""
_KS = f"""SELECT feature, max(abs(a - b)) AS ks, any_value(n) AS n, any_value(m) AS m FROM (SELECT feature, sum(na) OVER u / sum(na) OVER w AS a, sum(nb) OVER u / sum(nb) OVER w AS b, sum(na) OVER w AS n, sum(nb) OVER w AS m FROM (
  SELECT feature, x, count(*) FILTER (ref) AS na, count(*) FILTER (NOT ref) AS nb FROM {_SIDES} GROUP BY 1, 2) WINDOW u AS (PARTITION BY feature ORDER BY x), w AS (PARTITION BY feature)) GROUP BY 1"""
_KSP = f"SELECT feature, ks, CASE WHEN ks * sqrt(n * m / (n + m)) < 0.2 THEN 1 ELSE greatest(least(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * ks * ks * n * m / (n + m)))), 1), 0) END AS p FROM ({_KS})"


@query("psi", f"SELECT feature, round(psi, 6) AS psi FROM ({_PSI})")
def psi(spark, sf_dir):
    return quality.psi(*_sides(spark, sf_dir)).withColumn("psi", F.round("psi", 6))


@query("ks_stat", f"SELECT feature, round(ks, 6) AS ks, round(p, 6) AS p FROM ({_KSP})")
def ks_stat(spark, sf_dir):
    return quality.ks(*_sides(spark, sf_dir)).withColumns({"ks": F.round("ks", 6), "p": F.round("p", 6)})


@query("drift_report", f"""SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, round(p, 6) AS p, CASE WHEN psi > 0.25 OR p < 0.01 THEN 'drift' WHEN psi > 0.10 THEN 'warn' ELSE 'ok' END AS status
FROM ({_PSI}) JOIN ({_KSP}) USING (feature)""")  # fmt: skip
def drift_report(spark, sf_dir):
    return quality.drift_report(*_sides(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("psi", "ks", "p")})


_W = "PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING"


@query("page_hinkley", f"""SELECT series_id AS key, t, round(s - least(min(s) OVER ({_W}), 0), 4) AS excess, s - least(min(s) OVER ({_W}), 0) > 50 AS fired FROM (
  SELECT *, sum(y - mean - 0.005::DOUBLE) OVER ({_W}) AS s FROM (SELECT *, avg(y) OVER ({_W}) AS mean FROM ehour))""")  # fmt: skip
def page_hinkley(spark, sf_dir):
    rows = panels.filled_hourly(spark, sf_dir).select(F.col("series_id").alias("key"), "t", F.col("y").alias("x"))
    return quality.page_hinkley(rows).select("key", "t", F.round("excess", 4).alias("excess"), "fired")
