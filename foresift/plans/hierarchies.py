"""Queries of reconciliation by covariance and by sample, and of backtested hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresift.operators import forecasters, hier_folds, hierarchy, reconcile
from foresift.operators.folds import REVENUE
from foresift.plans.common import CTES, query, sql_tied, tied
from foresift.plans.monitoring import _ALL, _TREE, LEVELS, _base, _passes, _tree
from foresift.sources import panels, store

CTES["nodes_y"] = _ALL
CTES["npanel"] = """SELECT g.node AS series_id, g.ds, (row_number() OVER (PARTITION BY g.node ORDER BY g.ds) - 1)::BIGINT AS t, coalesce(o.y, 0.0::DOUBLE) AS y
  FROM (SELECT n.node, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS ds FROM (SELECT DISTINCT node FROM nodes_y) n, (SELECT min(ds) AS lo, max(ds) AS hi FROM nodes_y)) g
  LEFT JOIN nodes_y o ON g.node = o.node AND g.ds = o.ds"""
CTES["nfolds"] = """SELECT series_id, (i - 1)::BIGINT AS fold, te FROM (SELECT series_id, generate_series(greatest(104, n - 16), n - 4, 4) AS tes FROM (SELECT series_id, count(*) AS n FROM npanel GROUP BY 1)), unnest(tes) WITH ORDINALITY AS u(te, i) WHERE i <= 4"""
CTES["nfc"] = """SELECT f.series_id AS node, fold, h::BIGINT AS h, te + h - 1 AS t, y_pred FROM nfolds f, range(1, 5) r(h), (SELECT series_id, t AS u, quantile_cont(y, 0.5) OVER (PARTITION BY series_id ORDER BY t ROWS 7 PRECEDING) AS y_pred FROM npanel) p
  WHERE p.series_id = f.series_id AND u = te - 1"""


def _panel(spark, sf_dir) -> DataFrame:
    """Every node of the revenue hierarchy as a weekly series, 0 where there is none."""
    nodes = hierarchy.aggregate(panels.weekly_revenue(spark, sf_dir), LEVELS).select(F.col("node").alias("series_id"), "ds", "y")
    return store.kept(panels.regularize(nodes, "DAY", 7).withColumn("y", F.coalesce("y", F.lit(0.0))))


def _residuals(spark, sf_dir) -> DataFrame:
    """Differences over four weeks, standing in for the errors of one step."""
    moves = _panel(spark, sf_dir).withColumn("e", F.col("y") - F.lag("y", 4).over(Window.partitionBy("series_id").orderBy("t")))
    return moves.where("e IS NOT NULL").select(F.col("series_id").alias("node"), F.col("t").alias("ds"), "e")


_PAIRS = """SELECT a.node AS i, b.node AS j, sum(a.e * b.e) / (count(*) - 1) AS s, avg(a.e * b.e * a.e * b.e) AS q FROM cent a JOIN cent b ON a.t = b.t GROUP BY 1, 2"""
CTES["cent"] = """SELECT node, t, e - avg(e) OVER (PARTITION BY node) AS e FROM (SELECT series_id AS node, t, y - lag(y, 4) OVER (PARTITION BY series_id ORDER BY t) AS e FROM npanel) WHERE e IS NOT NULL"""


@query("shrink_cov", f"""SELECT i, j, round(CASE WHEN i = j THEN s ELSE (1 - lam) * s END / 1e6, 3) + 0.0::DOUBLE AS w FROM ({_PAIRS}), (
  SELECT greatest(least(sum(q - s * s) / greatest(sum(CASE WHEN i <> j THEN s * s ELSE 0 END), 1e-12), 1), 0) AS lam FROM ({_PAIRS}))""")  # fmt: skip
def shrink_cov(spark, sf_dir):
    return reconcile.shrunk_covariance(_residuals(spark, sf_dir)).select("i", "j", (F.round(F.col("w") / 1e6, 3) + 0.0).alias("w"))


@query("recon_mint")
def recon_mint(spark, sf_dir):
    _, base = _base(spark, sf_dir)
    return reconcile.reconcile("mint_shrink", base, _tree(spark, sf_dir), residuals=_residuals(spark, sf_dir))


@query("recon_ridge", _passes("1.0::DOUBLE", ridge="0.5::DOUBLE"))
def recon_ridge(spark, sf_dir):
    _, base = _base(spark, sf_dir)
    return reconcile.reconcile("ridge", store.kept(base), store.kept(_tree(spark, sf_dir)), lam=0.5).withColumn("y", F.round("y", 1))


_PATHS = f"""SELECT series_id AS bottom, 4 - (n - t - 1) % 4 AS h, (n - t - 1) // 4 AS sample, y FROM npanel, (SELECT max(t) + 1 AS n FROM npanel) WHERE n - t <= 20 AND series_id IN (SELECT bottom FROM ({_TREE}))"""


def _paths(spark, sf_dir) -> DataFrame:
    """``bottom, h, sample, y``: the last five spans of four weeks of each bottom, as paths of the next."""
    panel = _panel(spark, sf_dir).join(_tree(spark, sf_dir).select(F.col("bottom").alias("series_id")).distinct(), "series_id", "left_semi")
    back = F.max("t").over(Window.partitionBy("series_id")) - F.col("t")
    rows = panel.withColumn("back", back).where("back < 20")
    return rows.select(F.col("series_id").alias("bottom"), (4 - F.col("back") % 4).alias("h"), F.expr("back div 4").alias("sample"), "y")


@query("recon_samples_bu", f"SELECT node, h, sample, round(sum(y), 4) AS y FROM ({_PATHS}) JOIN ({_TREE}) USING (bottom) GROUP BY 1, 2, 3")
def recon_samples_bu(spark, sf_dir):
    """Each path by itself: step and sample are the key of the reconciliation."""
    base = _paths(spark, sf_dir).select(F.col("bottom").alias("node"), F.struct("h", "sample").alias("ds"), F.col("y").alias("y_pred"))
    return reconcile.reconcile("bu", base, _tree(spark, sf_dir)).select("node", "ds.h", "ds.sample", F.round("y", 4).alias("y"))


@query("recon_permbu", f"""SELECT node, h, place AS sample, round(sum(y), 4) AS y FROM ({_PATHS}) JOIN (SELECT bottom, sample, row_number() OVER (PARTITION BY bottom ORDER BY md5('0/' || bottom || '/' || sample), sample) - 1 AS place
  FROM (SELECT DISTINCT bottom, sample FROM ({_PATHS}))) USING (bottom, sample) JOIN ({_TREE}) USING (bottom) GROUP BY 1, 2, 3""")  # fmt: skip
def recon_permbu(spark, sf_dir):
    return reconcile.permuted_bottom_up(_paths(spark, sf_dir), _tree(spark, sf_dir)).withColumn("y", F.round("y", 4))


_KEYED = "SELECT node, level, fold * 10 + h AS ds, y_pred FROM nfc JOIN (SELECT DISTINCT node, level FROM nodes_y) USING (node)"
_CUM = "(SELECT node, fold, sum(y) AS past FROM (SELECT series_id AS node, fold, te FROM nfolds) f JOIN npanel p ON p.series_id = f.node AND p.t < te GROUP BY 1, 2)"
CTES["hier"] = f"""SELECT method, x.node, level, x.fold, x.h, c.t, a.y AS y_true, c.y_pred AS y_base, x.y_pred FROM (
  SELECT 'bu' AS method, t.node, fold, h, sum(y_pred) AS y_pred FROM nfc b JOIN ({_TREE}) t ON t.bottom = b.node GROUP BY ALL
  UNION ALL SELECT 'td', s.node, fold, h, s.past / a.past * y_pred FROM {_CUM} s JOIN {_CUM} a USING (fold) JOIN nfc b USING (fold) WHERE a.node = 'TOTAL' AND b.node = 'TOTAL'
  UNION ALL SELECT 'wls', node, ds // 10, ds % 10, y FROM ({_passes("n_bottom::DOUBLE", _KEYED, digits=9)})) x
  JOIN nfc c ON c.node = x.node AND c.fold = x.fold AND c.h = x.h JOIN npanel a ON a.series_id = x.node AND a.t = c.t JOIN (SELECT DISTINCT node, level FROM nodes_y) l ON l.node = x.node"""
_REPORT = "SELECT method, level, count(DISTINCT node) AS n_series, avg(abs(y_true - y_base)) AS mae_base, avg(abs(y_true - y_pred)) AS mae_recon FROM hier GROUP BY 1, 2"


def _results(spark, sf_dir, *methods: str) -> DataFrame:
    return hier_folds.hier_backtest(_panel(spark, sf_dir), store.kept(_tree(spark, sf_dir)), REVENUE, forecasters.recent_median, methods)


@query("hier_backtest", f"SELECT method, node, level, fold, h, t, round(y_true, 4) AS y_true, round(y_base, 5) AS y_base, {sql_tied('y_pred', 2)} AS y_pred FROM hier")
def hier_backtest(spark, sf_dir):
    rows = _results(spark, sf_dir, "bu", "td", "wls")
    return rows.withColumns({"y_true": F.round("y_true", 4), "y_base": F.round("y_base", 5), "y_pred": tied(F.col("y_pred"), 2)})


@query("hier_report", f"SELECT method, level, n_series, round(mae_base, 3) AS mae_base, round(mae_recon, 3) AS mae_recon, round((1 - mae_recon / mae_base) * 100, 5) AS delta FROM ({_REPORT})")
def hier_report(spark, sf_dir):
    by = hier_folds.hier_report(_results(spark, sf_dir, "bu", "td", "wls"))
    return by.withColumns({"mae_base": F.round("mae_base", 3), "mae_recon": F.round("mae_recon", 3), "delta": F.round("delta", 5)})


@query("best_method_per_level", f"""SELECT level, arg_min(method, struct_pack(d := d, m := method)) AS method, round(-min(d), 5) AS delta FROM (
  SELECT level, method, round(-(1 - mae_recon / mae_base) * 100, 6) AS d FROM ({_REPORT})) GROUP BY 1""")  # fmt: skip
def best_method_per_level(spark, sf_dir):
    return hier_folds.best_by_level(hier_folds.hier_report(_results(spark, sf_dir, "bu", "td", "wls"))).withColumn("delta", F.round("delta", 5))


@query("hier_backtest_mint")
def hier_backtest_mint(spark, sf_dir):
    return hier_folds.hier_report(_results(spark, sf_dir, "mint_shrink"))
