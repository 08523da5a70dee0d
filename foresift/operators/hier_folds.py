"""Backtests of a hierarchy: forecasts of every node and fold, reconciled, and scored by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.operators import hierarchy
from foresift.operators.folds import Protocol, splits
from foresift.operators.forecasters import _read, _train, by_series
from foresift.operators.reconcile import reconcile


def _dealt(panel: DataFrame, base: DataFrame, tree: DataFrame, p: Protocol) -> DataFrame:
    """Top-down within folds: a node's share is its part of the total over the fold's training rows; by number of bottoms if that is not positive."""
    seen = _read(panel.withColumn("past", F.sum("y").over(_train(p))), splits(panel, p), F.col("te") - 1, "past").select(F.col("series_id").alias("node"), "fold", "past")
    seen = seen.join(hierarchy.parents(tree).select("node", "n_bottom"), "node")
    total = seen.where("node = 'TOTAL'").select("fold", F.col("past").alias("all"), F.col("n_bottom").alias("every"))
    share = F.when(F.col("all") > 0, F.col("past") / F.nullif(F.col("all"), F.lit(0.0))).otherwise(F.col("n_bottom") / F.col("every"))
    shares = seen.join(total, "fold").select("node", "fold", share.alias("share"))
    top = base.where("node = 'TOTAL'").select("ds", F.col("ds.fold").alias("fold"), "y_pred")
    return top.join(shares, "fold").select("node", "ds", (F.col("share") * F.col("y_pred")).alias("y"))


def hier_backtest(panel: DataFrame, tree: DataFrame, p: Protocol, forecast: Callable[[DataFrame, Protocol], DataFrame], methods: tuple[str, ...]) -> DataFrame:
    """``method, node, level, fold, h, t, y_true, y_base, y_pred`` of all nodes.

    ``panel`` holds every node as a series. No method reads beyond a fold's training rows: ``td`` shares are those of
    the fold; ``mint_shrink`` has one covariance, of differences over a season before the first fold ends, standing in
    for the errors of one step.
    """
    fc = forecast(panel, p)
    base = fc.select(F.col("series_id").alias("node"), F.struct("fold", "h").alias("ds"), "y_pred")
    parts = []
    for method in methods:
        if method == "td":
            out = _dealt(panel, base, tree, p)
        elif method == "mint_shrink":
            first = splits(panel, p).groupBy("series_id").agg(F.min("te").alias("end"))
            moves = panel.withColumn("e", F.col("y") - F.lag("y", p.season).over(by_series())).join(first, "series_id")
            out = reconcile(method, base, tree, residuals=moves.where("t < end AND e IS NOT NULL").select(F.col("series_id").alias("node"), F.col("t").alias("ds"), "e"))
        else:
            out = reconcile(method, base, tree)
        parts.append(out.select(F.lit(method).alias("method"), "node", "ds.fold", "ds.h", F.col("y").alias("y_pred")))
    all_ = parts[0]
    for more in parts[1:]:
        all_ = all_.unionByName(more)
    actual = panel.select(F.col("series_id").alias("node"), "t", F.col("y").alias("y_true"))
    own = fc.select(F.col("series_id").alias("node"), "fold", "h", "t", F.col("y_pred").alias("y_base"))
    levels = tree.select("node", "level").distinct()
    rows = all_.join(own, ["node", "fold", "h"]).join(actual, ["node", "t"]).join(levels, "node")
    return rows.select("method", "node", "level", "fold", "h", "t", "y_true", "y_base", "y_pred")


def hier_report(results: DataFrame) -> DataFrame:
    """``method, level, n_series, mae_base, mae_recon, delta``: delta is the error saved, in percent of the base forecasts'."""
    error = lambda c: F.avg(F.abs(F.col("y_true") - F.col(c)))
    by = results.groupBy("method", "level").agg(F.count_distinct("node").alias("n_series"), error("y_base").alias("mae_base"), error("y_pred").alias("mae_recon"))
    return by.withColumn("delta", (1 - F.col("mae_recon") / F.nullif(F.col("mae_base"), F.lit(0.0))) * 100)


def best_by_level(report: DataFrame) -> DataFrame:
    """``level, method, delta`` of the method that saves most; ties go to the first name."""
    rank = F.struct(F.round(-F.col("delta"), 6).alias("d"), "method", "delta")
    return report.where("delta IS NOT NULL").groupBy("level").agg(F.min(rank).alias("x")).select("level", "x.method", "x.delta")
