"""Weights for ensembles, quantiles from whatever a forecast has, and parameter searches over whole training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.functions import metrics as M
from foresift.functions.special import z
from foresift.operators.folds import Protocol, splits


def weighted(fc: DataFrame, weights: dict[str, float] | Column, alpha: float = 0.1) -> DataFrame:
    """``series_id, fold, h, y_pred, lo, hi``: means of the models' forecasts and bounds.

    Explicit ``weights`` name models; others have no part, and a model without a row at a step leaves its weight to the
    rest. A column is a score of a model's rows in a fold (say ``metrics.winkler(0.1)``): its inverse weighs the model in the
    fold after, so the first fold has no rows.
    """
    if isinstance(weights, dict):
        rows = fc.withColumn("w", F.coalesce(*[F.when(F.col("model") == m, F.lit(float(w))) for m, w in weights.items()])).where("w IS NOT NULL")
    else:
        scores = fc.groupBy("model", "series_id", (F.col("fold") + 1).alias("fold")).agg((1 / (weights + 1e-9)).alias("w"))
        rows = fc.join(scores, ["model", "series_id", "fold"])
    return rows.groupBy("series_id", "fold", "h").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("y_pred", "lo", "hi")])


def pooled(paths: DataFrame) -> DataFrame:
    """``series_id, fold, h, samples`` of ``model, series_id, fold, h, samples``: all models' samples in one array, cut to as many of each, in the order of the models."""
    short = paths.groupBy("series_id", "fold", "h").agg(F.array_sort(F.collect_list(F.struct("model", "samples"))).alias("m"), F.min(F.size("samples")).alias("n"))
    return short.select("series_id", "fold", "h", F.flatten(F.transform("m", lambda m: F.slice(m["samples"], 1, F.col("n")))).alias("samples"))


def at_level(values: Column, q: float) -> Column:
    """The quantile of an array's values, linear between neighbours; null of no values."""
    sorted_ = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    r = F.lit(q) * (F.size(sorted_) - 1)
    low, high = (F.get(sorted_, of(r).cast("int")) for of in (F.floor, F.ceil))
    return low + (high - low) * (r - F.floor(r))


def forecast_quantile(q: float, levels: tuple[float, ...], alpha: float = 0.1) -> Column:
    """Quantile of a row's forecast: from its ``samples``, else from its ``quantiles`` at ``levels`` (held beyond the outer ones), else from the normal distribution of ``y_pred, lo, hi`` of level 1 - ``alpha``."""
    k = max([i for i, level in enumerate(levels) if level <= q], default=-1)
    at = lambda i: F.get("quantiles", F.lit(i))
    if k < 0 or k == len(levels) - 1:
        between = at(max(k, 0))
    else:
        between = at(k) + (at(k + 1) - at(k)) * (q - levels[k]) / (levels[k + 1] - levels[k])
    return F.coalesce(at_level(F.col("samples"), q), between, M.p() + z(q) * (M.hi() - M.lo()) / (2 * z(1 - alpha / 2)))


def search(panel: DataFrame, p: Protocol, alphas: tuple[float, ...], blends: tuple[float, ...]) -> DataFrame:
    """``series_id, alpha, blend, mae`` of (1 - blend) times a smoothed level plus blend times the value a season before, over all folds.

    Levels are smoothed over all training values from the first on. Every row is weighted once for each ``alpha``, towards
    the next fold's end; what lies before earlier ends fades from end to end.
    """
    folds = splits(panel, p)
    ends = folds.groupBy(F.col("series_id").alias("s")).agg(F.array_sort(F.collect_list(F.struct("te", "fold", "tr_lo"))).alias("ends"))
    a = F.col("alpha")
    rows = panel.join(ends, F.col("series_id") == F.col("s")).withColumn("end", F.array_min(F.transform(F.filter("ends", lambda e: e["te"] > F.col("t")), lambda e: e["te"]))).where("end IS NOT NULL")
    grid = rows.select("series_id", "t", "y", "end", F.explode(F.array(*[F.lit(x) for x in alphas])).alias("alpha"))
    weight = F.when(F.col("t") == 0, F.lit(1.0)).otherwise(a) * F.pow(1 - a, (F.col("end") - 1 - F.col("t")).cast("double"))
    parts = grid.groupBy("series_id", "alpha", "end").agg(F.sum(weight * F.col("y")).alias("part"))
    level = folds.join(parts, "series_id").where("end <= te").groupBy("series_id", "fold", "te", "alpha").agg(F.sum(F.col("part") * F.pow(1 - a, (F.col("te") - F.col("end")).cast("double"))).alias("level"))
    season = panel.select("series_id", (F.col("t") + p.season).alias("t"), F.col("y").alias("past"))
    back = F.col("te") + (F.col("t") - F.col("te")) % p.season
    steps = level.join(panel.select("series_id", "t", "y"), "series_id").where((F.col("t") >= F.col("te")) & (F.col("t") < F.col("te") + p.horizon)).withColumn("at", back)
    steps = steps.join(season.withColumnRenamed("t", "at"), ["series_id", "at"]).withColumn("blend", F.explode(F.array(*[F.lit(x) for x in blends])))
    return steps.groupBy("series_id", "alpha", "blend").agg(F.avg(F.abs(F.col("y") - (1 - F.col("blend")) * F.col("level") - F.col("blend") * F.col("past"))).alias("mae"))


def log_grid(low: float, high: float, n: int) -> tuple[float, ...]:
    """``n`` values from low to high, each the same factor above the last."""
    return tuple(round(low * (high / low) ** (k / (n - 1)), 6) for k in range(n))
