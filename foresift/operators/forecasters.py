"""Forecasters over all folds at once.

What a forecaster needs from the training rows of a fold ending at te is a running statistic of the series, read at
position te - 1. So the panel is windowed once, whatever the number of folds, and folds join single positions.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.functions.special import z
from foresift.operators.folds import Protocol, splits, steps
from foresift.operators.intermittent import smoothed


def by_series():
    return Window.partitionBy("series_id").orderBy("t")


def _train(p: Protocol, season: int = 1, skip: int = 0) -> Window:
    """The training rows of a fold that ends after the current row; ``season`` counts rows of one phase only.

    ``skip`` leaves out the first so many, whose differences reach before the training rows.
    """
    upto = Window.partitionBy("series_id").orderBy("t") if season == 1 else Window.partitionBy("series_id", F.col("t") % season).orderBy("t")
    return upto.rowsBetween(-((p.min_train - skip) // season) + 1 if p.mode == "rolling" else Window.unboundedPreceding, 0)


def _read(panel: DataFrame, at: DataFrame, t: Column, *columns: str) -> DataFrame:
    """Join ``columns`` of the panel at position ``t`` of each row of ``at``."""
    own = panel.select(F.col("series_id").alias("s"), F.col("t").alias("u"), *columns)
    return at.join(own, (F.col("s") == F.col("series_id")) & (F.col("u") == t)).drop("s", "u")


def base_forecasts(panel: DataFrame, p: Protocol, alpha: float = 0.1, folds: DataFrame | None = None) -> DataFrame:
    """Two forecasters, ``model, series_id, fold, te, h, t, y_pred, lo, hi``.

    seasonal_naive repeats the last season; its band grows with the root of the seasons ahead. trend_profile is a
    least-squares line plus the mean deviation of each phase of the season, with the deviation of the residuals.
    Both bands are normal, of level 1 - alpha.
    """
    m, q = p.season, z(1 - alpha / 2)
    folds = splits(panel, p) if folds is None else folds
    train = _train(p)
    known = panel.withColumn("d", F.col("y") - F.lag("y", m).over(by_series()))
    known = known.withColumns(
        {
            "sigma": F.stddev_pop("d").over(_train(p, skip=m)), "slope": F.regr_slope("y", "t").over(train), "mid_y": F.avg("y").over(train), "mid_t": F.avg("t").over(train),
            "phase_y": F.avg("y").over(_train(p, m)), "phase_t": F.avg("t").over(_train(p, m)), "spread": F.sqrt(F.var_pop("y").over(train)),
        }
    )
    ahead = _read(known, steps(folds, p), F.col("te") - m + (F.col("h") - 1) % m, "y", "phase_y", "phase_t").withColumnRenamed("y", "last_y")
    ahead = _read(known, ahead, F.col("te") - 1, "sigma", "slope", "mid_y", "mid_t", "spread")
    naive = q * F.col("sigma") * F.sqrt(F.ceil(F.col("h") / m).cast("double"))
    line = lambda t: F.col("mid_y") + F.col("slope") * (t - F.col("mid_t"))
    profile = line(F.col("t")) + F.col("phase_y") - line(F.col("phase_t"))
    band = q * F.col("spread")
    models = F.array(
        F.struct(F.lit("seasonal_naive").alias("model"), F.col("last_y").alias("y_pred"), naive.alias("band")),
        F.struct(F.lit("trend_profile").alias("model"), profile.alias("y_pred"), band.alias("band")),
    )
    out = ahead.select("series_id", "fold", "te", "h", "t", F.inline(models))
    return out.select("model", "series_id", "fold", "te", "h", "t", "y_pred", (F.col("y_pred") - F.col("band")).alias("lo"), (F.col("y_pred") + F.col("band")).alias("hi"))


def score(panel: DataFrame, p: Protocol, horizon: int, least: int = 10, alpha: float = 0.1) -> DataFrame:
    """Base forecasts beyond the end of every series with ``least`` rows or more, fitted on all of it."""
    end = panel.groupBy("series_id").agg((F.max("t") + 1).alias("te"), F.count("*").alias("n")).where(F.col("n") >= least)
    return base_forecasts(panel, replace(p, horizon=horizon), alpha, end.select("series_id", F.lit(0).cast("long").alias("fold"), "te"))


def recent_median(panel: DataFrame, p: Protocol, rows: int = 8) -> DataFrame:
    """``series_id, fold, te, h, t, y_pred``: the median of the last rows before the fold, for every step."""
    by = by_series().rowsBetween(-rows + 1, 0)
    return _read(panel.withColumn("y_pred", F.percentile("y", 0.5).over(by)), steps(splits(panel, p), p), F.col("te") - 1, "y_pred").select("series_id", "fold", "te", "h", "t", "y_pred")


def backtest(panel: DataFrame, p: Protocol, alpha: float = 0.1) -> DataFrame:
    """Base forecasts with the actual value ``y_true``."""
    return _read(panel, base_forecasts(panel, p, alpha), F.col("t"), "y").withColumnRenamed("y", "y_true")


def intermittent(panel: DataFrame, folds: DataFrame, alpha: float = 0.1, agg: int = 7, alpha_agg: float = 0.2) -> DataFrame:
    """Croston, its bias-corrected variant, TSB and ADIDA: ``model, series_id, fold, y_pred``, flat over the horizon (see ``operators.intermittent``)."""
    found = smoothed(panel, folds, alpha, agg, alpha_agg)
    return found.select("series_id", "fold", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in ("croston", "croston_sba", "tsb", "adida")]))).select("model", "series_id", "fold", "y_pred")


def seasonal_ar1(panel: DataFrame, p: Protocol) -> DataFrame:
    """``series_id, fold, h, t, y_pred``: the last season plus a first-order autoregression of the seasonal differences.

    Slope and intercept are running least squares of the training rows; h steps ahead are in closed form.
    """
    diff = panel.withColumn("d", F.col("y") - F.lag("y", p.season).over(by_series())).withColumn("e", F.lag("d").over(by_series()))
    train = _train(p, skip=p.season + 1)
    fitted = diff.withColumns({"phi": F.regr_slope("d", "e").over(train), "c": F.regr_intercept("d", "e").over(train)})
    ahead = _read(fitted, steps(splits(panel, p), p), F.col("te") - p.season + (F.col("h") - 1) % p.season, "y")
    ahead = _read(fitted, ahead, F.col("te") - 1, "d", "phi", "c")
    power = F.pow("phi", F.col("h").cast("double"))
    return ahead.select("series_id", "fold", "h", "t", (F.col("y") + F.col("d") * power + F.col("c") * (1 - power) / (1 - F.col("phi"))).alias("y_pred"))


def quantile_profile(panel: DataFrame, p: Protocol, levels: tuple[float, ...]) -> DataFrame:
    """``series_id, fold, phase, quantiles``: quantiles of each phase of the season over a fold's training rows."""
    rows = panel.join(splits(panel, p), "series_id").where((F.col("t") >= F.col("tr_lo")) & (F.col("t") < F.col("te")))
    return rows.groupBy("series_id", "fold", (F.col("t") % p.season).alias("phase")).agg(F.percentile("y", F.array(*[F.lit(q) for q in levels])).alias("quantiles"))
