"""Queries of autoregression, quantile profiles and scores of sample paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from foresift.functions import distributions
from foresift.operators import folds, forecasters, regressors, sampling
from foresift.operators.folds import HOURLY
from foresift.plans.common import query
from foresift.plans.searches import _SAMPLES
from foresift.sources import panels

LEVELS = (0.1, 0.5, 0.9)


@query("seasonal_ar1", """SELECT s.series_id, s.fold, s.h, round(a.y + b.d * pow(b.phi, s.h) + b.c * (1 - pow(b.phi, s.h)) / (1 - b.phi), 4) AS y_pred FROM steps s
JOIN ehour a ON a.series_id = s.series_id AND a.t = s.te - 24 + (s.h - 1) % 24
JOIN (SELECT series_id, t, d, regr_slope(d, e) OVER w AS phi, regr_intercept(d, e) OVER w AS c FROM (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY t) AS e FROM (
  SELECT *, y - lag(y, 24) OVER (PARTITION BY series_id ORDER BY t) AS d FROM ehour)) WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)) b ON b.series_id = s.series_id AND b.t = s.te - 1""")  # fmt: skip
def seasonal_ar1(spark, sf_dir):
    return forecasters.seasonal_ar1(panels.filled_hourly(spark, sf_dir), HOURLY).select("series_id", "fold", "h", F.round("y_pred", 4).alias("y_pred"))


def _banded(df):
    return df.select("series_id", "fold", "h", "t", *[F.round(c, 4).alias(c) for c in ("y_pred", "lo", "hi")])


@query("trend_fourier")
def trend_fourier(spark, sf_dir):
    return _banded(regressors.trend_fourier(panels.filled_hourly(spark, sf_dir), HOURLY))


@query("gbt_direct")
def gbt_direct(spark, sf_dir):
    return _banded(regressors.gbt_direct(panels.filled_hourly(spark, sf_dir), HOURLY))


_PROFILE = "SELECT p.series_id, fold, t % 24 AS phase, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM ehour p JOIN splits s ON s.series_id = p.series_id AND t < te GROUP BY 1, 2, 3"


def _profile(spark, sf_dir):
    return forecasters.quantile_profile(panels.filled_hourly(spark, sf_dir), HOURLY, LEVELS)


@query("quantile_profile", f"SELECT series_id, fold, phase, round(q[1], 5) AS q10, round(q[2], 5) AS q50, round(q[3], 5) AS q90 FROM ({_PROFILE})")
def quantile_profile(spark, sf_dir):
    return _profile(spark, sf_dir).select("series_id", "fold", "phase", *[F.round(F.get("quantiles", F.lit(k)), 5).alias(n) for k, n in enumerate(("q10", "q50", "q90"))])


@query("dist_quantile", f"SELECT series_id, fold, phase, round(q[2] + (q[3] - q[2]) * ((0.7::DOUBLE - 0.5) / (0.9::DOUBLE - 0.5)), 5) AS q70 FROM ({_PROFILE})")
def dist_quantile(spark, sf_dir):
    return _profile(spark, sf_dir).select("series_id", "fold", "phase", F.round(distributions.quantile_at(LEVELS, F.col("quantiles"), 0.7), 5).alias("q70"))


@query("dist_mean", f"SELECT series_id, fold, phase, round(((q[1] + q[2]) * 0.2::DOUBLE + (q[2] + q[3]) * 0.2::DOUBLE) / 0.8::DOUBLE, 5) AS mean FROM ({_PROFILE})")
def dist_mean(spark, sf_dir):
    return _profile(spark, sf_dir).select("series_id", "fold", "phase", F.round(distributions.mean_of(LEVELS, F.col("quantiles")), 5).alias("mean"))


_SCORED = f"SELECT s.*, e.y FROM ({_SAMPLES}) s JOIN ehour e ON e.series_id = s.series_id AND e.t = s.t"


def _scored(spark, sf_dir):
    panel = panels.filled_hourly(spark, sf_dir)
    return sampling.seasonal_samples(panel, HOURLY, 8).join(panel.select("series_id", "t", "y"), ["series_id", "t"])


@query("energy_score", f"""SELECT series_id, fold, round(avg(a) - avg(b) / 2, 4) AS energy FROM (SELECT series_id, fold, k, sqrt(sum((samples[k] - y) ^ 2)) AS a, sqrt(sum((samples[k] - samples[k % 8 + 1]) ^ 2)) AS b
FROM ({_SCORED}), range(1, 9) r(k) GROUP BY 1, 2, 3) GROUP BY 1, 2""")  # fmt: skip
def energy_score(spark, sf_dir):
    return sampling.energy_score(_scored(spark, sf_dir), ["series_id", "fold"]).withColumn("energy", F.round("energy", 4))


@query("pit_samples", f"SELECT series_id, fold, h, len(list_filter(samples, lambda x: x <= y)) / 8::DOUBLE AS pit FROM ({_SCORED})")
def pit_samples(spark, sf_dir):
    return _scored(spark, sf_dir).select("series_id", "fold", "h", sampling.pit(F.col("samples"), F.col("y")).alias("pit"))


@query("pit_quantiles", f"""SELECT s.series_id, s.fold, s.h, round(CASE WHEN y <= q[1] THEN 0.05 WHEN y >= q[3] THEN 0.95 WHEN y < q[2] THEN 0.1 + 0.4::DOUBLE * (y - q[1]) / (q[2] - q[1]) ELSE 0.5 + 0.4::DOUBLE * (y - q[2]) / (q[3] - q[2]) END, 5) AS pit
FROM steps s JOIN ({_PROFILE}) p ON p.series_id = s.series_id AND p.fold = s.fold AND p.phase = s.t % 24 JOIN ehour e ON e.series_id = s.series_id AND e.t = s.t""")  # fmt: skip
def pit_quantiles(spark, sf_dir):
    panel = panels.filled_hourly(spark, sf_dir)
    tested = folds.steps(folds.splits(panel, HOURLY), HOURLY).withColumn("phase", F.col("t") % HOURLY.season)
    both = tested.join(_profile(spark, sf_dir), ["series_id", "fold", "phase"]).join(panel.select("series_id", "t", "y"), ["series_id", "t"])
    return both.select("series_id", "fold", "h", F.round(distributions.pit(LEVELS, F.col("quantiles"), F.col("y")), 5).alias("pit"))
