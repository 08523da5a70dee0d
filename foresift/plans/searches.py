"""Queries of sample paths, parameter searches, rolling quality and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foresift.functions import metrics as M
from foresift.operators import quality, sampling
from foresift.operators.folds import HOURLY
from foresift.plans.backtests import forecasts
from foresift.plans.common import query
from foresift.sources import panels

ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
_PAST = ", ".join(["y", *[f"lag(y, {24 * k}) OVER (PARTITION BY series_id ORDER BY t)" for k in range(1, 8)]])
_SAMPLES = f"SELECT s.series_id, s.fold, s.h, s.t, p.samples FROM steps s JOIN (SELECT series_id, t, [{_PAST}] AS samples FROM ehour) p ON p.series_id = s.series_id AND p.t = s.te - 24 + (s.h - 1) % 24"


@query("bootstrap_paths", f"SELECT series_id, fold, h, (k - 1)::BIGINT AS path, round(samples[k], 6) AS y FROM ({_SAMPLES}), range(1, 9) r(k)")
def bootstrap_paths(spark, sf_dir):
    rows = sampling.seasonal_samples(panels.filled_hourly(spark, sf_dir), HOURLY, 8).select("series_id", "fold", "h", F.posexplode("samples").alias("path", "y"))
    return rows.select("series_id", "fold", "h", F.col("path").cast("long").alias("path"), F.round("y", 6).alias("y"))


@query("crps_sample", f"""SELECT s.series_id, fold, round(avg(list_sum(list_transform(samples, lambda x: abs(x - y))) / 8 - list_sum(list_transform(samples, lambda x: list_sum(list_transform(samples, lambda z: abs(x - z))))) / 128), 5) AS crps
FROM ({_SAMPLES}) s JOIN ehour e ON e.series_id = s.series_id AND e.t = s.t GROUP BY 1, 2""")  # fmt: skip
def crps_sample(spark, sf_dir):
    panel = panels.filled_hourly(spark, sf_dir)
    rows = sampling.seasonal_samples(panel, HOURLY, 8).join(panel.select("series_id", "t", "y"), ["series_id", "t"])
    return rows.groupBy("series_id", "fold").agg(F.round(F.avg(sampling.crps(F.col("samples"), F.col("y"))), 5).alias("crps"))


_SEARCH = f"""SELECT l.series_id, alpha, avg(abs(e.y - level)) AS mae FROM (
  SELECT f.series_id, fold, te, alpha, sum(y * CASE WHEN te - 1 - t = 47 THEN 1 ELSE alpha END * pow(1 - alpha, te - 1 - t)) AS level
  FROM splits f JOIN ehour e ON e.series_id = f.series_id AND t < te AND t >= te - 48, (SELECT unnest([{", ".join(f"{a}::DOUBLE" for a in ALPHAS)}]) AS alpha) GROUP BY ALL) l
  JOIN ehour e ON e.series_id = l.series_id AND e.t >= te AND e.t < te + 24 GROUP BY 1, 2"""


@query("grid_search_ses", f"SELECT series_id, arg_min(alpha, round(mae, 9)) AS alpha, round(min(mae), 6) AS mae FROM ({_SEARCH}) GROUP BY 1")
def grid_search_ses(spark, sf_dir):
    found = sampling.smoothing_search(panels.filled_hourly(spark, sf_dir), HOURLY, ALPHAS, 48)
    return found.groupBy("series_id").agg(F.min_by("alpha", F.round("mae", 9)).alias("alpha"), F.round(F.min("mae"), 6).alias("mae"))


@query("changepoint_l2", """SELECT series_id, t, round(gain, 2) AS gain FROM (SELECT series_id, arg_max(i, gain) AS t, max(gain) AS gain, any_value(v) AS v FROM (
  SELECT *, u ^ 2 / i + (s - u) ^ 2 / (n - i) - s ^ 2 / n AS gain FROM (SELECT series_id, t + 1 AS i, count(*) OVER w AS n, sum(y) OVER w AS s, var_pop(y) OVER w AS v,
    sum(y) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS u FROM ehour WINDOW w AS (PARTITION BY series_id)) WHERE i < n) GROUP BY 1) WHERE gain > 2 * v""")  # fmt: skip
def changepoint_l2(spark, sf_dir):
    return sampling.mean_shift(panels.filled_hourly(spark, sf_dir), 2.0).withColumn("gain", F.round("gain", 2))


@query("rolling_quality", """SELECT model, time_bucket(INTERVAL 6 HOUR, ds) - k * INTERVAL 6 HOUR AS start, count(*) AS n, round(avg(abs(y_true - y_pred)), 6) AS mae, round(avg(CASE WHEN y_true BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS coverage
FROM (SELECT f.*, e.ds FROM fc f JOIN ehour e ON e.series_id = f.series_id AND e.t = f.t), range(4) r(k) GROUP BY 1, 2""")  # fmt: skip
def rolling_quality(spark, sf_dir):
    """Error and coverage in sliding windows of a day, every six hours: the batch form of the streaming aggregate."""
    fc = forecasts(spark, sf_dir).join(panels.filled_hourly(spark, sf_dir).select("series_id", "t", "ds"), ["series_id", "t"])
    by = fc.withColumn("w", F.window(F.col("ds").cast("timestamp"), "1 day", "6 hours")).groupBy("model", F.col("w.start").cast("timestamp_ntz").alias("start"))
    return by.agg(F.count("*").alias("n"), F.round(M.mae(), 6).alias("mae"), F.round(M.coverage(), 6).alias("coverage"))


_ERRORS = """SELECT model || '/' || series_id AS feature, abs(y_true - y_pred) AS x, fold < 4 AS ref FROM fc"""
_KSE = f"""SELECT feature, max(abs(a - b)) AS ks FROM (SELECT feature, sum(na) OVER u / sum(na) OVER w AS a, sum(nb) OVER u / sum(nb) OVER w AS b FROM (
  SELECT feature, x, count(*) FILTER (ref) AS na, count(*) FILTER (NOT ref) AS nb FROM (SELECT feature, round(x, 6) AS x, ref FROM ({_ERRORS})) GROUP BY 1, 2) WINDOW u AS (PARTITION BY feature ORDER BY x), w AS (PARTITION BY feature)) GROUP BY 1"""


def _drifted(spark, sf_dir):
    """Distance of the later folds' absolute errors from the earlier ones', by model and series."""
    errors = forecasts(spark, sf_dir).select(F.concat("model", F.lit("/"), "series_id").alias("feature"), F.round(F.abs(M.y() - M.p()), 6).alias("x"), "fold")
    return quality.ks(errors.where("fold < 4").drop("fold"), errors.where("fold >= 4").drop("fold"))


@query("monitor_report", f"SELECT feature, round(ks, 6) AS ks, CASE WHEN ks > 0.2 THEN 'drift' WHEN ks > 0.1 THEN 'warn' ELSE 'ok' END AS alert FROM ({_KSE})")
def monitor_report(spark, sf_dir):
    found = _drifted(spark, sf_dir)
    return found.select("feature", F.round("ks", 6).alias("ks"), F.when(F.col("ks") > 0.2, "drift").when(F.col("ks") > 0.1, "warn").otherwise("ok").alias("alert"))


@query("retrain_subset", f"SELECT series_id, count(*) AS n FROM ehour WHERE series_id IN (SELECT split_part(feature, '/', 2) FROM ({_KSE}) WHERE ks > 0.1) GROUP BY 1")
def retrain_subset(spark, sf_dir):
    """The panel rows of the series whose errors have moved: what is fitted again."""
    due = _drifted(spark, sf_dir).where("ks > 0.1").select(F.split_part("feature", F.lit("/"), F.lit(2)).alias("series_id")).distinct()
    return panels.filled_hourly(spark, sf_dir).join(due, "series_id", "left_semi").groupBy("series_id").agg(F.count("*").alias("n"))
