"""Queries of adaptive intervals, ensembles, stacking, alarms, cleaning reports and run stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.functions import metrics as M
from foresift.operators import adaptive, prepare, quality
from foresift.operators.folds import HOURLY
from foresift.plans.backtests import forecasts
from foresift.plans.common import query, sql_tied, tied
from foresift.plans.monitoring import _PSI, _SIDES
from foresift.sources import panels, store


@query("aci")
def aci(spark, sf_dir):
    return adaptive.aci(forecasts(spark, sf_dir))


_NAMED = "series_id || '/' || fold || '/' || b || '/' || k"
_FITS = f"""SELECT series_id, fold, phase, avg(m) AS y_pred FROM (SELECT d.series_id, fold, b, p.t % 24 AS phase, avg(y) AS m FROM (
  SELECT series_id, fold, b, start + o AS t FROM (SELECT *, floor(('0x' || substr(md5({_NAMED}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * (n - 23))::BIGINT AS start FROM (
    SELECT series_id, fold, te - 48 AS n, b, unnest(range((te - 48 + 23) // 24)) AS k FROM splits, range(20) r(b))), range(24) q(o) WHERE o < n - k * 24) d
  JOIN ehour p ON p.series_id = d.series_id AND p.t = d.t GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


@query("enbpi", f"""SELECT s.series_id, s.fold, h, s.t, round(y_pred, 6) AS y_pred, {sql_tied('y_pred - r', 5)} AS lo, {sql_tied('y_pred + r', 5)} AS hi FROM steps s
JOIN ({_FITS}) f ON f.series_id = s.series_id AND f.fold = s.fold AND phase = s.t % 24
JOIN (SELECT c.series_id, c.fold, quantile_cont(abs(y - y_pred), 0.9) AS r FROM splits c JOIN ehour p ON p.series_id = c.series_id AND p.t >= te - 48 AND p.t < te JOIN ({_FITS}) g ON g.series_id = c.series_id AND g.fold = c.fold AND g.phase = p.t % 24
  GROUP BY 1, 2) r ON r.series_id = s.series_id AND r.fold = s.fold""")  # fmt: skip
def enbpi(spark, sf_dir):
    rows = adaptive.enbpi(panels.filled_hourly(spark, sf_dir), HOURLY)
    return rows.withColumns({"y_pred": F.round("y_pred", 6), "lo": tied(F.col("lo"), 5), "hi": tied(F.col("hi"), 5)})


_WIDE = """SELECT a.series_id, a.fold, a.h, a.y_true AS y, a.y_pred AS x1, b.y_pred AS x2, a.lo AS l1, b.lo AS l2, a.hi AS u1, b.hi AS u2 FROM fc a JOIN fc b USING (series_id, fold, h) WHERE a.model = 'seasonal_naive' AND b.model = 'trend_profile'"""
_GRAM = f"""SELECT f.series_id, f.fold, avg(x1) AS s1, avg(x2) AS s2, avg(y) AS sy, var_pop(x1) * count(*) + 1 AS g11, covar_pop(x1, x2) * count(*) AS g12, var_pop(x2) * count(*) + 1 AS g22, covar_pop(x1, y) * count(*) AS c1, covar_pop(x2, y) * count(*) AS c2
  FROM splits f JOIN ({_WIDE}) w ON w.series_id = f.series_id AND w.fold < f.fold GROUP BY 1, 2"""
_META = "sy + (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) * (%s - s1) + (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) * (%s - s2)"


@query("stacking_ridge2", f"""SELECT series_id, fold, h, round(m, 4) AS y_pred, round(least(p, q, m), 4) AS lo, round(greatest(p, q, m), 4) AS hi FROM (
  SELECT series_id, fold, h, {_META % ("x1", "x2")} AS m, {_META % ("l1", "l2")} AS p, {_META % ("u1", "u2")} AS q FROM ({_WIDE}) JOIN ({_GRAM}) USING (series_id, fold))""")  # fmt: skip
def stacking_ridge2(spark, sf_dir):
    rows = adaptive.stack(forecasts(spark, sf_dir), "seasonal_naive", "trend_profile")
    return rows.select("series_id", "fold", "h", *[F.round(c, 4).alias(c) for c in ("y_pred", "lo", "hi")])


_ERR = """SELECT model || '/' || series_id AS feature, row_number() OVER (PARTITION BY model, series_id ORDER BY fold, h) AS t, y_true - y_pred AS x, y_true BETWEEN lo AND hi AS inside, fold < 4 AS ref FROM fc"""
_SUMS = f"SELECT *, sum(x) OVER w AS s, count(*) OVER w AS n FROM (SELECT feature, t, abs(x) AS x FROM ({_ERR}) WHERE NOT ref) WINDOW w AS (PARTITION BY feature ORDER BY t)"
# Until the first alarm the number of values alone tells where the buckets end: level j has a_j = max(0, (a_{j-1} - 4) // 2) merges of level j - 1, and as many buckets fewer twice over.
_FIRST = f"""SELECT a.feature AS key, min(a.n)::BIGINT AS t FROM ({_SUMS}) a JOIN (
  SELECT n, n - base - i * (1 << j) AS n0 FROM (WITH RECURSIVE levels AS (
    SELECT DISTINCT n, 0 AS j, n AS a, 0::BIGINT AS base FROM ({_SUMS}) UNION ALL
    SELECT n, j + 1, (a - 4) // 2, base + (a - 2 * ((a - 4) // 2)) * (1 << j) FROM levels WHERE a >= 6) SELECT * FROM levels) l,
    range(1, 7) r(i) WHERE i <= a - 2 * greatest((a - 4) // 2, 0)) c ON c.n = a.n AND c.n0 >= 2 AND c.n0 <= a.n - 2
  JOIN ({_SUMS}) b ON a.feature = b.feature AND b.n = c.n0
  WHERE abs(b.s / b.n - (a.s - b.s) / (a.n - b.n)) >= sqrt((1 / (2 * b.n) + 1 / (2 * (a.n - b.n))) * ln(4 * a.n / 0.002::DOUBLE)) GROUP BY 1"""


def _errors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Residuals of the earlier and of the later folds by model and series, t counting steps over the folds."""
    fc = forecasts(spark, sf_dir).select(F.concat("model", F.lit("/"), "series_id").alias("feature"), (F.col("fold") * HOURLY.horizon + F.col("h")).alias("t"), (M.y() - M.p()).alias("x"), M.y().between(F.col("lo"), F.col("hi")).alias("inside"), "fold")
    return fc.where("fold < 4").drop("fold"), fc.where("fold >= 4").drop("fold")


@query("adwin_first_alarm", f"SELECT key, t FROM ({_FIRST})")
def adwin_first_alarm(spark, sf_dir):
    """The first alarm of each model and series over the later folds, as the number of errors read till then."""
    _, cur = _errors(spark, sf_dir)
    found = quality.adwin_first_alarm(cur.select(F.col("feature").alias("key"), "t", F.abs("x").alias("x")))
    return found.select("key", (F.col("t") - 4 * HOURLY.horizon).alias("t"))


_ESIDES = f"(SELECT feature, x, ref FROM ({_ERR}))"
_PH = f"""SELECT feature, bool_or(s - least(lo, 0) > 50) AS ph_drift FROM (SELECT *, min(s) OVER w AS lo FROM (SELECT *, sum(x - mean - 0.005::DOUBLE) OVER w AS s FROM (
  SELECT *, avg(x) OVER w AS mean FROM (SELECT feature, t, abs(x) AS x FROM ({_ERR}) WHERE NOT ref) WINDOW w AS (PARTITION BY feature ORDER BY t)) WINDOW w AS (PARTITION BY feature ORDER BY t)) WINDOW w AS (PARTITION BY feature ORDER BY t)) GROUP BY 1"""
_STATE = f"""SELECT feature, psi, mae, coverage, ph_drift, a.key IS NOT NULL AS adwin_drift FROM ({_PSI.replace(_SIDES, _ESIDES)}) JOIN ({_PH}) USING (feature)
  JOIN (SELECT feature, avg(abs(x)) AS mae, avg(CASE WHEN inside THEN 1 ELSE 0 END) AS coverage FROM ({_ERR}) WHERE NOT ref GROUP BY 1) USING (feature) LEFT JOIN ({_FIRST}) a ON a.key = feature"""


@query("monitor_evaluate", f"""SELECT feature, round(psi, 5) AS psi, round(mae, 5) AS mae, round(coverage, 6) AS coverage, ph_drift, adwin_drift, concat_ws(',', CASE WHEN psi > 0.25 THEN 'psi' WHEN psi > 0.1 THEN 'psi_warn' END,
  CASE WHEN abs(coverage - 0.9) > 0.05 THEN 'coverage' END, CASE WHEN ph_drift THEN 'page_hinkley' END, CASE WHEN adwin_drift THEN 'adwin' END) AS alerts,
  psi > 0.25 OR abs(coverage - 0.9) > 0.1 OR ph_drift OR adwin_drift AS retrain FROM ({_STATE})""")  # fmt: skip
def monitor_evaluate(spark, sf_dir):
    """The later folds against the earlier ones: all alarms, and whether to fit again."""
    found = quality.evaluate(*_errors(spark, sf_dir), 0.9)
    return found.withColumns({"psi": F.round("psi", 5), "mae": F.round("mae", 5), "coverage": F.round("coverage", 6), "alerts": F.concat_ws(",", "alerts")})


@query("fill_kalman")
def fill_kalman(spark, sf_dir):
    return prepare.fill_kalman(panels.gappy_hourly(spark, sf_dir))


_BY = "PARTITION BY series_id ORDER BY ds"
_CLEAN = f"""SELECT series_id, ds, t, dev > 3 * 1.4826::DOUBLE * quantile_cont(dev, 0.5) OVER w AS outlier, CASE WHEN dev > 3 * 1.4826::DOUBLE * quantile_cont(dev, 0.5) OVER w THEN med ELSE y END AS y FROM (
  SELECT *, abs(y - med) AS dev FROM (SELECT *, quantile_cont(y, 0.5) OVER ({_BY} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS med FROM (SELECT series_id, ds, t, coalesce(y, 0.0::DOUBLE) AS y FROM gappy)))
  WINDOW w AS ({_BY} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"""
_JUMPS = f"""SELECT series_id, count(*) AS n_changepoints FROM (SELECT series_id, row_number() OVER ({_BY}) - 1 AS k FROM (SELECT *, stddev_samp(jump) OVER (PARTITION BY series_id) * 3 AS most FROM (
  SELECT *, abs(mean - lag(mean) OVER ({_BY})) AS jump FROM (SELECT *, CASE WHEN t >= 23 THEN avg(y) OVER ({_BY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS mean FROM ({_CLEAN})))) WHERE jump > most) WHERE k % 24 = 0 GROUP BY 1"""


@query("preprocess_report", f"""SELECT series_id, n_missing, n_outliers, coalesce(n_changepoints, 0)::BIGINT AS n_changepoints FROM (SELECT series_id, count(*) FILTER (y IS NULL) AS n_missing FROM gappy GROUP BY 1)
JOIN (SELECT series_id, count(*) FILTER (outlier) AS n_outliers FROM ({_CLEAN}) GROUP BY 1) USING (series_id) LEFT JOIN ({_JUMPS}) USING (series_id)""")  # fmt: skip
def preprocess_report(spark, sf_dir):
    _, report = prepare.preprocess(panels.gappy_hourly(spark, sf_dir), 24, "zero", "hampel")
    return report.select("series_id", "n_missing", "n_outliers", F.size("changepoints").cast("long").alias("n_changepoints"))


def _models(spark, sf_dir) -> dict:
    """The two models' forecasts, each by itself."""
    return {m: lambda m=m: forecasts(spark, sf_dir).where(F.col("model") == m) for m in ("seasonal_naive", "trend_profile")}


@query("fold_store_resume", "SELECT model, count(*) AS n, round(sum(y_pred), 2) AS total, model = 'trend_profile' AS resumed FROM fc GROUP BY 1")
def fold_store_resume(spark, sf_dir):
    """A run that stops after one model and goes on: the second call computes the other only."""
    path, run, models = f"{store.folder(spark)}/folds_{uuid.uuid4().hex}", store.run_id({"horizon": HOURLY.horizon, "folds": HOURLY.folds}), _models(spark, sf_dir)
    store.resume(spark, path, run, {"seasonal_naive": models["seasonal_naive"]})
    rows, due = store.resume(spark, path, run, models)
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("y_pred"), 2).alias("total")).withColumn("resumed", F.col("model").isin(due))


@query("run_catalog", """SELECT horizon, 2::BIGINT AS n_rows FROM (SELECT unnest([12, 24])::BIGINT AS horizon)""")
def run_catalog(spark, sf_dir):
    """Metrics of two configurations, one of them written twice; the catalogue has each once."""
    path, fc = f"{store.folder(spark)}/runs_{uuid.uuid4().hex}", forecasts(spark, sf_dir)
    for most in (12, 24, 24):
        store.snapshot(fc.where(F.col("h") <= most).groupBy("model").agg(M.mae().alias("mae")), path, {"horizon": most})
    return store.catalogue(spark, path).select(F.get_json_object("config", "$.horizon").cast("long").alias("horizon"), "n_rows")
