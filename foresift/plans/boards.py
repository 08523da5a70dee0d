"""Queries of whole leaderboards, weights, bands of scored batches, and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foresift.functions import metrics as M
from foresift.functions import predictive
from foresift.functions.special import norm_cdf, norm_pdf
from foresift.operators import combine, compare, forecasters, quality, sampling
from foresift.operators.folds import HOURLY
from foresift.plans.backtests import _BOARD, _Z, forecasts
from foresift.plans.common import query, sql_norm_cdf
from foresift.plans.searches import _SAMPLES
from foresift.plans.wrappers import _STATE, _errors
from foresift.sources import panels

_CRPS = f"(hi - lo) / 3.289707253902943::DOUBLE * (z * (2 * {sql_norm_cdf('z')} - 1) + 2 * exp(-z * z / 2) / 2.5066282746310002::DOUBLE - 0.5641895835477563::DOUBLE)"


@query("leaderboard_full", f"""SELECT b.*, smape, mase, crps FROM ({_BOARD}) b
JOIN (SELECT model, round(100 * avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE 2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred)) END), 4) AS smape FROM fc GROUP BY 1) USING (model)
JOIN (SELECT model, round(avg({_CRPS}), 3) AS crps FROM (SELECT *, {_Z} AS z FROM fc WHERE hi > lo) GROUP BY 1) USING (model)
JOIN (SELECT f.model, round(avg(e / (scale + 1e-12::DOUBLE)), 6) AS mase FROM (SELECT model, series_id, fold, te, avg(abs(y_true - y_pred)) AS e FROM fc GROUP BY ALL) f
  JOIN (SELECT series_id, t, avg(abs(d)) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS scale FROM known) k ON k.series_id = f.series_id AND k.t = f.te - 1 GROUP BY 1) USING (model)""")  # fmt: skip
def leaderboard_full(spark, sf_dir):
    """The leaderboard with symmetric percentage error, scaled error, interval score and CRPS."""
    fc, panel = forecasts(spark, sf_dir), panels.filled_hourly(spark, sf_dir)
    x = (M.y() - M.p()) / compare.sigma(0.1)
    crps = compare.sigma(0.1) * (x * (2 * norm_cdf(x) - 1) + 2 * norm_pdf(x) - 0.5641895835477563)
    more = fc.groupBy("model").agg(F.round(M.smape(), 4).alias("smape"), F.round(F.avg(F.when(M.hi() > M.lo(), crps)), 3).alias("crps"))
    d = panel.withColumn("d", F.abs(F.col("y") - F.lag("y", HOURLY.season).over(forecasters.by_series())))
    scale = d.select("series_id", (F.col("t") + 1).alias("te"), F.avg("d").over(forecasters.by_series().rowsBetween(Window.unboundedPreceding, 0)).alias("scale"))
    mase = fc.groupBy("model", "series_id", "fold", "te").agg(M.mae().alias("e")).join(scale, ["series_id", "te"]).groupBy("model").agg(F.round(F.avg(F.col("e") / (F.col("scale") + 1e-12)), 6).alias("mase"))
    return compare.leaderboard(fc, "seasonal_naive", 0.1).join(more, "model").join(mase, "model")


#: Ten levels.
ALPHAS = tuple(k / 20 for k in range(1, 11))


@query("reliability_grid", "SELECT model, a AS alpha, round(avg(CASE WHEN abs(y_true - y_pred) <= (hi - lo) / 3.289707253902943::DOUBLE * q THEN 1 ELSE 0 END), 6) AS empirical, round(avg(2 * (hi - lo) / 3.289707253902943::DOUBLE * q), 3) AS width FROM fc, (VALUES " + ", ".join(f"({a}::DOUBLE, {combine.z(1 - a / 2)!r}::DOUBLE)" for a in ALPHAS) + ") v(a, q) GROUP BY 1, 2")
def reliability_grid(spark, sf_dir):
    return compare.reliability(forecasts(spark, sf_dir), ALPHAS, 0.1).select("model", "alpha", F.round("empirical", 6).alias("empirical"), F.round("width", 3).alias("width"))


@query("score_batch_bands", """SELECT f.series_id, h::BIGINT AS h, round(a.y, 6) AS y_pred, round(a.y - 1.6448536269514715::DOUBLE * k.sigma * sqrt(ceil(h / 24)), 4) AS lo, round(a.y + 1.6448536269514715::DOUBLE * k.sigma * sqrt(ceil(h / 24)), 4) AS hi
FROM (SELECT series_id, max(t) + 1 AS te, count(*) AS n FROM ehour GROUP BY 1) f, range(1, 49) r(h) JOIN ehour a ON a.series_id = f.series_id AND a.t = f.te - 24 + (h - 1) % 24 JOIN known k ON k.series_id = f.series_id AND k.t = f.te - 1 WHERE n >= 10""")  # fmt: skip
def score_batch_bands(spark, sf_dir):
    """Two days beyond the end of every series with ten values or more, with bands."""
    rows = forecasters.score(panels.filled_hourly(spark, sf_dir), HOURLY, horizon=48, least=10)
    return rows.where("model = 'seasonal_naive'").select("series_id", "h", F.round("y_pred", 6).alias("y_pred"), *[F.round(c, 4).alias(c) for c in ("lo", "hi")])


@query("ensemble_explicit", "SELECT series_id, fold, h, round(sum(y_pred * w) / sum(w), 5) AS y_pred, round(sum(lo * w) / sum(w), 4) AS lo, round(sum(hi * w) / sum(w), 4) AS hi FROM fc JOIN (VALUES ('seasonal_naive', 0.3::DOUBLE), ('trend_profile', 0.7::DOUBLE)) v(model, w) USING (model) GROUP BY 1, 2, 3")
def ensemble_explicit(spark, sf_dir):
    rows = combine.weighted(forecasts(spark, sf_dir), {"seasonal_naive": 0.3, "trend_profile": 0.7})
    return rows.select("series_id", "fold", "h", F.round("y_pred", 5).alias("y_pred"), *[F.round(c, 4).alias(c) for c in ("lo", "hi")])


@query("ensemble_inv_winkler", """SELECT f.series_id, f.fold, h, round(sum(y_pred / (e + 1e-9)) / sum(1 / (e + 1e-9)), 5) AS y_pred, round(sum(lo / (e + 1e-9)) / sum(1 / (e + 1e-9)), 4) AS lo, round(sum(hi / (e + 1e-9)) / sum(1 / (e + 1e-9)), 4) AS hi FROM fc f
JOIN (SELECT model, series_id, fold + 1 AS fold, avg(hi - lo + 20 * greatest(lo - y_true, 0) + 20 * greatest(y_true - hi, 0)) AS e FROM fc GROUP BY ALL) w USING (model, series_id, fold) GROUP BY 1, 2, 3""")  # fmt: skip
def ensemble_inv_winkler(spark, sf_dir):
    """Weights by the interval score of the fold before."""
    rows = combine.weighted(forecasts(spark, sf_dir), M.winkler(0.1))
    return rows.select("series_id", "fold", "h", F.round("y_pred", 5).alias("y_pred"), *[F.round(c, 4).alias(c) for c in ("lo", "hi")])


_RECENT = "SELECT s.series_id, s.fold, s.h, list(e.y ORDER BY e.t DESC) AS samples FROM steps s JOIN ehour e ON e.series_id = s.series_id AND e.t < s.te AND e.t >= s.te - 6 GROUP BY 1, 2, 3"


@query("ensemble_pooled", f"""SELECT series_id, fold, h, len(s) AS n, round(list_sum(s) / len(s), 5) AS mean, round(list_sort(s)[1], 6) AS low, round(list_sort(s)[12], 6) AS high
FROM (SELECT a.series_id, a.fold, a.h, list_concat(b.samples, a.samples[1:6]) AS s FROM ({_SAMPLES}) a JOIN ({_RECENT}) b USING (series_id, fold, h))""")  # fmt: skip
def ensemble_pooled(spark, sf_dir):
    """Samples of the same hour of earlier days and of the last six hours, as many of each."""
    panel = panels.filled_hourly(spark, sf_dir)
    seasonal = sampling.seasonal_samples(panel, HOURLY, 8).select(F.lit("seasonal").alias("model"), "series_id", "fold", "h", "samples")
    past = panel.withColumn("samples", F.array(*[F.lag("y", k).over(forecasters.by_series()) for k in range(6)])).select("series_id", (F.col("t") + 1).alias("te"), "samples")
    last = sampling.steps(sampling.splits(panel, HOURLY), HOURLY).join(past, ["series_id", "te"]).select(F.lit("recent").alias("model"), "series_id", "fold", "h", "samples")
    s = F.col("samples")
    rows = combine.pooled(seasonal.unionByName(last))
    return rows.select("series_id", "fold", "h", F.size(s).cast("long").alias("n"), F.round(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s), 5).alias("mean"), F.round(F.array_min(s), 6).alias("low"), F.round(F.array_max(s), 6).alias("high"))


@query("forecast_quantile_any", f"""SELECT series_id, fold, h, round(CASE WHEN h <= 8 THEN quantile_cont(v, 0.75) WHEN h <= 16 THEN quantile_cont(v, 0.5) + (quantile_cont(v, 0.8) - quantile_cont(v, 0.5)) * 0.25::DOUBLE / 0.3::DOUBLE
  ELSE any_value(g) END, 4) AS q75 FROM (SELECT s.series_id, s.fold, s.h, unnest(s.samples) AS v, y_pred + 0.6744897501960818::DOUBLE * (hi - lo) / 3.289707253902943::DOUBLE AS g FROM ({_SAMPLES}) s JOIN fc ON fc.series_id = s.series_id AND fc.fold = s.fold AND fc.h = s.h AND model = 'seasonal_naive') GROUP BY 1, 2, 3""")  # fmt: skip
def forecast_quantile_any(spark, sf_dir):
    """The quantile at 0.75 of forecasts that have samples (to step 8), quantiles (to step 16), or an interval only."""
    paths = sampling.seasonal_samples(panels.filled_hourly(spark, sf_dir), HOURLY, 8).select("series_id", "fold", "h", "samples")
    fc = forecasts(spark, sf_dir).where("model = 'seasonal_naive'").join(paths, ["series_id", "fold", "h"])
    levels = (0.2, 0.5, 0.8)
    fc = fc.withColumn("quantiles", F.when(F.col("h") <= 16, F.array(*[combine.at_level(F.col("samples"), q) for q in levels]))).withColumn("samples", F.when(F.col("h") <= 8, F.col("samples")))
    return fc.select("series_id", "fold", "h", F.round(combine.forecast_quantile(0.75, levels), 4).alias("q75"))


@query("retrain_due", f"SELECT series_id, count(*) AS n, round(sum(y), 4) AS total FROM ehour WHERE series_id IN (SELECT split_part(feature, '/', 2) FROM (SELECT feature, psi > 0.25 OR abs(coverage - 0.9) > 0.1 OR ph_drift OR adwin_drift AS retrain FROM ({_STATE})) WHERE retrain AND feature LIKE 'trend_profile/%') GROUP BY 1")
def retrain_due(spark, sf_dir):
    """The panel rows of the series whose model the monitor wants fitted again."""
    ref, cur = (rows.where(F.col("feature").startswith("trend_profile/")) for rows in _errors(spark, sf_dir))
    due = quality.due(quality.evaluate(ref, cur, 0.9), panels.filled_hourly(spark, sf_dir), F.split_part("feature", F.lit("/"), F.lit(2)))
    return due.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))


GRID, BLENDS = combine.log_grid(0.02, 0.8, 5), (0.0, 0.5, 1.0)
_GRID = f"""SELECT l.series_id, alpha, blend, avg(abs(e.y - (1 - blend) * level - blend * b.y)) AS mae FROM (
  SELECT f.series_id, fold, te, alpha, sum(y * CASE WHEN t = 0 THEN 1 ELSE alpha END * pow(1 - alpha, te - 1 - t)) AS level
  FROM splits f JOIN ehour e ON e.series_id = f.series_id AND t < te, (SELECT unnest([{", ".join(f"{a}::DOUBLE" for a in GRID)}]) AS alpha) GROUP BY ALL) l
  JOIN ehour e ON e.series_id = l.series_id AND e.t >= te AND e.t < te + 24 JOIN ehour b ON b.series_id = e.series_id AND b.t = te - 24 + (e.t - te) % 24, (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in BLENDS)}]) AS blend) GROUP BY 1, 2, 3"""


@query("grid_search_two", f"SELECT series_id, b.a AS alpha, b.b AS blend, round(mae, 5) AS mae FROM (SELECT series_id, arg_min({{a: alpha, b: blend}}, round(mae, 7)) AS b, min(mae) AS mae FROM ({_GRID}) GROUP BY 1)")
def grid_search_two(spark, sf_dir):
    """The best smoothing factor, of a logarithmic grid, and blend with the last season, over all training values."""
    found = combine.search(panels.filled_hourly(spark, sf_dir), HOURLY, GRID, BLENDS)
    best = found.groupBy("series_id").agg(F.min_by(F.struct("alpha", "blend"), F.round("mae", 7)).alias("b"), F.min("mae").alias("mae"))
    return best.select("series_id", "b.alpha", "b.blend", F.round("mae", 5).alias("mae"))


_LAST = "SELECT f.series_id, fold, avg(y) AS m, stddev_samp(y) * sqrt(1.2::DOUBLE) AS s FROM splits f JOIN ehour e ON e.series_id = f.series_id AND t < te AND t >= te - 5 GROUP BY 1, 2"


def _last(spark, sf_dir):
    """Mean and predictive scale of the last five values before each fold."""
    panel = panels.filled_hourly(spark, sf_dir)
    by = forecasters.by_series().rowsBetween(-4, 0)
    known = panel.select("series_id", (F.col("t") + 1).alias("te"), F.avg("y").over(by).alias("m"), (F.stddev_samp("y").over(by) * F.sqrt(F.lit(1.2))).alias("s"))
    return sampling.splits(panel, HOURLY).join(known, ["series_id", "te"]).select("series_id", "fold", "m", "s")


# Four degrees of freedom have a closed form: with a = 4 q (1 - q) and c = cos(acos(sqrt(a)) / 3) / sqrt(a), t is 2 sqrt(c - 1).
_T4 = "2 * sqrt(cos(acos(sqrt(4 * %s * (1 - %s))) / 3) / sqrt(4 * %s * (1 - %s)) - 1)"


@query("dist_student", f"""SELECT series_id, fold, round(m, 4) AS mean, round(m - s * a, 3) AS lo, round(m + s * a, 3) AS hi, round(m + s * b, 3) AS q75
FROM ({_LAST}), (SELECT {_T4 % (("0.95::DOUBLE",) * 4)} AS a, {_T4 % (("0.75::DOUBLE",) * 4)} AS b)""")  # fmt: skip
def dist_student(spark, sf_dir):
    """Student predictions of the next value from the last five: mean, 90 % interval and a quantile."""
    t = predictive.Student(F.col("m"), F.col("s"), F.lit(4.0))
    lo, hi = t.interval(0.1)
    return _last(spark, sf_dir).select("series_id", "fold", F.round(t.mean(), 4).alias("mean"), F.round(lo, 3).alias("lo"), F.round(hi, 3).alias("hi"), F.round(t.quantile(0.75), 3).alias("q75"))


_U = "((('0x' || substr(md5(series_id || '-' || fold || '/' || i || '/%s'), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)"


@query("dist_sample", f"""SELECT series_id, fold, i AS draw, round(m + s * sqrt(-2 * ln({_U % "a"})) * cos(2 * pi() * {_U % "b"}), 3) AS gaussian, round(m + s * sqrt(4 * (pow({_U % "a"}, -0.5::DOUBLE) - 1)) * cos(2 * pi() * {_U % "b"}), 3) AS student
FROM ({_LAST}), range(1, 9) r(i)""")  # fmt: skip
def dist_sample(spark, sf_dir):
    """Eight draws of the normal and of the Student prediction for each series and fold."""
    key = F.concat_ws("-", "series_id", "fold")
    normal, student = predictive.Gaussian(F.col("m"), F.col("s")), predictive.Student(F.col("m"), F.col("s"), F.lit(4.0))
    rows = _last(spark, sf_dir).select("series_id", "fold", F.posexplode(F.arrays_zip(normal.sample(8, key).alias("gaussian"), student.sample(8, key).alias("student"))).alias("k", "x"))
    return rows.select("series_id", "fold", (F.col("k") + 1).cast("long").alias("draw"), F.round("x.gaussian", 3).alias("gaussian"), F.round("x.student", 3).alias("student"))
