"""Folds, forecasts, scores and comparisons of the hourly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresift.functions import metrics as M
from foresift.functions.special import norm_cdf, norm_pdf
from foresift.operators import compare, features, folds, forecasters, intermittent, ranks
from foresift.operators.folds import HOURLY, ROLLING, WEEKLY
from foresift.plans.common import query, sql_norm_cdf
from foresift.sources import panels

R6 = lambda c: F.round(c, 6)


def forecasts(spark, sf_dir) -> DataFrame:
    """The hourly forecast table of two models over all folds, with actual values."""
    return forecasters.backtest(panels.filled_hourly(spark, sf_dir), HOURLY)


@query("splits", "SELECT * FROM splits")
def splits(spark, sf_dir):
    return folds.splits(panels.filled_hourly(spark, sf_dir), HOURLY)


@query(
    "fold_assignment",
    """SELECT f.series_id, fold, CASE WHEN p.t < te THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(y), 3) AS total
FROM ehour p JOIN splits f ON f.series_id = p.series_id AND p.t >= tr_lo AND p.t < ee GROUP BY 1, 2, 3""",
)
def fold_assignment(spark, sf_dir):
    panel = panels.filled_hourly(spark, sf_dir)
    rows = folds.assign(panel, folds.splits(panel, HOURLY))
    return rows.groupBy("series_id", "fold", "part").agg(F.count("*").alias("n"), F.round(F.sum("y"), 3).alias("total"))


@query(
    "fold_assignment_rolling",
    """SELECT f.series_id, fold, CASE WHEN p.t < te THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(y), 3) AS total
FROM ehour p JOIN splits f ON f.series_id = p.series_id AND p.t >= te - 240 AND p.t < ee GROUP BY 1, 2, 3""",
)
def fold_assignment_rolling(spark, sf_dir):
    panel = panels.filled_hourly(spark, sf_dir)
    rows = folds.assign(panel, folds.splits(panel, ROLLING))
    return rows.groupBy("series_id", "fold", "part").agg(F.count("*").alias("n"), F.round(F.sum("y"), 3).alias("total"))


def _counts(spark, sf_dir) -> DataFrame:
    """The hourly panel with ``x``, the number of events: a covariate that is known only after its hour."""
    events = panels.table(spark, sf_dir, "events")
    n = events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ds")).agg(F.count("*").alias("x"))
    return panels.filled_hourly(spark, sf_dir).join(n, ["series_id", "ds"], "left").withColumn("x", F.coalesce("x", F.lit(0)))


_X = "SELECT e.*, coalesce(n.x, 0) AS x FROM ehour e LEFT JOIN (SELECT event_type AS series_id, date_trunc('hour', ts) AS ds, count(*) AS x FROM events GROUP BY 1, 2) n USING (series_id, ds)"


@query("observed_lags", f"SELECT series_id, t, y, lag(x, 1) OVER w AS x_lag1, lag(x, 24) OVER w AS x_lag24 FROM ({_X}) WINDOW w AS (PARTITION BY series_id ORDER BY t)")
def observed_lags(spark, sf_dir):
    """An observed covariate enters by its past only."""
    return features.lags(_counts(spark, sf_dir), (1, 24), "x").select("series_id", "t", "y", "x_lag1", "x_lag24")


@query("fold_covariates", f"""SELECT f.series_id, fold, x.t, CASE WHEN x.t < te THEN 'train' ELSE 'test' END AS part, hour, x_lag24 FROM splits f JOIN (
  SELECT series_id, t, extract(hour FROM ds)::BIGINT AS hour, lag(x, 24) OVER (PARTITION BY series_id ORDER BY t) AS x_lag24 FROM ({_X})) x ON x.series_id = f.series_id AND x.t >= tr_lo AND x.t < ee""")  # fmt: skip
def fold_covariates(spark, sf_dir):
    """Covariates of each fold's rows without a look ahead: calendar ones as they are, an observed one lagged by the horizon."""
    panel = _counts(spark, sf_dir)
    known = features.lags(panel, (HOURLY.horizon,), "x").withColumn("hour", F.hour("ds").cast("long"))
    rows = folds.assign(panel.select("series_id", "t", "y"), folds.splits(panel, HOURLY))
    return rows.join(known.select("series_id", "t", "hour", "x_lag24"), ["series_id", "t"]).select("series_id", "fold", "t", "part", "hour", "x_lag24")


def _model(name: str) -> str:
    return f"SELECT series_id, fold, h, t, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred, round(lo, 4) AS lo, round(hi, 4) AS hi FROM fc WHERE model = '{name}'"


def _of_model(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("model") == name).select("series_id", "fold", "h", "t", R6("y_true").alias("y_true"), R6("y_pred").alias("y_pred"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("seasonal_naive", _model("seasonal_naive"))
@query("backtest_seasonal_naive", _model("seasonal_naive"))
def seasonal_naive(spark, sf_dir):
    return _of_model(forecasts(spark, sf_dir), "seasonal_naive")


@query("seasonal_naive_rolling", """SELECT series_id, fold, h, t, round(last_y, 6) AS y_pred, round(last_y - 1.6448536269514715::DOUBLE * s * sqrt(ceil(h / 24)), 4) AS lo, round(last_y + 1.6448536269514715::DOUBLE * s * sqrt(ceil(h / 24)), 4) AS hi
FROM at_phase JOIN (SELECT f.series_id, f.fold, stddev_pop(k.y - l.y) AS s FROM splits f JOIN ehour k ON k.series_id = f.series_id AND k.t >= f.te - 240 + 24 AND k.t < f.te
  JOIN ehour l ON l.series_id = k.series_id AND l.t = k.t - 24 GROUP BY 1, 2) USING (series_id, fold)""")  # fmt: skip
def seasonal_naive_rolling(spark, sf_dir):
    """Rolling training windows: differences that reach before the window do not count."""
    out = forecasters.base_forecasts(panels.filled_hourly(spark, sf_dir), ROLLING).where("model = 'seasonal_naive'")
    return out.select("series_id", "fold", "h", "t", R6("y_pred").alias("y_pred"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("trend_profile", _model("trend_profile"))
def trend_profile(spark, sf_dir):
    return _of_model(forecasts(spark, sf_dir), "trend_profile")


@query("score_batch", """SELECT series_id, h::BIGINT AS h, round(last_y, 6) AS y_pred FROM (
  SELECT a.series_id, h, a.y AS last_y FROM (SELECT series_id, max(t) + 1 AS te FROM ehour GROUP BY 1) f, range(1, 25) r(h) JOIN ehour a ON a.series_id = f.series_id AND a.t = f.te - 24 + (h - 1) % 24)""")  # fmt: skip
def score_batch(spark, sf_dir):
    panel = panels.filled_hourly(spark, sf_dir)
    end = panel.groupBy("series_id").agg((F.max("t") + 1).alias("te")).select("series_id", F.lit(0).cast("long").alias("fold"), "te")
    out = forecasters.base_forecasts(panel, HOURLY, folds=end)
    return out.where("model = 'seasonal_naive'").select("series_id", "h", R6("y_pred").alias("y_pred"))


_INTERMITTENT = """
WITH_FOLDS rows AS (SELECT p.series_id, fold, te, t AS i, y FROM pweek p JOIN wsplits USING (series_id) WHERE t < te),
hits AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY series_id, fold) AS n, i - lag(i, 1, -1) OVER w AS gap FROM rows WHERE y > 0 WINDOW w AS (PARTITION BY series_id, fold ORDER BY i)),
smooth AS (SELECT series_id, fold, min(i) AS first, sum(wt * y) AS size, sum(wt * gap) AS gap FROM (
  SELECT *, CASE WHEN k = 0 THEN pow(0.9::DOUBLE, n - 1) ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, n - 1 - k) END AS wt FROM hits) GROUP BY 1, 2),
chance AS (SELECT r.series_id, r.fold, sum(CASE WHEN y > 0 THEN CASE WHEN i = first THEN pow(0.9::DOUBLE, te - first - 1) ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, te - 1 - i) END ELSE 0 END) AS p
  FROM rows r JOIN smooth s ON r.series_id = s.series_id AND r.fold = s.fold AND i >= first GROUP BY 1, 2),
buckets AS (SELECT series_id, fold, te, ((i + (7 - te % 7) % 7) // 7) AS b, sum(y) AS v FROM rows GROUP BY ALL),
ad AS (SELECT series_id, fold, sum(v * CASE WHEN b = 0 THEN pow(0.8::DOUBLE, ceil(te / 7) - 1) ELSE 0.2::DOUBLE * pow(0.8::DOUBLE, ceil(te / 7) - 1 - b) END) / 7 AS adida FROM buckets GROUP BY 1, 2)
"""


def _intermittent_sql(expr: str) -> str:
    ctes = _INTERMITTENT.replace("WITH_FOLDS", """wsplits AS (SELECT series_id, (i - 1)::BIGINT AS fold, te FROM (
    SELECT series_id, generate_series(greatest(104, n - 8 - 3 * 8), n - 8, 8) AS tes FROM (SELECT series_id, count(*) AS n FROM pweek GROUP BY 1))
  , unnest(tes) WITH ORDINALITY AS u(te, i) WHERE i <= 4),""")  # fmt: skip
    return f"SELECT * FROM (WITH {ctes.strip()} SELECT f.series_id, f.fold, round(coalesce({expr}, 0.0::DOUBLE), 6) AS y_pred FROM wsplits f LEFT JOIN smooth s USING (series_id, fold) LEFT JOIN chance c USING (series_id, fold) LEFT JOIN ad a USING (series_id, fold))"


def _intermittent(name: str, expr: str) -> None:
    @query(name, _intermittent_sql(expr))
    def run(spark, sf_dir):
        panel = panels.weekly_parts(spark, sf_dir)
        out = forecasters.intermittent(panel, folds.splits(panel, WEEKLY))
        return out.where(F.col("model") == name).select("series_id", "fold", R6("y_pred").alias("y_pred"))


_ALL = " UNION ALL ".join(f"SELECT '{m}' AS model, series_id, fold, te, coalesce({e}, 0.0::DOUBLE) AS p, sigma FROM every" for m, e in (("croston", "size / greatest(gap, 1)"), ("croston_sba", "size / greatest(gap, 1) * 0.95::DOUBLE"), ("tsb", "p * size"), ("adida", "adida")))


@query("intermittent_bands", _intermittent_sql("0").split(" SELECT f.series_id, f.fold, round(")[0] + f""", every AS (
  SELECT f.series_id, f.fold, f.te, size, gap, p, adida, coalesce(sigma, 0) AS sigma FROM wsplits f LEFT JOIN smooth USING (series_id, fold) LEFT JOIN chance USING (series_id, fold) LEFT JOIN ad USING (series_id, fold)
  LEFT JOIN (SELECT series_id, fold, stddev_pop(y) AS sigma FROM rows GROUP BY 1, 2) USING (series_id, fold))
SELECT model, series_id, fold, h::BIGINT AS h, round(p, 5) AS y_pred, round(greatest(p - 1.6448536269514715::DOUBLE * sigma * sqrt(h), 0), 5) AS lo, round(p + 1.6448536269514715::DOUBLE * sigma * sqrt(h), 5) AS hi FROM ({_ALL}), range(1, 9) r(h))""")  # fmt: skip
def intermittent_bands(spark, sf_dir):
    """All four models with their bands at each step, from one pass over the panel."""
    panel = panels.weekly_parts(spark, sf_dir)
    out = intermittent.intermittent(panel, folds.splits(panel, WEEKLY), WEEKLY.horizon)
    return out.select("model", "series_id", "fold", "h", *[F.round(c, 5).alias(c) for c in ("y_pred", "lo", "hi")])


for _name, _expr in (("croston", "size / greatest(gap, 1)"), ("croston_sba", "size / greatest(gap, 1) * 0.95::DOUBLE"), ("tsb", "p * size"), ("adida", "adida")):
    _intermittent(_name, _expr)


@query("point_metrics", """SELECT model, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg((y_true - y_pred) ^ 2)), 6) AS rmse,
  round(100 * avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE 2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred)) END), 6) AS smape FROM fc GROUP BY 1""")  # fmt: skip
def point_metrics(spark, sf_dir):
    return forecasts(spark, sf_dir).groupBy("model").agg(R6(M.mae()).alias("mae"), R6(M.rmse()).alias("rmse"), R6(M.smape()).alias("smape"))


_INTERVAL = """round(avg(CASE WHEN y_true >= lo AND y_true <= hi THEN 1 ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 4) AS width,
  round(avg(hi - lo + 20 * greatest(lo - y_true, 0) + 20 * greatest(y_true - hi, 0)), 4) AS winkler"""


@query("interval_metrics", f"SELECT model, {_INTERVAL} FROM fc GROUP BY 1")
def interval_metrics(spark, sf_dir):
    return forecasts(spark, sf_dir).groupBy("model").agg(R6(M.coverage()).alias("coverage"), F.round(M.width(), 4).alias("width"), F.round(M.winkler(0.1), 4).alias("winkler"))


@query("cost_metrics", """SELECT model, round(avg(CASE WHEN y_pred > y_true THEN y_pred - y_true ELSE 3 * (y_true - y_pred) END), 6) AS nv_cost,
  round(avg(CASE WHEN y_true > y_pred THEN 1 ELSE 0 END), 6) AS stockout_rate FROM fc GROUP BY 1""")  # fmt: skip
def cost_metrics(spark, sf_dir):
    return forecasts(spark, sf_dir).groupBy("model").agg(R6(M.asymmetric()).alias("nv_cost"), R6(M.stockout()).alias("stockout_rate"))


@query("pinball", """SELECT model, q::DOUBLE AS q, round(avg(greatest(q * (y_true - y_pred), (q - 1) * (y_true - y_pred))), 6) AS loss
FROM fc, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(q) GROUP BY 1, 2""")  # fmt: skip
def pinball(spark, sf_dir):
    losses = F.array(*[F.struct(F.lit(q).alias("q"), R6(M.pinball(q)).alias("loss")) for q in (0.1, 0.5, 0.9)])
    return forecasts(spark, sf_dir).groupBy("model").agg(losses.alias("x")).select("model", F.inline("x"))


@query("qloss", """SELECT model, round(avg((greatest(0.05::DOUBLE * (y_true - lo), -0.95::DOUBLE * (y_true - lo)) + greatest(0.5::DOUBLE * (y_true - y_pred), -0.5::DOUBLE * (y_true - y_pred))
  + greatest(0.95::DOUBLE * (y_true - hi), -0.05::DOUBLE * (y_true - hi))) / 3), 4) AS qloss FROM fc GROUP BY 1""")  # fmt: skip
def qloss(spark, sf_dir):
    """Mean quantile loss over the levels that the interval and the point forecast stand for."""
    loss = (M.pinball(0.05, M.lo()) + M.pinball(0.5) + M.pinball(0.95, M.hi())) / 3
    return forecasts(spark, sf_dir).groupBy("model").agg(F.round(loss, 4).alias("qloss"))


@query("mase", """SELECT f.model, round(avg(e / (scale + 1e-12::DOUBLE)), 6) AS mase
FROM (SELECT model, series_id, fold, te, avg(abs(y_true - y_pred)) AS e FROM fc GROUP BY ALL) f
JOIN (SELECT series_id, t, avg(abs(d)) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS scale FROM known) k ON k.series_id = f.series_id AND k.t = f.te - 1 GROUP BY 1""")  # fmt: skip
def mase(spark, sf_dir):
    """Error in units of the mean seasonal difference of each fold's training rows."""
    panel = panels.filled_hourly(spark, sf_dir)
    scale = panel.withColumn("d", F.abs(F.col("y") - F.lag("y", 24).over(forecasters.by_series()))).select("series_id", (F.col("t") + 1).alias("te"), F.avg("d").over(forecasters.by_series().rowsBetween(Window.unboundedPreceding, 0)).alias("scale"))
    errors = forecasts(spark, sf_dir).groupBy("model", "series_id", "fold", "te").agg(M.mae().alias("e"))
    return errors.join(scale, ["series_id", "te"]).groupBy("model").agg(R6(F.avg(F.col("e") / (F.col("scale") + 1e-12))).alias("mase"))


_Z = "((y_true - y_pred) / ((hi - lo) / 3.289707253902943::DOUBLE))"


def _standard():
    sigma = (M.hi() - M.lo()) / 3.289707253902943
    return sigma, (M.y() - M.p()) / sigma


@query("crps_gaussian", f"""SELECT model, round(avg((hi - lo) / 3.289707253902943::DOUBLE * (z * (2 * {sql_norm_cdf("z")} - 1) + 2 * exp(-z * z / 2) / 2.5066282746310002::DOUBLE - 0.5641895835477563::DOUBLE)), 4) AS crps
FROM (SELECT *, {_Z} AS z FROM fc WHERE hi > lo) GROUP BY 1""")  # fmt: skip
def crps_gaussian(spark, sf_dir):
    sigma, x = _standard()
    crps = sigma * (x * (2 * norm_cdf(x) - 1) + 2 * norm_pdf(x) - 0.5641895835477563)
    return forecasts(spark, sf_dir).where("hi > lo").groupBy("model").agg(F.round(F.avg(crps), 4).alias("crps"))


@query("log_score", f"""SELECT model, round(avg({_Z} ^ 2 / 2 + ln((hi - lo) / 3.289707253902943::DOUBLE) + 0.9189385332046727::DOUBLE), 6) AS log_score FROM fc WHERE hi > lo GROUP BY 1""")
def log_score(spark, sf_dir):
    """Negative log-density of the normal distribution that the interval stands for."""
    sigma, x = _standard()
    return forecasts(spark, sf_dir).where("hi > lo").groupBy("model").agg(R6(F.avg(x * x / 2 + F.log(sigma) + 0.9189385332046727)).alias("log_score"))


_PIT = f"SELECT model, series_id, fold, h, {sql_norm_cdf('z')} AS pit FROM (SELECT *, {_Z} AS z FROM fc WHERE hi > lo)"


def _pits(spark, sf_dir):
    return forecasts(spark, sf_dir).where("hi > lo").withColumn("z", _standard()[1]).select("model", "series_id", "fold", "h", norm_cdf(F.col("z")).alias("pit"))


@query("pit", f"SELECT model, series_id, fold, h, round(pit, 6) AS pit FROM ({_PIT})")
def pit(spark, sf_dir):
    return _pits(spark, sf_dir).withColumn("pit", R6("pit"))


@query("pit_hist", f"""SELECT m.model, b.bin::BIGINT AS bin, count(x.pit) AS n FROM (SELECT DISTINCT model FROM fc) m CROSS JOIN range(20) b(bin)
LEFT JOIN (SELECT model, least(floor(pit * 20), 19) AS bin, pit FROM ({_PIT})) x ON x.model = m.model AND x.bin = b.bin GROUP BY 1, 2""")  # fmt: skip
def pit_hist(spark, sf_dir):
    found = _pits(spark, sf_dir).groupBy("model", F.least(F.floor(F.col("pit") * 20), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"))
    grid = found.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<bigint>")).alias("bin"))
    return grid.join(found, ["model", "bin"], "left").select("model", "bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("reliability", """SELECT model, a::DOUBLE AS alpha, round(avg(CASE WHEN abs(y_true - y_pred) <= (hi - lo) / 3.289707253902943::DOUBLE * q THEN 1 ELSE 0 END), 6) AS empirical,
  round(avg(2 * (hi - lo) / 3.289707253902943::DOUBLE * q), 4) AS width
FROM fc, (VALUES (0.05::DOUBLE, 1.9599639845400536::DOUBLE), (0.2::DOUBLE, 1.2815515655446008::DOUBLE), (0.5::DOUBLE, 0.6744897501960818::DOUBLE)) v(a, q) GROUP BY 1, 2""")  # fmt: skip
def reliability(spark, sf_dir):
    return compare.reliability(forecasts(spark, sf_dir), (0.05, 0.2, 0.5), 0.1).select("model", "alpha", R6("empirical").alias("empirical"), F.round("width", 4).alias("width"))


@query("sharpness", f"SELECT model, 0.9::DOUBLE AS nominal, {_INTERVAL} FROM fc GROUP BY 1")
def sharpness(spark, sf_dir):
    return interval_metrics(spark, sf_dir).withColumn("nominal", F.lit(0.9))


@query("error_by_horizon", """SELECT model, h, round(avg(abs(y_true - y_pred)), 6) AS mae, round(avg(y_pred - y_true), 6) AS bias,
  rank() OVER (PARTITION BY model ORDER BY round(avg(abs(y_true - y_pred)), 6)) = 1 AS best FROM fc GROUP BY 1, 2""")  # fmt: skip
def error_by_horizon(spark, sf_dir):
    by = forecasts(spark, sf_dir).groupBy("model", "h").agg(R6(M.mae()).alias("mae"), R6(F.avg(M.p() - M.y())).alias("bias"))
    return by.withColumn("best", F.rank().over(Window.partitionBy("model").orderBy("mae")) == 1)


@query("error_dist", """SELECT model, round(quantile_cont(y_pred - y_true, 0.05), 6) AS p05, round(quantile_cont(y_pred - y_true, 0.5), 6) AS p50, round(quantile_cont(y_pred - y_true, 0.95), 6) AS p95 FROM fc GROUP BY 1""")
def error_dist(spark, sf_dir):
    errors = forecasts(spark, sf_dir).select(F.col("model").alias("feature"), (M.p() - M.y()).alias("x"))
    found = ranks.percentiles(errors, [0.05, 0.5, 0.95])
    return found.select(F.col("feature").alias("model"), *[R6(F.get("quantiles", F.lit(k))).alias(n) for k, n in enumerate(("p05", "p50", "p95"))])


_D = """SELECT series_id, fold, h, row_number() OVER (ORDER BY series_id, fold, h) AS i, abs(b.y_true - b.y_pred) - abs(a.y_true - a.y_pred) AS d
  FROM fc a JOIN fc b USING (series_id, fold, h) WHERE a.model = 'seasonal_naive' AND b.model = 'trend_profile'"""


@query("dm_stat", f"""SELECT 'trend_profile' AS model, round(avg(d) / sqrt(greatest(var_pop(d), 1e-12) / count(*)) * sqrt((count(*) - 1.0) / count(*)), 6) AS dm, CASE WHEN avg(d) < 0 THEN 'trend_profile' ELSE 'seasonal_naive' END AS better, count(*) AS n
FROM ({_D})""")  # fmt: skip
def dm_stat(spark, sf_dir):
    return compare.diebold_mariano(forecasts(spark, sf_dir), "seasonal_naive").select("model", R6("dm").alias("dm"), "better", "n")


@query("gw_test", f"""SELECT model, round(stat, 5) AS stat, round(exp(-stat / 2), 6) AS p FROM (
  SELECT 'trend_profile' AS model, n * (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (s11 * s22 - s12 * s12) AS stat FROM (
    SELECT count(*) AS n, avg(d) AS m1, avg(d * l) AS m2, avg(d * d) AS s11, avg(d * d * l) AS s12, avg(d * l * d * l) AS s22
    FROM (SELECT d, coalesce(lag(d) OVER (PARTITION BY series_id ORDER BY fold, h), 0) AS l FROM ({_D}))))""")  # fmt: skip
def gw_test(spark, sf_dir):
    return compare.giacomini_white(forecasts(spark, sf_dir), "seasonal_naive").select("model", F.round("stat", 5).alias("stat"), R6("p").alias("p"))


_BOARD = f"""SELECT model, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg((y_true - y_pred) ^ 2)), 6) AS rmse, {_INTERVAL},
  round(avg(CASE WHEN y_pred > y_true THEN y_pred - y_true ELSE 3 * (y_true - y_pred) END), 6) AS nv_cost,
  round((1 - avg(abs(y_true - y_pred)) / (SELECT avg(abs(y_true - y_pred)) FROM fc WHERE model = 'seasonal_naive')) * 100, 4) AS skill FROM fc GROUP BY 1"""


@query("leaderboard", _BOARD)
def leaderboard(spark, sf_dir):
    return compare.leaderboard(forecasts(spark, sf_dir), "seasonal_naive", 0.1)


_DEVIATE = """u + (u ^ 3 + 3 * u) / (48 * a * a) - (4 * u ^ 7 + 33 * u ^ 5 + 240 * u ^ 3 + 855 * u) / (480 * a * a * (48 * a * a + 0.8::DOUBLE * u ^ 4 + 100))"""
_DM_P = f"""SELECT 'trend_profile' AS model, 2 * {sql_norm_cdf("(-v)")} AS p FROM (SELECT {_DEVIATE} AS v FROM (SELECT n - 1.5::DOUBLE AS a, sqrt((n - 1.5::DOUBLE) * ln(1 + dm * dm / (n - 1))) AS u
  FROM (SELECT count(*) AS n, avg(d) / sqrt(greatest(var_pop(d), 1e-12) / count(*)) * sqrt((count(*) - 1.0) / count(*)) AS dm FROM ({_D}))))"""


@query("leaderboard_dm", f"""SELECT b.*, round(p, 6) AS dm_p, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' WHEN model = 'seasonal_naive' THEN '—' ELSE '' END AS sig
FROM ({_BOARD}) b LEFT JOIN ({_DM_P}) USING (model)""")  # fmt: skip
def leaderboard_dm(spark, sf_dir):
    """The leaderboard with the p-value of the Diebold-Mariano test against the baseline, and stars."""
    return compare.significance(leaderboard(spark, sf_dir), forecasts(spark, sf_dir), "seasonal_naive").withColumn("dm_p", R6("dm_p"))


@query("normalized_scores", f"""SELECT model, CASE WHEN max(mae) OVER () = min(mae) OVER () THEN 1 ELSE round((max(mae) OVER () - mae) / (max(mae) OVER () - min(mae) OVER ()), 6) END AS mae,
  CASE WHEN max(coverage) OVER () = min(coverage) OVER () THEN 1 ELSE round((coverage - min(coverage) OVER ()) / (max(coverage) OVER () - min(coverage) OVER ()), 6) END AS coverage FROM ({_BOARD})""")  # fmt: skip
def normalized_scores(spark, sf_dir):
    return compare.normalise(leaderboard(spark, sf_dir), {"mae": False, "coverage": True})


@query("metrics_long", f"SELECT model, metric, value FROM (UNPIVOT (SELECT model, mae, rmse, coverage, nv_cost, skill FROM ({_BOARD})) ON mae, rmse, coverage, nv_cost, skill INTO NAME metric VALUE value)")
def metrics_long(spark, sf_dir):
    names = ["mae", "rmse", "coverage", "nv_cost", "skill"]
    return leaderboard(spark, sf_dir).unpivot(["model"], names, "metric", "value")


@query("compare_runs", """SELECT metric, round(a, 5) AS a, round(b, 5) AS b, round(b - a, 5) AS diff, model FROM (
  SELECT model, 'mae' AS metric, avg(abs(y_true - y_pred)) FILTER (fold < 4) AS a, avg(abs(y_true - y_pred)) FILTER (fold >= 4) AS b FROM fc GROUP BY 1
  UNION ALL SELECT model, 'rmse', sqrt(avg((y_true - y_pred) ^ 2) FILTER (fold < 4)), sqrt(avg((y_true - y_pred) ^ 2) FILTER (fold >= 4)) FROM fc GROUP BY 1)""")  # fmt: skip
def compare_runs(spark, sf_dir):
    """The earlier folds against the later ones, metric by metric."""
    fc = forecasts(spark, sf_dir)
    run = lambda rows: rows.groupBy("model").agg(M.mae().alias("mae"), M.rmse().alias("rmse")).unpivot(["model"], ["mae", "rmse"], "metric", "value")
    return compare.run_diff(run(fc.where("fold < 4")), run(fc.where("fold >= 4")))


@query("pareto_front", """SELECT series_id, model, mae, winkler FROM (SELECT *, min(winkler) OVER (PARTITION BY series_id ORDER BY mae, winkler, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (
  SELECT series_id, model, round(avg(abs(y_true - y_pred)), 6) AS mae, round(avg(hi - lo + 20 * greatest(lo - y_true, 0) + 20 * greatest(y_true - hi, 0)), 4) AS winkler FROM fc GROUP BY 1, 2)) WHERE best IS NULL OR winkler < best""")  # fmt: skip
def pareto_front(spark, sf_dir):
    scores = forecasts(spark, sf_dir).groupBy("series_id", "model").agg(R6(M.mae()).alias("mae"), F.round(M.winkler(0.1), 4).alias("winkler"))
    return compare.pareto(scores, "series_id", "mae", "winkler")


_ENS = """SELECT model, round(avg(abs(y_true - y_pred)), 6) AS mae FROM (%s) GROUP BY 1"""


@query("ensemble_uniform", "SELECT series_id, fold, h, round(avg(y_pred), 6) AS y_pred FROM fc GROUP BY 1, 2, 3")
def ensemble_uniform(spark, sf_dir):
    return forecasts(spark, sf_dir).groupBy("series_id", "fold", "h").agg(R6(F.avg("y_pred")).alias("y_pred"))


@query("ensemble_inv_mae", """SELECT f.series_id, f.fold, h, round(sum(y_pred / (e + 1e-9)) / sum(1 / (e + 1e-9)), 5) AS y_pred FROM fc f
JOIN (SELECT model, series_id, fold + 1 AS fold, avg(abs(y_true - y_pred)) AS e FROM fc GROUP BY ALL) w USING (model, series_id, fold) GROUP BY 1, 2, 3""")  # fmt: skip
def ensemble_inv_mae(spark, sf_dir):
    """Weights from the fold before, which ended before this one's forecasts begin."""
    fc = forecasts(spark, sf_dir)
    w = fc.groupBy("model", "series_id", (F.col("fold") + 1).alias("fold")).agg((1 / (M.mae() + 1e-9)).alias("w"))
    joined = fc.join(w, ["model", "series_id", "fold"])
    return joined.groupBy("series_id", "fold", "h").agg(F.round(F.sum(F.col("y_pred") * F.col("w")) / F.sum("w"), 5).alias("y_pred"))


_BOARD_BY_FOLD = """SELECT model, series_id, fold, avg(e) OVER (PARTITION BY model, series_id ORDER BY fold ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling
  FROM (SELECT model, series_id, fold, avg(abs(y_true - y_pred)) AS e FROM fc GROUP BY ALL)"""


@query("scoreboard", f"SELECT model, series_id, fold, round(rolling, 6) AS rolling_mae FROM ({_BOARD_BY_FOLD})")
def scoreboard(spark, sf_dir):
    return compare.scoreboard(forecasts(spark, sf_dir), 3).select("model", "series_id", "fold", R6("rolling").alias("rolling_mae"))


@query("best_of_n", f"""SELECT series_id, fold, h, round(CASE WHEN count(rolling) = 0 THEN avg(y_pred) ELSE arg_min(y_pred, round(rolling, 9)) END, 6) AS y_pred
FROM fc JOIN ({_BOARD_BY_FOLD}) USING (model, series_id, fold) GROUP BY 1, 2, 3""")  # fmt: skip
def best_of_n(spark, sf_dir):
    """The model with the lowest mean error over the last folds; their average where none has a record yet."""
    fc = forecasts(spark, sf_dir)
    return compare.best_of_n(fc, compare.scoreboard(fc, 3)).select("series_id", "fold", "h", R6("y_pred").alias("y_pred"))


@query("conformal", """SELECT f.model, f.series_id, f.fold, h, round(y_pred - r, 5) AS lo, round(y_pred + r, 5) AS hi FROM fc f
JOIN (SELECT model, series_id, fold + 1 AS fold, quantile_cont(abs(y_true - y_pred), 0.9) AS r FROM fc GROUP BY ALL) USING (model, series_id, fold)""")  # fmt: skip
def conformal(spark, sf_dir):
    """Radius: the 90 % quantile of the absolute errors of the fold before, which is the calibration part of this one's training rows."""
    fc = forecasts(spark, sf_dir)
    radius = fc.groupBy("model", "series_id", (F.col("fold") + 1).alias("fold")).agg(F.percentile(F.abs(M.y() - M.p()), 0.9).alias("r"))
    out = fc.join(radius, ["model", "series_id", "fold"])
    return out.select("model", "series_id", "fold", "h", F.round(F.col("y_pred") - F.col("r"), 5).alias("lo"), F.round(F.col("y_pred") + F.col("r"), 5).alias("hi"))


@query("verdict", f"""SELECT coalesce(string_agg(model, ', ' ORDER BY model), 'nothing beats seasonal_naive') AS verdict FROM ({_BOARD}) JOIN ({_DM_P}) USING (model) WHERE skill > 0 AND p < 0.05""")
def verdict(spark, sf_dir):
    """Models with a lower error than the baseline's at p < 0.05."""
    return compare.verdict(compare.significance(leaderboard(spark, sf_dir), forecasts(spark, sf_dir), "seasonal_naive"), "seasonal_naive")


@query("verdict_dm", f"""SELECT model, skill, round(p, 6) AS dm_p, coalesce(skill > 0 AND p < 0.05, false) AS beats FROM ({_BOARD}) LEFT JOIN ({_DM_P}) USING (model)""")
def verdict_dm(spark, sf_dir):
    """Of each model, what the verdict rests on."""
    board = compare.significance(leaderboard(spark, sf_dir), forecasts(spark, sf_dir), "seasonal_naive")
    return board.select("model", "skill", R6("dm_p").alias("dm_p"), F.coalesce((F.col("skill") > 0) & (F.col("dm_p") < 0.05), F.lit(False)).alias("beats"))


_SIGMA = "((hi - lo) / 3.289707253902943::DOUBLE)"


@query("forecast_quantile", f"SELECT model, series_id, fold, h, round(y_pred + 0.6744897501960818::DOUBLE * {_SIGMA}, 5) AS q75 FROM fc")
def forecast_quantile(spark, sf_dir):
    return forecasts(spark, sf_dir).select("model", "series_id", "fold", "h", F.round(compare.quantile(0.75, 0.1), 5).alias("q75"))


@query("newsvendor_order", f"SELECT model, series_id, fold, h, round(greatest(y_pred + 0.6744897501960818::DOUBLE * {_SIGMA}, 0), 5) AS order_qty FROM fc")
def newsvendor_order(spark, sf_dir):
    """Order at the quantile c_under / (c_under + c_over) = 3 / 4, not below 0."""
    return forecasts(spark, sf_dir).select("model", "series_id", "fold", "h", F.round(F.greatest(compare.quantile(3 / 4, 0.1), F.lit(0.0)), 5).alias("order_qty"))


@query("safety_stock", f"""SELECT model, series_id, fold, round(1.6448536269514715::DOUBLE * sqrt(sum({_SIGMA} ^ 2)), 4) AS safety_stock,
  round(sum(y_pred) + 1.6448536269514715::DOUBLE * sqrt(sum({_SIGMA} ^ 2)), 4) AS reorder_point FROM fc WHERE h <= 7 GROUP BY 1, 2, 3""")  # fmt: skip
def safety_stock(spark, sf_dir):
    sigma = F.sqrt(F.sum(_standard()[0] * _standard()[0])) * 1.6448536269514715
    lead = forecasts(spark, sf_dir).where("h <= 7").groupBy("model", "series_id", "fold")
    return lead.agg(F.round(sigma, 4).alias("safety_stock"), F.round(F.sum("y_pred") + sigma, 4).alias("reorder_point"))


@query("dispatch", f"""SELECT model, series_id, fold, h, round(y_pred + 1.6448536269514715::DOUBLE * {_SIGMA}, 4) AS upper, y_pred + 1.6448536269514715::DOUBLE * {_SIGMA} > 400 AS trigger,
  round(greatest(y_pred - 400, 0), 4) AS overage FROM fc""")  # fmt: skip
def dispatch(spark, sf_dir):
    """Act where the upper 95 % bound is above a capacity of 400."""
    upper = compare.quantile(0.95, 0.1)
    return forecasts(spark, sf_dir).select("model", "series_id", "fold", "h", F.round(upper, 4).alias("upper"), (upper > 400).alias("trigger"), F.round(F.greatest(M.p() - 400, F.lit(0.0)), 4).alias("overage"))


@query("decisions_best", f"""SELECT series_id, h, round(greatest(y_pred + 0.6744897501960818::DOUBLE * {_SIGMA}, 0), 5) AS order_qty FROM fc
WHERE model = (SELECT arg_min(model, round(mae, 9)) FROM (SELECT model, avg(abs(y_true - y_pred)) AS mae FROM fc GROUP BY 1)) AND fold = (SELECT max(fold) FROM fc)""")  # fmt: skip
def decisions_best(spark, sf_dir):
    """The last fold's orders of the model with the lowest error."""
    fc = forecasts(spark, sf_dir)
    best = fc.groupBy("model").agg(F.round(M.mae(), 9).alias("mae")).agg(F.min_by("model", "mae").alias("best"))
    last = fc.agg(F.max("fold").alias("last"))
    chosen = fc.join(F.broadcast(best), F.col("model") == F.col("best")).join(F.broadcast(last), F.col("fold") == F.col("last"))
    return chosen.select("series_id", "h", F.round(F.greatest(compare.quantile(3 / 4, 0.1), F.lit(0.0)), 5).alias("order_qty"))
