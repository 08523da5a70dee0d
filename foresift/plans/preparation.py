"""Queries of panel preparation and features over the hourly panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foresift.operators import features, prepare
from foresift.plans.common import query
from foresift.sources import panels

R6 = lambda c: F.round(c, 6)
_BY = "PARTITION BY series_id ORDER BY t"


@query("regularize", "SELECT series_id, ds, t, y FROM ehour_null")
def regularize(spark, sf_dir):
    return panels.hourly_events(spark, sf_dir)


@query("tail_n", "SELECT series_id, ds, y FROM ehour QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 48")
def tail_n(spark, sf_dir):
    """The last 48 rows of each series, the window that is scored."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("ds").desc()))
    return panels.filled_hourly(spark, sf_dir).withColumn("rank", rank).where("rank <= 48").select("series_id", "ds", "y")


@query("src_parquet_where", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1")
def src_parquet_where(spark, sf_dir):
    """An equality filter on a Parquet source; it reaches the scan."""
    from foresift.sources import connectors

    rows = connectors.source(spark, "parquet", f"{sf_dir}/events.parquet", {"event_type": "click"}).where("user_id % 2 = 0")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("fill_forward", f"""SELECT series_id, t, coalesce(last_value(y IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING),
  first_value(y IGNORE NULLS) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM gappy""")  # fmt: skip
def fill_forward(spark, sf_dir):
    return prepare.fill_forward(panels.gappy_hourly(spark, sf_dir)).select("series_id", "t", "y")


@query("fill_zero", "SELECT series_id, t, coalesce(y, 0) AS y FROM gappy")
def fill_zero(spark, sf_dir):
    return prepare.fill_zero(panels.gappy_hourly(spark, sf_dir)).select("series_id", "t", "y")


_INTERPOLATE = f"""SELECT series_id, t, round(coalesce(y, y0 + (y1 - y0) * (t - t0) / (t1 - t0), y0, y1), 6) AS y FROM (
  SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
    first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1
  FROM (%s) WINDOW b AS ({_BY} ROWS UNBOUNDED PRECEDING), a AS ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("regularize_interpolate", _INTERPOLATE % "SELECT * FROM ehour_null")
def regularize_interpolate(spark, sf_dir):
    return prepare.interpolate(panels.hourly_events(spark, sf_dir)).select("series_id", "t", R6("y").alias("y"))


@query("interpolate", _INTERPOLATE % "SELECT * FROM gappy")
def interpolate(spark, sf_dir):
    return prepare.interpolate(panels.gappy_hourly(spark, sf_dir)).select("series_id", "t", R6("y").alias("y"))


@query("fill_seasonal", _INTERPOLATE % f"SELECT series_id, t, coalesce(y, lag(y, 24) OVER ({_BY}), lag(y, 48) OVER ({_BY}), lag(y, 72) OVER ({_BY})) AS y FROM gappy")
def fill_seasonal(spark, sf_dir):
    return prepare.fill_seasonal(panels.gappy_hourly(spark, sf_dir), 24).select("series_id", "t", R6("y").alias("y"))


_HAMPEL = f"""SELECT series_id, t, y, med, dev > 3 * 1.4826::DOUBLE * quantile_cont(dev, 0.5) OVER w AS outlier FROM (
  SELECT *, abs(y - med) AS dev FROM (SELECT *, quantile_cont(y, 0.5) OVER ({_BY} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS med FROM ehour))
  WINDOW w AS ({_BY} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"""


@query("hampel", f"SELECT series_id, t, round(CASE WHEN outlier THEN med ELSE y END, 6) AS y, outlier FROM ({_HAMPEL})")
def hampel(spark, sf_dir):
    return prepare.hampel(panels.filled_hourly(spark, sf_dir)).select("series_id", "t", R6("y").alias("y"), "outlier")


_PARTS = f"""SELECT *, y - trend - seasonal AS resid FROM (SELECT *, part - avg(part) OVER (PARTITION BY series_id) AS seasonal FROM (
  SELECT *, avg(y - trend) OVER (PARTITION BY series_id, t % 24) AS part FROM (SELECT *, avg(y) OVER ({_BY} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS trend FROM ehour)))"""


@query("decompose", f"SELECT series_id, t, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM ({_PARTS})")
def decompose(spark, sf_dir):
    return prepare.decompose(panels.filled_hourly(spark, sf_dir), 24).select("series_id", "t", *[R6(c).alias(c) for c in ("trend", "seasonal", "resid")])


@query("decompose_outliers", f"""SELECT series_id, t, round(CASE WHEN dev > most THEN trend + seasonal ELSE y END, 6) AS y, dev > most AS outlier FROM (
  SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY series_id) * 1.4826::DOUBLE * 3 AS most FROM (
    SELECT *, abs(resid - quantile_cont(resid, 0.5) OVER (PARTITION BY series_id)) AS dev FROM ({_PARTS})))""")  # fmt: skip
def decompose_outliers(spark, sf_dir):
    return prepare.decompose_outliers(panels.filled_hourly(spark, sf_dir), 24).select("series_id", "t", R6("y").alias("y"), "outlier")


_POINTS = f"""SELECT series_id, t, ds FROM (SELECT *, row_number() OVER ({_BY}) - 1 AS k FROM (
  SELECT *, stddev_samp(jump) OVER (PARTITION BY series_id) * 3 AS most FROM (
    SELECT *, abs(mean - lag(mean) OVER ({_BY})) AS jump FROM (SELECT *, CASE WHEN t >= 47 THEN avg(y) OVER ({_BY} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) END AS mean FROM ehour)))
  WHERE jump > most) WHERE k % 48 = 0"""


@query("changepoint_cusum", _POINTS)
def changepoint_cusum(spark, sf_dir):
    return prepare.changepoints(panels.filled_hourly(spark, sf_dir))


@query("since_changepoint", f"""SELECT p.series_id, p.t, coalesce(floor(date_diff('second', max(c.ds), p.ds) / 86400), 0)::BIGINT AS since_changepoint
FROM ehour p LEFT JOIN ({_POINTS}) c ON c.series_id = p.series_id AND c.t <= p.t GROUP BY p.series_id, p.t, p.ds""")  # fmt: skip
def since_changepoint(spark, sf_dir):
    panel = panels.filled_hourly(spark, sf_dir)
    return prepare.since_changepoint(panel, prepare.changepoints(panel)).select("series_id", "t", "since_changepoint")


_LAGS = ", ".join(f"lag(y, {k}) OVER ({_BY}) AS y_lag{k}" for k in (1, 24, 168))
_CAL = "hour(ds) AS hour, isodow(ds) - 1 AS dow, month(ds) AS month, week(ds) AS week, isodow(ds) >= 6 AS weekend"


@query("lag_features", f"SELECT series_id, t, y, {_LAGS} FROM ehour")
def lag_features(spark, sf_dir):
    return features.lags(panels.filled_hourly(spark, sf_dir), (1, 24, 168)).drop("ds")


@query("calendar_features", f"SELECT series_id, ds, t, y, {_CAL} FROM ehour")
def calendar_features(spark, sf_dir):
    return features.calendar(panels.filled_hourly(spark, sf_dir))


@query("build_matrix", f"SELECT * FROM (SELECT series_id, ds, t, y, {_LAGS}, {_CAL} FROM ehour) WHERE y_lag168 IS NOT NULL")
def build_matrix(spark, sf_dir):
    return features.design_matrix(panels.filled_hourly(spark, sf_dir), (1, 24, 168))


_FOURIER = ", ".join(f"round({fn}(2 * pi() * {k} * (date_diff('hour', TIMESTAMP '1970-01-01', ds) % {p}) / {p}), 6) + 0.0::DOUBLE AS {fn}_{p}_{k}" for p in (24, 168) for k in (1, 2, 3) for fn in ("sin", "cos"))


@query("fourier_features", f"SELECT series_id, t, {_FOURIER} FROM ehour")
def fourier_features(spark, sf_dir):
    rows = features.fourier(panels.filled_hourly(spark, sf_dir))
    return rows.select("series_id", "t", *[(R6(c) + 0.0).alias(c) for c in rows.columns if c.startswith(("sin_", "cos_"))])


_DAYS = "(SELECT ds::DATE FROM ehour WHERE day(ds) IN (1, 15))"


@query("holiday_flags", f"SELECT series_id, t, ds::DATE IN {_DAYS} AS holiday, (ds::DATE + 1) IN {_DAYS} AS before, (ds::DATE - 1) IN {_DAYS} AS after FROM ehour")
def holiday_flags(spark, sf_dir):
    """Holidays here: the first and the fifteenth of each month."""
    panel = panels.filled_hourly(spark, sf_dir)
    days = panel.where(F.dayofmonth("ds").isin(1, 15)).select(F.to_date("ds").alias("day")).distinct()
    return features.holidays(panel, days).select("series_id", "t", "holiday", "before", "after")


@query("target_encode", """SELECT e.series_id, e.t, round((n * m + 10 * g) / (n + 10), 6) AS hour_enc FROM ehour e
JOIN (SELECT hour(ds) AS hour, count(*) AS n, avg(y) AS m FROM ehour WHERE t < 500 GROUP BY 1) b ON b.hour = hour(e.ds), (SELECT avg(y) AS g FROM ehour WHERE t < 500)""")  # fmt: skip
def target_encode(spark, sf_dir):
    rows = features.calendar(panels.filled_hourly(spark, sf_dir))
    return features.target_encode(rows.where("t < 500"), rows, "hour", "y").select("series_id", "t", R6("hour_enc").alias("hour_enc"))


@query("interactions", f"""SELECT series_id, t, round(y * y_lag1, 4) AS y_x_y_lag1, round(CASE WHEN y_lag1 = 0 THEN 0 ELSE y / y_lag1 END, 6) AS y_div_y_lag1, round(y - y_lag1, 6) AS y_sub_y_lag1
FROM (SELECT *, lag(y, 1) OVER ({_BY}) AS y_lag1 FROM ehour)""")  # fmt: skip
def interactions(spark, sf_dir):
    rows = features.interactions(features.lags(panels.filled_hourly(spark, sf_dir), (1,)), "y", "y_lag1")
    return rows.select("series_id", "t", F.round("y_x_y_lag1", 4).alias("y_x_y_lag1"), R6("y_div_y_lag1").alias("y_div_y_lag1"), R6("y_sub_y_lag1").alias("y_sub_y_lag1"))


_CORR = f"SELECT abs(corr(y_lag1, y)) AS y_lag1, abs(corr(y_lag24, y)) AS y_lag24, abs(corr(y_lag168, y)) AS y_lag168 FROM (SELECT y, {_LAGS} FROM ehour)"


@query("feature_prune_corr", f"""SELECT feature, round(r / m, 6) AS importance FROM (SELECT *, max(r) OVER () AS m FROM (
  SELECT unnest(['y_lag1', 'y_lag24', 'y_lag168']) AS feature, unnest([y_lag1, y_lag24, y_lag168]) AS r FROM ({_CORR}))) WHERE r / m >= 0.5""")  # fmt: skip
def feature_prune_corr(spark, sf_dir):
    rows = features.lags(panels.filled_hourly(spark, sf_dir), (1, 24, 168))
    return features.prune(rows, "y", ["y_lag1", "y_lag24", "y_lag168"], 0.5).select("feature", R6("importance").alias("importance"))


@query("covariate_join", """SELECT e.series_id, e.t, e.y, c.price FROM ehour e LEFT JOIN (SELECT date_trunc('hour', o_orderdate) AS ds, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1) c ON c.ds = e.ds WHERE e.t BETWEEN 100 AND 400""")
def covariate_join(spark, sf_dir):
    """A covariate known by time alone, aligned with the panel and cut to a range."""
    cov = panels.table(spark, sf_dir, "orders").groupBy(F.date_trunc("hour", "o_orderdate").cast("timestamp_ntz").alias("ds")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    return panels.filled_hourly(spark, sf_dir).where("t BETWEEN 100 AND 400").join(cov, "ds", "left").select("series_id", "t", "y", "price")


_WINDOWS = f"""SELECT series_id, t, list(y) OVER ({_BY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS context, list(y) OVER ({_BY} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS future FROM ehour"""


@query("training_windows", f"""SELECT series_id, t, round(list_sum(context), 4) AS context_sum, round(future[1], 6) AS first_y, round(future[6], 6) AS last_y FROM ({_WINDOWS}) WHERE len(context) = 24 AND len(future) = 6""")
def training_windows(spark, sf_dir):
    rows = features.training_windows(panels.filled_hourly(spark, sf_dir), 24, 6)
    total = F.aggregate("context", F.lit(0.0), lambda a, x: a + x)
    return rows.select("series_id", "t", F.round(total, 4).alias("context_sum"), R6(F.get("future", F.lit(0))).alias("first_y"), R6(F.get("future", F.lit(5))).alias("last_y"))


@query("patchify", f"""SELECT series_id, t, k::BIGINT AS k, round(list_sum(context[k * 4 + 1:k * 4 + 8]), 4) AS patch_sum FROM ({_WINDOWS}), range(5) r(k) WHERE len(context) = 24 AND len(future) = 6""")
def patchify(spark, sf_dir):
    rows = features.patches(features.training_windows(panels.filled_hourly(spark, sf_dir), 24, 6), 8, 4, 24)
    parts = rows.select("series_id", "t", F.posexplode("patches").alias("k", "patch"))
    return parts.select("series_id", "t", F.col("k").cast("long").alias("k"), F.round(F.aggregate("patch", F.lit(0.0), lambda a, x: a + x), 4).alias("patch_sum"))


def _u(text: str, start: int) -> str:
    return f"((('0x' || substr(md5({text}), {start}, 15))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(16**15)!r}::DOUBLE)"


_POINT = "('42/' || series_id || '/' || t::VARCHAR)"
_PUT = {
    "spike": f"y + CASE WHEN {_u(_POINT, 16)} < 0.5::DOUBLE THEN -1 ELSE 1 END * step",
    "level_shift": "y + step",
    "dropout": "NULL",
    "gaussian": f"y + sqrt(-2 * ln({_u(_POINT + " || '/a'", 1)})) * cos(2 * pi() * {_u(_POINT + " || '/b'", 1)}) * step",
}


def _inject(kind: str) -> None:
    """Five points of each series, five standard deviations."""
    start = f"(1 + floor({_u("('42/' || series_id)", 1)} * greatest(1, size - 6)))"
    hit = f"t >= {start} AND t < {start} + 5" if kind == "level_shift" else f"row_number() OVER (PARTITION BY series_id ORDER BY {_u(_POINT, 1)}, t) <= 5"

    @query(f"inject_{kind}", f"""SELECT series_id, t, round(CASE WHEN injected THEN {_PUT[kind]} ELSE y END, 5) AS y, injected FROM (SELECT *, {hit} AS injected FROM (
  SELECT *, coalesce(nullif(stddev_samp(y) OVER (PARTITION BY series_id), 0), 1) * 5 AS step, count(*) OVER (PARTITION BY series_id) AS size FROM ehour))""")  # fmt: skip
    def run(spark, sf_dir):
        return prepare.inject(panels.filled_hourly(spark, sf_dir), kind).select("series_id", "t", F.round("y", 5).alias("y"), "injected")


for _kind in _PUT:
    _inject(_kind)
