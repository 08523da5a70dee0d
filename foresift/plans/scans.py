"""Queries of operators that read a series in blocks or rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from foresift.operators import autoregression, forecasters, quantile_trees, segments, stacking
from foresift.operators.folds import HOURLY
from foresift.plans.backtests import forecasts
from foresift.plans.common import query, sql_tied, tied
from foresift.sources import panels


@query("changepoint_segments", """SELECT * FROM (WITH RECURSIVE sums AS MATERIALIZED (
  SELECT series_id, t, y, row_number() OVER w AS k, sum(y) OVER w AS u FROM ehour WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)
), open AS (
  SELECT series_id, -1::BIGINT AS depth, 0::BIGINT AS lo, max(k) AS hi, 0::DOUBLE AS u_lo, arg_max(u, k) AS u_hi, var_pop(y) * 2 AS most, NULL::BIGINT AS t, NULL::DOUBLE AS gain FROM sums GROUP BY 1
  UNION ALL
  SELECT series_id, depth, unnest([lo, -b.back]), unnest([-b.back, hi]), unnest([u_lo, b.u]), unnest([b.u, u_hi]), most, b.t, b.gain FROM (
    SELECT series_id, depth + 1 AS depth, lo, hi, u_lo, u_hi, most, max({gain: g, back: 1 - k, t: t, u: u}) AS b FROM (
      SELECT o.series_id, o.depth, o.lo, o.hi, o.u_lo, o.u_hi, o.most, s.k, s.t, s.u - s.y AS u,
             (s.u - s.y - o.u_lo) ^ 2 / (s.k - 1 - o.lo) + (o.u_hi - s.u + s.y) ^ 2 / (o.hi - s.k + 1) - (o.u_hi - o.u_lo) ^ 2 / (o.hi - o.lo) AS g
      FROM open o JOIN sums s ON s.series_id = o.series_id AND s.k - 1 >= o.lo + 2 AND s.k - 1 <= o.hi - 2)
    GROUP BY 1, 2, 3, 4, 5, 6, 7) WHERE b.gain > most AND depth < 6
) SELECT DISTINCT series_id, t, depth, round(gain, 2) AS gain FROM open WHERE depth >= 0)""")  # fmt: skip
def changepoint_segments(spark, sf_dir):
    """All changepoints of the mean of each series, with the round that found them."""
    return segments.changepoints(panels.filled_hourly(spark, sf_dir), penalty=2.0).withColumn("gain", F.round("gain", 2))


@query("seasonal_ar", f"""SELECT * FROM (WITH RECURSIVE d AS MATERIALIZED (
  SELECT s.series_id, s.fold, s.te, e.t, e.d FROM splits s JOIN (SELECT series_id, t, y - lag(y, 24) OVER (PARTITION BY series_id ORDER BY t) AS d FROM ehour) e ON e.series_id = s.series_id AND e.t < s.te AND e.d IS NOT NULL
), x AS MATERIALIZED (SELECT series_id, fold, te, t, d - avg(d) OVER w AS x, avg(d) OVER w AS mean, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY series_id, fold)
), c AS MATERIALIZED (
  SELECT series_id, fold, any_value(n) AS n, list(c ORDER BY k) AS c FROM (
    SELECT a.series_id, a.fold, k, any_value(a.n) AS n, sum(a.x * b.x) / any_value(a.n) AS c FROM x a, range(6) r(k) JOIN x b ON b.series_id = a.series_id AND b.fold = a.fold AND b.t = a.t - k GROUP BY 1, 2, 3) GROUP BY 1, 2
), lev AS (
  SELECT series_id, fold, n, c, 0 AS k, []::DOUBLE[] AS phi, c[1] AS v FROM c UNION ALL
  SELECT series_id, fold, n, c, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - r * phi[k + 1 - j]), r), v * (1 - r * r) FROM (
    SELECT *, (c[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * c[k + 2 - j])), 0)) / v AS r FROM lev WHERE k < 5)
), best AS (
  SELECT series_id, fold, arg_min({{phi: phi, v: v, k: k}}, n * ln(v) + 2 * k) AS b FROM lev GROUP BY 1, 2
), go AS (
  SELECT series_id, fold, b.phi AS phi, b.v AS v, b.k AS ord, 0 AS h, past, [1.0::DOUBLE] AS psi, 0.0::DOUBLE AS off, 1.0::DOUBLE AS total
  FROM best JOIN (SELECT series_id, fold, list(x ORDER BY t DESC)[1:5] AS past FROM x WHERE t >= te - 5 GROUP BY 1, 2) p USING (series_id, fold) UNION ALL
  SELECT series_id, fold, phi, v, ord, h + 1, list_prepend(new, past)[1:5], list_prepend(w, psi)[1:5], new, CASE WHEN h = 0 THEN 1 ELSE total + psi[1] ^ 2 END FROM (
    SELECT *, coalesce(list_sum(list_transform(range(1, ord + 1), lambda j: phi[j] * past[j])), 0) AS new, coalesce(list_sum(list_transform(range(1, ord + 1), lambda j: phi[j] * coalesce(psi[j], 0))), 0) AS w FROM go WHERE h < 24)
) SELECT g.series_id, g.fold, g.h::BIGINT AS h, {sql_tied('a.y + m.mean + off', 3)} AS y_pred, {sql_tied('a.y + m.mean + off - 1.6448536269514715::DOUBLE * sqrt(v * total)', 3)} AS lo, {sql_tied('a.y + m.mean + off + 1.6448536269514715::DOUBLE * sqrt(v * total)', 3)} AS hi, ord::BIGINT AS "order"
FROM go g JOIN (SELECT DISTINCT series_id, fold, te, mean FROM x) m USING (series_id, fold) JOIN ehour a ON a.series_id = g.series_id AND a.t = m.te - 24 + (g.h - 1) % 24 WHERE g.h > 0)""")  # fmt: skip
def seasonal_ar(spark, sf_dir):
    """Orders up to five by AIC, with intervals."""
    rows = autoregression.seasonal_ar(panels.filled_hourly(spark, sf_dir), HOURLY)
    return rows.select("series_id", "fold", "h", *[tied(F.col(c), 3).alias(c) for c in ("y_pred", "lo", "hi")], "order")


@query("gbt_quantiles")
def gbt_quantiles(spark, sf_dir):
    """Forecast and 90 % band from boosted trees at three levels, fitted anew for every fold."""
    rows = quantile_trees.forecast(panels.filled_hourly(spark, sf_dir), HOURLY)
    return rows.select("series_id", "fold", "h", "t", *[F.round(F.get("quantiles", k), 6).alias(c) for k, c in ((1, "y_pred"), (0, "lo"), (2, "hi"))])


MEMBERS = ("recent_median", "seasonal_naive", "trend_profile")
_X = """SELECT a.series_id, a.fold, a.h, a.y_true AS y, [m.m, a.y_pred, b.y_pred] AS x FROM fc a JOIN fc b ON b.series_id = a.series_id AND b.fold = a.fold AND b.h = a.h AND b.model = 'trend_profile'
  JOIN (SELECT s.series_id, s.fold, quantile_cont(y, 0.5) AS m FROM splits s JOIN ehour e ON e.series_id = s.series_id AND t < te AND t >= te - 8 GROUP BY 1, 2) m ON m.series_id = a.series_id AND m.fold = a.fold WHERE a.model = 'seasonal_naive'"""


def _members(spark, sf_dir):
    """Both base models and the median of the last values."""
    panel = panels.filled_hourly(spark, sf_dir)
    flat = forecasters.recent_median(panel, HOURLY).join(panel.select("series_id", "t", F.col("y").alias("y_true")), ["series_id", "t"])
    return forecasts(spark, sf_dir).select("model", "series_id", "fold", "h", "y_true", "y_pred").unionByName(flat.select(F.lit("recent_median").alias("model"), "series_id", "fold", "h", "y_true", "y_pred"))


@query("stacking_lasso", f"""SELECT * FROM (WITH RECURSIVE x AS MATERIALIZED ({_X}), e AS MATERIALIZED (
  SELECT f.series_id, f.fold, k, j, count(*) AS n, avg(y) AS my, avg(x[k]) AS mx, avg(x[k] * y) - avg(x[k]) * avg(y) AS c, avg(x[k] * x[j]) - avg(x[k]) * avg(x[j]) AS g
  FROM splits f JOIN x ON x.series_id = f.series_id AND x.fold < f.fold, range(1, 4) a(k), range(1, 4) b(j) GROUP BY 1, 2, 3, 4
), m AS MATERIALIZED (SELECT series_id, fold, any_value(my) AS my, list(mx ORDER BY k) AS mx, list(c ORDER BY k) AS c, list(g ORDER BY k) AS g FROM (
  SELECT series_id, fold, k, any_value(my) AS my, any_value(mx) AS mx, any_value(c) AS c, list(g ORDER BY j) AS g FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2
), b AS (
  SELECT series_id, fold, 0 AS i, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS w, c, g FROM m UNION ALL
  SELECT series_id, fold, i + 1, list_transform([1, 2, 3], lambda k: CASE WHEN k <> j THEN w[k] WHEN g[j][j] > 1e-9 THEN sign(rest) * greatest(abs(rest) - 1, 0) / g[j][j] ELSE 0 END), c, g FROM (
    SELECT *, c[j] - list_sum(list_transform([1, 2, 3], lambda k: g[j][k] * w[k])) + g[j][j] * w[j] AS rest FROM (SELECT *, i % 3 + 1 AS j FROM b WHERE i < 120))
) SELECT x.series_id, x.fold, x.h, round(my + list_sum(list_transform([1, 2, 3], lambda k: w[k] * (x.x[k] - mx[k]))), 4) AS y_pred FROM x JOIN m ON m.series_id = x.series_id AND m.fold = x.fold JOIN b ON b.series_id = x.series_id AND b.fold = x.fold AND b.i = 120)""")  # fmt: skip
def stacking_lasso(spark, sf_dir):
    rows = stacking.lasso(_members(spark, sf_dir), MEMBERS)
    return rows.select("series_id", "fold", "h", F.round("y_pred", 4).alias("y_pred"))


def _level(of: str) -> str:
    """A level of the tree in SQL: rows of ``of`` with the node that the best split puts them in."""
    cells = f"SELECT series_id, fo, node, k, b[k] AS bin, count(*) AS n, sum(e) AS s FROM {of}, range(1, 4) r(k) WHERE fold < fo GROUP BY 1, 2, 3, 4, 5"
    cuts = f"SELECT *, sum(n) OVER u AS cn, sum(s) OVER u AS cs, sum(n) OVER w AS tn, sum(s) OVER w AS ts FROM ({cells}) WINDOW w AS (PARTITION BY series_id, fo, node, k), u AS (PARTITION BY series_id, fo, node, k ORDER BY bin)"
    gain = "round(cs ^ 2 / cn + (ts - cs) ^ 2 / (tn - cn) - ts ^ 2 / tn, 4)"
    best = f"SELECT series_id, fo, node, max({{gain: {gain}, k: -k, bin: -bin}}) AS best FROM ({cuts}) WHERE cn >= 8 AND tn - cn >= 8 AND {gain} > 0 GROUP BY 1, 2, 3"
    return f"SELECT t.* EXCLUDE (node), t.node * 2 + CASE WHEN best IS NOT NULL AND b[-best.k] > -best.bin THEN 1 ELSE 0 END AS node FROM {of} t LEFT JOIN ({best}) s ON s.series_id = t.series_id AND s.fo = t.fo AND s.node = t.node"


@query("stacking_tree", f"""SELECT * FROM (WITH x AS MATERIALIZED ({_X}), edges AS MATERIALIZED (
  SELECT series_id, fo, list(lo ORDER BY k) AS lo, list(hi ORDER BY k) AS hi FROM (SELECT f.series_id, f.fold AS fo, k, min(x[k]) AS lo, max(x[k]) AS hi FROM splits f JOIN x ON x.series_id = f.series_id AND x.fold < f.fold, range(1, 4) r(k) GROUP BY 1, 2, 3) GROUP BY 1, 2
), t0 AS MATERIALIZED (SELECT x.series_id, x.fold, x.h, d.fo, x.y - list_sum(x.x) / 3 AS e, list_sum(x.x) / 3 AS mean, 1::BIGINT AS node,
    list_transform([1, 2, 3], lambda k: CASE WHEN hi[k] > lo[k] THEN least(greatest(floor((x.x[k] - lo[k]) / (hi[k] - lo[k]) * 8), 0), 7) ELSE 0 END) AS b
  FROM x JOIN edges d ON d.series_id = x.series_id AND x.fold <= d.fo
), t1 AS MATERIALIZED ({_level("t0")}), t2 AS MATERIALIZED ({_level("t1")})
SELECT t.series_id, t.fold, t.h, round(t.mean + coalesce(move, 0), 4) AS y_pred, t.node AS leaf FROM t2 t LEFT JOIN (SELECT series_id, fo, node, avg(e) AS move FROM t2 WHERE fold < fo GROUP BY 1, 2, 3) v ON v.series_id = t.series_id AND v.fo = t.fo AND v.node = t.node WHERE t.fold = t.fo)""")  # fmt: skip
def stacking_tree(spark, sf_dir):
    rows = stacking.tree(_members(spark, sf_dir), MEMBERS)
    return rows.select("series_id", "fold", "h", F.round("y_pred", 4).alias("y_pred"), "leaf")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """What each feature of the boosted trees is worth to their median forecasts."""
    rows = quantile_trees.importance(panels.filled_hourly(spark, sf_dir), HOURLY)
    return rows.select("feature", F.round("loss", 3).alias("loss"), F.round("share", 5).alias("share"), "chosen")
