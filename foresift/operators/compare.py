"""Comparing forecasters: leaderboards, tests of significance, ensembles, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.functions import metrics as M
from foresift.functions.special import t_two_sided, z


def sigma(alpha: float) -> Column:
    """Standard deviation of the normal distribution whose interval of level 1 - alpha is [lo, hi]."""
    return (M.hi() - M.lo()) / (2 * z(1 - alpha / 2))


def quantile(q: float, alpha: float) -> Column:
    return M.p() + z(q) * sigma(alpha)


def reliability(fc: DataFrame, alphas: tuple[float, ...], alpha: float) -> DataFrame:
    """``model, alpha, empirical, width``: coverage of the intervals of other levels that the normal distributions give."""
    levels = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(z(1 - a / 2)).alias("q")) for a in alphas])
    rows = fc.select("model", F.abs(M.y() - M.p()).alias("e"), sigma(alpha).alias("s"), F.inline(levels))
    return rows.groupBy("model", "alpha").agg(F.avg(F.when(F.col("e") <= F.col("s") * F.col("q"), 1.0).otherwise(0.0)).alias("empirical"), F.avg(2 * F.col("s") * F.col("q")).alias("width"))


def _losses(fc: DataFrame, baseline: str) -> DataFrame:
    """Each model's absolute error less the baseline's, ``d``."""
    key = ["series_id", "fold", "h"]
    base = fc.where(F.col("model") == baseline).select(*key, F.abs(M.y() - M.p()).alias("base"))
    return fc.where(F.col("model") != baseline).join(base, key).select("model", *key, (F.abs(M.y() - M.p()) - F.col("base")).alias("d"))


def diebold_mariano(fc: DataFrame, baseline: str, h: int = 1) -> DataFrame:
    """``model, dm, better, n, p``: the statistic with the small-sample correction; negative if the model is better.

    ``p`` is two-sided, by Student's t with n - 1 degrees of freedom; null for a single row.

    Beyond h = 1 the variance takes the covariances with up to h - 1 steps before, within each series.
    """
    d = _losses(fc, baseline)
    by = Window.partitionBy("model", "series_id").orderBy("fold", "h")
    lags = [f"l{k}" for k in range(1, h)]
    d = d.withColumns({f"l{k}": F.lag("d", k).over(by) for k in range(1, h)}) if lags else d
    n = F.count("*")
    var = F.var_pop("d")
    for name in lags:
        var = var + 2 * F.covar_pop("d", name)
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    dm = F.avg("d") / F.sqrt(F.greatest(var, F.lit(1e-12)) / n) * factor
    found = d.groupBy("model").agg(dm.alias("dm"), F.when(F.avg("d") < 0, F.first("model")).otherwise(baseline).alias("better"), n.alias("n"))
    return found.withColumn("p", F.when(F.col("n") > 1, t_two_sided(F.col("dm"), F.col("n") - 1)))


def giacomini_white(fc: DataFrame, baseline: str) -> DataFrame:
    """``model, stat, p``: conditional predictive ability with the loss difference and its predecessor as instruments."""
    by = Window.partitionBy("model", "series_id").orderBy("fold", "h")
    d = _losses(fc, baseline).withColumn("l", F.coalesce(F.lag("d").over(by), F.lit(0.0))).select("model", F.col("d").alias("a"), (F.col("d") * F.col("l")).alias("b"))
    m = d.groupBy("model").agg(F.count("*").alias("n"), F.avg("a").alias("m1"), F.avg("b").alias("m2"), F.avg(F.col("a") ** 2).alias("s11"), F.avg(F.col("a") * F.col("b")).alias("s12"), F.avg(F.col("b") ** 2).alias("s22"))
    stat = F.expr("n * (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (s11 * s22 - s12 * s12)")
    return m.select("model", stat.alias("stat"), F.exp(-stat / 2).alias("p"))


def leaderboard(fc: DataFrame, baseline: str, alpha: float) -> DataFrame:
    """One row a model, metrics rounded; ``skill`` is the percentage by which its error is below the baseline's."""
    r = F.round
    board = fc.groupBy("model").agg(
        M.mae().alias("e"), r(M.rmse(), 6).alias("rmse"), r(M.coverage(), 6).alias("coverage"), r(M.width(), 4).alias("width"), r(M.winkler(alpha), 4).alias("winkler"), r(M.asymmetric(), 6).alias("nv_cost")
    )
    base = F.max(F.when(F.col("model") == baseline, F.col("e"))).over(Window.partitionBy())  # a row a model
    board = board.withColumn("skill", r((1 - F.col("e") / base) * 100, 4)).withColumn("mae", r("e", 6))
    return board.select("model", "mae", "rmse", "coverage", "width", "winkler", "nv_cost", "skill").orderBy("mae", "model")


def significance(board: DataFrame, fc: DataFrame, baseline: str) -> DataFrame:
    """A leaderboard with ``dm_p``, null for the baseline, and ``sig``: a star each for p below 0.1, 0.05 and 0.01."""
    p = F.col("dm_p")
    stars = F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").when(F.col("model") == baseline, "—").otherwise("")
    found = diebold_mariano(fc, baseline).select("model", F.col("p").alias("dm_p"))
    return board.join(found, "model", "left").withColumn("sig", stars).orderBy("mae", "model")


def verdict(board: DataFrame, baseline: str) -> DataFrame:
    """``verdict``, one row: the models of a leaderboard with ``significance`` that beat the baseline at p < 0.05."""
    better = board.where("skill > 0 and dm_p < 0.05").agg(F.array_join(F.array_sort(F.collect_list("model")), ", ").alias("v"))
    return better.select(F.when(F.col("v") != "", F.col("v")).otherwise(f"nothing beats {baseline}").alias("verdict"))


def normalise(board: DataFrame, up: dict[str, bool]) -> DataFrame:
    """Columns scaled to [0, 1], 1 the best; a constant column is 1. ``up`` says of each whether larger is better."""
    every = Window.partitionBy()  # a row a model

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        return F.when(lo == hi, 1.0).otherwise(F.round(((F.col(c) - lo) if up[c] else (hi - F.col(c))) / (hi - lo), 6))

    return board.select("model", *[scaled(c).alias(c) for c in up])


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Models and metrics that two long metric tables share: ``model, metric, a, b, diff``."""
    both = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["model", "metric"])
    return both.select("model", "metric", F.round("x", 5).alias("a"), F.round("y", 5).alias("b"), F.round(F.col("y") - F.col("x"), 5).alias("diff"))


def pareto(scores: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """The rows of each group that no other beats in both scores (smaller is better)."""
    before = Window.partitionBy(group).orderBy(first, second, "model").rowsBetween(Window.unboundedPreceding, -1)
    best = scores.withColumn("best", F.min(second).over(before))
    return best.where(F.col("best").isNull() | (F.col(second) < F.col("best"))).drop("best")


def scoreboard(fc: DataFrame, window: int) -> DataFrame:
    """``model, series_id, fold, rolling``: the mean error over the folds before, ``window`` at most; null in the first."""
    e = fc.groupBy("model", "series_id", "fold").agg(M.mae().alias("e"))
    return e.select("model", "series_id", "fold", F.avg("e").over(Window.partitionBy("model", "series_id").orderBy("fold").rowsBetween(-window, -1)).alias("rolling"))


def best_of_n(fc: DataFrame, board: DataFrame) -> DataFrame:
    joined = fc.join(board, ["model", "series_id", "fold"])
    champion = F.min_by("y_pred", F.round("rolling", 9))
    return joined.groupBy("series_id", "fold", "h").agg(F.when(F.count("rolling") == 0, F.avg("y_pred")).otherwise(champion).alias("y_pred"))
