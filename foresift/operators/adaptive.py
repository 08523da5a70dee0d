"""Wrappers around forecasts: adaptive intervals, bootstrap ensembles, stacking. ``fc`` is a forecast table with ``y_true``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.operators.folds import Protocol, splits, steps

KEYS = ("model", "series_id", "fold")


def quantile_of(ordered: Column, p: Column) -> Column:
    """The quantile of an ascending array, linear between its values."""
    at = (F.size(ordered) - 1) * p
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def aci(fc: DataFrame, alpha: float = 0.1, gamma: float = 0.01) -> DataFrame:
    """``model, series_id, fold, h, alpha_t, y_pred, lo, hi`` with a level that follows the misses of the fold before.

    Its absolute errors are replayed step by step: a miss lowers the level by gamma (1 - alpha), a hit raises it by
    gamma alpha; the radius of step h is their quantile at one minus the level, held to 0.001 to 0.5. The first fold
    has no errors before it and no rows.
    """
    error = F.struct("h", F.abs(F.col("y_true") - F.col("y_pred")).alias("e"))
    past = fc.groupBy("model", "series_id", (F.col("fold") + 1).alias("fold")).agg(F.transform(F.array_sort(F.collect_list(error)), lambda x: x["e"]).alias("errors"))
    past = past.withColumn("ordered", F.array_sort("errors"))

    def step(s, e):
        q = quantile_of(F.col("ordered"), 1 - F.greatest(F.least(s["a"], F.lit(0.9)), F.lit(1e-3)))
        a = s["a"] + gamma * (alpha - F.when(e > q, 1.0).otherwise(0.0))
        return F.struct(a.alias("a"), F.concat(s["path"], F.array(F.greatest(F.least(a, F.lit(0.5)), F.lit(1e-3)))).alias("path"))

    start = F.struct(F.lit(float(alpha)).alias("a"), F.array().cast("array<double>").alias("path"))
    past = past.withColumn("path", F.aggregate("errors", start, step)["path"])
    rows = fc.drop("lo", "hi").join(past, list(KEYS)).withColumn("alpha_t", F.get("path", F.col("h").cast("int") - 1))
    rows = rows.withColumn("r", quantile_of(F.col("ordered"), 1 - F.col("alpha_t")))
    return rows.select(*KEYS, "h", "alpha_t", "y_pred", (F.col("y_pred") - F.col("r")).alias("lo"), (F.col("y_pred") + F.col("r")).alias("hi"))


def enbpi(panel: DataFrame, p: Protocol, copies: int = 20, block: int = 24, tail: int = 48, alpha: float = 0.1) -> DataFrame:
    """``series_id, fold, h, t, y_pred, lo, hi``: the mean of phase means fitted on block bootstraps of the training rows.

    The last ``tail`` training rows are kept out of the bootstraps; the quantile of their absolute errors is the
    radius. Blocks start where hashes of series, fold, copy and block say. A fold shorter than a block and its tail
    has no rows. Drawn rows are counted by position before they meet the panel, so a fold's copies add no panel rows.
    """
    folds = splits(panel, p).withColumn("n", F.col("te") - F.col("tr_lo") - tail).where(F.col("n") >= block)
    draws = folds.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    name = F.concat_ws("/", "series_id", *[F.col(c).cast("string") for c in ("fold", "b", "k")])
    u = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / float(16**12)
    start = F.col("tr_lo") + F.floor(u * (F.col("n") - block + 1))
    length = F.least(F.lit(block), F.col("n") - F.col("k") * block).cast("int")  # the last block is cut
    drawn = draws.withColumn("start", start).select("series_id", "fold", "te", "b", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("t"))
    drawn = drawn.groupBy("series_id", "fold", "te", "b", "t").agg(F.count("*").alias("times"))
    fits = drawn.join(panel.select("series_id", "t", "y"), ["series_id", "t"]).groupBy("series_id", "fold", "b", (F.col("t") % p.season).alias("phase"))
    fits = fits.agg((F.sum(F.col("y") * F.col("times")) / F.sum("times")).alias("m")).groupBy("series_id", "fold", "phase").agg(F.avg("m").alias("y_pred"))
    kept = folds.select("series_id", "fold", F.explode(F.sequence(F.col("te") - tail, F.col("te") - 1)).alias("t")).withColumn("phase", F.col("t") % p.season)
    kept = kept.join(fits, ["series_id", "fold", "phase"]).join(panel.select("series_id", "t", "y"), ["series_id", "t"])
    radius = kept.groupBy("series_id", "fold").agg(F.percentile(F.abs(F.col("y") - F.col("y_pred")), 1 - alpha).alias("r"))
    ahead = steps(folds, p).withColumn("phase", F.col("t") % p.season).join(fits, ["series_id", "fold", "phase"]).join(radius, ["series_id", "fold"])
    return ahead.select("series_id", "fold", "h", "t", "y_pred", (F.col("y_pred") - F.col("r")).alias("lo"), (F.col("y_pred") + F.col("r")).alias("hi"))


def stack(fc: DataFrame, a: str, b: str, penalty: float = 1.0) -> DataFrame:
    """``series_id, fold, h, y_pred, lo, hi``: a ridge regression of the actual values on two models' forecasts.

    It is fitted on all earlier folds of the series, whose forecasts are out of fold; the first fold has no rows. The
    bounds pass through the same weights and stay on their sides of the mean.
    """
    of = lambda m: F.max(F.when(F.col("model") == m, F.struct("y_pred", "lo", "hi", "y_true")))
    wide = fc.where(F.col("model").isin(a, b)).groupBy("series_id", "fold", "h").agg(of(a).alias("a"), of(b).alias("b"))
    x1, x2, y = F.col("a.y_pred"), F.col("b.y_pred"), F.col("a.y_true")
    sums = {"n": F.lit(1.0), "s1": x1, "s2": x2, "sy": y, "s11": x1 * x1, "s12": x1 * x2, "s22": x2 * x2, "s1y": x1 * y, "s2y": x2 * y}
    gram = wide.groupBy("series_id", "fold").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    before = Window.partitionBy("series_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    g = gram.select("series_id", "fold", *[F.sum(k).over(before).alias(k) for k in sums]).where("n > 0")
    about = lambda xy, x, z: F.col(xy) - F.col(x) * F.col(z) / F.col("n")
    g = g.select("series_id", "fold", *[(F.col(k) / F.col("n")).alias(k) for k in ("s1", "s2", "sy")],
        (about("s11", "s1", "s1") + penalty).alias("g11"), about("s12", "s1", "s2").alias("g12"), (about("s22", "s2", "s2") + penalty).alias("g22"), about("s1y", "s1", "sy").alias("c1"), about("s2y", "s2", "sy").alias("c2"))
    det = F.col("g11") * F.col("g22") - F.col("g12") * F.col("g12")
    g = g.select("series_id", "fold", "s1", "s2", "sy", ((F.col("c1") * F.col("g22") - F.col("c2") * F.col("g12")) / det).alias("w1"), ((F.col("c2") * F.col("g11") - F.col("c1") * F.col("g12")) / det).alias("w2"))
    meta = lambda c: F.col("sy") + F.col("w1") * (F.col(f"a.{c}") - F.col("s1")) + F.col("w2") * (F.col(f"b.{c}") - F.col("s2"))
    out = wide.join(g, ["series_id", "fold"]).select("series_id", "fold", "h", meta("y_pred").alias("y_pred"), meta("lo").alias("p"), meta("hi").alias("q"))
    return out.select("series_id", "fold", "h", "y_pred", F.least("p", "q", "y_pred").alias("lo"), F.greatest("p", "q", "y_pred").alias("hi"))
