"""Seasonal autoregressions of an order chosen for each fold, with intervals.

Sums of products of seasonal differences run along the panel once; a fold reads them where its training rows end. From
there on a fold is one row and everything is array expressions: autocovariances, Levinson-Durbin with the order by AIC,
steps ahead, and their variance by the weights of the integrated process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.functions.special import z
from foresift.operators.folds import Protocol, splits
from foresift.operators.forecasters import by_series


def autocovariances(panel: DataFrame, p: Protocol, most: int) -> DataFrame:
    """``series_id, t, n, mean, c, recent, season``: of the training rows of a fold that ends after t, the seasonal differences' number, mean and autocovariances to lag ``most`` (divided by n), the last ``most`` of them and the last season's values, newest first."""
    length = p.min_train - p.season
    frame = lambda k: Window.partitionBy("series_id").orderBy("t").rowsBetween(-length + 1 + k if p.mode == "rolling" else Window.unboundedPreceding, 0)
    rows = panel.select("series_id", "t", "y", (F.col("y") - F.lag("y", p.season).over(by_series())).alias("d"))
    rows = rows.withColumns({f"d{k}": F.lag("d", k).over(by_series()) for k in range(1, most + 1)})
    rows = rows.withColumns({"n": F.nullif(F.count("d").over(frame(0)), F.lit(0).cast("long")), "mean": F.avg("d").over(frame(0))})
    both = lambda k: F.when(F.col(f"d{k}").isNotNull(), F.col("d"))
    sums = {f"p{k}": F.sum(F.col("d") * F.col(f"d{k}")).over(frame(k)) for k in range(1, most + 1)}
    sums |= {f"a{k}": (F.sum(both(k)).over(frame(k)) + F.sum(F.when(F.col("d").isNotNull(), F.col(f"d{k}"))).over(frame(k))) for k in range(1, most + 1)}
    sums |= {f"n{k}": F.count(F.col("d") * F.col(f"d{k}")).over(frame(k)) for k in range(1, most + 1)} | {"p0": F.sum(F.col("d") * F.col("d")).over(frame(0))}
    rows = rows.withColumns(sums)
    m = F.col("mean")
    own = [(F.col("p0") - F.col("n") * m * m) / F.col("n")] + [(F.coalesce(F.col(f"p{k}") - m * F.col(f"a{k}") + F.col(f"n{k}") * m * m, F.lit(0.0))) / F.col("n") for k in range(1, most + 1)]
    last = F.array(F.col("d"), *[F.col(f"d{k}") for k in range(1, most)])
    season = F.array(*[F.lag("y", k).over(by_series()) for k in range(p.season)])
    return rows.select("series_id", "t", "n", "mean", F.array(*own).alias("c"), last.alias("recent"), season.alias("season"))


def levinson(c: Column, n: Column, most: int) -> Column:
    """``phi, v``: the autoregression whose order, ``most`` at most, has the least n ln(v) + 2 order; the lowest order where two are level. A series that does not vary has order 0."""
    none = F.array().cast("array<double>")
    score = lambda v, k: n * F.log(v) + 2 * k
    v0 = F.get(c, F.lit(0))
    first = F.struct(none.alias("phi"), v0.alias("v"), none.alias("best"), v0.alias("best_v"), score(v0, F.lit(0.0)).alias("least"))

    def grow(s: Column, k: Column) -> Column:
        at = lambda j: F.get(c, j)
        known = F.aggregate(F.zip_with(s["phi"], F.sequence(F.lit(1), k), lambda f, j: F.coalesce(f * at(k - j), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        r = F.try_divide(at(k) - known, s["v"])
        phi = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda f, b: f - r * b), F.array(r))
        v = s["v"] * (1 - r * r)
        better = score(v, k.cast("double")) < s["least"]
        grown = F.struct(phi.alias("phi"), v.alias("v"), F.when(better, phi).otherwise(s["best"]).alias("best"), F.when(better, v).otherwise(s["best_v"]).alias("best_v"), F.when(better, score(v, k.cast("double"))).otherwise(s["least"]).alias("least"))
        return F.when((s["v"] > 0) & (v > 0), grown).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, grow, lambda s: F.struct(s["best"].alias("phi"), s["best_v"].alias("v")))


def _dot(a: Column, b: Column) -> Column:
    """The sum of products of two arrays, as long as the shorter."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator, so that what refers to them reads their values: plain projections would be merged, and their expressions evaluated again for each reference."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def seasonal_ar(panel: DataFrame, p: Protocol, most: int = 5, alpha: float = 0.1) -> DataFrame:
    """``series_id, fold, h, t, y_pred, lo, hi, order``: the last season plus an autoregression of the seasonal differences around their mean.

    Its order, ``most`` at most, is chosen by AIC on each fold's training rows. Bands are normal, of level 1 - alpha, from
    the variance of one step and the weights of past shocks, which recur every season.
    """
    m, q = p.season, z(1 - alpha / 2)
    ends = splits(panel, p).select(F.col("series_id").alias("s"), "fold", "te")
    at = autocovariances(panel, p, most)
    rows = ends.join(at, (F.col("s") == F.col("series_id")) & (F.col("t") == F.col("te") - 1))
    rows = _computed(rows, ar=levinson(F.col("c"), F.col("n"), most)).select("series_id", "fold", "te", "mean", "recent", "season", "ar.phi", "ar.v")
    steps = F.sequence(F.lit(1), F.lit(p.horizon))
    off = F.transform("recent", lambda d: F.coalesce(d - F.col("mean"), F.lit(0.0)))
    ahead = F.aggregate(steps, F.struct(off.alias("past"), F.array().cast("array<double>").alias("out")), lambda s, h: (lambda x: F.struct(F.concat(F.array(x), s["past"]).alias("past"), F.concat(s["out"], F.array(x)).alias("out")))(_dot(F.col("phi"), s["past"])), lambda s: s["out"])
    # weights of past shocks: newest first while they grow
    weights = F.aggregate(F.sequence(F.lit(1), F.lit(p.horizon - 1)), F.array(F.lit(1.0)), lambda s, _: F.concat(F.array(_dot(F.col("phi"), s)), s)) if p.horizon > 1 else F.array(F.lit(1.0))
    rows = _computed(rows, x=ahead, psi=F.reverse(weights))
    # whole seasons back: the differences add up, and so do the weights
    back = lambda values, j: F.aggregate(F.sequence(F.lit(0), F.floor(j / m).cast("int")), F.lit(0.0), lambda s, k: s + F.get(values, j - k * m))
    rows = _computed(rows, whole=F.transform("psi", lambda _, j: back(F.col("psi"), j)), moved=F.transform("x", lambda _, j: back(F.col("x"), j) + F.col("mean") * (F.floor(j / m) + 1)))
    out = rows.select("series_id", "fold", "te", "season", "phi", "v", "whole", F.posexplode("moved").alias("j", "moved"))
    y = F.get("season", m - 1 - F.col("j") % m) + F.col("moved")
    spread = F.sqrt(F.col("v") * F.aggregate(F.slice("whole", 1, F.col("j") + 1), F.lit(0.0), lambda s, w: s + w * w))
    out = out.select("series_id", "fold", (F.col("j") + 1).cast("long").alias("h"), (F.col("te") + F.col("j")).alias("t"), y.alias("y_pred"), (q * spread).alias("band"), F.size("phi").cast("long").alias("order"))
    return out.select("series_id", "fold", "h", "t", "y_pred", (F.col("y_pred") - F.col("band")).alias("lo"), (F.col("y_pred") + F.col("band")).alias("hi"), "order")
