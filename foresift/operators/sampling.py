"""Sample paths, their scores, smoothing searches and mean shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.operators.folds import Protocol, splits, steps


def seasonal_samples(panel: DataFrame, p: Protocol, paths: int) -> DataFrame:
    """``series_id, fold, h, t, samples``: the values of the same phase in the last ``paths`` seasons, the latest first.

    Path k is season k before, so a path's steps belong together. The windowed panel is joined once.
    """
    by = Window.partitionBy("series_id").orderBy("t")
    past = panel.select(F.col("series_id").alias("s"), F.col("t").alias("u"), F.array(*[F.lag("y", k * p.season).over(by) if k else F.col("y") for k in range(paths)]).alias("samples"))
    ahead = steps(splits(panel, p), p)
    last = F.col("te") - p.season + (F.col("h") - 1) % p.season
    return ahead.join(past, (F.col("s") == F.col("series_id")) & (F.col("u") == last)).select("series_id", "fold", "h", "t", "samples")


def crps(samples: Column, y: Column) -> Column:
    """Mean distance of the samples from the value, less half their mean distance from one another."""
    n = F.size(samples)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    spread = total(F.transform(samples, lambda x: total(F.transform(samples, lambda z: F.abs(x - z)))))
    return total(F.transform(samples, lambda x: F.abs(x - y))) / n - spread / (2 * n * n)


def smoothing_search(panel: DataFrame, p: Protocol, alphas: tuple[float, ...], memory: int) -> DataFrame:
    """``series_id, alpha, mae`` of exponential smoothing over the last ``memory`` training values; the parameter is a column.

    Weights are in closed form, so every parameter and fold is one weighted sum.
    """
    folds = splits(panel, p)
    near = folds.join(panel, "series_id").where((F.col("t") < F.col("te")) & (F.col("t") >= F.col("te") - memory)).select("series_id", "fold", "te", (F.col("te") - 1 - F.col("t")).alias("age"), "y")
    a = F.col("alpha")
    weight = F.when(F.col("age") == memory - 1, F.lit(1.0)).otherwise(a) * F.pow(1 - a, F.col("age").cast("double"))
    grid = near.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in alphas])))
    level = grid.groupBy("series_id", "fold", "te", "alpha").agg(F.sum(weight * F.col("y")).alias("level"))
    tested = level.join(panel, "series_id").where((F.col("t") >= F.col("te")) & (F.col("t") < F.col("te") + p.horizon))
    return tested.groupBy("series_id", "alpha").agg(F.avg(F.abs(F.col("y") - F.col("level"))).alias("mae"))


def mean_shift(panel: DataFrame, penalty: float) -> DataFrame:
    """``series_id, t, gain``: the split of each series that lowers the squared error most, if by more than ``penalty`` variances."""
    by = Window.partitionBy("series_id")
    n, s, i = F.count("*").over(by), F.sum("y").over(by), F.col("t") + 1
    upto = F.sum("y").over(by.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    rows = panel.select("series_id", "t", i.alias("i"), n.alias("n"), s.alias("s"), upto.alias("u"), F.var_pop("y").over(by).alias("v")).where("i < n")
    gain = F.col("u") ** 2 / F.col("i") + (F.col("s") - F.col("u")) ** 2 / (F.col("n") - F.col("i")) - F.col("s") ** 2 / F.col("n")
    best = rows.withColumn("gain", gain).groupBy("series_id").agg(F.max_by("i", "gain").alias("t"), F.max("gain").alias("gain"), F.first("v").alias("v"))
    return best.where(F.col("gain") > penalty * F.col("v")).select("series_id", "t", "gain")


def energy_score(rows: DataFrame, keys: list[str], samples: str = "samples", y: str = "y") -> DataFrame:
    """``keys, energy``: the score of whole sample paths, one row a step; each path is paired with the one after it."""
    s = F.col(samples)
    pairs = F.transform(s, lambda x, k: F.struct(k.alias("path"), F.pow(x - F.col(y), 2).alias("off"), F.pow(x - F.get(s, (k + 1) % F.size(s)), 2).alias("apart")))
    paths = rows.select(*keys, F.inline(pairs)).groupBy(*keys, "path").agg(F.sqrt(F.sum("off")).alias("off"), F.sqrt(F.sum("apart")).alias("apart"))
    return paths.groupBy(*keys).agg((F.avg("off") - F.avg("apart") / 2).alias("energy"))


def pit(samples: Column, y: Column) -> Column:
    """The share of the samples that are not above the value."""
    return F.size(F.filter(samples, lambda x: x <= y)) / F.size(samples)
