"""Learners over the forecasts of any number of members, fitted on all earlier folds of a series.

Rows are ``model, series_id, fold, h, y_true, y_pred``. Members are columns of an array, in the order of their names, so
their number is no part of the plan. The first fold of a series, before which nothing is known, has no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members(fc: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """``series_id, fold, h, y, x``: the members' forecasts of a step as an array. Steps that a member lacks are left out, and so are forecasts of others."""
    rows = fc.where(F.col("model").isin(*models) & F.col("y_pred").isNotNull()).groupBy("series_id", "fold", "h").agg(F.max("y_true").alias("y"), F.array_sort(F.collect_set(F.struct("model", "y_pred"))).alias("x"))
    return rows.where(F.size("x") == len(models)).select("series_id", "fold", "h", "y", F.col("x.y_pred").alias("x"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def grams(rows: DataFrame) -> DataFrame:
    """``series_id, fold, mx, my, g, c``: over the rows of earlier folds the means, and the mean products about them of members with each other and with the value."""
    k = F.col("k")
    entries = rows.where("y IS NOT NULL").select("series_id", "fold", "y", "x", F.posexplode("x").alias("k", "own"))
    sums = entries.groupBy("series_id", "fold", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("own").alias("x"), F.sum(F.col("own") * F.col("y")).alias("xy"))
    cross = entries.select("series_id", "fold", "k", "own", F.posexplode("x").alias("j", "other")).groupBy("series_id", "fold", "k", "j").agg(F.sum(F.col("own") * F.col("other")).alias("xx"))
    every = rows.select("series_id", "fold").distinct()
    # a fold with nothing to learn from still asks for the sums before it
    earlier = lambda df, keys: every.join(df.withColumnsRenamed({"fold": "before"}), "series_id").where("before < fold").groupBy("series_id", "fold", *keys)
    one = earlier(sums, ["k"]).agg(*[F.sum(c).alias(c) for c in ("n", "y", "x", "xy")]).select("series_id", "fold", "k", (F.col("x") / F.col("n")).alias("mx"), (F.col("y") / F.col("n")).alias("my"), "n", (F.col("xy") / F.col("n")).alias("xy"))
    two = earlier(cross, ["k", "j"]).agg(F.sum("xx").alias("xx")).groupBy("series_id", "fold", "k").agg(F.array_sort(F.collect_list(F.struct("j", "xx"))).alias("row"))
    both = one.join(two, ["series_id", "fold", "k"]).groupBy("series_id", "fold").agg(F.max("my").alias("my"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(k, "mx", "xy", F.col("row.xx").alias("xx")))).alias("m"))
    mx = F.col("m.mx")
    g = F.transform("m", lambda m: F.zip_with(m["xx"], mx, lambda xx, other: xx / F.col("n") - m["mx"] * other))
    return both.select("series_id", "fold", mx.alias("mx"), "my", g.alias("g"), F.transform("m", lambda m: m["xy"] - m["mx"] * F.col("my")).alias("c"))


def lasso(fc: DataFrame, models: tuple[str, ...], penalty: float = 1.0, sweeps: int = 40) -> DataFrame:
    """``series_id, fold, h, y_pred, weights``: the members' weights that minimise half the mean squared error plus ``penalty`` times the sum of their sizes, by coordinate descent.

    ``sweeps`` rounds over all members from weights of 0; a member that does not vary has weight 0. The intercept is free.
    """
    rows = members(fc, models)

    def step(b: Column, i: Column) -> Column:
        j = F.pmod(i, F.size("c"))
        own = F.get(F.get("g", j), j)
        left = F.get("c", j) - _dot(F.get("g", j), b) + own * F.get(b, j)
        new = F.when(own > 1e-9, F.signum(left) * F.greatest(F.abs(left) - penalty, F.lit(0.0)) / F.nullif(own, F.lit(0.0))).otherwise(0.0)
        return F.transform(b, lambda w, k: F.when(k == j, new).otherwise(w))

    start = F.transform("c", lambda _: F.lit(0.0))
    fitted = grams(rows).withColumn("weights", F.aggregate(F.sequence(F.lit(0), F.size("c") * sweeps - 1), start, step))
    out = rows.join(fitted, ["series_id", "fold"])
    return out.select("series_id", "fold", "h", (F.col("my") + _dot(F.col("weights"), F.zip_with("x", "mx", lambda x, m: x - m))).alias("y_pred"), "weights")


def tree(fc: DataFrame, models: tuple[str, ...], bins: int = 8, depth: int = 2, least: int = 8) -> DataFrame:
    """``series_id, fold, h, y_pred, leaf``: the members' mean, moved by the mean error of the leaf of a regression tree over their binned forecasts.

    A member's bins are of equal width over the forecasts of earlier folds. A node splits where that lowers the squared
    error most (rounded to 4 decimals; ties to the first member, then the lowest bin), if both sides have ``least`` rows.
    """
    rows = members(fc, models).withColumn("e", F.col("y") - F.aggregate("x", F.lit(0.0), lambda s, x: s + x) / F.size("x"))
    folds = rows.select("series_id", F.col("fold").alias("of")).distinct()
    seen = rows.join(folds, "series_id").where("fold <= of")
    flat = seen.where("fold < of").select("series_id", "of", F.posexplode("x").alias("k", "v")).groupBy("series_id", "of", "k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edges = flat.groupBy("series_id", "of").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("edges"))
    put = lambda v, b: F.when(b["hi"] > b["lo"], F.least(F.greatest(F.floor((v - b["lo"]) / (b["hi"] - b["lo"]) * bins), F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = seen.join(edges, ["series_id", "of"]).select("series_id", "of", "fold", "h", "e", "x", F.zip_with("x", "edges", put).alias("b"), F.lit(1).cast("long").alias("node"))
    for _ in range(depth):
        cells = binned.where("fold < of AND e IS NOT NULL").select("series_id", "of", "node", "e", F.posexplode("b").alias("k", "bin")).groupBy("series_id", "of", "node", "k", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"))
        upto = Window.partitionBy("series_id", "of", "node", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy("series_id", "of", "node", "k")
        cut = cells.select("series_id", "of", "node", "k", "bin", F.sum("n").over(upto).alias("n"), F.sum("s").over(upto).alias("s"), F.sum("n").over(every).alias("n_"), F.sum("s").over(every).alias("s_")).where(f"n >= {least} AND n_ - n >= {least}")
        gain = F.round(F.col("s") ** 2 / F.col("n") + (F.col("s_") - F.col("s")) ** 2 / (F.col("n_") - F.col("n")) - F.col("s_") ** 2 / F.col("n_"), 4)
        best = cut.withColumn("gain", gain).where("gain > 0").groupBy("series_id", "of", "node").agg(F.max(F.struct("gain", (-F.col("k")).alias("k"), (-F.col("bin")).alias("bin"))).alias("best"))
        side = F.when(F.get("b", -F.col("best.k")) > -F.col("best.bin"), 1).otherwise(0)
        binned = binned.join(best, ["series_id", "of", "node"], "left").withColumn("node", F.when(F.col("best").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + side)).drop("best")
    values = binned.where("fold < of").groupBy("series_id", "of", "node").agg(F.avg("e").alias("move"))
    out = binned.where("fold = of").join(values, ["series_id", "of", "node"], "left")
    mean = F.aggregate("x", F.lit(0.0), lambda s, x: s + x) / F.size("x")
    return out.select("series_id", "fold", "h", (mean + F.coalesce("move", F.lit(0.0))).alias("y_pred"), F.col("node").alias("leaf"))
