"""Smoothed forecasts of intermittent demand from affine steps.

Exponential smoothing moves its state by an affine step at each demand, and such steps compose. So a series is cut into
pieces, where folds begin or end and every ``BLOCK`` rows; each piece becomes one row with its composed step, and a fold
starts at nothing and takes the steps of its pieces in order. Rows without demand change no state but the chance of
demand, which only needs to know how many they are: they are left out before anything is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.functions.special import z

BLOCK = 65_536


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _begun(agg: int) -> Column:
    """Where the oldest of a fold's sums of ``agg`` rows ends."""
    return F.col("te") - agg * (F.ceil((F.col("te") - F.col("tr_lo")) / agg) - 1)


def pieces(panel: DataFrame, folds: DataFrame, alpha: float, agg: int, alpha_agg: float, block: int = BLOCK) -> DataFrame:
    """A row for each piece of a series that has demand: ``series_id, lo, hi`` (its rows are at lo to hi - 1), sums, and its steps.

    ``k`` demands from ``first`` to ``last``; ``size`` and ``gap`` are what smoothing leaves of sizes and gaps, the first gap
    left out; ``chance`` that of the demand's indicator at row hi - 1; ``cells`` the discounted sums by row's remainder.
    """
    edges = folds.select("series_id", F.explode(F.array("tr_lo", "te", _begun(agg))).alias("edge"))
    cuts = edges.groupBy(F.col("series_id").alias("s")).agg(F.array_sort(F.collect_set("edge")).alias("cuts"))
    rows = panel.where("y <> 0").join(cuts, F.col("series_id") == F.col("s")).select("series_id", "t", "y", "cuts")
    below, above = (F.filter("cuts", test) for test in (lambda c: c <= F.col("t"), lambda c: c > F.col("t")))
    at = F.floor(F.col("t") / block) * block
    rows = rows.select("series_id", "t", "y", F.greatest(F.array_max(below), at).alias("lo"), F.least(F.array_min(above), at + block).alias("hi"))
    left = F.pow(F.lit(1 - alpha_agg), F.floor((F.col("hi") - 1) / agg) - F.floor(F.col("t") / agg))
    cells = [F.sum(F.when(F.col("t") % agg == r, F.col("y") * left).otherwise(0.0)) for r in range(agg)]
    grouped = rows.groupBy("series_id", "lo", "hi").agg(
        F.sum("y").alias("sum"), F.sum(F.col("y") * F.col("y")).alias("squares"), F.array(*cells).alias("cells"),
        F.sum(F.when(F.col("y") > 0, alpha * F.pow(F.lit(1 - alpha), F.col("hi") - 1 - F.col("t"))).otherwise(0.0)).alias("chance"),
        F.array_sort(F.collect_list(F.when(F.col("y") > 0, F.struct("t", "y")))).alias("hits"),
    )
    k = F.size("hits")
    weight = lambda i: alpha * F.pow(F.lit(1 - alpha), (k - 1 - i).cast("double"))
    size = _sum(F.transform("hits", lambda h, i: weight(i) * h["y"]))
    gap = _sum(F.transform("hits", lambda h, i: F.when(i == 0, 0.0).otherwise(weight(i) * (h["t"] - F.get("hits", i - 1)["t"]))))
    return grouped.select("series_id", "lo", "hi", "sum", "squares", "cells", "chance", k.cast("double").alias("k"), F.get("hits", F.lit(0))["t"].alias("first"), F.get("hits", k - 1)["t"].alias("last"), F.get("hits", F.lit(0))["y"].alias("first_y"), size.alias("size"), gap.alias("gap"))


def smoothed(panel: DataFrame, folds: DataFrame, alpha: float = 0.1, agg: int = 7, alpha_agg: float = 0.2, block: int = BLOCK) -> DataFrame:
    """``series_id, fold, te, sigma`` and the forecasts ``croston, croston_sba, tsb, adida`` of every fold, 0 where there is no demand.

    Sizes and gaps start at the first demand, the chance with 1 there. ADIDA smooths sums of ``agg`` rows counted back from
    the fold's end; its oldest sum may lack rows. ``sigma`` is the deviation of the training rows. Null y counts as 0.
    """
    found = pieces(panel, folds, alpha, agg, alpha_agg, block)
    own = folds.select("series_id", "fold", "tr_lo", "te")
    of = own.join(found.withColumnRenamed("series_id", "s"), (F.col("series_id") == F.col("s")) & (F.col("lo") >= F.col("tr_lo")) & (F.col("hi") <= F.col("te")))
    names = ["lo", "hi", "sum", "squares", "cells", "chance", "k", "first", "last", "first_y", "size", "gap"]
    rows = of.groupBy("series_id", "fold", "tr_lo", "te").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("p"))
    keep, none = 1 - alpha, F.lit(None).cast("double")
    start = F.struct(none.alias("size"), none.alias("gap"), none.alias("chance"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("end"))

    def step(s: Column, p: Column) -> Column:
        new, power = s["size"].isNull(), F.pow(F.lit(keep), p["k"])
        size = p["size"] + power * F.when(new, p["first_y"]).otherwise(s["size"])
        first_gap = F.when(new, p["first"] - F.col("tr_lo") + 1).otherwise(p["first"] - s["last"])
        gap = p["gap"] + alpha * F.pow(F.lit(keep), p["k"] - 1) * first_gap + power * F.when(new, first_gap).otherwise(s["gap"])
        # the chance fades with every row since the row at which it was last known
        faded = F.when(new, F.pow(F.lit(keep), (p["hi"] - p["first"]).cast("double"))).otherwise(s["chance"] * F.pow(F.lit(keep), (p["hi"] - s["end"]).cast("double")))
        moved = F.struct(size.alias("size"), gap.cast("double").alias("gap"), (p["chance"] + faded).alias("chance"), p["last"].alias("last"), p["hi"].alias("end"))
        return F.when(p["k"] > 0, moved).otherwise(s)

    rows = rows.withColumn("s", F.aggregate("p", start, step))
    # ADIDA: row t lies (te - 1 - t) // agg sums before the newest
    n, to = F.col("te") - F.col("tr_lo"), F.col("te") - 1
    rest = lambda p: F.pow(F.lit(1 - alpha_agg), (F.floor(to / agg) - F.floor((p["hi"] - 1) / agg)).cast("double"))
    shift = F.array(*[F.when(F.lit(r) > to % agg, F.lit(1 / (1 - alpha_agg))).otherwise(F.lit(1.0)) for r in range(agg)])
    newest = alpha_agg * F.aggregate("p", F.lit(0.0), lambda s, p: s + rest(p) * _sum(F.zip_with(p["cells"], shift, lambda x, w: x * w)))
    begun = F.aggregate("p", F.lit(0.0), lambda s, p: s + F.when(p["hi"] <= _begun(agg), p["sum"]).otherwise(0.0))
    rows = rows.withColumns({"newest": newest, "begun": begun, "total": F.aggregate("p", F.lit(0.0), lambda s, p: s + p["sum"]), "squares": F.aggregate("p", F.lit(0.0), lambda s, p: s + p["squares"])})
    rows = own.join(rows.select("series_id", "fold", "s", "newest", "begun", "total", "squares"), ["series_id", "fold"], "left")
    adida = (F.col("newest") + F.col("begun") * F.pow(F.lit(1 - alpha_agg), F.ceil(n / agg).cast("double"))) / agg
    croston = F.col("s.size") / F.greatest(F.col("s.gap"), F.lit(1.0))
    chance = F.col("s.chance") * F.pow(F.lit(keep), (F.col("te") - F.col("s.end")).cast("double"))
    mean = F.col("total") / n
    sigma = F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0)))
    out = {"sigma": sigma, "croston": croston, "croston_sba": croston * (1 - alpha / 2), "tsb": chance * F.col("s.size"), "adida": adida}
    return rows.select("series_id", "fold", "te", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in out.items()])


def intermittent(panel: DataFrame, folds: DataFrame, horizon: int, alpha_band: float = 0.1, **how) -> DataFrame:
    """``model, series_id, fold, h, t, y_pred, lo, hi`` of all four models, flat over the horizon.

    Bands of level 1 - ``alpha_band`` are normal, grow with the root of the steps ahead and end at 0 below.
    """
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in ("croston", "croston_sba", "tsb", "adida")])
    rows = smoothed(panel, folds, **how).select("series_id", "fold", "te", "sigma", F.inline(models)).withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    band = z(1 - alpha_band / 2) * F.col("sigma") * F.sqrt(F.col("h").cast("double"))
    return rows.select("model", "series_id", "fold", "h", (F.col("te") + F.col("h") - 1).alias("t"), "y_pred", F.greatest(F.col("y_pred") - band, F.lit(0.0)).alias("lo"), (F.col("y_pred") + band).alias("hi"))
