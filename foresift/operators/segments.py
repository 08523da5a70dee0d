"""Changepoints of the mean by binary segmentation, in rounds over a table of segments.

The panel gets running sums once, by blocks so that a long series is many tasks. Each round then is one pass over the rows
of open segments: every row is the start of a possible right part, and the best split of a segment is a maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.sources.store import kept

#: Rows of a series that one task sums at a time.
BLOCK = 65_536


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds running sums (this row included) of columns over ``keys``, in the order of a whole-number column from about 0 on.

    Blocks of a key are summed by themselves, then their totals, so that no task reads more than a block of rows.
    """
    parts = rows.withColumns({f"{n}_": c.cast("double") for n, c in sums.items()}).withColumn("block_", F.floor(F.col(order) / block))
    totals = parts.groupBy(*keys, "block_").agg(*[F.sum(f"{n}_").alias(f"{n}_") for n in sums])
    before = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("block_").alias("block_of"), *[F.coalesce(F.sum(f"{n}_").over(before), F.lit(0.0)).alias(f"{n}_start") for n in sums])
    met = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys] + [F.col("block_") == F.col("block_of")]
    within = Window.partitionBy(*keys, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = parts.withColumns({n: F.coalesce(F.sum(f"{n}_").over(within), F.lit(0.0)) for n in sums})
    both = inner.join(starts, met).withColumns({n: F.col(n) + F.col(f"{n}_start") for n in sums})
    return both.drop("block_", "block_of", *[f"{k}_of" for k in keys], *[f"{n}_" for n in sums], *[f"{n}_start" for n in sums])


def changepoints(panel: DataFrame, penalty: float = 10.0, least: int = 2, rounds: int = 6) -> DataFrame:
    """``series_id, t, depth, gain``: every row at which a new mean begins, with the round that found it and what it gained.

    A segment is split where that lowers its squared error most, the first such place, if by more than ``penalty``
    variances of the series; both parts have ``least`` rows or more. Rounds end when no segment is split, after ``rounds``
    at the latest: 2^rounds segments a series. Null values do not count. The gain is that of the segment split.
    """
    spark, known = panel.sparkSession, panel.where("y IS NOT NULL").select("series_id", "t", "y")
    sums = kept(running(known, ["series_id"], "t", {"k": F.lit(1), "u": F.col("y")}).select("series_id", "t", F.col("k").cast("long").alias("k"), F.col("u").alias("u"), "y"))
    whole = sums.groupBy("series_id").agg(F.var_pop("y").alias("v"), F.max("k").alias("hi"), F.max_by("u", "k").alias("u_hi"))
    open_ = kept(whole.select("series_id", F.lit(0).cast("long").alias("lo"), "hi", F.lit(0.0).alias("u_lo"), "u_hi", (F.col("v") * penalty).alias("most")))
    found = None
    for depth in range(rounds):
        by = open_.groupBy(F.col("series_id").alias("s")).agg(F.collect_list(F.struct("lo", "hi", "u_lo", "u_hi", "most")).alias("open"))
        # a row is left of the split before it: at hand are the count and the sum up to the row before
        at = F.get(F.filter("open", lambda x: (F.col("k") - 1 >= x["lo"] + least) & (F.col("k") - 1 <= x["hi"] - least)), F.lit(0))
        rows = sums.join(by, F.col("series_id").eqNullSafe(F.col("s"))).select("series_id", "t", (F.col("k") - 1).alias("c"), (F.col("u") - F.col("y")).alias("u"), at.alias("of")).where("of IS NOT NULL")
        left, right = F.col("u") - F.col("of.u_lo"), F.col("of.u_hi") - F.col("u")
        gain = left**2 / (F.col("c") - F.col("of.lo")) + right**2 / (F.col("of.hi") - F.col("c")) - (left + right) ** 2 / (F.col("of.hi") - F.col("of.lo"))
        best = rows.withColumn("gain", gain).groupBy("series_id", "of").agg(F.max(F.struct("gain", (-F.col("c")).alias("back"), "t", "u")).alias("best")).where("best.gain > of.most")
        split = kept(best.select("series_id", "of", "best.t", (-F.col("best.back")).alias("c"), "best.u", "best.gain", F.lit(depth).cast("long").alias("depth")))
        if split.isEmpty():
            break
        found = split if found is None else found.unionByName(split)
        sides = F.array(F.struct(F.col("of.lo").alias("lo"), F.col("c").alias("hi"), F.col("of.u_lo").alias("u_lo"), F.col("u").alias("u_hi"), F.col("of.most").alias("most")), F.struct(F.col("c").alias("lo"), F.col("of.hi").alias("hi"), F.col("u").alias("u_lo"), F.col("of.u_hi").alias("u_hi"), F.col("of.most").alias("most")))
        open_ = split.select("series_id", F.inline(sides))
    if found is None:
        return spark.createDataFrame([], "series_id string, t long, depth long, gain double")
    return found.select("series_id", "t", "depth", "gain")
