"""Exact ranks, quantiles and distribution distances of long tables, however many rows a feature has.

Equal values are counted together first. A sketch of each feature then gives edges that cut its values into blocks; block
totals are summed up in a short table, values within their block, so no task sees a whole feature. The edges decide only
who does the work, never a result; they are stored, so that every reader cuts alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.sources.store import kept

#: Blocks of a feature, and the sketch's accuracy in ranks.
BLOCKS, ACCURACY = 64, 4_096
#: Up to so many values on either side the significance of a distance is exact.
EXACT = 150


def values(rows: DataFrame) -> DataFrame:
    """Nulls and NaN are no values."""
    return rows.where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double")))


def cumulative(rows: DataFrame, counts: dict[str, Column], blocks: int = BLOCKS) -> DataFrame:
    """``feature, x`` once each, for every count ``c`` its own ``c``, ``c_upto`` (this value included) and ``c_all``.

    ``rows`` are ``feature, x`` and what the counts are sums of.
    """
    steps = kept(values(rows).groupBy("feature", "x").agg(*[F.sum(c).cast("long").alias(n) for n, c in counts.items()]))
    levels = [k / blocks for k in range(1, blocks)]
    edges = kept(steps.groupBy(F.col("feature").alias("f")).agg(F.percentile_approx("x", levels, ACCURACY).alias("edges")))
    own = F.col("feature").eqNullSafe(F.col("f"))
    cut = steps.join(edges, own).withColumn("block", F.size(F.filter("edges", lambda e: e <= F.col("x")))).drop("f", "edges")
    before, every = Window.partitionBy("feature").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    totals = cut.groupBy("feature", "block").agg(*[F.sum(n).alias(n) for n in counts])
    starts = totals.select(F.col("feature").alias("f"), F.col("block").alias("block_of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in counts], *[F.sum(n).over(every).alias(f"{n}_all") for n in counts])
    within = Window.partitionBy("feature", "block").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumns({f"{n}_upto": F.sum(n).over(within) for n in counts})
    both = inner.join(starts, own & (F.col("block") == F.col("block_of")))
    return both.select("feature", "x", *counts, *[(F.col(f"{n}_upto") + F.col(f"{n}_before")).alias(f"{n}_upto") for n in counts], *[f"{n}_all" for n in counts])


def quantiles(ranked: DataFrame, levels: list[float], n: str = "n") -> DataFrame:
    """``feature, quantiles`` from ``cumulative`` counts ``n``, linear between the two values next to a rank. Features without values have no row."""
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col(f"{n}_all") - 1)).alias("r")) for k, q in enumerate(levels)])
    first = F.col(f"{n}_upto") - F.col(n)
    held = F.filter(wanted, lambda w: (F.ceil(w["r"]) >= first) & (F.floor(w["r"]) < F.col(f"{n}_upto")))
    rows = ranked.where(F.col(n) > 0).select("feature", "x", first.alias("first"), F.col(f"{n}_upto").alias("upto"), F.explode(held).alias("w"))
    within = lambda at: (at >= F.col("first")) & (at < F.col("upto"))
    low, high = (F.max(F.when(within(of(F.col("w.r"))), F.col("x").cast("double"))) for of in (F.floor, F.ceil))
    found = rows.groupBy("feature", "w").agg(low.alias("low"), high.alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("w.r") - F.floor("w.r"))
    return found.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("w.k", value.alias("v")))).alias("q")).select("feature", F.col("q.v").alias("quantiles"))


def percentiles(rows: DataFrame, levels: list[float], blocks: int = BLOCKS) -> DataFrame:
    """``feature, quantiles`` of ``feature, x``. Nulls and NaN do not count."""
    return quantiles(cumulative(rows, {"n": F.lit(1)}, blocks), levels)


def compared(ref: DataFrame, cur: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Ranks of the values of both sides together: counts ``a`` of the reference, ``b`` of the other."""
    side = lambda rows, a: rows.select("feature", "x", F.lit(a).alias("a"), F.lit(1 - a).alias("b"))
    return cumulative(side(ref, 1).unionByName(side(cur, 0)), {"a": F.col("a"), "b": F.col("b")}, blocks)


def psi(ranked: DataFrame, bins: int = 10) -> DataFrame:
    """``feature, psi`` from ``compared``: bins by the reference's quantiles, open at the ends, shares of at least 1e-6. Features without reference have no row."""
    edges = quantiles(ranked, [k / bins for k in range(1, bins)], "a").select(F.col("feature").alias("f"), F.col("quantiles").alias("edges"))
    binned = ranked.join(edges, F.col("feature").eqNullSafe(F.col("f"))).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    shares = binned.groupBy("feature", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("a_all").alias("n"), F.max("b_all").alias("m"))
    grid = edges.select("f", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("k"))
    both = grid.join(shares, F.col("f").eqNullSafe(F.col("feature")) & (F.col("k") == F.col("bin")), "left")
    p, q = (F.greatest(F.coalesce(F.try_divide(F.col(c), F.col(t)), F.lit(0.0)), F.lit(1e-6)) for c, t in (("a", "n"), ("b", "m")))
    return both.groupBy(F.col("f").alias("feature")).agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def exact_tail(n: Column, m: Column, steps: Column) -> Column:
    """The chance that two samples of one distribution, of n and m values without ties, are ``steps`` / (n m) or further apart.

    Orders of n + m values are paths on a grid; a(i, j), the share of paths to (i, j) that stay nearer than that all along,
    is i / (i + j) a(i - 1, j) + j / (i + j) a(i, j - 1).
    """

    def row(above: Column, i: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            inside = F.abs(i * m - j * n) < steps
            share = F.when((i == 0) & (j == 0), 1.0).otherwise((i * F.coalesce(F.get(above, j), F.lit(0.0)) + j * F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), done), -1), F.lit(0.0))) / F.greatest(i + j, F.lit(1)))
            return F.concat(done, F.array(F.when(inside, share).otherwise(0.0)))

        return F.aggregate(F.sequence(F.lit(0).cast("int"), m.cast("int")), F.array().cast("array<double>"), cell)

    return 1 - F.element_at(F.aggregate(F.sequence(F.lit(0).cast("int"), n.cast("int")), F.array().cast("array<double>"), row), -1)


def ks(ranked: DataFrame, exact: int = EXACT) -> DataFrame:
    """``feature, ks, p`` from ``compared``: the largest distance of the distribution functions and its significance.

    Exact where both sides have ``exact`` values at most; else asymptotic (1 where the series, which converges slowly there,
    is within 1e-9 of it).
    """
    n, m = F.col("n"), F.col("m")
    apart = F.abs(F.col("a_upto") * F.col("b_all") - F.col("b_upto") * F.col("a_all"))
    gap = F.abs(F.try_divide(F.col("a_upto"), F.col("a_all")) - F.try_divide(F.col("b_upto"), F.col("b_all")))
    d = ranked.groupBy("feature").agg(F.max(gap).alias("ks"), F.max(apart).alias("steps"), F.max("a_all").alias("n"), F.max("b_all").alias("m"))
    z = F.col("ks") * F.sqrt(F.try_divide(n * m, n + m))
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * F.col("z") * F.col("z")))
    limit = F.when(F.col("z") < 0.2, 1.0).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))
    return d.withColumn("z", z).select("feature", "ks", F.when(F.greatest(n, m) <= exact, F.when(F.col("steps") > 0, exact_tail(n, m, F.col("steps"))).otherwise(1.0)).otherwise(limit).alias("p"))
