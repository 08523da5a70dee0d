"""Hierarchies as ancestor tables, aggregation by rollup, and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label(levels: list[str]) -> Column:
    """TOTAL, or the known levels as ``level=value`` joined by slashes."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c))) for c in levels]
    return F.when(F.col(levels[0]).isNull(), "TOTAL").otherwise(F.concat_ws("/", *parts))


def ancestors(cells: DataFrame, levels: list[str]) -> DataFrame:
    """``node, level, bottom``: each bottom key with all its prefixes, the sparse summation matrix; level 0 is the total."""
    keys = cells.select(*levels).distinct()
    name = lambda k: F.lit("TOTAL") if k == 0 else F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in levels[:k]])
    nodes = F.array(*[F.struct(name(k).alias("node"), F.lit(k).cast("long").alias("level")) for k in range(len(levels) + 1)])
    return keys.select(F.inline(nodes), name(len(levels)).alias("bottom"))


def aggregate(cells: DataFrame, levels: list[str], value: str = "y") -> DataFrame:
    """``node, level, ds, y`` of every node: a rollup yields exactly the prefixes."""
    known = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in levels), F.lit(0))
    rolled = cells.rollup("ds", *levels).agg(F.sum(value).alias("y")).where("ds IS NOT NULL")
    return rolled.select(label(levels).alias("node"), known.cast("long").alias("level"), "ds", "y")


def bottom_up(base: DataFrame, tree: DataFrame) -> DataFrame:
    """``node, ds, y``: sums of the bottom forecasts; ``base`` has ``node, ds, y_pred`` of all nodes."""
    bottoms = base.join(tree.select("bottom").distinct(), F.col("node") == F.col("bottom"), "left_semi").select(F.col("node").alias("bottom"), "ds", "y_pred")
    return bottoms.join(tree.select("bottom", "node"), "bottom").groupBy("node", "ds").agg(F.sum("y_pred").alias("y"))


def top_down(base: DataFrame, tree: DataFrame, history: DataFrame) -> DataFrame:
    """``node, ds, y``: the total's forecast dealt by the bottoms' average share of history, uniformly if that is not positive."""
    share = history.join(tree.select("bottom").distinct(), F.col("node") == F.col("bottom")).groupBy("bottom").agg(F.sum("y").alias("s"))
    every = share.agg(F.sum("s").alias("all"), F.count("*").alias("n"))  # one row
    share = share.join(F.broadcast(every)).select("bottom", F.when(F.col("all") > 0, F.col("s") / F.col("all")).otherwise(1 / F.col("n")).alias("p"))
    nodes = tree.join(share, "bottom").groupBy("node").agg(F.sum("p").alias("p"))
    total = base.where("node = 'TOTAL'").select("ds", "y_pred")
    return nodes.join(total).select("node", "ds", (F.col("p") * F.col("y_pred")).alias("y"))


def coherence_gap(values: DataFrame, tree: DataFrame) -> DataFrame:
    """``ds, gap``: the largest difference between a node and the sum of its bottoms."""
    own = values.select("node", "ds", F.col("y").alias("own"))
    sums = values.select(F.col("node").alias("bottom"), "ds", "y").join(tree.select("bottom", "node"), "bottom").groupBy("node", "ds").agg(F.sum("y").alias("s"))
    return own.join(sums, ["node", "ds"]).groupBy("ds").agg(F.max(F.abs(F.col("own") - F.col("s"))).alias("gap"))


def parents(tree: DataFrame) -> DataFrame:
    """``node, parent, level, n_bottom`` of each node; the total has no parent."""
    path = Window.partitionBy("bottom").orderBy("level")
    above = tree.withColumn("parent", F.lag("node").over(path))
    return above.groupBy("node", "level").agg(F.min("parent").alias("parent"), F.count("*").alias("n_bottom"))


def tree_reconcile(base: DataFrame, variance: Column, depth: int, ridge: float = 0.0) -> DataFrame:
    """``node, ds, y``: the coherent values nearest to the base forecasts, weighted by the inverse of ``variance``.

    ``base`` has ``node, parent, level, ds, y_pred`` of a tree with levels 0 to ``depth``. Equal variances give ordinary
    least squares, the number of bottoms weighted ones. Upward, each node's own forecast is combined with the sum of
    its children by precision; downward, what a node's final value differs from that sum is dealt to the children in
    proportion to their variances. One join a level each way: the same result as the dense projection. ``ridge``
    penalises the bottoms' squares: it acts as one more forecast of 0 for each bottom, of variance 1 / ridge.
    """
    base = base.withColumn("v", variance.cast("double"))
    up = {depth: base.where(F.col("level") == depth).select("node", "parent", "ds", (F.col("y_pred") / (1 + ridge * F.col("v"))).alias("m"), (F.col("v") / (1 + ridge * F.col("v"))).alias("var"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("vc"))}
    for k in range(depth - 1, -1, -1):
        below = up[k + 1].groupBy(F.col("parent").alias("node"), "ds").agg(F.sum("m").alias("c"), F.sum("var").alias("vc"))
        own = base.where(F.col("level") == k).join(below, ["node", "ds"])
        precision = 1 / F.col("vc") + 1 / F.col("v")
        up[k] = own.select("node", "parent", "ds", ((F.col("c") / F.col("vc") + F.col("y_pred") / F.col("v")) / precision).alias("m"), (1 / precision).alias("var"), "c", "vc")
    final = up[0].select("node", "ds", F.col("m").alias("y"), "c", "vc")
    out = final.select("node", "ds", "y")
    for k in range(1, depth + 1):
        above = final.select(F.col("node").alias("parent"), "ds", ((F.col("y") - F.col("c")) / F.col("vc")).alias("share"))
        final = up[k].join(above, ["parent", "ds"]).select("node", "ds", (F.col("m") + F.col("share") * F.col("var")).alias("y"), "c", "vc")
        out = out.unionByName(final.select("node", "ds", "y"))
    return out
