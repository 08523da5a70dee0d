"""Reconciliation by covariance, by sample path, and by name. ``tree`` is the table of hierarchy.ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresift.operators import hierarchy

METHODS = ("bu", "td", "ols", "wls", "ridge", "mint_shrink")


def shrunk_covariance(residuals: DataFrame) -> DataFrame:
    """``i, j, w`` of residuals ``node, ds, e``: the covariance, drawn towards its diagonal by one intensity of 0 to 1.

    The intensity is the sum of the products' variances over the squared covariances off the diagonal. The result has
    a row for each pair of nodes, so this is for hierarchies of some thousand nodes.
    """
    e = residuals.select("node", "ds", (F.col("e") - F.avg("e").over(Window.partitionBy("node"))).alias("e"))
    a, b = (e.select("ds", F.col("node").alias(n), F.col("e").alias(f"e{n}")) for n in ("i", "j"))
    product = F.col("ei") * F.col("ej")
    s = a.join(b, "ds").groupBy("i", "j").agg((F.sum(product) / (F.count("*") - 1)).alias("s"), F.avg(product * product).alias("q"))
    off = F.when(F.col("i") != F.col("j"), F.col("s") * F.col("s")).otherwise(0.0)
    lam = s.agg((F.sum(F.col("q") - F.col("s") * F.col("s")) / F.greatest(F.sum(off), F.lit(1e-12))).alias("lam"))  # one row
    lam = lam.select(F.greatest(F.least("lam", F.lit(1.0)), F.lit(0.0)).alias("lam"))
    return s.join(F.broadcast(lam)).select("i", "j", F.when(F.col("i") == F.col("j"), F.col("s")).otherwise((1 - F.col("lam")) * F.col("s")).alias("w"))


def mint(base: DataFrame, tree: DataFrame, cov: DataFrame, key: str = "ds") -> DataFrame:
    """``node, <key>, y``: the coherent values nearest to the base forecasts under the errors' covariance ``cov``.

    The matrix of weights is solved once, in one task (two thousand nodes are a matrix of 32 MB); it is applied as a
    join and a sum, so forecasts of any number of keys stay distributed.
    """
    schema = "node string, part string, p double"

    def solve(pdf):
        import numpy as np
        import pandas as pd

        links, w = pdf[pdf["w"].isna()], pdf[pdf["w"].notna()]
        nodes, bottoms = sorted(links["a"].unique()), sorted(links["b"].unique())
        at, leaf = {n: k for k, n in enumerate(nodes)}, {n: k for k, n in enumerate(bottoms)}
        s, cov = np.zeros((len(nodes), len(bottoms))), np.zeros((len(nodes), len(nodes)))
        s[links["a"].map(at), links["b"].map(leaf)] = 1
        cov[w["a"].map(at), w["b"].map(at)] = w["w"]
        inverse = np.linalg.pinv(cov)
        p = s @ np.linalg.pinv(s.T @ inverse @ s) @ s.T @ inverse
        return pd.DataFrame({"node": np.repeat(nodes, len(nodes)), "part": np.tile(nodes, len(nodes)), "p": p.ravel()})

    inputs = tree.select(F.col("node").alias("a"), F.col("bottom").alias("b"), F.lit(None).cast("double").alias("w")).unionByName(cov.select(F.col("i").alias("a"), F.col("j").alias("b"), "w"))
    weights = inputs.groupBy().applyInPandas(solve, schema).where("p <> 0")
    own = base.select(F.col("node").alias("part"), key, "y_pred")
    return own.join(weights, "part").groupBy("node", key).agg(F.sum(F.col("p") * F.col("y_pred")).alias("y"))


def permuted_bottom_up(samples: DataFrame, tree: DataFrame, seed: int = 0) -> DataFrame:
    """``node, h, sample, y`` from sample paths ``bottom, h, sample, y``: each bottom's paths are shuffled, then summed.

    A path keeps its place over all h, so its steps stay together; the order comes from hashes of seed, bottom and path.
    """
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.col("bottom"), F.lit("/"), F.col("sample").cast("string")))
    place = samples.select("bottom", "sample").distinct().withColumn("place", F.row_number().over(Window.partitionBy("bottom").orderBy(order, "sample")) - 1)
    moved = samples.join(place, ["bottom", "sample"]).select("bottom", "h", F.col("place").cast("long").alias("sample"), "y")
    return moved.join(tree.select("node", "bottom"), "bottom").groupBy("node", "h", "sample").agg(F.sum("y").alias("y"))


def reconcile(method: str, base: DataFrame, tree: DataFrame, history: DataFrame | None = None, residuals: DataFrame | None = None, lam: float = 1e-3) -> DataFrame:
    """``node, ds, y`` by name. ``base`` has ``node, ds, y_pred``; for sample paths ``ds`` is a struct of step and sample.

    ``td`` needs ``history`` (``node, ds, y``), ``mint_shrink`` ``residuals`` (``node, ds, e``).
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {METHODS}")
    if method == "bu":
        return hierarchy.bottom_up(base, tree)
    if method == "td":
        if history is None:
            raise ValueError("td needs history")
        return hierarchy.top_down(base, tree, history)
    if method == "mint_shrink":
        if residuals is None:
            raise ValueError("mint_shrink needs residuals")
        return mint(base, tree, shrunk_covariance(residuals))
    parents = hierarchy.parents(tree)
    depth = tree.agg(F.max("level")).first()[0]
    variance = F.col("n_bottom") if method == "wls" else F.lit(1.0)
    return hierarchy.tree_reconcile(base.select("node", "ds", "y_pred").join(parents, "node"), variance, depth, lam if method == "ridge" else 0.0)
