"""The smoothed local level of series with gaps, by scans over blocks.

A random walk observed with noise: filter variances move by fractional linear steps, levels by affine ones, and so does
the smoother on its way back. All of these compose, so every block of a series is summed up by itself, for all ratios of
variances at once, a short table of blocks is composed by series, and no task reads more than a block. Within a block
prefixes are composed by doubling, not value by value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
#: Variance of the level before the first value, and the variance from which on a value counts in the likelihood.
START, KNOWN = 1e7, 1e6


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, ``then`` after ``first``, scaled to a largest entry of 1: the scale of a fractional linear step does not matter."""
    out = np.einsum("...ij,...jk->...ik", then, first)
    return out / np.abs(out).max(axis=(-1, -2), keepdims=True)


def prefixes(steps: np.ndarray, join) -> np.ndarray:
    """All prefixes of steps along axis 1, composed by doubling."""
    steps, span = steps.copy(), 1
    while span < steps.shape[1]:
        steps[:, span:] = join(steps[:, :-span], steps[:, span:])
        span *= 2
    return steps


def affine(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Steps x -> a x + b as pairs (a, b), ``then`` after ``first``."""
    return np.stack([first[..., 0] * then[..., 0], then[..., 0] * first[..., 1] + then[..., 1]], axis=-1)


def variance_steps(known: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """For each ratio and row, the step from the variance before a row to that before the next, as a matrix."""
    q = np.broadcast_to(ratios[:, None], (len(ratios), len(known)))
    k = np.broadcast_to(known.astype(float), q.shape)
    return np.stack([np.stack([1 + k * q, q], axis=-1), np.stack([k, np.ones_like(q)], axis=-1)], axis=-2)


def variances(known: np.ndarray, ratios: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The variance before each row, by ratio."""
    m = prefixes(variance_steps(known, ratios), composed)[:, :-1]
    p = start[:, None]
    after = (m[..., 0, 0] * p + m[..., 0, 1]) / (m[..., 1, 0] * p + m[..., 1, 1])
    return np.concatenate([p, after], axis=1)


def level_steps(y: np.ndarray, known: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each ratio and row the affine step of the level, as prefixes from the block's start."""
    gain = np.where(known, p / (p + 1), 0.0)
    return prefixes(np.stack([1 - gain, gain * np.where(known, y, 0.0)], axis=-1), affine)


def back_steps(level: np.ndarray, var: np.ndarray, q: float, last: bool) -> np.ndarray:
    """For each row the smoothed level as an affine step of that at the next block's first row; at the end of a series the level stays."""
    j = var / (var + q)
    if last:
        j[-1] = 0.0
    return prefixes(np.stack([j, (1 - j) * level], axis=-1)[None, ::-1], affine)[0, ::-1]


def smoothed(panel: DataFrame, ratios: tuple[float, ...], block: int = BLOCK) -> DataFrame:
    """``series_id, t, level`` of the rows without a value: the smoothed local level with the likeliest of the ratios of the walk's variance to the noise's.

    Rows must be the steps of a series from about t = 0 on. A series without any value has null levels, one with a single
    value has that. Equal likelihood goes to the first ratio.
    """
    q, many = np.array(ratios), len(ratios)
    rows = panel.select("series_id", "t", "y", F.floor(F.col("t") / block).alias("block"))
    keys = ["series_id", "block"]
    pack = lambda values: np.ascontiguousarray(values, np.float64).tolist()

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["y"].to_numpy(float)
        known = ~np.isnan(y)
        m = prefixes(variance_steps(known, q), composed)[:, -1]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "block": pdf["block"].iloc[:1], "m": [pack(m.ravel())], "first": [float(y[known][0]) if known.any() else None], "n": [int(known.sum())]})

    blocks = rows.groupBy(*keys).applyInPandas(summary, "series_id string, block long, m array<double>, first double, n long")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, p, out = pdf.sort_values("block"), np.full(many, START), []
        for m in pdf["m"]:
            out.append(pack(p))
            m = np.array(m).reshape(many, 2, 2)
            p = (m[:, 0, 0] * p + m[:, 0, 1]) / (m[:, 1, 0] * p + m[:, 1, 1])
        return pdf[keys].assign(p=out, first=pdf["first"].dropna().iloc[0] if pdf["first"].notna().any() else np.nan, n=pdf["n"].sum())

    begun = blocks.groupBy("series_id").applyInPandas(starts, "series_id string, block long, p array<double>, first double, n long")

    def likelihood(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["y"].to_numpy(float)
        known = ~np.isnan(y)
        p = variances(known, q, np.array(at["p"].iloc[0]))
        steps = level_steps(y, known, p)
        before = np.concatenate([np.tile([1.0, 0.0], (many, 1, 1)), steps[:, :-1]], axis=1)  # the level before each row, from that at the start
        f, off = p + 1, np.where(known, y, 0.0) - before[..., 1]
        counts = known & (p < KNOWN)
        sums = [np.where(counts, x, 0.0).sum(axis=1) for x in (np.log(f), off**2 / f, before[..., 0] * off / f, before[..., 0] ** 2 / f)]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "block": pdf["block"].iloc[:1], "step": [pack(steps[:, -1].ravel())], "sums": [pack(np.ravel(sums))], "p": [at["p"].iloc[0]], "first": at["first"].iloc[:1].tolist(), "n": at["n"].iloc[:1].tolist()})

    judged = rows.groupBy(*keys).cogroup(begun.groupBy(*keys)).applyInPandas(likelihood, "series_id string, block long, step array<double>, sums array<double>, p array<double>, first double, n long")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        n, first = int(pdf["n"].iloc[0]), float(pdf["first"].iloc[0])
        a, logs, scale, out = np.full(many, first), np.zeros(many), np.zeros(many), []
        for step, sums in zip(pdf["step"], pdf["sums"], strict=True):
            out.append(a)
            log_f, c0, c1, c2 = np.array(sums).reshape(4, many)
            logs, scale = logs + log_f, scale + c0 - 2 * a * c1 + a * a * c2
            step = np.array(step).reshape(many, 2)
            a = step[:, 0] * a + step[:, 1]
        best = int(np.argmin(logs + (n - 1) * np.log(np.maximum(scale / max(n - 1, 1), 1e-300)))) if n > 1 else 0
        return pdf[keys].assign(q=q[best], p=[p[best] for p in pdf["p"]], a=[float(x[best]) for x in out], last=[False] * (len(pdf) - 1) + [True])

    chosen = judged.groupBy("series_id").applyInPandas(choose, "series_id string, block long, q double, p double, a double, last boolean")

    def back(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        pdf, at = pdf.sort_values("t"), at.iloc[0]
        y = pdf["y"].to_numpy(float)
        known = ~np.isnan(y)
        p = variances(known, np.array([at["q"]]), np.array([at["p"]]))
        steps = level_steps(y, known, p)[0]
        way = back_steps(steps[:, 0] * at["a"] + steps[:, 1], np.where(known, p[0] / (p[0] + 1), p[0]), at["q"], at["last"])
        wanted = ~known
        wanted[0] = True  # the step of the whole block
        return pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "block": pdf["block"], "gap": ~known, "head": np.arange(len(y)) == 0, "scale": way[:, 0], "add": way[:, 1]})[wanted]

    ways = rows.groupBy(*keys).cogroup(chosen.groupBy(*keys)).applyInPandas(back, "series_id string, t long, block long, gap boolean, head boolean, scale double, add double")
    heads = ways.where("head").select("series_id", "block", F.struct("scale", "add").alias("s"))
    # the smoothed level at each block's first row, composed from the last block back
    after = Window.partitionBy("series_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    steps = heads.withColumn("later", F.collect_list("s").over(after))
    level = F.aggregate(F.reverse("later"), F.lit(0.0), lambda x, s: s["scale"] * x + s["add"])
    nexts = steps.select("series_id", "block", level.alias("next"))
    found = ways.where("gap").join(nexts, keys)
    return found.select("series_id", "t", F.nanvl(F.col("scale") * F.col("next") + F.col("add"), F.lit(None).cast("double")).alias("level"))
