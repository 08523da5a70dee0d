"""Boosted trees for quantiles, for all folds and levels at once.

Every target row is used where it lies: a pass over the panel adds it to integer histograms of what the trees so far leave
of it, by fold, level, proposed tree, leaf and cell. From these few counts the driver takes, for each fold and level, the
proposal that lowers the pinball loss most, with the quantile of each leaf's cell counts as its values. Counts are whole
numbers, so their sums, and with them trees and forecasts, are the same in any partitioning and every run.

Trees are oblivious: all nodes of a depth share one split. Proposals are drawn from a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresift.operators.folds import Protocol, splits
from foresift.sources.store import kept

LEVELS = (0.05, 0.5, 0.95)
TREES, DEPTH, PROPOSALS, RATE = 12, 3, 12, 0.3
#: Bins of a feature, and cells of a residual over -REACH to REACH of its scale; the outer cells hold what lies beyond.
BINS, CELLS, REACH = 16, 192, 6.0
CENTRES = (np.arange(CELLS) + 0.5) * (2 * REACH / CELLS) - REACH


def features(panel: DataFrame, p: Protocol) -> DataFrame:
    """``series_id, t, y, mid, scale`` and bins ``f0, f1, ...``: what is known of a row a horizon before it.

    ``mid`` and ``scale`` are mean and deviation of the earlier rows of its phase; values are binned in units of ``scale``.
    Lags are whole seasons, the first of them at least a horizon back. Rows with fewer than two earlier ones are left out.
    """
    m = p.season
    back = -(-p.horizon // m)  # seasons in a horizon
    by = Window.partitionBy("series_id").orderBy("t")
    phase = Window.partitionBy("series_id", F.col("t") % m).orderBy("t").rowsBetween(Window.unboundedPreceding, -back)
    recent, all_ = by.rowsBetween(-m * back - m + 1, -m * back), by.rowsBetween(Window.unboundedPreceding, -m * back)
    rows = panel.select("series_id", "t", "y", F.avg("y").over(phase).alias("mid"), F.stddev_samp("y").over(phase).alias("own"), F.count("y").over(phase).alias("n"), F.stddev_samp("y").over(all_).alias("wide"), F.avg("y").over(all_).alias("level"), F.avg("y").over(recent).alias("recent"), *[F.lag("y", m * k).over(by).alias(f"lag{k}") for k in (back, back + 1, back + 6)])
    rows = rows.where("n >= 2 AND wide > 0").withColumn("scale", F.greatest("own", F.col("wide") / 10))
    unit = lambda x: F.least(F.greatest(F.floor((x + 3) / 6 * BINS), F.lit(0)), F.lit(BINS - 1))
    off = lambda c: F.coalesce((F.col(c) - F.col("mid")) / F.col("scale"), F.lit(0.0))
    found = [unit(off(f"lag{k}")) for k in (back, back + 1, back + 6)] + [unit((F.coalesce("recent", "level") - F.col("level")) / F.col("wide")), unit((F.col("mid") - F.col("level")) / F.col("wide")), F.floor(F.col("t") % m * BINS / m), F.floor(F.col("t") / m) % 7, F.least(F.floor(F.col("own") / F.col("wide") * BINS / 2), F.lit(BINS - 1))]
    return rows.select("series_id", "t", "y", "mid", "scale", *[F.coalesce(c, F.lit(0)).cast("int").alias(f"f{k}") for k, c in enumerate(found)])


class Trees:
    """By fold and level a start value and trees: splits (feature, bin) and leaf values."""

    def __init__(self, folds: int, levels: int):
        self.start = np.zeros((folds, levels))
        self.splits: list[np.ndarray] = []  # folds, levels, DEPTH, 2
        self.leaves: list[np.ndarray] = []  # folds, levels, 2 ** DEPTH

    def of(self, bins: np.ndarray, fold: int, level: int) -> np.ndarray:
        out = np.full(len(bins), self.start[fold, level])
        for splits, leaves in zip(self.splits, self.leaves, strict=True):
            out += leaves[fold, level][leaf(bins, splits[fold, level])]
        return out


def leaf(bins: np.ndarray, splits: np.ndarray) -> np.ndarray:
    found = np.zeros(len(bins), np.int64)
    for feature, edge in splits:
        found = 2 * found + (bins[:, feature] > edge)
    return found


def cell(left: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((left + REACH) * (CELLS / (2 * REACH))), 0, CELLS - 1).astype(np.int64)


def quantiles(counts: np.ndarray, level: float) -> np.ndarray:
    """The quantile of each row of cell counts, within its cell by share; 0 without counts."""
    total, upto = counts.sum(axis=-1, keepdims=True), np.cumsum(counts, axis=-1)
    k = np.argmax(upto >= np.maximum(total * level, 1e-9), axis=-1)[..., None]
    own, before = np.take_along_axis(counts, k, -1), np.take_along_axis(upto - counts, k, -1)
    inner = (total * level - before) / np.maximum(own, 1)
    return np.where(total > 0, (k + inner) * (2 * REACH / CELLS) - REACH, 0.0)[..., 0]


def pinball(counts: np.ndarray, moved: np.ndarray, level: float) -> np.ndarray:
    """The loss of each row of cell counts once its values are moved."""
    off = CENTRES - moved[..., None]
    return (counts * np.maximum(level * off, (level - 1) * off)).sum(axis=-1)


def padded(lists: pd.Series, width: int) -> np.ndarray:
    """Lists as rows of one width; what a series lacks is 0, which no row lies before."""
    out = np.zeros((len(lists), width), np.int64)
    for k, values in enumerate(lists):
        out[k, : len(values)] = values
    return out


def _counted(rows: DataFrame, folds: int, levels: int, model: Trees, proposals: np.ndarray) -> np.ndarray:
    """Counts by fold, level, proposal, leaf and cell, of all training rows."""
    shape, names = (folds, levels, len(proposals), 1 << proposals.shape[1], CELLS), [c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]
    shared = rows.sparkSession.sparkContext.broadcast((model, proposals))

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, proposals = shared.value
        counts = np.zeros(shape, np.int64)
        for pdf in parts:
            bins, x, t = pdf[names].to_numpy(), ((pdf["y"] - pdf["mid"]) / pdf["scale"]).to_numpy(), pdf["t"].to_numpy()
            los, tes = (padded(pdf[c], folds) for c in ("los", "tes"))
            homes = [leaf(bins, s) for s in proposals]
            for fold in range(folds):
                on = (t >= los[:, fold]) & (t < tes[:, fold])
                for level in range(levels):
                    cells = cell(x[on] - model.of(bins[on], fold, level))
                    for k, home in enumerate(homes):
                        counts[fold, level, k] += np.bincount(home[on] * CELLS + cells, minlength=shape[3] * CELLS).reshape(shape[3], CELLS)
        flat = counts.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"at": at, "n": flat[at]})

    found = rows.select("t", "y", "mid", "scale", "los", "tes", *names).where("y IS NOT NULL").mapInPandas(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(np.prod(shape)), np.int64)
    counts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts.reshape(shape)


def fit(rows: DataFrame, p: Protocol, levels: tuple[float, ...], trees: int, seed: int) -> Trees:
    """Trees from rows of ``features`` with the training bounds ``los, tes`` of each fold. The driver holds counts of bounded number only."""
    n_features = sum(c[0] == "f" and c[1:].isdigit() for c in rows.columns)
    model, rng = Trees(p.folds, len(levels)), np.random.default_rng(seed)
    first = _counted(rows, p.folds, len(levels), model, np.array([[[0, BINS]]]))[:, :, 0].sum(axis=2)
    model.start = np.stack([quantiles(first[:, k], q) for k, q in enumerate(levels)], axis=1)
    for _ in range(trees):
        proposals = np.stack([rng.integers(n_features, size=(PROPOSALS, DEPTH)), rng.integers(BINS - 1, size=(PROPOSALS, DEPTH))], axis=-1)
        counts = _counted(rows, p.folds, len(levels), model, proposals)
        splits, leaves = np.zeros((p.folds, len(levels), DEPTH, 2), np.int64), np.zeros((p.folds, len(levels), 1 << DEPTH))
        for k, q in enumerate(levels):
            values = RATE * quantiles(counts[:, k], q)
            best = pinball(counts[:, k], values, q).sum(axis=-1).argmin(axis=1)
            splits[:, k], leaves[:, k] = proposals[best], values[np.arange(p.folds), best]
        model.splits.append(splits)
        model.leaves.append(leaves)
    return model


def _prepared(panel: DataFrame, p: Protocol) -> DataFrame:
    """Stored rows of ``features`` with the training bounds of all folds of their series."""
    bounds = splits(panel, p).groupBy(F.col("series_id").alias("s")).agg(F.array_sort(F.collect_list(F.struct("fold", "tr_lo", "te"))).alias("b"))
    return kept(features(panel, p).join(bounds, F.col("series_id") == F.col("s")).withColumns({"los": F.col("b.tr_lo"), "tes": F.col("b.te")}).drop("s", "b"))


def _tested(rows: DataFrame, p: Protocol, *columns: str) -> DataFrame:
    """The rows that a fold forecasts, once for each such fold."""
    return rows.select("series_id", "t", "mid", "scale", *columns, F.posexplode("tes").alias("fold", "te")).where((F.col("t") >= F.col("te")) & (F.col("t") < F.col("te") + p.horizon))


def forecast(panel: DataFrame, p: Protocol, levels: tuple[float, ...] = LEVELS, trees: int = TREES, seed: int = 7) -> DataFrame:
    """``series_id, fold, h, t, quantiles``: the forecast at each of ascending ``levels``, by trees fitted for every fold on its training rows of all series.

    Quantiles that cross are put in order. Rows whose phase has fewer than two values a horizon before have no forecast.
    Null y is not learnt from.
    """
    rows = _prepared(panel, p)
    model = rows.sparkSession.sparkContext.broadcast(fit(rows, p, levels, trees, seed))
    names = [c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]
    tested = _tested(rows, p, *names)

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            bins, fold, out = pdf[names].to_numpy(), pdf["fold"].to_numpy(), np.zeros((len(pdf), len(levels)))
            for f in np.unique(fold):
                for k in range(len(levels)):
                    out[fold == f, k] = model.value.of(bins[fold == f], f, k)
            found = pdf["mid"].to_numpy()[:, None] + pdf["scale"].to_numpy()[:, None] * np.sort(out, axis=1)
            yield pd.DataFrame({"series_id": pdf["series_id"], "fold": fold, "h": pdf["t"] - pdf["te"] + 1, "t": pdf["t"], "quantiles": found.tolist()})

    return tested.mapInPandas(predict, "series_id string, fold long, h long, t long, quantiles array<double>")


def importance(panel: DataFrame, p: Protocol, level: float = 0.5, trees: int = TREES, seed: int = 7, block: int = 256, threshold: float = 0.05, most: int | None = None) -> DataFrame:
    """``feature, loss, share, chosen``: by how much the pinball loss of forecasts grows when a feature's values change places.

    Values move within blocks of ``block`` rows of a series, in an order by hash, so that they stay plausible and no task
    holds more than a block; all features are tried in one pass over the rows that the folds forecast. ``share`` is that of the
    largest growth; features with a share of ``threshold`` or more are chosen, ``most`` of them at most, ties by name.
    """
    rows = _prepared(panel, p)
    names = [c for c in rows.columns if c[0] == "f" and c[1:].isdigit()]
    model = rows.sparkSession.sparkContext.broadcast(fit(rows, p, (level,), trees, seed))
    tested = _tested(rows.where("y IS NOT NULL"), p, "y", *names).withColumn("block", F.floor(F.col("t") / block))
    for name in names:
        by = Window.partitionBy("series_id", "fold", "block").orderBy(F.xxhash64(F.lit(name), "t"), "t")
        tested = tested.withColumn(f"moved_{name}", F.coalesce(F.lead(name).over(by), F.first(name).over(by)))

    def losses(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(names) + 1)
        for pdf in parts:
            bins, fold, y = pdf[names].to_numpy(), pdf["fold"].to_numpy(), ((pdf["y"] - pdf["mid"]) / pdf["scale"]).to_numpy()
            for f in np.unique(fold):
                on = fold == f
                for k in range(-1, len(names)):
                    own = bins[on].copy()
                    if k >= 0:
                        own[:, k] = pdf[f"moved_{names[k]}"].to_numpy()[on]
                    off = y[on] - model.value.of(own, f, 0)
                    total[k + 1] += np.maximum(level * off, (level - 1) * off).sum()
        yield pd.DataFrame({"feature": ["", *names], "loss": np.round(total, 6)})

    summed = tested.drop("series_id", "block").mapInPandas(losses, "feature string, loss double").groupBy("feature").agg(F.sum("loss").alias("loss"))
    whole = Window.partitionBy()  # a row a feature
    grown = summed.withColumn("loss", F.col("loss") - F.max(F.when(F.col("feature") == "", F.col("loss"))).over(whole)).where("feature <> ''")
    ranked = grown.withColumn("share", F.coalesce(F.try_divide(F.col("loss"), F.nullif(F.greatest(F.max("loss").over(whole), F.lit(0.0)), F.lit(0.0))), F.lit(0.0)))
    place = F.row_number().over(Window.orderBy(F.desc("share"), "feature"))
    return ranked.select("feature", "loss", "share", ((F.col("share") >= threshold) & (place <= (len(names) if most is None else most))).alias("chosen"))
