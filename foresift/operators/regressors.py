"""Forecasters that fit a regression: trend with Fourier terms by series and fold, gradient-boosted trees for all series at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from foresift.functions.special import z
from foresift.operators.folds import Protocol, splits, steps
from foresift.operators.forecasters import _read, _train, by_series


FIT = StructType().add("coef", ArrayType(DoubleType())).add("sse", DoubleType())


def _terms(t: Column, p: Protocol, pairs: int) -> list[Column]:
    """One, the trend, and the sine and cosine of each harmonic of the season."""
    waves = [f(2 * F.pi() * k * (t % p.season) / p.season) for k in range(1, pairs + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), t / F.lit(float(p.min_train)), *waves]


@F.pandas_udf(FIT)
def _solve(gram: pd.Series, moment: pd.Series, total: pd.Series) -> pd.DataFrame:
    """Least squares of each row's normal equations; ``gram`` is the upper triangle by rows. Terms without information get the smallest coefficients."""
    b = np.stack(moment.to_list())
    upper = np.triu_indices(b.shape[1])
    full = np.zeros((len(b), b.shape[1], b.shape[1]))
    full[:, upper[0], upper[1]] = np.stack(gram.to_list())
    full[:, upper[1], upper[0]] = full[:, upper[0], upper[1]]
    coef = np.einsum("nij,nj->ni", np.linalg.pinv(full, rcond=1e-12, hermitian=True), b)
    return pd.DataFrame({"coef": list(coef), "sse": np.maximum(total.to_numpy() - (coef * b).sum(axis=1), 0.0)})


def trend_fourier(panel: DataFrame, p: Protocol, pairs: int = 3, alpha: float = 0.1) -> DataFrame:
    """``series_id, fold, te, h, t, y_pred, lo, hi``: least squares on a trend and ``pairs`` harmonics of the season.

    The normal equations are running sums, read at the end of each fold: one window over the panel, and one small
    system to solve for each series and fold. Null values do not count; a fold without any has null forecasts, one with
    no more values than terms null bands. Bands are normal, from the residual variance.
    """
    d = 2 + 2 * pairs
    rows = panel.withColumns({f"x{k}": F.when(F.col("y").isNotNull(), x) for k, x in enumerate(_terms(F.col("t"), p, pairs))})
    train = _train(p)
    over = lambda x: F.coalesce(F.sum(x).over(train), F.lit(0.0))
    gram = [over(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(d) for j in range(i, d)]
    sums = rows.select("series_id", "t", F.array(*gram).alias("gram"), F.array(*[over(F.col(f"x{i}") * F.col("y")) for i in range(d)]).alias("moment"), over(F.col("y") * F.col("y")).alias("total"), F.count("y").over(train).alias("n"))
    ends = _read(sums, splits(panel, p), F.col("te") - 1, "gram", "moment", "total", "n")
    fits = ends.select("series_id", "fold", "te", "n", _solve("gram", "moment", "total").alias("fit"))
    ahead = steps(fits, p).withColumn("y_pred", F.when(F.col("n") > 0, sum((F.get("fit.coef", F.lit(k)) * x for k, x in enumerate(_terms(F.col("t"), p, pairs))), F.lit(0.0))))
    band = z(1 - alpha / 2) * F.when(F.col("n") > d, F.sqrt(F.col("fit.sse") / (F.col("n") - d)))
    return ahead.select("series_id", "fold", "te", "h", "t", "y_pred", (F.col("y_pred") - band).alias("lo"), (F.col("y_pred") + band).alias("hi"))


INPUTS = ("season_y", "last_y", "phase", "h")


def _inputs(panel: DataFrame, origins: DataFrame, p: Protocol) -> DataFrame:
    """Adds to ``series_id, te`` a row for each step, with what is known before te: values relative to the last season's mean."""
    season = by_series().rowsBetween(-p.season + 1, 0)
    known = panel.withColumns({"level": F.avg("y").over(season), "spread": F.stddev_pop("y").over(season)})
    rows = _read(known, steps(origins, p), F.col("te") - p.season + (F.col("h") - 1) % p.season, "y").withColumnRenamed("y", "season_y")
    rows = _read(known, rows, F.col("te") - 1, "y", "level", "spread").withColumnRenamed("y", "last_y")
    rows = rows.withColumns({"season_y": F.col("season_y") - F.col("level"), "last_y": F.col("last_y") - F.col("level"), "phase": F.col("t") % p.season})
    return rows.withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0))


def _past(panel: DataFrame, folds: DataFrame, p: Protocol) -> DataFrame:
    """Inputs and ``target`` of origins a horizon apart whose steps end before each series' first fold, ``back`` horizons before it."""
    first = folds.groupBy("series_id").agg(F.min("te").alias("first"))
    back = (F.col("first") - F.col("t")) / p.horizon
    origins = panel.join(first, "series_id").where((F.col("t") >= p.season) & (back >= 1) & (back == F.floor(back))).select("series_id", F.col("t").alias("te"), back.alias("back"))
    return _read(panel, _inputs(panel, origins, p), F.col("t"), "y").where("y IS NOT NULL").withColumn("target", F.col("y") - F.col("level"))


def gbt_direct(panel: DataFrame, p: Protocol, alpha: float = 0.1, held: int = 4, trees: int = 20, depth: int = 4) -> DataFrame:
    """``series_id, fold, te, h, t, y_pred, lo, hi`` by one model of gradient-boosted trees for all series and steps ahead.

    It learns from origins a horizon apart that end before each series' first fold, so no fold sees its own future; the
    last ``held`` of them are kept for the bands: the quantile of the absolute errors of each step ahead, in units of
    the last season's spread. Origins with a null among their inputs give no row. Raises where no series has an origin
    to learn from. Reruns usually agree, but need not.
    """
    folds, vectors = splits(panel, p), VectorAssembler(inputCols=list(INPUTS), outputCol="x", handleInvalid="skip").transform
    past = vectors(_past(panel, folds, p)).withColumn("kept_back", F.col("back") <= held)
    learned = past.where("NOT kept_back").repartition("series_id", "te").sortWithinPartitions("series_id", "te", "h")
    if learned.isEmpty():
        raise ValueError("no origin to learn from: the first folds begin too early")
    model = GBTRegressor(featuresCol="x", labelCol="target", predictionCol="p", maxIter=trees, maxDepth=depth, seed=0).fit(learned)
    errors = model.transform(past.where("kept_back")).groupBy("h").agg(F.percentile(F.abs(F.col("target") - F.col("p")) / F.col("spread"), 1 - alpha).alias("q"))
    ahead = model.transform(vectors(_inputs(panel, folds, p))).join(errors, "h", "left")
    y, band = F.col("p") + F.col("level"), F.col("q") * F.col("spread")
    return ahead.select("series_id", "fold", "te", "h", "t", y.alias("y_pred"), (y - band).alias("lo"), (y + band).alias("hi"))
