"""Walk-forward folds as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Protocol:
    """Season m, horizon h, folds k, stride, smallest training length; rolling or expanding training windows."""

    season: int
    horizon: int
    folds: int
    stride: int
    min_train: int
    mode: str = "expanding"


HOURLY = Protocol(24, 24, 8, 24, 240)
ROLLING = Protocol(24, 24, 8, 24, 240, "rolling")
DAILY = Protocol(7, 14, 6, 14, 365)
WEEKLY = Protocol(1, 8, 4, 8, 104)
REVENUE = Protocol(4, 4, 4, 4, 104)


def splits(panel: DataFrame, p: Protocol) -> DataFrame:
    """``series_id, fold, tr_lo, te, ee`` for each series: train on [tr_lo, te), test on [te, ee).

    The last fold ends with the series. When ``min_train`` binds there are fewer folds.
    """
    n = panel.groupBy("series_id").agg(F.count("*").alias("n"))
    last = F.col("n") - p.horizon
    first = F.greatest(F.lit(p.min_train), last - (p.folds - 1) * p.stride)
    ends = n.where(last >= first).select("series_id", F.posexplode(F.slice(F.sequence(first, last, F.lit(p.stride).cast("long")), 1, p.folds)).alias("fold", "te"))
    low = F.col("te") - p.min_train if p.mode == "rolling" else F.lit(0)
    return ends.select("series_id", F.col("fold").cast("long").alias("fold"), low.cast("long").alias("tr_lo"), "te", (F.col("te") + p.horizon).alias("ee"))


def steps(folds: DataFrame, p: Protocol) -> DataFrame:
    """A row for each fold and step ahead: adds ``h`` and the tested position ``t``."""
    return folds.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(p.horizon)))).withColumn("h", F.col("h").cast("long")).withColumn("t", F.col("te") + F.col("h") - 1)


def assign(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows by fold and part (train or test); a row counts in every fold that it is part of."""
    within = (F.col("f.series_id") == F.col("p.series_id")) & (F.col("p.t") >= F.col("tr_lo")) & (F.col("p.t") < F.col("ee"))
    rows = panel.alias("p").join(folds.alias("f"), within)
    return rows.select("p.series_id", "fold", "p.t", "y", F.when(F.col("p.t") < F.col("te"), "train").otherwise("test").alias("part"))
