"""Forecast metrics as aggregate columns over rows with ``y_true, y_pred, lo, hi``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def y() -> Column:
    return F.col("y_true")


def p() -> Column:
    return F.col("y_pred")


def lo() -> Column:
    return F.col("lo")


def hi() -> Column:
    return F.col("hi")


def mae() -> Column:
    return F.avg(F.abs(y() - p()))


def rmse() -> Column:
    return F.sqrt(F.avg((y() - p()) * (y() - p())))


def smape() -> Column:
    size = F.abs(y()) + F.abs(p())
    return 100 * F.avg(F.when(size == 0, 0.0).otherwise(2 * F.abs(y() - p()) / size))


def pinball(q: float, forecast: Column | None = None) -> Column:
    d = y() - (p() if forecast is None else forecast)
    return F.avg(F.greatest(q * d, (q - 1) * d))


def _whole(metric: Column) -> Column:
    """Null if any bound is missing."""
    return F.when(F.count_if(lo().isNull() | hi().isNull()) == 0, metric)


def coverage() -> Column:
    return _whole(F.avg(F.when((y() >= lo()) & (y() <= hi()), 1.0).otherwise(0.0)))


def width() -> Column:
    return _whole(F.avg(hi() - lo()))


def winkler(alpha: float) -> Column:
    return _whole(F.avg(hi() - lo() + 2 / alpha * F.greatest(lo() - y(), F.lit(0.0)) + 2 / alpha * F.greatest(y() - hi(), F.lit(0.0))))


def asymmetric(over: float = 1.0, under: float = 3.0) -> Column:
    """Cost of the error: ``over`` a unit forecast too much, ``under`` a unit too little."""
    return F.avg(F.when(p() > y(), over * (p() - y())).otherwise(under * (y() - p())))


def stockout() -> Column:
    return F.avg(F.when(y() > p(), 1.0).otherwise(0.0))
