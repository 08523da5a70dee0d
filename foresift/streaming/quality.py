"""Live forecast quality with Structured Streaming. Event times are timestamps; NTZ columns must be cast before a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.functions import metrics as M


def with_actuals(forecasts: DataFrame, actuals: DataFrame, late: str = "1 day") -> DataFrame:
    """Join the stream of forecasts (``model, series_id, ds, y_pred, lo, hi``) with that of actual values (``series_id, ds, y``).

    An actual value may come ``late`` after its forecast's time; state beyond that is dropped by the watermarks.
    """
    f = forecasts.withWatermark("ds", late)
    a = actuals.select(F.col("series_id").alias("id"), F.col("ds").alias("at"), F.col("y").alias("y_true")).withWatermark("at", late)
    return f.join(a, (F.col("id") == F.col("series_id")) & (F.col("at") == F.col("ds"))).drop("id", "at")


def rolling_quality(scored: DataFrame, window: str = "1 day", slide: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """``model, start, n, mae, coverage`` of sliding windows; a window is emitted once the watermark has passed it."""
    by = scored.withWatermark("ds", late).groupBy(F.window("ds", window, slide).alias("w"), "model")
    found = by.agg(F.count("*").alias("n"), M.mae().alias("mae"), M.coverage().alias("coverage"))
    return found.select("model", F.col("w.start").alias("start"), "n", "mae", "coverage")
