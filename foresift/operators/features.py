"""Features of a panel: lags, calendar, encodings, training windows. Lags of one panel share one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by():
    return Window.partitionBy("series_id").orderBy("t")


def lags(panel: DataFrame, steps: tuple[int, ...], col: str = "y") -> DataFrame:
    return panel.withColumns({f"{col}_lag{k}": F.lag(col, k).over(_by()) for k in steps})


def calendar(panel: DataFrame) -> DataFrame:
    """Hour, day of week (Monday 0), month, ISO week, weekend flag."""
    ds = F.col("ds")
    return panel.withColumns({"hour": F.hour(ds).cast("long"), "dow": F.weekday(ds).cast("long"), "month": F.month(ds).cast("long"), "week": F.weekofyear(ds).cast("long"), "weekend": F.weekday(ds) >= 5})


def fourier(panel: DataFrame, terms: tuple[tuple[int, int], ...] = ((24, 3), (168, 3))) -> DataFrame:
    """Sine and cosine pairs of (period in hours, number), by the clock, so that training and later rows agree."""
    hours = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ds"))
    new = {}
    for period, n in terms:
        for k in range(1, n + 1):
            angle = 2 * F.pi() * k * (hours % period) / period
            new |= {f"sin_{period}_{k}": F.sin(angle), f"cos_{period}_{k}": F.cos(angle)}
    return panel.withColumns(new)


def design_matrix(panel: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """Lags and calendar, complete rows only."""
    return calendar(lags(panel, steps)).dropna()


def holidays(panel: DataFrame, days: DataFrame, around: int = 1) -> DataFrame:
    """Adds ``holiday, before, after``; ``days`` has ``day`` (date), a small dimension. The windows are in days whatever the panel's step."""
    dated = panel.withColumn("day", F.to_date("ds"))
    for name, shift in (("holiday", 0), ("before", around), ("after", -around)):
        own = days.select(F.date_sub("day", shift).alias("day")).distinct().withColumn(name, F.lit(True))
        dated = dated.join(own, "day", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return dated.drop("day")


def target_encode(train: DataFrame, rows: DataFrame, col: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Adds ``{col}_enc``: the category's mean target in ``train``, drawn to the global mean; unseen categories get that."""
    by = train.groupBy(col).agg(F.count(target).alias("n"), F.avg(target).alias("m"))
    every = train.agg(F.avg(target).alias("g"))  # one row
    enc = (F.col("n") * F.col("m") + smoothing * F.col("g")) / (F.col("n") + smoothing)
    return rows.join(by, col, "left").join(F.broadcast(every)).withColumn(f"{col}_enc", F.coalesce(enc, "g")).drop("n", "m", "g")


def interactions(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Product, ratio (0 where the divisor is 0) and difference of two columns."""
    return rows.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b), f"{a}_div_{b}": F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b)), f"{a}_sub_{b}": F.col(a) - F.col(b)})


def prune(rows: DataFrame, target: str, columns: list[str], threshold: float) -> DataFrame:
    """``feature, importance``: absolute correlation with the target relative to the largest, at least ``threshold``."""
    scores = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.corr(c, target)).alias("r")) for c in columns])
    found = rows.agg(scores.alias("x")).select(F.inline("x"))
    best = F.max("r").over(Window.partitionBy())  # a row a feature
    return found.withColumn("importance", F.col("r") / best).where(F.col("importance") >= threshold).select("feature", "importance")


def training_windows(panel: DataFrame, context: int, horizon: int) -> DataFrame:
    """``series_id, t, context, future``: the values up to each row and after it, where both are complete."""
    past = F.collect_list("y").over(_by().rowsBetween(-context + 1, 0))
    ahead = F.collect_list("y").over(_by().rowsBetween(1, horizon))
    rows = panel.select("series_id", "t", past.alias("context"), ahead.alias("future"))
    return rows.where((F.size("context") == context) & (F.size("future") == horizon))


def patches(windows: DataFrame, size: int, step: int, context: int) -> DataFrame:
    """Adds ``patches``: overlapping pieces of the context."""
    starts = F.sequence(F.lit(1), F.lit(context - size + 1), F.lit(step))
    return windows.withColumn("patches", F.transform(starts, lambda k: F.slice("context", k, F.lit(size))))
