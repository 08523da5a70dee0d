"""Cleaning a panel: gaps, outliers, seasonal decomposition, changepoints. All are windows over ``series_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresift.operators import local_level


def _by():
    return Window.partitionBy("series_id").orderBy("t")


def _upto():
    return _by().rowsBetween(Window.unboundedPreceding, 0)


def _from():
    return _by().rowsBetween(0, Window.unboundedFollowing)


def fill_forward(panel: DataFrame) -> DataFrame:
    """The last value before a gap; for leading gaps the first after it."""
    return panel.withColumn("y", F.coalesce(F.last("y", True).over(_upto()), F.first("y", True).over(_from())))


def fill_zero(panel: DataFrame) -> DataFrame:
    return panel.withColumn("y", F.coalesce("y", F.lit(0.0)))


def interpolate(panel: DataFrame) -> DataFrame:
    """Linear by position; trailing gaps hold the last value, leading ones the first."""
    at = F.when(F.col("y").isNotNull(), F.col("t"))
    known = panel.withColumns({"t0": F.last(at, True).over(_upto()), "y0": F.last("y", True).over(_upto()), "t1": F.first(at, True).over(_from()), "y1": F.first("y", True).over(_from())})
    blend = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return known.withColumn("y", F.coalesce("y", blend, "y0", "y1")).drop("t0", "y0", "t1", "y1")


def _uniform(text, start: int):
    """A number in (0, 1) from 15 hex digits of a hash, the same in any partitioning."""
    return (F.conv(F.substring(F.md5(text), start, 15), 16, 10).cast("double") + 0.5) / float(16**15)


def inject(panel: DataFrame, kind: str, n: int = 5, magnitude: float = 5.0, seed: int = 42) -> DataFrame:
    """Corrupt ``n`` points of each series and mark them in ``injected``.

    ``spike`` adds or takes ``magnitude`` standard deviations, ``gaussian`` adds normal noise of that deviation,
    ``dropout`` leaves nulls, ``level_shift`` adds it to n neighbouring points. Points and signs are chosen by hashes
    of seed, series and position; a constant series counts as one of deviation 1.
    """
    every = Window.partitionBy("series_id")
    name = F.concat(F.lit(f"{seed}/"), F.col("series_id"))
    point = F.concat(name, F.lit("/"), F.col("t").cast("string"))
    scale, size = F.stddev_samp("y").over(every), F.count("*").over(every)
    rows = panel.withColumns({"step": F.coalesce(F.nullif(scale, F.lit(0.0)), F.lit(1.0)) * magnitude, "size": size})
    if kind == "level_shift":
        start = 1 + F.floor(_uniform(name, 1) * F.greatest(F.lit(1), F.col("size") - n - 1))
        rows = rows.withColumn("injected", (F.col("t") >= start) & (F.col("t") < start + n))
    else:
        rank = F.row_number().over(every.orderBy(_uniform(point, 1), "t"))
        rows = rows.withColumn("injected", rank <= n)
    sign = F.when(_uniform(point, 16) < 0.5, -1.0).otherwise(1.0)
    normal = F.sqrt(-2 * F.log(_uniform(F.concat(point, F.lit("/a")), 1))) * F.cos(2 * F.pi() * _uniform(F.concat(point, F.lit("/b")), 1))
    put = {"spike": F.col("y") + sign * F.col("step"), "level_shift": F.col("y") + F.col("step"), "dropout": F.lit(None).cast("double"), "gaussian": F.col("y") + normal * F.col("step")}[kind]
    return rows.withColumn("y", F.when(F.col("injected"), put).otherwise(F.col("y"))).drop("step", "size")


def fill_seasonal(panel: DataFrame, season: int) -> DataFrame:
    """The value one, two or three seasons before, then interpolation."""
    return interpolate(panel.withColumn("y", F.coalesce("y", *[F.lag("y", k * season).over(_by()) for k in (1, 2, 3)])))


def hampel(panel: DataFrame, window: int = 24, k: float = 3.0) -> DataFrame:
    """Adds ``med, outlier``; outliers are replaced by the centred rolling median.

    A value is out if it is further from the median than k times the scaled median deviation, where each deviation is
    from its own row's median. Even windows reach one row less forward.
    """
    frame = _by().rowsBetween(-(window // 2), window // 2 - (window % 2 == 0))
    known = panel.withColumn("med", F.percentile("y", 0.5).over(frame)).withColumn("dev", F.abs(F.col("y") - F.col("med")))
    known = known.withColumn("outlier", F.col("dev") > k * 1.4826 * F.percentile("dev", 0.5).over(frame))
    return known.withColumn("y", F.when(F.col("outlier"), F.col("med")).otherwise(F.col("y"))).drop("dev")


def decompose(panel: DataFrame, season: int) -> DataFrame:
    """Adds ``trend`` (centred moving average), ``seasonal`` (mean deviation of the phase, centred), ``resid``."""
    known = panel.withColumn("trend", F.avg("y").over(_by().rowsBetween(-(season // 2), season - season // 2 - 1)))
    known = known.withColumn("part", F.avg(F.col("y") - F.col("trend")).over(Window.partitionBy("series_id", F.col("t") % season)))
    known = known.withColumn("seasonal", F.col("part") - F.avg("part").over(Window.partitionBy("series_id")))
    return known.withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal")).drop("part")


def decompose_outliers(panel: DataFrame, season: int, k: float = 3.0) -> DataFrame:
    """Adds ``outlier``: residuals further from their median than k scaled median deviations; replaced by trend + seasonal."""
    parts = decompose(panel, season)
    med = parts.groupBy("series_id").agg(F.percentile("resid", 0.5).alias("mid"))
    parts = parts.join(med, "series_id").withColumn("dev", F.abs(F.col("resid") - F.col("mid")))
    mad = parts.groupBy("series_id").agg((F.percentile("dev", 0.5) * 1.4826 * k).alias("most"))
    parts = parts.join(mad, "series_id").withColumn("outlier", F.col("dev") > F.col("most"))
    return parts.withColumn("y", F.when(F.col("outlier"), F.col("trend") + F.col("seasonal")).otherwise(F.col("y"))).drop("mid", "dev", "most")


def changepoints(panel: DataFrame, size: int = 48) -> DataFrame:
    """``series_id, t, ds`` where the rolling mean jumps by more than three standard deviations of the series' jumps; every ``size``-th such row."""
    mean = F.when(F.col("t") >= size - 1, F.avg("y").over(_by().rowsBetween(-size + 1, 0)))
    jumps = panel.withColumn("mean", mean).withColumn("jump", F.abs(F.col("mean") - F.lag("mean").over(_by())))
    jumps = jumps.withColumn("most", 3 * F.stddev_samp("jump").over(Window.partitionBy("series_id")))
    hits = jumps.where("jump > most").withColumn("k", F.row_number().over(_by()) - 1)
    return hits.where(F.col("k") % size == 0).select("series_id", "t", "ds")


def since_changepoint(panel: DataFrame, points: DataFrame) -> DataFrame:
    """Adds ``since_changepoint``: whole days since the last changepoint, 0 before the first."""
    marked = panel.join(points.select("series_id", "t", F.col("ds").alias("cp")), ["series_id", "t"], "left")
    last = F.last("cp", True).over(_upto())
    return marked.withColumn("since_changepoint", F.coalesce(F.floor(F.timestamp_diff("SECOND", last, F.col("ds")) / 86400), F.lit(0)).cast("long")).drop("cp")


def fill_kalman(panel: DataFrame, ratios: tuple[float, ...] = (0.001, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 100.0)) -> DataFrame:
    """Gaps take the smoothed local level of the series; series without gaps, or without any value, stay as they are.

    The signal-to-noise ratio with the highest likelihood of ``ratios`` is taken (see ``local_level``).
    """
    gaps = panel.where("y IS NULL").select("series_id").distinct()
    levels = local_level.smoothed(panel.join(gaps, "series_id", "left_semi"), ratios)
    own = levels.select(F.col("series_id").alias("s"), F.col("t").alias("u"), "level")
    filled = panel.join(own, (F.col("series_id") == F.col("s")) & (F.col("t") == F.col("u")), "left")
    return filled.withColumn("y", F.coalesce("y", "level")).select(*panel.columns)


FILLS = {"kalman": lambda p, m: fill_kalman(p), "seasonal": fill_seasonal, "forward": lambda p, m: fill_forward(p), "zero": lambda p, m: fill_zero(p), "linear": lambda p, m: interpolate(p)}
OUTLIERS = {"stl": decompose_outliers, "hampel": hampel, "none": lambda p, m: p.withColumn("outlier", F.lit(False))}


def preprocess(panel: DataFrame, season: int, fill: str = "kalman", outliers: str = "stl", find_changepoints: bool = True) -> tuple[DataFrame, DataFrame]:
    """The panel filled, with outliers replaced, and ``outlier, since_changepoint``; and a report by series.

    The report has ``series_id, n_missing, n_outliers, changepoints``, the last an ascending list of times.
    """
    if fill not in FILLS or outliers not in OUTLIERS:
        raise ValueError(f"fill is one of {sorted(FILLS)}, outliers one of {sorted(OUTLIERS)}")
    clean = OUTLIERS[outliers](FILLS[fill](panel, season), season).select("series_id", "ds", "t", "y", "outlier")
    report = panel.groupBy("series_id").agg(F.count_if(F.col("y").isNull()).alias("n_missing"))
    report = report.join(clean.groupBy("series_id").agg(F.count_if("outlier").alias("n_outliers")), "series_id")
    if find_changepoints:
        points = changepoints(clean, season)
        clean = since_changepoint(clean, points)
        report = report.join(points.groupBy("series_id").agg(F.array_sort(F.collect_list("ds")).alias("changepoints")), "series_id", "left")
        return clean, report.withColumn("changepoints", F.coalesce("changepoints", F.array().cast("array<timestamp_ntz>")))
    return clean.withColumn("since_changepoint", F.lit(0).cast("long")), report.withColumn("changepoints", F.array().cast("array<timestamp_ntz>"))
