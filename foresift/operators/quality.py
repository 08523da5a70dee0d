"""Data quality and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.operators import adaptive_window, ranks
from foresift.sources.store import kept

def violations(rows: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """``column, rule, n_bad`` of declared rules (dtype, nonnull, min, max, in), all counted in one pass; a missing column or another type is one violation."""
    found, known = [], {"dtype", "nonnull", "min", "max", "in"}
    for name, rules in spec.items():
        if odd := set(rules) - known:
            raise ValueError(f"unknown rules for {name}: {sorted(odd)}")
        if name not in rows.columns:
            found.append((name, "missing", F.lit(1).cast("long")))
            continue
        c = F.col(name)
        tests: dict[str, Column] = {"nonnull": c.isNull(), "min": c < rules.get("min"), "max": c > rules.get("max"), "in": ~c.isin(*rules.get("in", ()))}
        if "dtype" in rules:
            found.append((name, "dtype", F.lit(int(rows.schema[name].dataType.simpleString() != rules["dtype"])).cast("long")))
        found += [(name, rule, F.count_if(tests[rule])) for rule in rules if rule in tests and (rule != "nonnull" or rules[rule])]
    return rows.agg(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(r).alias("rule"), x.alias("n_bad")) for n, r, x in found]).alias("x")).select(F.inline("x"))


def psi(ref: DataFrame, cur: DataFrame, bins: int = 10) -> DataFrame:
    """``feature, psi`` of long tables ``feature, x``: bins by the reference's quantiles, open at the ends, shares of at least 1e-6. Nulls and NaN do not count."""
    return ranks.psi(ranks.compared(ref, cur), bins)


def ks(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """``feature, ks, p``: the largest distance of the two distribution functions, and its significance: exact for few values, else asymptotic. Nulls and NaN do not count."""
    return ranks.ks(ranks.compared(ref, cur))


def drift_report(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """``feature, psi, ks, p, status``: drift above PSI 0.25 or below p 0.01, warn above PSI 0.10."""
    ranked = kept(ranks.compared(ref, cur))
    both = ranks.psi(ranked).join(ranks.ks(ranked), "feature")
    status = F.when((F.col("psi") > 0.25) | (F.col("p") < 0.01), "drift").when(F.col("psi") > 0.10, "warn").otherwise("ok")
    return both.withColumn("status", status)


def page_hinkley(rows: DataFrame, delta: float = 0.005, most: float = 50.0) -> DataFrame:
    """Adds ``mean, excess, fired`` to ``key, t, x``: the drift of the running sum of deviations above its minimum."""
    by = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mean", F.avg("x").over(by)).withColumn("sum", F.sum(F.col("x") - F.col("mean") - delta).over(by))
    rows = rows.withColumn("excess", F.col("sum") - F.least(F.min("sum").over(by), F.lit(0.0)))
    return rows.withColumn("fired", F.col("excess") > most).drop("sum")


def adwin_first_alarm(rows: DataFrame, delta: float = 0.002) -> DataFrame:
    """``key, t, cut`` of ``key, t, x``: the first row at which the adaptive window drops values, and how many (see ``adaptive_window``). Keys without an alarm have no row."""
    return adaptive_window.first_alarm(rows, delta)


def evaluate(ref: DataFrame, cur: DataFrame, nominal: float, most_mae: float | None = None, tolerance: float = 0.05, serious: float = 0.25, delta: float = 0.005, most: float = 50.0, adwin: float = 0.002, covariates: DataFrame | None = None) -> DataFrame:
    """``feature, psi, mae, coverage, ph_drift, adwin_drift, alerts, retrain`` of a window of forecasts.

    ``ref`` and ``cur`` have ``feature, t, x, inside``: the residual in order of t and whether the value was inside its
    interval. Alerts: PSI above 0.10 (``serious``: retrain), coverage off by more than ``tolerance`` (twice that:
    retrain), a mean error above ``most_mae``, Page-Hinkley or ADWIN on absolute errors, and the ``covariates`` (rows of
    drift by ks, ``feature`` being the same as here, ``name``, ``p``) with p < 0.01; the last four retrain.
    """
    absolute = cur.select(F.col("feature").alias("key"), "t", F.abs("x").alias("x"))
    level = cur.groupBy("feature").agg(F.avg(F.abs("x")).alias("mae"), F.avg(F.col("inside").cast("double")).alias("coverage"))
    ph = page_hinkley(absolute, delta, most).groupBy(F.col("key").alias("feature")).agg(F.bool_or("fired").alias("ph_drift"))
    alarms = adwin_first_alarm(absolute, adwin).select(F.col("key").alias("feature"), F.lit(True).alias("adwin_drift"))
    all_ = level.join(psi(ref, cur), "feature", "left").join(ph, "feature").join(alarms, "feature", "left").withColumn("adwin_drift", F.coalesce("adwin_drift", F.lit(False)))
    moved = F.lit(False)
    if covariates is not None:
        shifted = covariates.where("p < 0.01").groupBy("feature").agg(F.array_sort(F.collect_set("name")).alias("shifted"))
        all_ = all_.join(shifted, "feature", "left")
        moved = F.col("shifted").isNotNull()
    off = F.abs(F.col("coverage") - nominal)
    late = F.lit(False) if most_mae is None else F.col("mae") > most_mae
    tests = [(F.col("psi") > serious, "psi"), ((F.col("psi") > 0.10) & (F.col("psi") <= serious), "psi_warn"), (off > tolerance, "coverage"), (late, "mae"), (F.col("ph_drift"), "page_hinkley"), (F.col("adwin_drift"), "adwin"), (moved, "covariates")]
    alerts = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))
    retrain = F.coalesce(F.col("psi") > serious, F.lit(False)) | (off > 2 * tolerance) | late | F.col("ph_drift") | F.col("adwin_drift") | moved
    return all_.select("feature", "psi", "mae", "coverage", "ph_drift", "adwin_drift", alerts.alias("alerts"), retrain.alias("retrain"))


def due(report: DataFrame, panel: DataFrame, series: Column) -> DataFrame:
    """The panel's rows of the series that ``evaluate`` wants fitted again; ``series`` names a report row's series."""
    return panel.join(report.where("retrain").select(series.alias("series_id")).distinct(), "series_id", "left_semi")
