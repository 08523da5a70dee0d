"""Quantile trees: equal reruns, no look ahead, accuracy, and the counts behind them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.operators import forecasters, quantile_trees
from foresift.operators.folds import HOURLY, Protocol
from foresift.sources import panels

SCHEMA = "series_id string, t long, y double"
P = Protocol(6, 6, 3, 6, 60)


def table(spark, change=0.0):
    rng, rows = np.random.default_rng(1), []
    for k in range(3):
        y = 20 + 5 * k + 4 * np.sin(np.arange(120) * np.pi / 3) + rng.gamma(2, 1 + k, 120)
        rows += [(f"s{k}", t, float(v) + (change if t >= 120 - 6 - 2 * 6 else 0)) for t, v in enumerate(y)]
    return spark.createDataFrame(rows, SCHEMA)


def made(panel):
    return {(r["series_id"], r["fold"], r["h"]): tuple(r["quantiles"]) for r in quantile_trees.forecast(panel, P, trees=4).collect()}


def test_reruns_and_look_ahead(spark):
    one = made(table(spark))
    assert len(one) == 3 * 3 * 6 and all(list(q) == sorted(q) for q in one.values())
    assert made(table(spark).repartition(7, "t")) == one  # the same to the last bit, whatever the partitions
    other = made(table(spark, change=50.0))  # all values from the first fold's end on
    assert all(other[k] == one[k] for k in one if k[1] == 0) and any(other[k] != one[k] for k in one if k[1] == 2)


def test_nulls_and_few_rows(spark):
    short = spark.createDataFrame([("x", t, 1.0) for t in range(10)] + [("y", t, None if t % 3 else float(t % 6)) for t in range(90)], SCHEMA)
    got = made(short)
    assert {k[0] for k in got} == {"y"} and all(np.isfinite(q).all() for q in got.values())
    assert made(spark.createDataFrame([], SCHEMA)) == {}


def test_quantiles_of_counts():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1.2, 5000)
    counts = np.bincount(quantile_trees.cell(x), minlength=quantile_trees.CELLS)[None]
    for level in (0.05, 0.5, 0.95):
        assert quantile_trees.quantiles(counts, level)[0] == pytest.approx(np.quantile(x, level), abs=0.03)
        off = x - 0.4
        assert quantile_trees.pinball(counts, np.array([0.4]), level)[0] == pytest.approx(np.maximum(level * off, (level - 1) * off).sum(), rel=0.01)
    assert quantile_trees.quantiles(np.zeros((1, quantile_trees.CELLS), int), 0.5)[0] == 0


def test_against_profile(spark):
    """On the hourly panel: less error than the trend profile, and bands that hold within three points of 90 %."""
    panel = panels.filled_hourly(spark, "/root/testdata/sf0.01").cache()
    base = forecasters.backtest(panel, HOURLY).where("model = 'trend_profile'").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0]
    rows = quantile_trees.forecast(panel, HOURLY).join(panel.select("series_id", "t", "y"), ["series_id", "t"])
    q = F.col("quantiles")
    mae, inside = rows.agg(F.avg(F.abs(F.col("y") - q[1])), F.avg(F.col("y").between(q[0], q[2]).cast("double"))).first()
    assert mae < base and abs(inside - 0.9) < 0.03


def test_importance(spark):
    """Deviations that carry over from season to season: the last season's value counts most, and is chosen first."""
    rng, rows = np.random.default_rng(3), []
    for k in range(4):
        off = rng.normal(size=240)
        for t in range(6, 240):
            off[t] = 0.95 * off[t - 6] + 0.3 * off[t]
        rows += [(f"s{k}", t, float(50 + 3 * np.sin(t * np.pi / 3) + 4 * off[t])) for t in range(240)]
    p = Protocol(6, 6, 4, 6, 60)
    found = quantile_trees.importance(spark.createDataFrame(rows, SCHEMA), p, most=2, block=64).orderBy(F.desc("share")).collect()
    assert len(found) == 8 and found[0]["feature"] == "f0" and found[0]["share"] == 1.0 and found[0]["loss"] > 0
    assert found[0]["chosen"] and sum(r["chosen"] for r in found) <= 2 and all(not r["chosen"] for r in found if r["share"] < 0.05)
