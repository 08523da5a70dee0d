"""Forecasters that follow a stream, against the batch operator at every row, over a restart; keys that leave."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.operators import intermittent
from foresift.streaming import forecasters

SCHEMA = "series_id string, ds timestamp, t long, y double"
DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def files(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    forecasters.keep_state_in_files(spark)
    yield
    spark.conf.set(name, before)


def streamed(spark, tmp_path, parts, **how):
    """The rows of a stream that reads one part in each run."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = forecasters.follow(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), **how)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(200)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_equal_to_the_batch_operator_over_restarts(spark, tmp_path, files):
    rng = np.random.default_rng(6)
    series = {f"s{k}": np.where(rng.random(60) < share, rng.integers(1, 9, 60), 0).astype(float) for k, share in enumerate((0.08, 0.4, 0.95))}
    series |= {"none": np.zeros(60), "late": np.r_[np.zeros(50), 4.0, np.zeros(9)], "first": np.r_[3.0, np.zeros(59)]}
    rows = [(k, START + t * DAY, t, None if v == 0 and t % 5 == 0 else float(v)) for k, y in series.items() for t, v in enumerate(y)]
    cut = [0, 1, 23, 24, 60]
    got = streamed(spark, tmp_path, [[r for r in rows if a <= r[2] < b] for a, b in zip(cut, cut[1:], strict=False)], season=7)
    assert len(got) == len(rows)
    panel = spark.createDataFrame([(k, t, y) for k, _, t, y in rows], "series_id string, t long, y double")
    folds = panel.where("t > 0").select("series_id", F.col("t").alias("fold"), F.lit(0).cast("long").alias("tr_lo"), F.col("t").alias("te"))
    want = {(r["series_id"], r["te"]): r for r in intermittent.smoothed(panel, folds).collect()}
    known = {(k, t): y for k, _, t, y in rows}
    for r in got:
        k, t = r["series_id"], r["t"]
        for m in ("croston", "croston_sba", "tsb"):
            assert r[m] == pytest.approx(want[k, t][m] if t else 0.0, abs=1e-9), (k, t, m)
        past = [known[k, u] for u in range(t - 7, -1, -7) if known[k, u] is not None]
        assert r["seasonal_naive"] == (past[0] if past else None), (k, t)


def test_rows_that_repeat_or_come_late(spark, tmp_path, files):
    at = lambda t: START + t * DAY
    first = [("a", at(0), 0, 2.0), ("a", at(1), 1, 4.0), ("a", at(1), 1, 9.0), ("a", at(1), None, 7.0)]
    got = streamed(spark, tmp_path, [first, [("a", at(2), 1, 8.0), ("a", at(3), 3, None), (None, at(3), 0, 1.0)]], alpha=0.5, season=1)
    found = {(r["series_id"], r["t"], r["y"]): (r["croston"], r["seasonal_naive"]) for r in got}
    none = (None, None)
    assert found == {("a", 0, 2.0): (0.0, None), ("a", 1, 4.0): (2.0, 2.0), ("a", 1, 9.0): none, ("a", None, 7.0): none, ("a", 1, 8.0): none, ("a", 3, None): (3.0, 4.0), (None, 0, 1.0): (0.0, None)}


def test_idle_keys_leave(spark, tmp_path, files):
    at = lambda t: START + t * DAY
    parts = [[("gone", at(0), 0, 5.0), ("kept", at(0), 0, 5.0)], [("kept", at(9), 9, 1.0)], [("kept", at(12), 12, 1.0)], [("gone", at(13), 13, 2.0), ("kept", at(13), 13, 2.0)]]
    got = streamed(spark, tmp_path, parts, season=1, idle_ms=10 * 86_400_000)
    last = {r["series_id"]: r for r in got if r["t"] == 13}
    assert last["gone"]["croston"] == 0 and last["gone"]["seasonal_naive"] is None
    assert last["kept"]["croston"] > 0 and last["kept"]["seasonal_naive"] == 1.0
    left = spark.read.format("statestore").option("stateVarName", "level").load(str(tmp_path / "ck")).count()
    assert left == 2
