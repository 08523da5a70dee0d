"""Alarms, filling, run stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.operators import local_level, prepare, quality
from foresift.sources import store


def first_alarm(x, delta=0.002):
    for n in range(4, len(x) + 1):
        for cut in range(2, n - 1):
            if abs(np.mean(x[:cut]) - np.mean(x[cut:n])) >= np.sqrt((1 / (2 * cut) + 1 / (2 * (n - cut))) * np.log(4 * n / delta)):
                return n - 1, cut
    return None


def shifted():
    rng = np.random.default_rng(2)
    return {"calm": rng.normal(1, 0.2, 60), "step": np.r_[rng.normal(1, 0.2, 40), rng.normal(4, 0.2, 20)], "loud": rng.normal(0, 5, 50), "short": np.array([0.0, 9.0, 0.0])}


def test_adwin_first_alarm(spark):
    series = shifted()
    rows = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)], "key string, t long, x double")
    found = {r["key"]: (r["t"], r["cut"]) for r in quality.adwin_first_alarm(rows).collect()}
    want = {k: first_alarm(x) for k, x in series.items()}
    assert found == {k: v for k, v in want.items() if v} and "step" in found and "calm" not in found


def test_evaluate(spark):
    rng = np.random.default_rng(0)
    ref = [(k, t, float(v), True) for k in ("good", "bad") for t, v in enumerate(rng.normal(0, 1, 400))]
    cur = [("good", t, v, t % 10 > 0) for _, t, v, _ in ref[:400]] + [("bad", t, float(v), False) for t, v in enumerate(rng.normal(30, 1, 400))]
    a, b = (spark.createDataFrame(x, "feature string, t long, x double, inside boolean") for x in (ref, cur))
    moved = spark.createDataFrame([("good", "price", 0.5), ("bad", "price", 0.001)], "feature string, name string, p double")
    found = {r["feature"]: r for r in quality.evaluate(a, b, 0.9, most_mae=5.0, covariates=moved).collect()}
    assert found["bad"]["retrain"] and set(found["bad"]["alerts"]) >= {"psi", "coverage", "mae", "covariates"}
    assert not set(found["good"]["alerts"]) & {"psi", "psi_warn", "coverage", "mae", "covariates"}
    assert found["good"]["coverage"] == pytest.approx(0.9) and found["good"]["psi"] == pytest.approx(0)


def panel(spark, series):
    rows = [(k, t, None if v is None else float(v)) for k, x in series.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, t long, y double").withColumn("ds", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("t").cast("int"))).select("series_id", "ds", "t", "y")


def test_fill_kalman(spark):
    walk = list(np.cumsum(np.random.default_rng(4).normal(0, 1, 80)))
    series = {"walk": [None if t in (10, 11, 50) else v for t, v in enumerate(walk)], "flat": [5, None, 5, 5], "none": [None, None], "one": [None, 3, None], "full": [1, 2, 3]}
    found = {}
    for r in prepare.fill_kalman(panel(spark, series)).orderBy("t").collect():
        found.setdefault(r["series_id"], []).append(r["y"])
    assert found["flat"] == pytest.approx([5] * 4) and found["full"] == [1, 2, 3] and found["one"] == [3, 3, 3] and found["none"] == [None, None]
    assert all(found["walk"][t] == walk[t] for t in range(80) if t not in (10, 11, 50))
    low, high = sorted((walk[9], walk[12]))
    assert low - 1 <= found["walk"][10] <= high + 1 and abs(found["walk"][50] - (walk[49] + walk[51]) / 2) < 0.5


@pytest.mark.parametrize("block", [local_level.BLOCK, 3])
def test_local_level_is_the_posterior_mean(spark, block):
    """Against the dense normal equations of the walk, for one ratio."""
    y, q = np.array([1.0, np.nan, 4.0, 2.0, np.nan, np.nan, 7.0]), 0.7
    known = ~np.isnan(y)
    d = np.diff(np.eye(len(y)), axis=0)
    want = np.linalg.solve(np.diag(known.astype(float)) + d.T @ d / q, np.where(known, y, 0))
    rows = panel(spark, {"a": [None if np.isnan(v) else v for v in y]})
    got = {r["t"]: r["level"] for r in local_level.smoothed(rows, (q,), block).collect()}
    assert got == pytest.approx({t: want[t] for t in (1, 4, 5)}, abs=1e-5)


def filtered(y, ratios):
    """The filter and the smoother value by value."""
    known, best = ~np.isnan(y), None
    for q in ratios:
        level, var, a, p, deviance, scale = [], [], y[known][0], 1e7, 0.0, 0.0
        for v, k in zip(y, known, strict=True):
            if k:
                if p < 1e6:
                    deviance, scale = deviance + np.log(p + 1), scale + (v - a) ** 2 / (p + 1)
                a, p = a + p / (p + 1) * (v - a), p / (p + 1)
            level.append(a)
            var.append(p)
            p += q
        n = known.sum()
        deviance += (n - 1) * np.log(max(scale / (n - 1), 1e-300))
        if best is None or deviance < best[0]:
            best = deviance, q, level, var
    _, q, level, var = best
    for t in range(len(y) - 2, -1, -1):
        level[t] += var[t] / (var[t] + q) * (level[t + 1] - level[t])
    return np.array(level)


@pytest.mark.parametrize("block", [local_level.BLOCK, 13, 64])
def test_local_level_by_blocks(spark, block):
    rng, ratios = np.random.default_rng(6), (0.01, 0.1, 1.0, 10.0)
    series = {f"s{k}": np.cumsum(rng.normal(0, walk, 150)) + rng.normal(0, noise, 150) for k, (walk, noise) in enumerate(((1, 0.2), (0.1, 1), (0, 1), (1, 1)))}
    for y in series.values():
        y[rng.random(150) < 0.3] = np.nan
        y[20:40] = np.nan
    series["s0"][:15] = np.nan
    series["s1"][-15:] = np.nan
    rows = panel(spark, {k: [None if np.isnan(v) else v for v in y] for k, y in series.items()})
    got = {(r["series_id"], r["t"]): r["level"] for r in local_level.smoothed(rows, ratios, block).collect()}
    want = {(k, t): v for k, y in series.items() for t, v in enumerate(filtered(y, ratios)) if np.isnan(y[t])}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("fill", sorted(prepare.FILLS))
@pytest.mark.parametrize("outliers", sorted(prepare.OUTLIERS))
def test_preprocess(spark, fill, outliers):
    values = [10 + t % 6 + (t * 7 % 5) / 10 for t in range(60)]
    values[20], values[33] = 500, None
    clean, report = prepare.preprocess(panel(spark, {"a": values}), 6, fill, outliers)
    assert clean.count() == 60 and clean.where("y IS NULL").count() == 0
    row = report.first()
    assert row["n_missing"] == 1 and (row["n_outliers"] > 0) == (outliers != "none")
    with pytest.raises(ValueError):
        prepare.preprocess(panel(spark, {"a": values}), 6, "best", outliers)


def test_store_resumes(spark, tmp_path):
    path, calls = (tmp_path / "runs").as_uri(), []

    def model(name):
        def make():
            calls.append(name)
            return spark.range(3).select(F.col("id").alias("h"), F.lit(1.0).alias("y_pred"))

        return make

    models = {m: model(m) for m in ("a", "b")}
    run = store.run_id({"x": 1, "y": [2]})
    assert run == store.run_id({"y": [2], "x": 1}) != store.run_id({"x": 2})
    assert store.resume(spark, path, run, {"a": models["a"]})[1] == ["a"]
    rows, due = store.resume(spark, path, run, models)
    assert due == ["b"] and calls == ["a", "b"] and rows.count() == 6
    assert store.resume(spark, path, run, models)[1] == []
    rows, due = store.resume(spark, path, run, models, only=("b",))
    assert due == ["b"] and rows.count() == 6
    assert store.resume(spark, path, "other", models, fresh=True)[1] == ["a", "b"]
    assert spark.read.parquet(path).count() == 12


def test_snapshots_and_catalogue(spark, tmp_path):
    path = (tmp_path / "metrics").as_uri()
    assert store.catalogue(spark, path).count() == 0
    metrics = spark.createDataFrame([("m", 1.0)], "model string, mae double")
    run, wrote = store.snapshot(metrics, path, {"h": 1})
    assert wrote and store.snapshot(metrics, path, {"h": 1}) == (run, False)
    store.snapshot(metrics, path, {"h": 2})
    assert {r["run_id"]: r["n_rows"] for r in store.catalogue(spark, path).collect()} == {run: 1, store.run_id({"h": 2}): 1}


@pytest.mark.parametrize("fails", [False, True])
def test_alert_sink(spark, tmp_path, fails):
    spark.createDataFrame([("a", "psi")], "feature string, alert string").write.parquet(str(tmp_path / "in"))
    told = []

    def deliver(rows):
        told.extend(rows)
        if fails:
            raise OSError("unreachable")

    stream = spark.readStream.schema("feature string, alert string").parquet(str(tmp_path / "in"))
    store.alert_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck"), deliver).trigger(availableNow=True).start().awaitTermination(60)
    assert told == [{"feature": "a", "alert": "psi"}]
    assert [r["delivered"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [not fails]


def test_alerts_beyond_one_call(spark, tmp_path):
    """2,500 alerts of one batch, of which the second call fails: the others are delivered, and each row says so."""
    spark.range(2500).select(F.col("id").cast("string").alias("feature")).coalesce(1).write.parquet(str(tmp_path / "in"))
    told, calls = [], []

    def deliver(rows):
        calls.append(len(rows))
        if len(calls) == 2:
            raise OSError("unreachable")
        told.extend(r["feature"] for r in rows)

    stream = spark.readStream.schema("feature string").parquet(str(tmp_path / "in"))
    store.alert_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck"), deliver).trigger(availableNow=True).start().awaitTermination(60)
    kept = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(kept) == 2500 and len(calls) == 3 and max(calls) <= 1000
    assert {r["feature"] for r in kept if r["delivered"]} == set(told) and len(told) == 2500 - calls[1]
