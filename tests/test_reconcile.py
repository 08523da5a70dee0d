"""Reconciliation, adaptive wrappers and stacking against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.operators import adaptive, hierarchy, reconcile
from foresift.operators.folds import Protocol

NODES = ["TOTAL", "g=a", "g=b", "g=a/k=1", "g=a/k=2", "g=b/k=1"]
S = np.array([[1, 1, 1], [1, 1, 0], [0, 0, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)


@pytest.fixture(scope="module")
def tree(spark):
    return hierarchy.ancestors(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "g string, k string"), ["g", "k"])


def long(spark, values, column):
    return spark.createDataFrame([(n, t, float(values[t, k])) for t in range(len(values)) for k, n in enumerate(NODES)], f"node string, ds long, {column} double")


def dense(found, h):
    at = {(r["node"], r["ds"]): r["y"] for r in found.collect()}
    return np.array([[at[n, t] for n in NODES] for t in range(h)])


def shrunk(errors):
    """From the definition, pair by pair: w_ij = (1 - k) s_ij off the diagonal, with k the summed estimation variance of all s_ij over the summed squares off the diagonal."""
    rows, nodes = errors.shape
    mean = [sum(errors[t, i] for t in range(rows)) / rows for i in range(nodes)]
    pairs = {}
    for i in range(nodes):
        for j in range(nodes):
            products = [(errors[t, i] - mean[i]) * (errors[t, j] - mean[j]) for t in range(rows)]
            s = sum(products) / (rows - 1)
            pairs[i, j] = s, sum(x * x for x in products) / rows - s * s
    k = sum(v for _, v in pairs.values()) / sum(s * s for (i, j), (s, _) in pairs.items() if i != j)
    k = min(max(k, 0.0), 1.0)
    return np.array([[pairs[i, j][0] * (1 if i == j else 1 - k) for j in range(nodes)] for i in range(nodes)])


def test_shrinkage_by_hand(spark):
    """Three rows of two nodes: (1, 2), (-1, 0), (0, -2). s = [[1, 1], [1, 4]]; mean squared products 2/3, 4/3, 4/3, 32/3 less s^2 sum to -5: no shrinkage is left. Doubled rows keep the sign, so k = 0."""
    e = spark.createDataFrame([("a", 0, 1.0), ("a", 1, -1.0), ("a", 2, 0.0), ("b", 0, 2.0), ("b", 1, 0.0), ("b", 2, -2.0)], "node string, ds long, e double")
    assert {(r["i"], r["j"]): r["w"] for r in reconcile.shrunk_covariance(e).collect()} == pytest.approx({("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 4})


@pytest.mark.parametrize("method", reconcile.METHODS)
def test_methods(spark, tree, method):
    rng = np.random.default_rng(3)
    y, history, e = rng.normal(10, 3, (4, 6)), rng.uniform(1, 5, (20, 3)) @ S.T, rng.normal(0, 1, (40, 6)) @ rng.normal(0, 1, (6, 6))
    w = {"ols": np.eye(6), "wls": np.diag(S.sum(1)), "ridge": np.eye(6), "mint_shrink": shrunk(e)}.get(method)
    if method == "bu":
        want = y[:, 3:] @ S.T
    elif method == "td":
        p = history[:, 3:].sum(0)
        want = np.outer(y[:, 0], S @ (p / p.sum()))
    else:
        i = np.linalg.inv(w)
        want = y @ (S @ np.linalg.solve(S.T @ i @ S + (0.5 * np.eye(3) if method == "ridge" else 0), S.T @ i)).T
    found = reconcile.reconcile(method, long(spark, y, "y_pred"), tree, long(spark, history, "y"), long(spark, e, "e"), 0.5)
    assert dense(found, 4) == pytest.approx(want)
    assert found.count() == 24


def test_shrunk_covariance(spark):
    e = np.random.default_rng(1).normal(0, 1, (12, 6)) @ np.random.default_rng(2).normal(0, 1, (6, 6))
    found = {(r["i"], r["j"]): r["w"] for r in reconcile.shrunk_covariance(long(spark, e, "e")).collect()}
    assert np.array([[found[a, b] for b in NODES] for a in NODES]) == pytest.approx(shrunk(e))


def test_arguments(spark, tree):
    base = long(spark, np.ones((1, 6)), "y_pred")
    for method, message in (("td", "history"), ("mint_shrink", "residuals"), ("best", "unknown")):
        with pytest.raises(ValueError, match=message):
            reconcile.reconcile(method, base, tree)


def test_permuted_paths_add_up(spark, tree):
    rows = [(n, h, s, float(100 * k + 10 * s + h)) for k, n in enumerate(NODES[3:]) for h in range(3) for s in range(5)]
    found = reconcile.permuted_bottom_up(spark.createDataFrame(rows, "bottom string, h long, sample long, y double"), tree)
    at = {(r["node"], r["h"], r["sample"]): r["y"] for r in found.collect()}
    assert len(at) == 6 * 3 * 5
    for h in range(3):
        for s in range(5):
            assert [at[n, h, s] for n in NODES[:3]] == pytest.approx(S[:3] @ [at[n, h, s] for n in NODES[3:]])
            assert all(at[n, h, s] - at[n, 0, s] == h for n in NODES[3:])
    assert sorted(at[NODES[3], 0, s] for s in range(5)) == [0, 10, 20, 30, 40]
    again = reconcile.permuted_bottom_up(spark.createDataFrame(rows[::-1], "bottom string, h long, sample long, y double").repartition(3), tree)
    assert {(r["node"], r["h"], r["sample"]): r["y"] for r in again.collect()} == pytest.approx(at)


def forecasts(spark, folds=3, horizon=12):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(folds):
        for h in range(1, horizon + 1):
            y = rng.normal(20, 5)
            for m, noise in (("a", 2.0), ("b", 4.0)):
                p = y + rng.normal(0, noise)
                rows.append((m, "s", f, h, y, p, p - 1, p + 1))
    return rows, spark.createDataFrame(rows, "model string, series_id string, fold long, h long, y_true double, y_pred double, lo double, hi double").repartition(3)


def test_adaptive_intervals(spark):
    rows, fc = forecasts(spark)
    found = {(r["model"], r["fold"], r["h"]): (r["alpha_t"], r["lo"], r["hi"]) for r in adaptive.aci(fc, 0.1, 0.05).collect()}
    assert len(found) == 2 * 2 * 12
    for m in "ab":
        for f in (1, 2):
            e = [abs(r[4] - r[5]) for r in rows if r[0] == m and r[2] == f - 1]
            a = 0.1
            for h, p in enumerate((r[5] for r in rows if r[0] == m and r[2] == f), 1):
                a += 0.05 * (0.1 - float(e[h - 1] > np.quantile(e, 1 - np.clip(a, 1e-3, 0.9))))
                used = np.clip(a, 1e-3, 0.5)
                r = np.quantile(e, 1 - used)
                assert found[m, f, h] == pytest.approx((used, p - r, p + r))


def test_stacking(spark):
    rows, fc = forecasts(spark)
    found = {(r["fold"], r["h"]): r for r in adaptive.stack(fc, "a", "b", 1.0).collect()}
    assert {f for f, _ in found} == {1, 2}
    for f in (1, 2):
        pick = lambda m, c, past: np.array([r[c] for r in rows if r[0] == m and (r[2] < f if past else r[2] == f)])  # noqa: B023, E731
        x, y = np.column_stack([pick("a", 5, True), pick("b", 5, True)]), pick("a", 4, True)
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
        want = y.mean() + (np.column_stack([pick("a", 5, False), pick("b", 5, False)]) - x.mean(0)) @ w
        assert [found[f, h]["y_pred"] for h in range(1, 13)] == pytest.approx(want.tolist())
    assert all(r["lo"] <= r["y_pred"] <= r["hi"] for r in found.values())


def test_bootstrap_ensemble(spark):
    """Of a series that repeats exactly, every bootstrap is exact; the same rows give the same result in any partitioning."""
    p = Protocol(4, 4, 2, 4, 40)
    rows = [("a", t, float(t % 4)) for t in range(60)] + [("b", t, float((t * 7) % 11)) for t in range(60)]
    panel = spark.createDataFrame(rows, "series_id string, t long, y double")
    found = adaptive.enbpi(panel, p, copies=5, block=8, tail=8).orderBy("series_id", "fold", "h").collect()
    assert len(found) == 2 * 2 * 4
    assert all(r["y_pred"] == r["t"] % 4 and r["lo"] == r["hi"] for r in found if r["series_id"] == "a")
    again = adaptive.enbpi(panel.repartition(5, "t"), p, copies=5, block=8, tail=8).orderBy("series_id", "fold", "h").collect()
    assert [tuple(r)[:4] for r in found] == [tuple(r)[:4] for r in again]
    assert np.array([tuple(r)[4:] for r in found]) == pytest.approx(np.array([tuple(r)[4:] for r in again]))
    assert adaptive.enbpi(panel.where(F.lit(False)), p).count() == 0
