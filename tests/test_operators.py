"""Hand fixtures and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.operators import folds, forecasters, hierarchy, prepare, quality
from foresift.operators.folds import Protocol


def panel(spark, values, name="a"):
    return spark.createDataFrame([(name, t, None if v is None else float(v)) for t, v in enumerate(values)], "series_id string, t long, y double")


@pytest.mark.parametrize(("least", "ends"), [(30, [30, 50, 70, 90]), (45, [45, 65, 85])])
def test_splits(spark, least, ends):
    found = folds.splits(panel(spark, range(100)), Protocol(1, 10, 4, 20, least))
    assert sorted(r["te"] for r in found.collect()) == ends


def test_seasonal_naive(spark):
    end = spark.createDataFrame([("a", 0, 6)], "series_id string, fold long, te long")
    found = forecasters.base_forecasts(panel(spark, [1, 2, 3, 1, 2, 3]), Protocol(3, 4, 1, 1, 3), folds=end).where("model = 'seasonal_naive'").orderBy("h").collect()
    assert [r["y_pred"] for r in found] == [1, 2, 3, 1] and all(r["lo"] == r["hi"] for r in found)


def test_intermittent(spark):
    at = spark.createDataFrame([("a", 0, 0, 5)], "series_id string, fold long, tr_lo long, te long")
    found = {r["model"]: r["y_pred"] for r in forecasters.intermittent(panel(spark, [0, 2, 0, 0, 4]), at, 0.5).collect()}
    assert found["croston"] == pytest.approx(1.2) and found["croston_sba"] == pytest.approx(0.9)
    at = spark.createDataFrame([("a", 0, 0, 4)], "series_id string, fold long, tr_lo long, te long")
    found = {r["model"]: r["y_pred"] for r in forecasters.intermittent(panel(spark, [0, 2, 0, 4]), at, 0.5).collect()}
    assert found["tsb"] == pytest.approx(2.25)
    at = spark.createDataFrame([("a", 0, 0, 3)], "series_id string, fold long, tr_lo long, te long")
    found = {r["model"]: r["y_pred"] for r in forecasters.intermittent(panel(spark, [1, 2, 3]), at, 0.5, agg=2, alpha_agg=0.5).collect()}
    assert found["adida"] == pytest.approx(1.5)


def test_fill_seasonal(spark):
    found = prepare.fill_seasonal(panel(spark, [1, 2, None, 4, None]), 2).orderBy("t").collect()
    assert [r["y"] for r in found] == [1, 2, 1, 4, 1]


def test_no_leakage(spark):
    """Values after a fold's end do not change its forecasts, whatever the partitioning."""
    p = Protocol(4, 4, 2, 4, 12)
    values = [(t * 7) % 11 for t in range(40)]
    before = forecasters.base_forecasts(panel(spark, values), p).where("fold = 0")
    after = forecasters.base_forecasts(panel(spark, values[:32] + [99] * 8).repartition(7), p).where("fold = 0")
    key = lambda df: sorted((r["model"], r["h"], r["y_pred"], r["lo"]) for r in df.collect())
    assert key(before) == key(after)


def test_tree_reconcile_equals_dense_projection(spark):
    nodes = [("T", None, 0), ("A", "T", 1), ("B", "T", 1), ("a1", "A", 2), ("a2", "A", 2), ("b1", "B", 2), ("b2", "B", 2), ("b3", "B", 2)]
    y = [10.0, 3.0, 4.0, 1.0, 2.5, 2.0, 0.5, 4.0]
    s = np.array([[1] * 5, [1, 1, 0, 0, 0], [0, 0, 1, 1, 1], *np.eye(5)])
    base = spark.createDataFrame([(n, p, k, 0, v) for (n, p, k), v in zip(nodes, y, strict=True)], "node string, parent string, level long, ds long, y_pred double")
    for variance, w in ((F.lit(1.0), np.ones(8)), (F.element_at(F.map_from_arrays(F.array(*[F.lit(n[0]) for n in nodes]), F.array(*[F.lit(float(x)) for x in s.sum(axis=1)])), F.col("node")), s.sum(axis=1))):
        want = s @ np.linalg.solve(s.T @ np.diag(1 / w) @ s, s.T @ (np.array(y) / w))
        found = {r["node"]: r["y"] for r in hierarchy.tree_reconcile(base, variance, 2).collect()}
        assert [found[n[0]] for n in nodes] == pytest.approx(want.tolist())


def test_rolling_folds_read_their_window_only(spark):
    """What happened before a rolling window changes no forecast and no band."""
    p = Protocol(2, 2, 3, 2, 12, "rolling")
    rows = [("a", t, float(t % 5 + t * t % 3)) for t in range(24)]
    before = [("a", t, y + (1000.0 * (t % 3) if t < 6 else 0.0)) for _, t, y in rows]
    one, two = (spark.createDataFrame(x, "series_id string, t long, y double") for x in (rows, before))
    assert min(r["tr_lo"] for r in folds.splits(one, p).collect()) >= 6
    key = ("model", "series_id", "fold", "h")
    for model in (forecasters.base_forecasts, forecasters.seasonal_ar1):
        a, b = (sorted(([str(r[k]) for k in key if k in r], [r[c] for c in ("y_pred", "lo", "hi") if c in r]) for r in (r.asDict() for r in model(x, p).collect())) for x in (one, two))
        assert a == b


def test_drift_passes_over_nulls(spark):
    ref = [("f", float(k)) for k in range(100)]
    cur = ref + [("f", None)] * 50 + [("f", float("nan"))] * 10
    a, b = (spark.createDataFrame(x, "feature string, x double") for x in (ref, cur))
    found = quality.drift_report(a, b).first()
    assert (round(found["psi"], 9), found["ks"], found["p"], found["status"]) == (0, 0, 1, "ok")


def test_schema_rules(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    found = {(r["column"], r["rule"]): r["n_bad"] for r in quality.violations(rows, {"a": {"dtype": "int", "min": 2}, "b": {"dtype": "string", "nonnull": False}}).collect()}
    assert found == {("a", "dtype"): 1, ("a", "min"): 1, ("b", "dtype"): 0}
    with pytest.raises(ValueError, match="minimum"):
        quality.violations(rows, {"a": {"minimum": 1}})
