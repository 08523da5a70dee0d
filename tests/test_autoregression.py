"""Seasonal autoregressions against NumPy."""

import numpy as np
import pytest

from foresift.operators import autoregression
from foresift.operators.folds import Protocol

SCHEMA = "series_id string, t long, y double"


def fitted(y, p, te, most):
    """Order by AIC over Yule-Walker systems solved whole, forecasts and deviations by simulation of unit shocks."""
    train = y[(te - p.min_train if p.mode == "rolling" else 0) : te]
    d = train[p.season :] - train[: -p.season]
    x, n = d - d.mean(), len(d)
    c = np.array([x[k:] @ x[: n - k] / n for k in range(most + 1)])
    best = (n * np.log(c[0]), np.zeros(0), c[0]) if c[0] > 0 else (0, np.zeros(0), 0.0)
    for k in range(1, most + 1 if c[0] > 0 else 1):
        phi = np.linalg.solve(np.array([[c[abs(i - j)] for j in range(k)] for i in range(k)]), c[1 : k + 1])
        v = c[0] - phi @ c[1 : k + 1]
        if n * np.log(v) + 2 * k < best[0]:
            best = n * np.log(v) + 2 * k, phi, v
    _, phi, v = best

    def go(values, offs, shocks):
        values, offs = list(values), list(offs)
        for e in shocks:
            offs.append(sum(f * offs[-1 - i] for i, f in enumerate(phi)) + e)
            values.append(values[-p.season] + d_mean + offs[-1])
        return np.array(values[-p.horizon :])

    d_mean = d.mean()
    mean = go(train, x, np.zeros(p.horizon))
    d_mean = 0.0
    shock = go(np.zeros(p.season), np.zeros(most), [1.0, *np.zeros(p.horizon - 1)])
    return mean, np.sqrt(v * np.cumsum(shock**2)), len(phi)


@pytest.mark.parametrize("mode", ["expanding", "rolling"])
def test_seasonal_ar(spark, mode):
    p, rng, series = Protocol(4, 10, 3, 5, 60, mode), np.random.default_rng(1), {}
    for name, phi in (("white", []), ("one", [0.8]), ("three", [0.5, -0.4, 0.3])):
        x = rng.normal(size=120)
        for t in range(120):
            x[t] += sum(f * x[t - 1 - i] for i, f in enumerate(phi) if t > i)
        series[name] = 50 + 10 * np.sin(np.arange(120) * np.pi / 2) + np.cumsum(0.1 * np.ones(120)) + x
    series["flat"] = np.full(100, 3.0)
    rows = [(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y)]
    got = {(r["series_id"], r["fold"], r["h"]): r for r in autoregression.seasonal_ar(spark.createDataFrame(rows, SCHEMA), p, 5).collect()}
    assert len(got) == 4 * 3 * 10
    orders = set()
    for k, y in series.items():
        for fold in range(3):
            te = len(y) - 10 - (2 - fold) * 5
            mean, dev, order = fitted(y, p, te, 5)
            orders.add(order)
            for h in range(1, 11):
                r = got[k, fold, h]
                assert r["order"] == order and r["t"] == te + h - 1
                assert r["y_pred"] == pytest.approx(mean[h - 1], abs=1e-8)
                assert r["hi"] - r["y_pred"] == pytest.approx(1.6448536269514715 * dev[h - 1], abs=1e-6)
    assert len(orders) > 1
    assert autoregression.seasonal_ar(spark.createDataFrame([], SCHEMA), p).count() == 0
