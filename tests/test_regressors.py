"""Forecasters that fit a regression, against NumPy and against their own past."""

import numpy as np
import pytest

from foresift.operators import regressors
from foresift.operators.folds import Protocol

SEASON = 6


def series(n=120, names=("a", "b")):
    rng = np.random.default_rng(5)
    return [(s, t, 10.0 * (k + 1) + 0.1 * t + 5 * np.sin(2 * np.pi * t / SEASON) + float(rng.normal(0, 0.3))) for k, s in enumerate(names) for t in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(s, t, None if y is None else float(y)) for s, t, y in rows], "series_id string, t long, y double")


@pytest.mark.parametrize("mode", ["expanding", "rolling"])
def test_trend_fourier(spark, mode):
    p = Protocol(SEASON, 6, 3, 6, 48, mode)
    rows = [(s, t, None if t % 17 == 3 else y) for s, t, y in series()]
    found = regressors.trend_fourier(frame(spark, rows), p, pairs=2).collect()
    assert len(found) == 2 * 3 * 6
    terms = lambda t: [1.0, t / 48, *[f(2 * np.pi * k * t / SEASON) for k in (1, 2) for f in (np.sin, np.cos)]]
    for r in found:
        low = r["te"] - 48 if mode == "rolling" else 0
        train = [(t, y) for s, t, y in rows if s == r["series_id"] and low <= t < r["te"] and y is not None]
        x, y = np.array([terms(t) for t, _ in train]), np.array([y for _, y in train])
        coef, *_ = np.linalg.lstsq(x, y, rcond=None)
        sd = np.sqrt(((y - x @ coef) ** 2).sum() / (len(y) - x.shape[1]))
        want = float(np.dot(terms(r["t"]), coef))
        assert (r["y_pred"], r["lo"], r["hi"]) == pytest.approx((want, want - 1.6448536 * sd, want + 1.6448536 * sd), abs=1e-6)


def test_trend_fourier_without_values(spark):
    p = Protocol(SEASON, 6, 1, 6, 12)
    found = regressors.trend_fourier(frame(spark, [("a", t, None) for t in range(30)] + [("b", t, 2.0 if t < 3 else None) for t in range(30)]), p, pairs=2).collect()
    assert all(r["lo"] is None for r in found) and all((r["y_pred"] is None) == (r["series_id"] == "a") for r in found) and len(found) == 12


def test_gbt_direct(spark):
    p, rows = Protocol(SEASON, 6, 3, 6, 90), series()
    found = regressors.gbt_direct(frame(spark, rows), p, held=3).collect()
    assert len(found) == 2 * 3 * 6
    actual = {(s, t): y for s, t, y in rows}
    assert np.mean([abs(r["y_pred"] - actual[r["series_id"], r["t"]]) for r in found]) < 1.2  # the season's swing is 5
    assert all(r["lo"] <= r["y_pred"] <= r["hi"] for r in found)


def test_gbt_learns_from_the_past_only(spark):
    """Values from the first fold on change no row to learn from, and no input of the first fold."""
    p, first = Protocol(SEASON, 6, 3, 6, 90), 120 - 6 - 2 * 6
    one, two = (frame(spark, [(s, t, y + 100 * (t >= first and late)) for s, t, y in series()]) for late in (False, True))
    at = regressors.splits(one, p)
    past = [sorted(regressors._past(x, at, p).collect()) for x in (one, two)]
    inputs = [sorted(regressors._inputs(x, at.where("fold = 0"), p).collect()) for x in (one, two)]
    assert past[0] == past[1] and inputs[0] == inputs[1]
    assert len(past[0]) == 2 * 16 * 6 and max(r["t"] for r in past[0]) == first - 1


def test_gbt_direct_needs_a_past(spark):
    with pytest.raises(ValueError, match="origin"):
        regressors.gbt_direct(frame(spark, series(30)), Protocol(SEASON, 6, 1, 6, 12), held=4)
