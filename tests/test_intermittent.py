"""Intermittent demand: affine pieces against recursions value by value."""

import numpy as np
import pytest

from foresift.operators import intermittent
from foresift.operators.folds import Protocol, splits

SCHEMA = "series_id string, t long, y double"


def recursions(y, a=0.1, agg=7, b=0.2):
    """All four forecasts and the deviation, by loops."""
    hits = np.flatnonzero(y > 0)
    croston = tsb = 0.0
    if len(hits):
        size, gap, last = y[hits[0]], hits[0] + 1.0, hits[0]
        for t in hits[1:]:
            size, gap, last = a * y[t] + (1 - a) * size, a * (t - last) + (1 - a) * gap, t
        croston, chance = size / max(gap, 1.0), 1.0
        for v in y[hits[0] + 1 :]:
            chance = a * (v > 0) + (1 - a) * chance
        tsb = chance * size
    sums = np.concatenate([np.zeros(-len(y) % agg), y]).reshape(-1, agg).sum(axis=1)
    level = sums[0]
    for v in sums[1:]:
        level = b * v + (1 - b) * level
    return {"croston": croston, "croston_sba": croston * (1 - a / 2), "tsb": tsb, "adida": level / agg}, np.std(y)


@pytest.mark.parametrize(("mode", "block"), [("expanding", intermittent.BLOCK), ("expanding", 9), ("rolling", 9)])
def test_all_models(spark, mode, block):
    rng, p = np.random.default_rng(4), Protocol(1, 5, 4, 6, 40, mode)
    series = {f"s{k}": np.where(rng.random(90) < share, rng.integers(1, 9, 90), 0).astype(float) for k, share in enumerate((0.05, 0.3, 0.9, 0.02))}
    series |= {"none": np.zeros(80), "late": np.r_[np.zeros(75), 4.0, np.zeros(4)], "first": np.r_[3.0, np.zeros(79)]}
    rows = [(k, t, None if v == 0 and t % 5 == 0 else float(v)) for k, y in series.items() for t, v in enumerate(y)]
    panel = spark.createDataFrame(rows, SCHEMA)
    got = intermittent.intermittent(panel, splits(panel, p), 5, block=block).collect()
    assert len(got) == 7 * 4 * 4 * 5
    for r in got:
        y = series[r["series_id"]]
        te = len(y) - 5 - (3 - r["fold"]) * 6
        want, sigma = recursions(y[(te - 40 if mode == "rolling" else 0) : te])
        assert r["t"] == te + r["h"] - 1 and r["y_pred"] == pytest.approx(want[r["model"]], abs=1e-9)
        band = 1.6448536269514715 * sigma * np.sqrt(r["h"])
        assert r["hi"] == pytest.approx(r["y_pred"] + band, abs=1e-6) and r["lo"] == pytest.approx(max(r["y_pred"] - band, 0), abs=1e-6)
