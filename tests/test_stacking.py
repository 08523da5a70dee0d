"""Stacking of several members against NumPy."""

import numpy as np
import pytest

from foresift.operators import stacking

SCHEMA = "model string, series_id string, fold long, h long, y_true double, y_pred double"
MODELS = ("a", "b", "c", "d")


def table():
    rng, rows, data = np.random.default_rng(5), [], {}
    for s in ("s", "t"):
        for fold in range(4):
            y = rng.normal(10, 3, 12)
            x = np.stack([y + rng.normal(0, 1, 12), y + rng.normal(2, 2, 12), rng.normal(10, 3, 12), np.full(12, 5.0)], axis=1)
            data[s, fold] = y, x
            rows += [(m, s, fold, h + 1, float(y[h]), float(x[h, k])) for h in range(12) for k, m in enumerate(MODELS)]
    return rows, data


def descent(x, y, penalty):
    """Cyclic minimisation of the penalised loss itself, weight by weight, from its values on a line."""
    w = np.zeros(x.shape[1])
    for _ in range(400):
        for j in range(len(w)):
            if x[:, j].std() < 1e-9:
                continue
            rest = y - x @ w + x[:, j] * w[j]
            sq, at = (x[:, j] ** 2).mean(), (x[:, j] * rest).mean()
            loss = lambda b: ((rest - x[:, j] * b) ** 2).mean() / 2 + penalty * abs(b)  # noqa: B023, E731
            w[j] = min((0.0, (at - penalty) / sq, (at + penalty) / sq), key=loss)
    return w


def test_lasso(spark):
    rows, data = table()
    got = {(r["series_id"], r["fold"], r["h"]): r for r in stacking.lasso(spark.createDataFrame([*rows, ("z", "s", 0, 1, 1.0, 2.0), ("a", "s", 9, 1, 1.0, 2.0)], SCHEMA), MODELS, 0.5, 200).collect()}
    assert len(got) == 2 * 3 * 12  # not the first fold, and no step that a member lacks
    for (s, fold, h), r in got.items():
        y, x = (np.concatenate([data[s, f][k] for f in range(fold)]) for k in (0, 1))
        w = descent(x - x.mean(0), y - y.mean(), 0.5)
        assert r["weights"] == pytest.approx(w, abs=1e-6) and r["weights"][3] == 0
        assert r["y_pred"] == pytest.approx(y.mean() + w @ (data[s, fold][1][h - 1] - x.mean(0)), abs=1e-6)


def test_tree(spark):
    rows, data = table()
    found = stacking.tree(spark.createDataFrame(rows, SCHEMA), MODELS, least=3).collect()
    assert len(found) == 2 * 3 * 12
    for r in found:
        y, x = (np.concatenate([data[r["series_id"], f][k] for f in range(r["fold"])]) for k in (0, 1))
        lo, hi = x.min(0), x.max(0)
        put = lambda v: np.where(hi > lo, np.clip(np.floor((v - lo) / np.where(hi > lo, hi - lo, 1) * 8), 0, 7), 0)  # noqa: B023, E731
        own = data[r["series_id"], r["fold"]][1][r["h"] - 1]
        e, b, q = y - x.mean(1), put(x), put(own)
        for _ in range(2):
            best = (0.0, None)
            for k in range(4):
                for cut in range(8):
                    left = b[:, k] <= cut
                    if min(left.sum(), (~left).sum()) >= 3:
                        gain = round(e[left].sum() ** 2 / left.sum() + e[~left].sum() ** 2 / (~left).sum() - e.sum() ** 2 / len(e), 4)
                        best = max(best, (gain, (-k, -cut)), key=lambda z: (z[0], z[1] or (-9, 0)))
            if best[1]:
                k, cut = -best[1][0], -best[1][1]
                side = (b[:, k] > cut) == (q[k] > cut)
                e, b = e[side], b[side]
        assert r["y_pred"] == pytest.approx(own.mean() + e.mean(), abs=1e-6)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert stacking.lasso(none, MODELS).count() == 0 and stacking.tree(none, MODELS).count() == 0
