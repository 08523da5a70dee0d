"""Segmentation and running sums against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.operators import segments

SCHEMA = "series_id string, t long, y double"


def splits(y, penalty, least, rounds):
    """Binary segmentation by loops: place -> round."""
    found, waiting = {}, [(0, len(y), 0)]
    most = penalty * np.var(y)
    error = lambda x: float(((x - x.mean()) ** 2).sum())
    while waiting:
        lo, hi, depth = waiting.pop()
        cuts = range(lo + least, hi - least + 1)
        if depth == rounds or not cuts:
            continue
        gains = [error(y[lo:hi]) - error(y[lo:c]) - error(y[c:hi]) for c in cuts]
        k = int(np.argmax(gains))
        if gains[k] > most:
            found[cuts[k]] = depth
            waiting += [(lo, cuts[k], depth + 1), (cuts[k], hi, depth + 1)]
    return found


@pytest.mark.parametrize("block", [segments.BLOCK, 17])
def test_changepoints(spark, monkeypatch, block):
    monkeypatch.setattr(segments.running, "__defaults__", (block,))
    rng, rows, wanted = np.random.default_rng(2), [], {}
    for name, levels in (("steps", [0, 5, 1, 9, 9, 3]), ("flat", [2]), ("noise", [0]), ("short", None), ("gaps", [0, 8])):
        y = np.array([1.0, 2.0]) if levels is None else np.concatenate([np.full(40, float(x)) for x in levels]) + (0 if name == "flat" else rng.normal(size=40 * len(levels)))
        wanted[name] = splits(y, 10, 2, 6)
        t = np.arange(len(y)) * (3 if name == "gaps" else 1)
        rows += [(name, int(a), float(b)) for a, b in zip(t, y, strict=True)]
        rows += [(name, int(a) + 1, None) for a in t] if name == "gaps" else []
    rng.shuffle(rows)
    got = {}
    for r in segments.changepoints(spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit(1))).collect():
        got.setdefault(r["series_id"], {})[r["t"] // (3 if r["series_id"] == "gaps" else 1)] = r["depth"]
    assert got == {k: v for k, v in wanted.items() if v}
    assert {40, 80, 120, 200} <= set(wanted["steps"])
    assert segments.changepoints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running(spark):
    rows = [(f"s{k % 3}", k, float(k % 7)) for k in range(200)]
    got = segments.running(spark.createDataFrame(rows, SCHEMA), ["series_id"], "t", {"n": F.lit(1), "u": F.col("y")}, block=9).collect()
    for name in ("s0", "s1", "s2"):
        own = [r for r in sorted(got, key=lambda r: r["t"]) if r["series_id"] == name]
        assert [r["u"] for r in own] == np.cumsum([r["y"] for r in own]).tolist() and [r["n"] for r in own] == [*range(1, len(own) + 1)]
