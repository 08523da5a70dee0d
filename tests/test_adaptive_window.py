"""The adaptive window against lists of values, as a table and as a stream."""

import time

import numpy as np
from test_stateful import streamed

from foresift.operators import adaptive_window
from foresift.streaming import stateful


def plain(values, delta=0.002, most=5):
    """Values dropped at each row, by a window of buckets that hold their values."""
    window, out = [], []
    for x in values:
        window.append([x])
        size = 1
        while sum(len(b) == size for b in window) > most:
            k = next(i for i, b in enumerate(window) if len(b) == size)
            window[k : k + 2] = [window[k] + window[k + 1]]
            size *= 2
        n, gone = sum(map(len, window)), 0
        for k in range(1, len(window)):
            old, new = sum(window[:k], []), sum(window[k:], [])
            if min(len(old), len(new)) >= 2 and abs(np.mean(old) - np.mean(new)) >= np.sqrt((1 / (2 * len(old)) + 1 / (2 * len(new))) * np.log(4 * n / delta)):
                gone, window = len(old), window[k:]
                break
        out.append(gone)
    return out


def planted():
    rng = np.random.default_rng(3)
    return {"calm": rng.normal(1, 0.2, 400), "steps": np.r_[rng.normal(1, 0.2, 150), rng.normal(4, 0.2, 200), rng.normal(0, 0.2, 100)], "loud": rng.normal(0, 5, 300), "short": np.array([0.0, 9.0, 0.0]), "slope": np.linspace(0, 9, 300)}


SCHEMA = "key string, t long, x double"


def test_table(spark):
    series = planted()
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)] + [("calm", 1000, None), (None, 0, 1.0)]
    np.random.default_rng(1).shuffle(rows)
    got = {}
    for r in adaptive_window.adwin(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got.setdefault(r["key"], {})[r["t"]] = r["dropped"]
    for k, x in series.items():
        assert [got[k][t] for t in range(len(x))] == plain(x)
    assert got[None] == {0: 0} and got["calm"][1000] == 0 and sum(v > 0 for v in got["steps"].values()) >= 2
    firsts = {r["key"]: (r["t"], r["cut"]) for r in adaptive_window.first_alarm(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert firsts == {k: next((t, g) for t, g in enumerate(plain(x)) if g) for k, x in series.items() if any(plain(x))}
    assert adaptive_window.adwin(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream(spark, tmp_path):
    series = planted()
    rows = [(k, t, float(v), t) for k in ("calm", "steps") for t, v in enumerate(series[k])]
    got = {(r["key"], r["t"]): r["drift"] for r in streamed(spark, tmp_path, rows, SCHEMA, stateful.adwin, 170)}
    assert got == {(k, t): g > 0 for k in ("calm", "steps") for t, g in enumerate(plain(series[k]))}


def test_many_rows_of_one_key():
    """The state stays small and the time linear."""
    rng, state, took = np.random.default_rng(1), adaptive_window.Buckets(), []
    for n in (60_000, 60_000, 60_000):
        began = time.process_time()
        adaptive_window.advance(state, rng.normal(0, 0.1, n), 1e-12)
        took.append(time.process_time() - began)
    assert len(state.sizes) < 5 * 18 and sum(state.sizes) == 180_000 and took[2] < 3 * took[0]
