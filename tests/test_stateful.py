"""Stateful streams against their batch twins, over two runs of one checkpoint."""

import numpy as np
import pytest

from foresift.operators import quality
from foresift.streaming import stateful


def streamed(spark, tmp_path, rows, schema, operator, cut):
    """The operator's rows over a stream that stops and goes on at t = cut."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([r for r in rows if r[-1] < cut], [r for r in rows if r[-1] >= cut]):
        spark.createDataFrame([r[:-1] for r in part], schema).coalesce(1).write.mode("append").parquet(source)
        stream = operator(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_smoothing(spark, tmp_path):
    y = [None if t == 5 else float(t * 7 % 10) for t in range(12)]
    found = streamed(spark, tmp_path, [("a", t, v, t) for t, v in enumerate(y)], "series_id string, t long, y double", lambda s: stateful.smoothing(s, 0.5), 7)
    level, want = None, []
    for v in y:
        want.append(level)
        level = level if v is None else v if level is None else (v + level) / 2
    got = {r["t"]: r["y_pred"] for r in found}
    assert [got[t] for t in range(12)] == pytest.approx(want)


def test_page_hinkley(spark, tmp_path):
    rows = [(k, t, float(t > 20) * j * 9 + t % 3, t) for j, k in enumerate("ab") for t in range(40)]
    schema = "key string, t long, x double"
    found = {(r["key"], r["t"]): (r["excess"], r["fired"]) for r in streamed(spark, tmp_path, rows, schema, stateful.page_hinkley, 25)}
    batch = quality.page_hinkley(spark.createDataFrame([r[:-1] for r in rows], schema)).collect()
    assert {k: v[1] for k, v in found.items()} == {(r["key"], r["t"]): r["fired"] for r in batch}
    assert [found[r["key"], r["t"]][0] for r in batch] == pytest.approx([r["excess"] for r in batch]) and any(v[1] for v in found.values())


def test_adwin(spark, tmp_path):
    x = np.r_[np.ones(30), np.full(20, 5.0)]
    rows = [("a", t, float(v), t) for t, v in enumerate(x)]
    found = streamed(spark, tmp_path, rows, "key string, t long, x double", stateful.adwin, 20)
    batch = quality.adwin_first_alarm(spark.createDataFrame([r[:-1] for r in rows], "key string, t long, x double")).first()
    assert min(r["t"] for r in found if r["drift"]) == batch["t"]


def test_champion(spark, tmp_path):
    rows = [("s", m, t, 10.0, 10.0 + (e if t < 12 else 3 - e), t) for t in range(24) for m, e in (("a", 1.0), ("b", 2.0))]
    found = streamed(spark, tmp_path, rows, "series_id string, model string, t long, y_true double, y_pred double", lambda s: stateful.champion(s, 4, 2), 9)
    got = {(r["t"], r["model"]): r["champion"] for r in found}
    assert got[0, "a"] is None and got[5, "a"] == "a" and got[23, "a"] == "b" and len(got) == 48


def test_adaptive_level(spark, tmp_path):
    e = np.random.default_rng(1).normal(0, 1, 30)
    rows = [("s", t, float(v), 0.0, t) for t, v in enumerate(e)]
    found = {r["t"]: r for r in streamed(spark, tmp_path, rows, "series_id string, t long, y_true double, y_pred double", lambda s: stateful.adaptive_level(s, 0.1, 0.05), 11)}
    a, past = 0.1, []
    for t, v in enumerate(abs(e)):
        used = np.clip(a, 1e-3, 0.5)
        assert found[t]["alpha_t"] == pytest.approx(used)
        if past:
            r = np.quantile(past, 1 - used)
            assert found[t]["hi"] == pytest.approx(r)
            a += 0.05 * (0.1 - float(v > r))
        past.append(v)
