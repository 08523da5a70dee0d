"""Operators with state by series. State is a few numbers a key; each emits a row for each row that it reads.

Rows of one key in one batch are taken in order of t. A key's state ends only when the stream does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from foresift.operators.adaptive_window import Buckets, advance


def _fold(rows: DataFrame, keys: list[str], adds: str, state: str, start: tuple, step: Callable[[tuple, dict], tuple[tuple, tuple]]) -> DataFrame:
    """Runs ``step(state, row) -> state, added values`` over each key's rows."""
    columns = [c.strip().split(" ")[0] for c in adds.split(",")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + adds
    names = rows.columns

    def run(_key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        batch = pd.concat(list(parts)).sort_values("t", kind="stable")
        out = []
        for row in batch.to_dict("records"):
            now, added = step(now, row)
            out.append(added)
        held.update(now)
        yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(out, columns=columns)], axis=1)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", "NoTimeout")


def smoothing(rows: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Adds ``y_pred`` to ``series_id, t, y``: the exponentially smoothed level before the row, which is null at first. Null y keeps the level."""

    def step(s, row):
        level, y = s[0], row["y"]
        known = not pd.isna(y)
        return ((level if not known else y if level is None else alpha * y + (1 - alpha) * level),), (level,)

    return _fold(rows, ["series_id"], "y_pred double", "level double", (None,), step)


def page_hinkley(rows: DataFrame, delta: float = 0.005, most: float = 50.0) -> DataFrame:
    """Adds ``excess, fired`` to ``key, t, x`` as quality.page_hinkley does. Null x changes nothing."""

    def step(s, row):
        n, total, drift, least = s
        if not pd.isna(row["x"]):
            n, total = n + 1, total + row["x"]
            drift += row["x"] - total / n - delta
            least = min(least, drift)
        return (n, total, drift, least), (drift - least, bool(drift - least > most))

    return _fold(rows, ["key"], "excess double, fired boolean", "n long, total double, drift double, least double", (0, 0.0, 0.0, 0.0), step)


def adwin(rows: DataFrame, delta: float = 0.002) -> DataFrame:
    """Adds ``drift`` to ``key, t, x``: the adaptive window dropped its older part, as adaptive_window.adwin does; the state is its buckets. Null x changes nothing."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", drift boolean"

    def run(_key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = Buckets(*held.get) if held.exists else Buckets()
        batch = pd.concat(list(parts)).sort_values("t", kind="stable")
        yield batch.assign(drift=advance(state, batch["x"].to_numpy(float, na_value=float("nan")), delta) > 0)
        held.update((state.sizes, state.sums))

    return rows.groupBy("key").applyInPandasWithState(run, schema, "sizes array<long>, sums array<double>", "append", "NoTimeout")


def champion(rows: DataFrame, window: int = 168, burn_in: int = 24) -> DataFrame:
    """Adds ``champion`` to ``series_id, model, t, y_true, y_pred``: the model with the lowest mean error over its last ``window`` rows before this one.

    It is null until every model seen has ``burn_in`` errors; ties go to the first name.
    """

    def step(s, row):
        errors = {m: list(e) for m, e in zip(s[0], s[1], strict=True)}
        ready = errors and all(len(e) >= burn_in for e in errors.values())
        best = min(sorted(errors), key=lambda m: sum(errors[m]) / len(errors[m])) if ready else None
        if not (pd.isna(row["y_true"]) or pd.isna(row["y_pred"])):
            errors[row["model"]] = [*errors.get(row["model"], []), abs(row["y_true"] - row["y_pred"])][-window:]
        return (list(errors), list(errors.values())), (best,)

    return _fold(rows, ["series_id"], "champion string", "models array<string>, errors array<array<double>>", ([], []), step)


def adaptive_level(rows: DataFrame, alpha: float = 0.1, gamma: float = 0.01, window: int = 336) -> DataFrame:
    """Adds ``alpha_t, lo, hi`` to ``series_id, t, y_true, y_pred``: the band by the quantile of the last errors at one minus a level that follows the misses.

    After a row the level moves by gamma (alpha - miss). Bounds are null before the first error; the level in use is held to 0.001 to 0.5.
    """

    def step(s, row):
        import numpy as np

        a, errors = s[0], list(s[1])
        used = min(max(a, 1e-3), 0.5)
        r = float(np.quantile(errors, 1 - used)) if errors else None
        lo, hi = (None, None) if r is None or pd.isna(row["y_pred"]) else (row["y_pred"] - r, row["y_pred"] + r)
        if not (pd.isna(row["y_true"]) or pd.isna(row["y_pred"])):
            e = abs(row["y_true"] - row["y_pred"])
            if r is not None:
                a += gamma * (alpha - float(e > r))
            errors = [*errors, e][-window:]
        return (a, errors), (used, lo, hi)

    return _fold(rows, ["series_id"], "alpha_t double, lo double, hi double", "a double, errors array<double>", (alpha, []), step)
