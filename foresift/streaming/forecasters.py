"""Forecasters that follow a stream: every row gets the forecasts that were due before it was known.

A key's state is one row of numbers, a map with the last value of each phase of the season, and one timer. A batch's
steps are composed by doubling, so no value is taken by itself. Where event time has passed a key's newest row by
``idle``, its timer fires and the key leaves, state and all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foresift.operators.local_level import affine, prefixes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MODELS = ("croston", "croston_sba", "tsb", "seasonal_naive")


class Follow(StatefulProcessor):
    """State of one series; ``alpha`` smooths sizes, gaps and the chance of demand, ``idle`` is in milliseconds."""

    def __init__(self, alpha: float, season: int, idle: int):
        self.alpha, self.season, self.idle = alpha, season, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: first and newest t; demand's last t, size, gap, and chance just after it (null before the first demand)
        self.level = handle.getValueState("level", "begun long, seen long, last long, size double, gap double, chance double")
        self.phases = handle.getMapState("phases", "phase long", "y double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "y"], kind="stable", ignore_index=True)
        held = self.level.get() if self.level.exists() else None
        new = batch["t"].notna() & ~batch["t"].duplicated()
        if held is not None:
            new &= batch["t"].fillna(held[1]) > held[1]
        out = batch.drop(columns="at_ms").assign(**dict.fromkeys(MODELS, np.nan))
        fresh = batch[new]
        if len(fresh):
            t, y = fresh["t"].to_numpy(np.int64), fresh["y"].to_numpy(float, na_value=np.nan)
            for name, values in {**self._smooth(t, y, held), "seasonal_naive": self._season(t, fresh["y"].astype(float))}.items():
                out.loc[new, name] = values
            self._wake(fresh["at_ms"].max())
        yield out

    def _smooth(self, t: np.ndarray, y: np.ndarray, held: tuple | None) -> dict[str, np.ndarray]:
        """Forecasts before each row, by the steps of the demands; keeps what follows the last."""
        begun = held[0] if held else int(t[0])
        keep, hit = 1 - self.alpha, y > 0
        at, size = t[hit], y[hit]
        known = held is not None and held[2] is not None
        before = np.r_[held[2] if known else begun - 1, at[:-1]][: len(at)]
        gap = (at - before).astype(float)
        # rows: size, gap, chance; each demand is a step x -> a x + b
        a = np.stack([np.full(len(at), keep), np.full(len(at), keep), keep**gap])
        b = np.stack([self.alpha * size, self.alpha * gap, np.full(len(at), self.alpha)])
        if len(at) and not known:
            a[:, 0], b[:, 0] = 0.0, (size[0], gap[0], 1.0)
        steps = prefixes(np.stack([a, b], axis=-1), affine)
        start = np.array(held[3:] if known else (np.nan,) * 3, float)[:, None]
        # without demand so far the first step forgets what it starts from
        after = np.c_[start, steps[..., 0] * np.nan_to_num(start) + steps[..., 1]]
        past = np.cumsum(hit) - hit
        last = np.r_[held[2] if known else begun, at][past]
        size_at, gap_at, chance_at = after[:, past]
        croston = size_at / np.maximum(gap_at, 1.0)
        tsb = chance_at * keep ** (t - 1 - last).astype(float) * size_at
        end = after[:, -1]
        some = known or len(at) > 0
        self.level.update((begun, int(t[-1]), int(at[-1]) if len(at) else held[2] if known else None, *(map(float, end) if some else (None,) * 3)))
        return {k: np.nan_to_num(v) for k, v in {"croston": croston, "croston_sba": croston * (1 - self.alpha / 2), "tsb": tsb}.items()}

    def _season(self, t: np.ndarray, y: pd.Series) -> np.ndarray:
        """The last known value of each row's phase, from the batch or from the map; keeps the newest of each phase."""
        phase = pd.Series(t % self.season, index=y.index)
        held = {int(k[0]): v[0] for k, v in self.phases.iterator()} if self.phases.exists() else {}
        filled = y.groupby(phase).ffill()
        found = filled.groupby(phase).shift(1)
        for k, v in filled.groupby(phase).last().dropna().items():
            if held.get(k) != v:
                self.phases.updateValue((int(k),), (float(v),))
        return found.fillna(phase.map(held).astype(float)).to_numpy()

    def _wake(self, newest: float) -> None:
        """One timer a key, after the newest row."""
        if pd.isna(newest):
            return
        timers, to = list(self.handle.listTimers()), int(newest) + self.idle
        if any(x >= to for x in timers):
            return
        for x in timers:
            self.handle.deleteTimer(x)
        self.handle.registerTimer(to)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.level.clear()
        self.phases.clear()
        return iter(())


def keep_state_in_files(spark: SparkSession) -> None:
    """State by name and timers need Spark's RocksDB store in place of the one in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def follow(rows: DataFrame, alpha: float = 0.1, season: int = 24, idle_ms: int = 30 * 86_400_000, late: str = "0 seconds") -> DataFrame:
    """Adds ``croston, croston_sba, tsb, seasonal_naive`` to ``series_id, ds, t, y``, as intermittent.smoothed has them at te = t.

    ``t`` numbers a series' rows; one that is missing counts as one without demand, as does null y. The three are 0 before
    the first demand, the last is null before its phase has a value, and is the newest known value of the phase. A row
    whose t is null, is not above those of earlier batches or repeats one of its batch (the larger y of the two, null
    last) changes nothing, and its forecasts are null. Rows more than ``late`` behind the newest ds of earlier batches
    are dropped, as Spark does with a watermark. A series without rows for ``idle_ms`` starts anew.

    Needs ``keep_state_in_files``. A task holds one series' rows of one batch; bound batches by the source's options.
    """
    if not 0 < alpha < 1 or season < 1:
        raise ValueError("alpha lies between 0 and 1, season is 1 or more")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", {m} double" for m in MODELS)
    timed = rows.withWatermark("ds", late).withColumn("at_ms", F.unix_millis("ds"))
    return timed.groupBy("series_id").transformWithStateInPandas(Follow(alpha, season, idle_ms), schema, "Append", "EventTime")
