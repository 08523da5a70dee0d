"""A window of values that drops its older part when its mean has changed, kept as an exponential histogram.

The window is a list of buckets, oldest first, each with the number of its values (a power of two) and their sum. At most
``MOST`` buckets have the same size: one more merges the two oldest of them. So n values are some ``MOST`` log2(n)
buckets, and the window is cut between buckets only. The same state serves tables, key by key, and streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 5


class Buckets:
    """Sizes and sums of the buckets, oldest first."""

    def __init__(self, sizes: list[int] | None = None, sums: list[float] | None = None, most: int = MOST):
        self.sizes, self.sums, self.most = list(sizes or []), list(sums or []), most

    def add(self, x: float) -> None:
        sizes, sums, size, end = self.sizes, self.sums, 1, len(self.sizes) + 1
        sizes.append(1)
        sums.append(x)
        # the buckets of one size lie together and end at ``end``: those of double the size end where these begin
        while end > self.most and sizes[end - self.most - 1] == size:
            first = end - self.most - 1
            sizes[first : first + 2] = [2 * size]
            sums[first : first + 2] = [sums[first] + sums[first + 1]]
            end, size = first + 1, 2 * size

    def drop(self, delta: float) -> int:
        """Drops the buckets before the first cut with means too far apart on its sides; how many values went."""
        if len(self.sizes) < 2:
            return 0
        before = np.cumsum(self.sizes)
        n, n0, total = before[-1], before[:-1], np.cumsum(self.sums)
        if n < 4:
            return 0
        n1 = n - n0
        wide = np.sqrt((1 / (2 * n0) + 1 / (2 * n1)) * np.log(4 * n / delta))
        hits = np.flatnonzero((n0 >= 2) & (n1 >= 2) & (np.abs(total[:-1] / n0 - (total[-1] - total[:-1]) / n1) >= wide))
        if not len(hits):
            return 0
        cut = int(hits[0]) + 1
        del self.sizes[:cut], self.sums[:cut]
        return int(n0[hits[0]])


def advance(state: Buckets, values: np.ndarray, delta: float) -> np.ndarray:
    """Reads values in order; after each how many older ones were dropped. NaN changes nothing."""
    gone = np.zeros(len(values), np.int64)
    for k in np.flatnonzero(~np.isnan(values)).tolist():
        state.add(float(values[k]))
        gone[k] = state.drop(delta)
    return gone


def adwin(rows: DataFrame, delta: float = 0.002) -> DataFrame:
    """``key, t, dropped`` of ``key, t, x``: how many older values left the window with this row; above 0 is an alarm.

    With parts of n0 and n1 of n values, at least two each, means may be sqrt((1 / (2 n0) + 1 / (2 n1)) ln(4 n / delta))
    apart. Rows of a key are read in the order of t by one task that holds its buckets only. Null and NaN x change
    nothing. A null key is a key; rows of one t are in no set order.
    """
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = Buckets(), None
        for pdf in parts:
            keys = pdf["key"].astype(object).where(pdf["key"].notna(), None).to_numpy()
            new = np.flatnonzero(np.r_[last is None or keys[0] != last[0], keys[1:] != keys[:-1]]) if len(keys) else []
            gone, values = np.zeros(len(pdf), np.int64), pdf["x"].to_numpy(float, na_value=np.nan)
            at = 0
            for end in [*new, len(pdf)]:
                gone[at:end] = advance(state, values[at:end], delta)
                if end < len(pdf):
                    state = Buckets()
                at = end
            last = [keys[-1]] if len(keys) else last
            yield pdf[["key", "t"]].assign(dropped=gone)

    ordered = rows.select("key", "t", "x").repartition("key").sortWithinPartitions("key", "t")
    return ordered.mapInPandas(run, f"key {kinds['key']}, t {kinds['t']}, dropped long")


def first_alarm(rows: DataFrame, delta: float = 0.002) -> DataFrame:
    """``key, t, cut``: the first alarm of each key that has one, and how many values lay before the cut."""
    return adwin(rows, delta).where("dropped > 0").groupBy("key").agg(F.min(F.struct("t", "dropped")).alias("x")).select("key", "x.t", F.col("x.dropped").alias("cut"))
