"""Distributions given by quantiles: arrays of levels (ascending) and of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile_at(levels: tuple[float, ...], values: Column, q: float) -> Column:
    """Linear between the given levels, flat beyond them."""
    if q <= levels[0]:
        return F.get(values, F.lit(0))
    if q >= levels[-1]:
        return F.get(values, F.lit(len(levels) - 1))
    k = max(i for i, x in enumerate(levels) if x <= q)
    low, high = F.get(values, F.lit(k)), F.get(values, F.lit(k + 1))
    return low + (high - low) * ((q - levels[k]) / (levels[k + 1] - levels[k]))


def mean_of(levels: tuple[float, ...], values: Column) -> Column:
    """The area below the quantile curve by trapezoids, over the range of levels."""
    areas = [(F.get(values, F.lit(k)) + F.get(values, F.lit(k + 1))) * ((b - a) / 2) for k, (a, b) in enumerate(zip(levels, levels[1:], strict=False))]
    return sum(areas[1:], areas[0]) / (levels[-1] - levels[0])


def pit(levels: tuple[float, ...], quantiles: Column, y: Column) -> Column:
    """The level at which the quantiles reach y, by linear interpolation; beyond them, half way to 0 or 1."""
    q = lambda k: F.get(quantiles, F.lit(k))
    found = F.when(y <= q(0), F.lit(levels[0] / 2)).when(y >= q(len(levels) - 1), F.lit((1 + levels[-1]) / 2))
    for k in range(len(levels) - 1):
        found = found.when(y < q(k + 1), levels[k] + (levels[k + 1] - levels[k]) * (y - q(k)) / (q(k + 1) - q(k)))
    return found
