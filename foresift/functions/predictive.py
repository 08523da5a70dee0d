"""Normal and Student predictive distributions as columns: quantiles, intervals, means and samples."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from foresift.functions.special import z

#: Steps of the continued fraction and of Newton's rule.
FRACTION, NEWTON = 120, 14


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0, by Stirling's series at x + 10."""
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    below = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, k: s + F.log(x + k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its end: it converges fast for x below (a + 1) / (a + b + 2)."""

    def term(rest: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / rest

    return 1 / F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1), F.lit(-1)), F.lit(1.0), term)


def incomplete_beta(x: Column, a: Column, b: Column, y: Column | None = None) -> Column:
    """The regularised incomplete beta function of 0 < x < 1; ``y`` is 1 - x, where that is known better."""
    y = 1 - x if y is None else y
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(y))
    return F.when(x < (a + 1) / (a + b + 2), front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(y, b, a) / b)


def t_tail(t: Column, df: Column) -> Column:
    """The chance that a Student variable exceeds t > 0."""
    s = t * t
    return incomplete_beta(df / (df + s), df / 2, F.lit(0.5), s / (df + s)) / 2


def t_quantile(q: float, df: Column) -> Column:
    """Student quantile at a level, for df > 0 degrees of freedom.

    Newton's rule on the logarithm of the tail against that of t, which is close to a line far out, from the normal
    quantile; steps are held to a factor of e^3, and the tail stays between its values at the steps taken.
    """
    if q == 0.5:
        return F.lit(0.0) * df
    p = min(q, 1 - q)

    def step(u: Column, _: Column) -> Column:
        t = F.exp(u)
        density = F.exp(log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * F.log(df * math.pi) - (df + 1) / 2 * F.log1p(t * t / df))
        move = _let(t_tail(t, df), lambda tail: (F.log(tail) - math.log(p)) * tail / (density * t))
        return u + F.greatest(F.least(move, F.lit(3.0)), F.lit(-3.0))

    start = F.lit(math.log(max(-z(p), 1e-3)))
    t = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), start, step))
    return t if q > 0.5 else -t


def uniform(key: Column, i: Column, part: str) -> Column:
    """A number in (0, 1) for each key, counter and part, the same in any partitioning and any engine with md5."""
    text = F.concat_ws("/", key.cast("string"), i.cast("string"), F.lit(part))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


@dataclass(frozen=True)
class Gaussian:
    mu: Column
    sigma: Column

    def mean(self) -> Column:
        return self.mu

    def quantile(self, q: float) -> Column:
        return self.mu + z(q) * self.sigma

    def interval(self, alpha: float) -> tuple[Column, Column]:
        return self.quantile(alpha / 2), self.quantile(1 - alpha / 2)

    def sample(self, n: int, key: Column) -> Column:
        """``n`` draws as an array, the same for the same key."""
        draw = lambda i: F.sqrt(-2 * F.log(uniform(key, i, "a"))) * F.cos(2 * math.pi * uniform(key, i, "b"))
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: self.mu + self.sigma * draw(i))


@dataclass(frozen=True)
class Student:
    mu: Column
    scale: Column
    df: Column

    def mean(self) -> Column:
        """Null where there is none, for one degree of freedom or fewer."""
        return F.when(self.df > 1, self.mu)

    def quantile(self, q: float) -> Column:
        return self.mu + self.scale * t_quantile(q, self.df)

    def interval(self, alpha: float) -> tuple[Column, Column]:
        return self.quantile(alpha / 2), self.quantile(1 - alpha / 2)

    def sample(self, n: int, key: Column) -> Column:
        """``n`` draws as an array, the same for the same key."""
        draw = lambda i: F.sqrt(self.df * (F.pow(uniform(key, i, "a"), -2 / self.df) - 1)) * F.cos(2 * math.pi * uniform(key, i, "b"))
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: self.mu + self.scale * draw(i))
