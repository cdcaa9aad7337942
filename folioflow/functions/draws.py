"""Draws of counts from hashed uniforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: deviations, and steps besides, from the mean beyond which no uniform of 32 bits reaches
DEVIATIONS, STEPS = 9, 60


def _table(m: int, p: float) -> tuple[int, np.ndarray]:
    """(first, cdf): the distribution of m trials from `first` on, as far as a uniform of 32 bits can tell."""
    spread = DEVIATIONS * (m * p * (1 - p)) ** 0.5 + STEPS
    low, high = max(0, int(m * p - spread)), min(m, int(m * p + spread) + 1)
    k = np.arange(low, high)
    logs = np.concatenate(([0.0], np.cumsum(np.log((m - k) / (k + 1.0)) + np.log(p) - np.log1p(-p))))
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return low, cdf / cdf[-1]


def binomial_quantiles(m: np.ndarray, left: np.ndarray, whole: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row the least k with P(successes of m trials at left / whole <= k) >= u.  Time and memory of a
    distinct (m, left, whole) grow with the square root of m."""
    out = np.where(left >= whole, m, 0)
    rows = np.flatnonzero((left > 0) & (left < whole) & (m > 0))
    order = rows[np.lexsort((whole[rows], left[rows], m[rows]))]
    keys = np.stack((m[order], left[order], whole[order]))
    begins = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))) if len(order) else []
    for a, b in zip(begins, [*begins[1:], len(order)]):
        low, cdf = _table(int(keys[0, a]), int(keys[1, a]) / int(keys[2, a]))
        at = order[a:b]
        out[at] = np.minimum(low + np.searchsorted(cdf, u[at], side="left"), m[at])
    return out


def binomial(m: Column, left: Column, whole: Column, draw: Column) -> Column:
    """Successes of m trials of probability left / whole for a draw of 32 bits (`functions.text.draw`)."""

    @F.pandas_udf("long")
    def quantile(m: pd.Series, left: pd.Series, whole: pd.Series, draw: pd.Series) -> pd.Series:
        ints = [np.asarray(c, dtype=np.int64) for c in (m, left, whole)]
        return pd.Series(binomial_quantiles(*ints, (np.asarray(draw, dtype=np.float64) + 0.5) / 4294967296.0))

    return quantile(m.cast("long"), left.cast("long"), whole.cast("long"), draw)
