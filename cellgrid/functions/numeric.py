"""Functions without a built-in: log-gamma and the normal distribution, over Arrow batches; bit codes and normalised weights in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lanczos' series of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# A rational start for the normal quantile (Abramowitz and Stegun, 26.2.23).
QUANTILE_OVER = (2.515517, 0.802853, 0.010328)
QUANTILE_UNDER = (1.0, 1.432788, 0.189269, 0.001308)
HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function's size; nan for nan, 0, -1, -2, ..."""
    x = np.asarray(x, float)
    low = x < 0.5
    z = np.where(low, 1 - x, x) - 1  # below a half by reflection
    total = LANCZOS[0] + sum(c / (z + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    with np.errstate(all="ignore"):
        out = np.where(z > 1e17, z * (np.log(z) - 1), HALF_LOG_2PI + (z + 0.5) * np.log(t) - t + np.log(total))
        reflected = np.log(np.pi / np.abs(np.sin(np.pi * np.fmod(x, 2)))) - out
    return np.where((x <= 0) & (x == np.floor(x)), np.nan, np.where(low, reflected, out))


def upper_tail(x: np.ndarray) -> np.ndarray:
    """Chance that a standard normal value exceeds ``x``, of ``x`` at least 0."""
    x = np.minimum(np.asarray(x, float), 40.0)
    density = np.exp(-0.5 * x * x - HALF_LOG_2PI)
    near = np.minimum(x, 4.0)
    term, total = near.copy(), near.copy()
    for k in range(3, 161, 2):  # all terms are positive
        term = term * near * near / k
        total = total + term
    far = np.maximum(x, 4.0)
    fraction = far
    for k in range(80, 0, -1):
        fraction = far + k / fraction
    return np.where(x < 4, 0.5 - np.exp(-0.5 * near * near - HALF_LOG_2PI) * total, density / fraction)


def _quantile(p: np.ndarray) -> np.ndarray:
    tail = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(tail))
    x = t - np.polyval(QUANTILE_OVER[::-1], t) / np.polyval(QUANTILE_UNDER[::-1], t)
    for _ in range(3):  # Halley's steps from an error below 5e-4
        x = np.maximum(x, 0)
        e = (tail - upper_tail(x)) / np.exp(-0.5 * x * x - HALF_LOG_2PI)
        x = x - e / (1 - 0.5 * x * e)
    return np.where(p < 0.5, -x, x)


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    """ln of the gamma function; null and non-positive integers give null."""
    out = log_gamma(x.to_numpy(float))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    v = x.to_numpy(float)
    tail = upper_tail(np.abs(v))
    return pd.Series(np.where(v > 0, 1 - tail, tail)).astype(object).where(~np.isnan(v), None)


@F.pandas_udf(T.DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    """Quantile of the standard normal; outside (0, 1) null."""
    v = p.to_numpy(float)
    ok = (v > 0) & (v < 1)
    return pd.Series(_quantile(np.where(ok, v, 0.5))).astype(object).where(ok, None)


def sign_code(values: Column) -> Column:
    """Bits of an array of fewer than 64 numbers: the sum of 2^k over its positive places k."""
    bits = F.transform(values, lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def exp_weights(distances: np.ndarray, target: float, steps: int = 60) -> np.ndarray:
    """``exp(-rate * (d - least))`` with the rate at which the weights sum up to ``target``."""
    d = np.asarray(distances, float) - np.min(distances)
    lo, hi = 0.0, 1.0
    while np.exp(-hi * d).sum() > target and hi < 1e12:
        hi *= 2
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.exp(-mid * d).sum() > target else (lo, mid)
    return np.exp(-hi * d)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def distance_weights(distances: pd.Series, target: pd.Series) -> pd.Series:
    """``exp_weights`` of each array."""
    return pd.Series([exp_weights(np.asarray(d), t).tolist() if d is not None and len(d) else [] for d, t in zip(distances, target, strict=True)])
