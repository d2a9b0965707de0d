"""Noise mechanisms as column expressions over uniform columns.

A uniform is either ``F.rand()`` (production) or ``keyed_uniform`` (tests, reruns that must agree): a hash of a
seed, a stream name and a row key, which doesn't depend on partitioning. Seeds must not be shared between
releases: two releases with the same uniforms cancel each other's noise. Doubles leak low bits of Laplace noise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DELTA = 1e-5
MECHANISMS = ("laplace", "gaussian")


def keyed_digest(seed: int, stream: str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string")))


def uniform_part(digest: Column, i: int) -> Column:
    """In (0, 1), from 40 bits of a digest; parts 0, 1 and 2 share none."""
    return (F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 40))


def keyed_uniform(seed: int, stream: str, key: Column) -> Column:
    """In (0, 1), from 48 bits of an md5."""
    digest = keyed_digest(seed, stream, key)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def laplace(u: Column, scale: Column) -> Column:
    """Inverse distribution function; u in (0, 1)."""
    return -scale * F.signum(u - 0.5) * F.ln(1 - 2 * F.abs(u - 0.5))


def gaussian(u1: Column, u2: Column, sigma: Column) -> Column:
    """Box and Muller."""
    return sigma * F.sqrt(-2 * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def gaussian_sigma(sensitivity: Column, epsilon: Column, delta: float = DELTA) -> Column:
    return F.lit(math.sqrt(2 * math.log(1.25 / delta))) * sensitivity / epsilon


def dp_noise(mechanism: str, sensitivity: Column, epsilon: Column, u1: Column, u2: Column, delta: float = DELTA) -> Column:
    """Noise of a release with the given sensitivity and budget."""
    if mechanism == "laplace":
        return laplace(u1, sensitivity / epsilon)
    if mechanism == "gaussian":
        return gaussian(u1, u2, gaussian_sigma(sensitivity, epsilon, delta))
    raise ValueError(f"unknown mechanism {mechanism!r}; one of {MECHANISMS}")


def noise_variance(mechanism: Column, sensitivity: Column, epsilon: Column, delta: float = DELTA) -> Column:
    """Null for an unknown mechanism."""
    b, s = sensitivity / epsilon, gaussian_sigma(sensitivity, epsilon, delta)
    return F.when(mechanism == "laplace", 2 * b * b).when(mechanism == "gaussian", s * s)


def gumbel_score(utility: Column, sensitivity: float, epsilon: Column, u: Column) -> Column:
    """The row with the greatest score of a group is a draw of the exponential mechanism."""
    return epsilon * utility / (2 * sensitivity) - F.ln(-F.ln(u))


# Local mechanisms on a value v in [low, high]


def _unit(v: Column, low: Column, high: Column) -> Column:
    return 2 * (v - low) / (high - low) - 1


def _back(t: Column, v: Column, low: Column, high: Column) -> Column:
    return F.when(high <= low, v).otherwise((t + 1) / 2 * (high - low) + low)


def ldp_duchi(v: Column, low: Column, high: Column, epsilon: Column, u: Column) -> Column:
    """One of two points, unbiased; a value without a range stays."""
    e = F.exp(epsilon)
    c, x = (e + 1) / (e - 1), F.when(high > low, _unit(v, low, high))
    return _back(F.when(u < (1 + x * (e - 1) / (e + 1)) / 2, c).otherwise(-c), v, low, high)


def ldp_piecewise(v: Column, low: Column, high: Column, epsilon: Column, u1: Column, u2: Column, u3: Column) -> Column:
    """Near the value with probability e^(eps/2) / (e^(eps/2) + 1), else in one of the tails by their width."""
    half = F.exp(epsilon / 2)
    c, x = (half + 1) / (half - 1), F.when(high > low, _unit(v, low, high))
    left = (c + 1) / 2 * x - (c - 1) / 2
    right = left + c - 1
    below, above = left + c, c - right
    tail = F.when(u2 * (below + above) < below, -c + u3 * below).otherwise(right + u3 * above)
    return _back(F.when(u1 < half / (half + 1), left + u3 * (right - left)).otherwise(tail), v, low, high)


def randomized_response(v: Column, k: int, epsilon: Column, u1: Column, u2: Column) -> Column:
    """v in 0 .. k - 1 (taken modulo k): itself with probability e^eps / (e^eps + k - 1), else one of the others."""
    e, x = F.exp(epsilon), F.pmod(v, F.lit(k))
    other = F.pmod(x + 1 + F.least(F.lit(k - 2), F.floor(u2 * (k - 1))), F.lit(k))
    return F.when(u1 < e / (e + (k - 1)), x).otherwise(other).cast("int")


def ldp_mse(mechanism: Column, sensitivity: Column, epsilon: Column, n: Column) -> Column:
    """Theoretical error of the mean of n reports."""
    b, e, half = sensitivity / epsilon, F.exp(epsilon), F.exp(epsilon / 2)
    duchi, piecewise = (e + 1) / (e - 1) * sensitivity / 2, (half + 1) / (half - 1) * sensitivity / 2
    return F.when(mechanism == "laplace", 2 * b * b / n).when(mechanism == "duchi", duchi * duchi / n).when(mechanism == "piecewise", piecewise * piecewise / n)
