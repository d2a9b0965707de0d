"""Scalar column functions shared by the operators. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attack labels of the intrusion data by class, class order as in CLASS_NAMES.
CLASS_NAMES = ("Normal", "DoS", "Probe", "R2L", "U2R")
LABELS_BY_CLASS = {
    "Normal": ("normal",),
    "DoS": ("back", "land", "neptune", "pod", "smurf", "teardrop", "apache2", "udpstorm", "processtable", "mailbomb", "worm"),
    "Probe": ("satan", "ipsweep", "nmap", "portsweep", "mscan", "saint"),
    "R2L": ("warezclient", "warezmaster", "imap", "ftp_write", "guess_passwd", "phf", "multihop", "spy", "named", "snmpgetattack", "snmpguess", "xsnoop", "xlock", "sendmail", "httptunnel"),
    "U2R": ("buffer_overflow", "loadmodule", "perl", "rootkit", "ps", "sqlattack", "xterm"),
}
#: Class of labels that no class lists.
UNKNOWN_CLASS = 1
# Coefficients of the error function's rational approximation (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def number(c: Column) -> Column:
    """To double; what isn't a number, NaN and infinities become null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clip(c: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Null stays null."""
    out = c
    if high is not None:
        out = F.when(out > high, high).otherwise(out)
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    return out


def ratio(top: Column, bottom: Column, otherwise: Column | None = None) -> Column:
    """top / bottom where bottom is above 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(None).cast("double") if otherwise is None else otherwise)


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0 .. bins - 1; the upper edge belongs to the last bin; 0 where the range is empty."""
    place = F.floor((x - low) / ((high - low) / bins))
    return F.when(high > low, F.least(F.lit(bins - 1), place).cast("int")).otherwise(F.when(x.isNotNull(), F.lit(0)))


def encode_binary(label: Column, normal: str = "normal") -> Column:
    """0 for the normal label in any case, else 1."""
    return (F.lower(label) != normal.lower()).cast("int")


def encode_multiclass(label: Column) -> Column:
    """Class number by the fixed label lists, case-sensitive; unknown labels and null count as UNKNOWN_CLASS."""
    pairs = [F.lit(x) for i, c in enumerate(CLASS_NAMES) for name in LABELS_BY_CLASS[c] for x in (name, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(UNKNOWN_CLASS))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, F.lit(-500.0), F.lit(500.0))))


def softmax(scores: Column) -> Column:
    """Of an array, shifted by its greatest element."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(scores, lambda x: F.exp(x - top) / total)


def erf(x: Column) -> Column:
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def norm_cdf(x: Column) -> Column:
    return F.lit(0.5) * (1 + erf(x / F.sqrt(F.lit(2.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def strip_names(names: Iterable[str]) -> list[str]:
    """Column names without byte-order mark and surrounding white space."""
    return [n.replace("﻿", "").strip() for n in names]
