"""Similarities of two strings: built-in expressions where Spark has them, Arrow functions for the rest."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that fingerprints count.
SMIFP34 = list("CcOoNnSsPpFIBb123456789()[]=#+-@%.")
SMIFP38 = [c for c in SMIFP34 if c != "%"] + ["/", "\\", "@@"]


def _bounded(a: Column, b: Column, score: Column) -> Column:
    """Two empty strings score 1, one 0."""
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(score)


def edit(a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def hamming(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    pad = lambda c: F.split(F.rpad(c, n, F.lit(" ")), "")
    apart = F.size(F.filter(F.zip_with(pad(a), pad(b), lambda x, y: x != y), lambda v: v))
    return F.when(n == 0, 1.0).otherwise(1.0 - apart / F.greatest(n, F.lit(1)))


def prefix_length(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = F.array_position(same, False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(end > 0, end - 1).otherwise(F.least(F.length(a), F.length(b))).cast("int")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence by one machine-integer row of bits per character (Hyyro 2004)."""
    full = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _run(a: str, b: str) -> int:
    """Length of the longest common substring, growing the best length at each end."""
    best = 0
    for i in range(len(a)):
        while i - best >= 0 and a[i - best : i + 1] in b:
            best += 1
    return best


def _damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2)] + [[top, *range(len(b) + 1)]] + [[top, i + 1] + [0] * len(b) for i in range(len(a))]
    for i, x in enumerate(a, 1):
        col = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), col
            if x == y:
                col = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _winkler(a: str, b: str) -> float:
    j = _jaro(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + 0.1 * same * (1 - j) if j > 0.7 else j


def _size(x: str) -> int:
    return len(gzip.compress(x.encode(), 9, mtime=0))


def _ncd(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    one, two = _size(a), _size(b)
    both = min(_size(f"{a}|{b}"), _size(f"{b}|{a}"))
    return min(1.0, max(0.0, 1 - (both - min(one, two)) / max(one, two)))


def _arrow(kind: str, f):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return run


def lcs_length(a: Column, b: Column) -> Column:
    return _arrow("int", _lcs)(a, b)


def substring_length(a: Column, b: Column) -> Column:
    return _arrow("int", _run)(a, b)


def nlcs(a: Column, b: Column) -> Column:
    n = lcs_length(a, b).cast("double")
    return _bounded(a, b, n * n / F.greatest(F.length(a) * F.length(b), F.lit(1)))


def lcs_substring(a: Column, b: Column) -> Column:
    n = substring_length(a, b).cast("double")
    return _bounded(a, b, n * n / F.greatest(F.length(a) * F.length(b), F.lit(1)))


def clcs(a: Column, b: Column, w1: float = 0.33, w2: float = 0.33, w3: float = 0.34) -> Column:
    if abs(w1 + w2 + w3 - 1) > 1e-9:
        import warnings

        warnings.warn("the weights don't add up to 1", stacklevel=2)
    sq = lambda c: c.cast("double") * c.cast("double")
    top = F.lit(w1) * sq(lcs_length(a, b)) + F.lit(w2) * sq(prefix_length(a, b)) + F.lit(w3) * sq(substring_length(a, b))
    return _bounded(a, b, top / F.greatest(F.length(a) * F.length(b), F.lit(1)))


def damerau(a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).otherwise(1.0 - _arrow("int", _damerau)(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def jaro(a: Column, b: Column) -> Column:
    return _arrow("double", _jaro)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _arrow("double", _winkler)(a, b)


def ncd(a: Column, b: Column) -> Column:
    return _arrow("double", _ncd)(a, b)


def smifp(s: Column, chars: list[str], binary: bool = False) -> Column:
    """Counts, or presence, of each listed character; a listed pair of characters never matches one."""
    def count(c: str) -> Column:
        left = F.length(F.replace(s, F.lit(c), F.lit("")))
        return (F.length(s) - (left if len(c) == 1 else F.length(s))).cast("double")

    counts = F.array(*map(count, chars))
    return F.transform(counts, lambda x: F.when(x > 0, 1.0).otherwise(0.0)) if binary else counts


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def cityblock(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def tanimoto(a: Column, b: Column) -> Column:
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p * q))
    low = dot(a, a) + dot(b, b) - dot(a, b)
    return F.when((dot(a, a) == 0) & (dot(b, b) == 0), 1.0).when(low == 0, 0.0).otherwise(dot(a, b) / low)
