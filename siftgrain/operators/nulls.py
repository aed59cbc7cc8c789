"""Null laws of rank tests (§2: H3, H6, M10): exact where samples are small and ranks differ, else the normal law.

Signed ranks: exact for at most 50 pairs without ties or zeros. Rank sums: exact
where the smaller side has at most 8 rows, n1 * n0 is at most 100,000 and no
values tie; else normal with ties in the variance and, for rank sums, half a
step of continuity.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The sizes up to which laws are exact.
MOST_PAIRS, MOST_SIDE, MOST_CELLS = 50, 8, 100_000


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(maxsize=64)
def signed_rank_cdf(n: int) -> np.ndarray:
    """P(W <= w) for w from 0 to n (n + 1) / 2, by adding a rank at a time."""
    ways = np.ones(1)
    for rank in range(1, n + 1):
        ways = np.r_[ways, np.zeros(rank)] + np.r_[np.zeros(rank), ways]
    return np.cumsum(ways) / 2.0**n


@lru_cache(maxsize=256)
def rank_sum_cdf(n1: int, n0: int) -> np.ndarray:
    """P(U <= u) for u from 0 to n1 n0: counts are the coefficients of a Gaussian binomial, worked out in whole numbers."""
    n1, n0 = min(n1, n0), max(n1, n0)
    ways = [1] + [0] * (n1 * n0)
    for i in range(1, n1 + 1):
        for u in range(n1 * n0, n0 + i - 1, -1):
            ways[u] -= ways[u - n0 - i]
        for u in range(i, n1 * n0 + 1):
            ways[u] += ways[u - i]
    total, below, out = math.comb(n1 + n0, n1), 0, []
    for x in ways:
        below += x
        out.append(below / total)
    return np.array(out)


def tail(cdf: np.ndarray, x: int, alternative: str) -> float:
    less, greater = float(cdf[x]), float(1 - cdf[x - 1]) if x else 1.0
    return {"less": less, "greater": greater, "two-sided": min(1.0, 2 * min(less, greater))}[alternative]


def signed_rank(w_plus: float, n: int, z: float, ties: float, zeros: int, alternative: str = "two-sided") -> float:
    """p that positive differences rank no higher (less), no lower (greater) or the same."""
    if n <= MOST_PAIRS and not ties and not zeros:
        return tail(signed_rank_cdf(int(n)), int(w_plus), alternative)
    return {"less": 1 - normal_sf(z), "greater": normal_sf(z), "two-sided": min(1.0, 2 * normal_sf(abs(z)))}[alternative]


def rank_sum(u1: float, n1: int, n0: int, ties: float, alternative: str = "two-sided") -> float:
    """p that values of the first side are no greater (less), no smaller (greater) or the same."""
    if min(n1, n0) <= MOST_SIDE and n1 * n0 <= MOST_CELLS and not ties:
        return tail(rank_sum_cdf(int(n1), int(n0)), int(u1), alternative)
    n, mean = n1 + n0, n1 * n0 / 2
    sigma = math.sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if not sigma:
        return 1.0
    return {"less": 1 - normal_sf((u1 - mean + 0.5) / sigma), "greater": normal_sf((u1 - mean - 0.5) / sigma), "two-sided": min(1.0, 2 * normal_sf(max(abs(u1 - mean) - 0.5, 0) / sigma))}[alternative]


def signed_rank_p(alternative: str = "two-sided", w_plus: str = "w_plus", n: str = "n", z: str = "z", ties: str = "ties", zeros: str = "zeros") -> Column:
    """``signed_rank`` of each row of a report; null without a difference."""

    @F.pandas_udf(DoubleType())
    def p(w: pd.Series, n: pd.Series, z: pd.Series, t: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([signed_rank(a, int(b), c, d, e, alternative) if pd.notna(b) and b > 0 else None for a, b, c, d, e in zip(w, n, z, t, o, strict=True)], dtype=float)

    return p(w_plus, n, z, ties, zeros)


def rank_sum_p(alternative: str = "two-sided", u1: str = "u1", n1: str = "n1", n0: str = "n0", ties: str = "ties") -> Column:
    """``rank_sum`` of each row of a report; null where a side is empty."""

    @F.pandas_udf(DoubleType())
    def p(u: pd.Series, a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([rank_sum(w, int(x), int(y), z, alternative) if pd.notna(w) and x > 0 and y > 0 else None for w, x, y, z in zip(u, a, b, t, strict=True)], dtype=float)

    return p(u1, n1, n0, ties)
