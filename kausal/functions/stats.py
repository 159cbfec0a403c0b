"""Guarded correlation, partial correlation, Fisher's z and normal tails as Columns.

Spark orders NaN above every number, so each comparison with a value that may be NaN is guarded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Products and denominators up to this count as zero; correlations are clipped to this.
TINY, CLIP = 1e-8, 0.999999999

# Coefficients of Cody's rational approximations of erf and erfc (1969), highest power first.
ERF_P = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MID_P = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
MID_Q = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
FAR_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
FAR_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _horner(x: Column, c: Sequence[float]) -> Column:
    out = F.lit(c[0])
    for v in c[1:]:
        out = out * x + F.lit(v)
    return out


def erfc(x: Column) -> Column:
    """erfc for x >= 0."""
    small = 1.0 - x * _horner(x * x, ERF_P) / _horner(x * x, ERF_Q)
    mid = F.exp(-x * x) * _horner(x, MID_P) / _horner(x, MID_Q)
    y = 1.0 / F.greatest(x * x, F.lit(1.0))
    far = F.exp(-x * x) / F.greatest(x, F.lit(1.0)) * (1 / math.sqrt(math.pi) - y * _horner(y, FAR_P) / _horner(y, FAR_Q))
    return F.when(x <= 0.46875, small).when(x <= 4.0, mid).otherwise(far)


def guarded_corr(n: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from centred sums: 0 under two rows or for a norm product up to TINY, clipped; NaN passes."""
    norms = F.sqrt(sxx) * F.sqrt(syy)
    r = sxy / norms
    clipped = F.when(F.isnan(r), F.lit(float("nan"))).otherwise(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), r)))
    return F.when((n < 2) | (~F.isnan(norms) & (norms <= TINY)), F.lit(0.0)).otherwise(clipped)


def fisher_z(rho: Column, n: Column | int, k: Column | int) -> Column:
    """Fisher's z statistic; 0 where the conditioning set is too large for n, infinite where |rho| >= 1."""
    n, k = (v if isinstance(v, Column) else F.lit(v) for v in (n, k))
    z = 0.5 * F.sqrt(F.greatest(n - k - 3, F.lit(0)).cast("double")) * F.ln((1.0 + rho) / (1.0 - rho))
    return F.when(k >= n - 2, F.lit(0.0)).when(F.isnan(rho), F.lit(float("nan"))).when(F.abs(rho) >= 1.0, F.lit(float("inf"))).otherwise(z)


def p_value(z: Column) -> Column:
    """Two-sided normal tail of |z|."""
    return F.when(F.isnan(z), z).otherwise(F.when(F.abs(z) > 40, F.lit(0.0)).otherwise(erfc(F.abs(z) / math.sqrt(2.0))))


def critical_z(alpha: float) -> float:
    """|z| up to this is independence (p >= alpha); infinite for alpha <= 0, negative for alpha > 1."""
    if alpha <= 0:
        return math.inf
    if alpha > 1:
        return -1.0
    return NormalDist().inv_cdf(1 - alpha / 2)


def independent(z: Column, alpha: float) -> Column:
    """The verdict p >= alpha; NaN is not independent."""
    zc = critical_z(alpha)
    if math.isinf(zc):
        return ~F.isnan(z)
    return ~F.isnan(z) & (F.abs(z) <= zc)


def z_statistic(rho: np.ndarray, n: int, k: int) -> np.ndarray:
    """Fisher's z of an array, as fisher_z gives it."""
    if k >= n - 2:
        return np.zeros(len(rho))
    with np.errstate(all="ignore"):
        z = 0.5 * math.sqrt(max(n - k - 3, 0)) * np.log((1.0 + rho) / (1.0 - rho))
    return np.where(np.isnan(rho), np.nan, np.where(np.abs(rho) >= 1.0, np.inf, z))


@dataclass(frozen=True)
class CITest:
    """A conditional-independence test on a matrix of correlations. statistic: of an array of partial correlations, n and k,
    which is independence up to the critical value of the normal distribution; columns: (rho, n, k, alpha) to the same as
    Columns (z, verdict); matrix: what makes (DataFrame, columns) the matrix, None for plain correlations."""

    statistic: Callable[[np.ndarray, int, int], np.ndarray]
    columns: Callable[..., tuple[Column, Column]]
    matrix: Callable | None = None


_tests: dict[str, CITest] = {}


def register_test(name: str, test: CITest) -> None:
    """Makes a test known by name."""
    _tests[name] = test


def ci_test(name: str) -> CITest:
    if name not in _tests:
        raise ValueError(f"Unknown test {name}; known are {', '.join(sorted(_tests))}")
    return _tests[name]


def fisher_columns(rho: Column, n: Column | int, k: Column | int, alpha: float) -> tuple[Column, Column]:
    z = fisher_z(rho, n, k)
    return z, independent(z, alpha)


register_test("fisher_z", CITest(z_statistic, fisher_columns))
