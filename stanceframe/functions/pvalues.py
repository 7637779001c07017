"""Tail probabilities (FUN-1, FUN-2) as Arrow-batched pandas UDFs.

Spark SQL has neither an incomplete beta nor ``erf``, so these are the only
numeric Python workers in the library.  They always run on already-aggregated
rows (one per question pair / feature-question), never on raw cells.

* ``p_from_r(r, n)``: two-sided p of a Pearson/Spearman/point-biserial r with
  ``n - 2`` degrees of freedom.  With t = r*sqrt(df/(1-r^2)) the t tail is the
  regularized incomplete beta ``I_{1-r^2}(df/2, 1/2)``, evaluated by the
  modified Lentz continued fraction.
* ``p_from_z(z)``: two-sided normal p, ``erfc(|z|/sqrt(2))`` capped at 1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300
_EPS = 1e-15


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction for the incomplete beta (modified Lentz), vectorized."""
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    max_iter = int(200 + 10 * math.sqrt(float(np.max(np.maximum(a, b))) + 1.0))
    for m in range(1, max_iter + 1):
        m2 = 2.0 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < _EPS):
            break
    return h


def betainc_reg(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta I_x(a, b) for arrays (x in [0, 1])."""
    a = np.asarray(a, float)
    b = np.asarray(b, float)
    x = np.asarray(x, float)
    out = np.full(x.shape, np.nan)
    out[x <= 0.0] = 0.0
    out[x >= 1.0] = 1.0
    mid = (x > 0.0) & (x < 1.0)
    if not mid.any():
        return out
    am, bm, xm = a[mid], b[mid], x[mid]
    ln_front = (_lgamma(am + bm) - _lgamma(am) - _lgamma(bm)
                + am * np.log(xm) + bm * np.log1p(-xm))
    front = np.exp(ln_front)
    direct = xm < (am + 1.0) / (am + bm + 2.0)
    res = np.empty(xm.shape)
    if direct.any():
        res[direct] = front[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
    flip = ~direct
    if flip.any():
        res[flip] = 1.0 - front[flip] * _betacf(bm[flip], am[flip], 1.0 - xm[flip]) / bm[flip]
    out[mid] = res
    return out


def t_two_sided_from_r(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p for a correlation r on n pairs (df = n - 2)."""
    r = np.clip(np.asarray(r, float), -1.0, 1.0)
    df = np.asarray(n, float) - 2.0
    out = np.full(r.shape, np.nan)
    ok = np.isfinite(r) & (df > 0)
    if ok.any():
        out[ok] = betainc_reg(df[ok] / 2.0, np.full(ok.sum(), 0.5), 1.0 - r[ok] * r[ok])
    return np.clip(out, 0.0, 1.0)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, float)
    out = np.full(z.shape, np.nan)
    ok = ~np.isnan(z)
    if ok.any():
        out[ok] = _erfc(np.abs(z[ok]) / math.sqrt(2.0))
    return np.minimum(out, 1.0)


@F.pandas_udf(DoubleType())
def _p_from_r_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    rv = r.astype("float64").to_numpy(na_value=np.nan)
    nv = n.astype("float64").to_numpy(na_value=np.nan)
    res = t_two_sided_from_r(rv, nv)
    return pd.Series(res).where(~np.isnan(res), None)


@F.pandas_udf(DoubleType())
def _p_from_z_udf(z: pd.Series) -> pd.Series:
    zv = z.astype("float64").to_numpy(na_value=np.nan)
    res = normal_two_sided(zv)
    return pd.Series(res).where(~np.isnan(res), None)


def p_from_r(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of correlation ``r`` over ``n`` observations (NULL if r is NULL)."""
    r = F.col(r) if isinstance(r, str) else r
    n = F.col(n) if isinstance(n, str) else n
    return F.when(r.isNull() | (n < 3), F.lit(None).cast("double")).otherwise(
        _p_from_r_udf(r.cast("double"), n.cast("double")))


def p_from_z(z: Column | str) -> Column:
    """Two-sided standard-normal p-value (NULL if z is NULL)."""
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z.isNull(), F.lit(None).cast("double")).otherwise(_p_from_z_udf(z.cast("double")))
