"""Scalar functions with IEEE results: division by zero, logarithms and NaN as in floating point, not as in SQL.

A null argument gives null. Booleans from comparisons follow IEEE too: NaN equals nothing.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _d(x) -> Column:
    return _c(x).cast("double")


# --- arithmetic ---------------------------------------------------------------


def add(a, b) -> Column:
    return _c(a) + _c(b)


def sub(a, b) -> Column:
    return _c(a) - _c(b)


def mul(a, b) -> Column:
    return _c(a) * _c(b)


def div(a, b) -> Column:
    """Floating division; x/0 is infinite with the sign of x, 0/0 NaN."""
    a, b = _d(a), _d(b)
    by_zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, F.when(is_negative_zero(b), -INF).otherwise(INF)).otherwise(F.when(is_negative_zero(b), INF).otherwise(-INF))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def is_negative_zero(x) -> Column:
    return (_d(x) == 0) & (_d(x).cast("string") == "-0.0")


def round_to(x, digits: int) -> Column:
    """To decimal digits; the sign of zero stays, as do values that aren't finite."""
    x = _d(x)
    rounded = F.round(x, digits)
    return F.when(isfinite(x), F.when(rounded == 0, x * 0.0).otherwise(rounded)).otherwise(x)


def int_div(a, b) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", _c(a), _c(b))


def mod(a, b) -> Column:
    """The remainder, with the sign of the dividend."""
    return _c(a) % _c(b)


def pow_(a, b) -> Column:
    return F.pow(_d(a), _d(b))


def neg(a) -> Column:
    return -_c(a)


def abs_(a) -> Column:
    return F.abs(_c(a))


def sign(a) -> Column:
    return F.signum(_d(a))


def square(a) -> Column:
    return _c(a) * _c(a)


def sqrt(a) -> Column:
    return F.sqrt(_d(a))


def recip(a) -> Column:
    return div(F.lit(1.0), a)


def rsqrt(a) -> Column:
    return div(F.lit(1.0), F.sqrt(_d(a)))


def _log(a, f) -> Column:
    a = _d(a)
    return F.when(F.isnan(a) | (a < 0), NAN).when(a == 0, -INF).otherwise(f(a))


def log(a) -> Column:
    return _log(a, F.ln)


def log2(a) -> Column:
    return _log(a, F.log2)


def exp(a) -> Column:
    return F.exp(_d(a))


def exp2(a) -> Column:
    return F.pow(F.lit(2.0), _d(a))


sin, cos, tan = (lambda a, f=f: f(_d(a)) for f in (F.sin, F.cos, F.tan))
asin, acos, atan = (lambda a, f=f: f(_d(a)) for f in (F.asin, F.acos, F.atan))
sinh, cosh, tanh = (lambda a, f=f: f(_d(a)) for f in (F.sinh, F.cosh, F.tanh))
asinh, acosh, atanh = (lambda a, f=f: f(_d(a)) for f in (F.asinh, F.acosh, F.atanh))


def atan2(y, x) -> Column:
    return F.atan2(_d(y), _d(x))


def hypot(a, b) -> Column:
    return F.hypot(_d(a), _d(b))


def _whole(a, f) -> Column:
    """Rounding that keeps what a long can't hold, NaN and infinities."""
    a = _d(a)
    return F.when(F.isnan(a) | (F.abs(a) >= 2.0**52), a).otherwise(f(a).cast("double"))


def floor(a) -> Column:
    return _whole(a, F.floor)


def ceil(a) -> Column:
    return _whole(a, F.ceil)


def trunc(a) -> Column:
    return _whole(a, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def round_(a) -> Column:
    """Half away from zero."""
    return _whole(a, lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))


def lerp(a, b, w) -> Column:
    return _d(a) + _d(w) * (_d(b) - _d(a))


def clamp(a, low=None, high=None) -> Column:
    a = _c(a)
    if low is not None:
        a = maximum(a, low)
    return a if high is None else minimum(a, high)


def erf(a) -> Column:
    """The error function (Arrow batches; Spark has none built in)."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(math.erf, na_action="ignore")

    return run(_d(a))


# --- comparison and logic -----------------------------------------------------


def _ieee(a, b, test: Column) -> Column:
    return test & ~F.isnan(_d(a)) & ~F.isnan(_d(b))


def equal(a, b) -> Column:
    return _ieee(a, b, _c(a) == _c(b))


def not_equal(a, b) -> Column:
    return ~equal(a, b)


def less(a, b) -> Column:
    return _ieee(a, b, _c(a) < _c(b))


def less_equal(a, b) -> Column:
    return _ieee(a, b, _c(a) <= _c(b))


def greater(a, b) -> Column:
    return _ieee(a, b, _c(a) > _c(b))


def greater_equal(a, b) -> Column:
    return _ieee(a, b, _c(a) >= _c(b))


def _either_null(a: Column, b: Column, out: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), out)


def maximum(a, b) -> Column:
    """The larger; NaN if either is."""
    a, b = _c(a), _c(b)
    return _either_null(a, b, F.greatest(a, b))


def minimum(a, b) -> Column:
    a, b = _c(a), _c(b)
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return _either_null(a, b, F.when(nan, NAN).otherwise(F.least(a, b)))


def isnan(a) -> Column:
    return F.isnan(_d(a))


def isinf(a) -> Column:
    return F.abs(_d(a)) == INF


def isfinite(a) -> Column:
    return ~F.isnan(_d(a)) & (F.abs(_d(a)) != INF)


def _true(a) -> Column:
    return _c(a) != 0


def logical_and(a, b) -> Column:
    return _true(a) & _true(b)


def logical_or(a, b) -> Column:
    return _true(a) | _true(b)


def logical_xor(a, b) -> Column:
    return _true(a) != _true(b)


def logical_not(a) -> Column:
    return ~_true(a)


def where(condition, a, b) -> Column:
    return F.when(_c(condition), _c(a)).otherwise(_c(b))


def bitwise_and(a, b) -> Column:
    return _c(a).bitwiseAND(_c(b))


def bitwise_or(a, b) -> Column:
    return _c(a).bitwiseOR(_c(b))


def bitwise_xor(a, b) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def bitwise_not(a) -> Column:
    return F.bitwise_not(_c(a))


def lshift(a, n: int) -> Column:
    return F.shiftleft(_c(a), n)


def rshift(a, n: int) -> Column:
    return F.shiftright(_c(a), n)


# --- activations --------------------------------------------------------------


def relu(a) -> Column:
    return maximum(_d(a), F.lit(0.0))


def leaky_relu(a, slope: float = 0.01) -> Column:
    a = _d(a)
    return F.when(a > 0, a).otherwise(a * slope)


def sigmoid(a) -> Column:
    """Stable for large arguments of either sign."""
    a = _d(a)
    e = F.exp(-F.abs(a))
    return F.when(a >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def gelu(a) -> Column:
    a = _d(a)
    return 0.5 * a * (1 + erf(a / math.sqrt(2)))


def gelu_approx(a) -> Column:
    a = _d(a)
    return 0.5 * a * (1 + F.tanh(math.sqrt(2 / math.pi) * (a + 0.044715 * a * a * a)))


def silu(a) -> Column:
    return _d(a) * sigmoid(a)


def softplus(a) -> Column:
    a = _d(a)
    return F.log1p(F.exp(-F.abs(a))) + F.greatest(a, F.lit(0.0))


# --- random values by key -----------------------------------------------------


def uniform(key, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Uniform in [low, high), fixed by the key and the seed whatever the partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(_c(key), F.lit(seed)), 11)
    return bits.cast("double") * (2.0**-53) * (high - low) + low


def normal(key, seed: int) -> Column:
    """Standard normal by Box-Muller."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(key, seed)))
    return radius * F.cos(uniform(key, seed + 0x5BD1E995) * (2 * math.pi))


def randint(key, seed: int, low: int, high: int) -> Column:
    return (F.floor(uniform(key, seed) * (high - low)) + low).cast("int")


def bernoulli(key, seed: int, p: float) -> Column:
    return uniform(key, seed) < p


def truncated_normal(key, seed: int, low: float, high: float) -> Column:
    """Standard normal between two bounds, by the inverse distribution function (Arrow batches)."""

    @F.pandas_udf("double")
    def draw(u: pd.Series) -> pd.Series:
        from statistics import NormalDist

        d = NormalDist()
        a, b = d.cdf(low), d.cdf(high)
        return u.map(lambda x: min(high, max(low, d.inv_cdf(min(1 - 1e-16, max(1e-300, a + x * (b - a)))))))

    return draw(uniform(key, seed))


def fold_in(key, n) -> Column:
    """A key derived from a key and a number."""
    return F.xxhash64(_c(key), _c(n))
