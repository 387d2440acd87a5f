"""Derivatives of numpy functions, by dual numbers (forward mode), and gradients of sums over tables.

A function is given on the driver; for a loss over a table each task adds up
the gradients of its rows, so a step costs one pass and a vector to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dual:
    """A value and its directional derivative; knows arithmetic and numpy's elementary functions."""

    __array_priority__ = 1000

    def __init__(self, value, tangent) -> None:
        self.value, self.tangent = np.asarray(value, float), np.asarray(tangent, float)

    def __array_ufunc__(self, ufunc, method, *inputs, **options):
        if method != "__call__" or options or ufunc not in _RULES:
            return NotImplemented
        values = [x.value if isinstance(x, Dual) else np.asarray(x, float) for x in inputs]
        tangents = [x.tangent if isinstance(x, Dual) else np.zeros_like(v) for x, v in zip(inputs, values, strict=True)]
        return Dual(ufunc(*values), _RULES[ufunc](*values, *tangents))

    def _op(ufunc, swap=False):  # noqa: N805
        return lambda self, other: ufunc(other, self) if swap else ufunc(self, other)

    __add__, __radd__ = _op(np.add), _op(np.add, True)
    __sub__, __rsub__ = _op(np.subtract), _op(np.subtract, True)
    __mul__, __rmul__ = _op(np.multiply), _op(np.multiply, True)
    __truediv__, __rtruediv__ = _op(np.divide), _op(np.divide, True)
    __pow__, __rpow__ = _op(np.power), _op(np.power, True)

    def __neg__(self):
        return Dual(-self.value, -self.tangent)

    def __getitem__(self, i):
        return Dual(self.value[i], self.tangent[i])

    def __len__(self) -> int:
        return len(self.value)

    def sum(self, axis=None):
        return Dual(self.value.sum(axis), self.tangent.sum(axis))

    def mean(self, axis=None):
        return Dual(self.value.mean(axis), self.tangent.mean(axis))

    def __matmul__(self, other):
        if isinstance(other, Dual):
            return Dual(self.value @ other.value, self.tangent @ other.value + self.value @ other.tangent)
        return Dual(self.value @ other, self.tangent @ other)

    def __rmatmul__(self, other):
        return Dual(other @ self.value, other @ self.tangent)


_RULES = {
    np.add: lambda a, b, da, db: da + db,
    np.subtract: lambda a, b, da, db: da - db,
    np.multiply: lambda a, b, da, db: da * b + a * db,
    np.divide: lambda a, b, da, db: (da * b - a * db) / (b * b),
    np.power: lambda a, b, da, db: b * a ** (b - 1) * da + (a**b * np.log(np.where(a > 0, a, 1)) * db if np.any(db) else 0),
    np.negative: lambda a, da: -da,
    np.exp: lambda a, da: np.exp(a) * da,
    np.log: lambda a, da: da / a,
    np.sqrt: lambda a, da: da / (2 * np.sqrt(a)),
    np.sin: lambda a, da: np.cos(a) * da,
    np.cos: lambda a, da: -np.sin(a) * da,
    np.tanh: lambda a, da: (1 - np.tanh(a) ** 2) * da,
    np.absolute: lambda a, da: np.sign(a) * da,
    np.square: lambda a, da: 2 * a * da,
    np.maximum: lambda a, b, da, db: np.where(a >= b, da, db),
    np.minimum: lambda a, b, da, db: np.where(a <= b, da, db),
}


def _plain(x):
    return (x.value, x.tangent) if isinstance(x, Dual) else (np.asarray(x, float), np.zeros_like(np.asarray(x, float)))


def jvp(f: Callable, x, tangent) -> tuple[np.ndarray, np.ndarray]:
    """(value, derivative along a tangent)."""
    return _plain(f(Dual(x, tangent)))


def jacobian(f: Callable, x) -> np.ndarray:
    x = np.asarray(x, float)
    columns = [jvp(f, x, e)[1] for e in np.eye(x.size).reshape(-1, *x.shape)]
    return np.stack(columns, -1)


def grad(f: Callable, x) -> np.ndarray:
    """Of a scalar function."""
    return jacobian(f, x).reshape(np.shape(x))


def value_and_grad(f: Callable, x) -> tuple[float, np.ndarray]:
    return float(f(np.asarray(x, float))), grad(f, x)


def vjp(f: Callable, x, cotangent) -> np.ndarray:
    return np.tensordot(np.asarray(cotangent, float), jacobian(f, x), np.ndim(cotangent)).reshape(np.shape(x))


def hessian(f: Callable, x, eps: float = 1e-5) -> np.ndarray:
    """Central differences of exact gradients, made symmetric."""
    x = np.asarray(x, float)
    h = np.stack([(grad(f, x + eps * e) - grad(f, x - eps * e)) / (2 * eps) for e in np.eye(x.size)])
    return (h + h.T) / 2


def hvp(f: Callable, x, v, eps: float = 1e-5) -> np.ndarray:
    x, v = np.asarray(x, float), np.asarray(v, float)
    return (grad(f, x + eps * v) - grad(f, x - eps * v)) / (2 * eps)


def check_grads(f: Callable, x, eps: float = 1e-6, tolerance: float = 1e-4) -> bool:
    """Whether the derivatives agree with differences."""
    x = np.asarray(x, float)
    near = np.array([(f(x + eps * e) - f(x - eps * e)) / (2 * eps) for e in np.eye(x.size)])
    return bool(np.allclose(near, grad(f, x).ravel(), rtol=tolerance, atol=tolerance))


def table_gradient(df: DataFrame, columns: Sequence[str], loss: Callable, params: np.ndarray) -> tuple[float, np.ndarray]:
    """(sum of losses, its gradient): ``loss(params, batch)`` sums over the rows of a matrix of the columns."""
    params = np.asarray(params, float)
    n = len(params)

    def run(batches):
        total = np.zeros(n + 1)
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1)
            if len(x):
                total[0] += float(loss(params, x))
                total[1:] += grad(lambda p, x=x: loss(p, x), params)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(total)], ["i", "v"])

    got = df.select(*columns).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(n + 1)
    for r in got:
        out[r["i"]] = r["v"]
    return float(out[0]), out[1:]


def scan(values, f: Callable, start):
    """Along an array column: the state after each element, by a Column function of state and element."""
    none = F.array().cast("array<double>")
    c = F.col(values) if isinstance(values, str) else values
    return F.aggregate(c.cast("array<double>"), none, lambda out, x: F.array_append(out, f(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(float(start))), x)))
