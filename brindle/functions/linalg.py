"""Linear algebra and transforms of one matrix or signal a row, in Arrow batches with numpy.

A matrix is an array of rows. A matrix that can't be factored gives null.
Tall tables don't fit a row: ``least_squares`` solves these from sums that Spark makes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATRIX, VECTOR = "array<array<double>>", "array<double>"
COMPLEX = "array<struct<re:double,im:double>>"


def _matrix(x) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in x], float)


def _rows(m: np.ndarray) -> list:
    return np.atleast_2d(m).astype(float).tolist()


def _udf(kind: str, f: Callable, n: int = 1):
    """A pandas UDF that applies ``f`` to each row's arguments; null for null and for failures of the algebra."""

    def one(*args):
        if any(a is None for a in args):
            return None
        try:
            return f(*args)
        except np.linalg.LinAlgError:
            return None

    def run(*columns):
        # Made when it is used: tasks import this module without a session.
        if n == 1:

            @F.pandas_udf(kind)
            def call(a: pd.Series) -> pd.Series:
                return pd.Series([one(x) for x in a], dtype=object)
        else:

            @F.pandas_udf(kind)
            def call(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return call(*(F.col(c) if isinstance(c, str) else c for c in columns))

    return run


cholesky = _udf(MATRIX, lambda a: _rows(np.linalg.cholesky(_matrix(a))))
qr_q = _udf(MATRIX, lambda a: _rows(np.linalg.qr(_matrix(a))[0]))
qr_r = _udf(MATRIX, lambda a: _rows(np.linalg.qr(_matrix(a))[1]))
svd_u = _udf(MATRIX, lambda a: _rows(np.linalg.svd(_matrix(a), full_matrices=False)[0]))
svd_vt = _udf(MATRIX, lambda a: _rows(np.linalg.svd(_matrix(a), full_matrices=False)[2]))
svdvals = _udf(VECTOR, lambda a: np.linalg.svd(_matrix(a), compute_uv=False).tolist())
eigvalsh = _udf(VECTOR, lambda a: np.linalg.eigvalsh(_matrix(a)).tolist())
eigh_vectors = _udf(MATRIX, lambda a: _rows(np.linalg.eigh(_matrix(a))[1]))
eigvals = _udf(COMPLEX, lambda a: [{"re": float(z.real), "im": float(z.imag)} for z in np.linalg.eigvals(_matrix(a)).astype(complex)])
inv = _udf(MATRIX, lambda a: _rows(np.linalg.inv(_matrix(a))))
pinv = _udf(MATRIX, lambda a: _rows(np.linalg.pinv(_matrix(a))))
det = _udf("double", lambda a: float(np.linalg.det(_matrix(a))))
matrix_rank = _udf("int", lambda a: int(np.linalg.matrix_rank(_matrix(a))))
cond = _udf("double", lambda a: float(np.linalg.cond(_matrix(a))))
solve = _udf(VECTOR, lambda a, b: np.linalg.solve(_matrix(a), np.asarray(b, float)).tolist(), 2)
lstsq = _udf(VECTOR, lambda a, b: np.linalg.lstsq(_matrix(a), np.asarray(b, float), rcond=None)[0].tolist(), 2)
norm_nuc = _udf("double", lambda a: float(np.linalg.norm(_matrix(a), "nuc")))
norm_2 = _udf("double", lambda a: float(np.linalg.norm(_matrix(a), 2)))

def slogdet(a) -> Column:
    @F.pandas_udf("sign double, logdet double")
    def call(m: pd.Series) -> pd.DataFrame:
        found = [np.linalg.slogdet(_matrix(x)) if x is not None else (None, None) for x in m]
        return pd.DataFrame([tuple(x) for x in found], columns=["sign", "logdet"])

    return call(F.col(a) if isinstance(a, str) else a)


def least_squares(df: DataFrame, features: Sequence[str], target: str, intercept: bool = True) -> np.ndarray:
    """Coefficients of a tall table: the normal equations' sums by Spark in one pass, a small solve on the driver."""
    xs = [F.col(c).cast("double") for c in features] + ([F.lit(1.0)] if intercept else [])
    n = len(xs)
    y = F.col(target).cast("double")
    sums = [F.sum(xs[i] * xs[j]) for i in range(n) for j in range(i, n)] + [F.sum(x * y) for x in xs]
    got = list(df.agg(*sums).first())
    gram = np.zeros((n, n))
    gram[np.triu_indices(n)] = got[: n * (n + 1) // 2]
    gram = gram + np.triu(gram, 1).T
    return np.linalg.lstsq(gram, np.array(got[n * (n + 1) // 2 :], float), rcond=None)[0]


# --- transforms ---------------------------------------------------------------


def _pairs(z) -> list:
    return [{"re": float(v.real), "im": float(v.imag)} for v in np.asarray(z, complex)]


def _complex(x) -> np.ndarray:
    return np.array([complex(v["re"], v["im"]) for v in x])


fft = _udf(COMPLEX, lambda x: _pairs(np.fft.fft(np.asarray(x, float))))
rfft = _udf(COMPLEX, lambda x: _pairs(np.fft.rfft(np.asarray(x, float))))
ifft = _udf(COMPLEX, lambda x: _pairs(np.fft.ifft(_complex(x))))
irfft = _udf(VECTOR, lambda x: np.fft.irfft(_complex(x)).tolist())
hfft = _udf(VECTOR, lambda x: np.fft.hfft(_complex(x)).tolist())
ihfft = _udf(COMPLEX, lambda x: _pairs(np.fft.ihfft(np.asarray(x, float))))
COMPLEX_MATRIX = f"array<{COMPLEX}>"


def _complex_rows(z: np.ndarray) -> list:
    return [_pairs(r) for r in np.atleast_2d(z)]


def _complex_matrix(x) -> np.ndarray:
    return np.array([_complex(r) for r in x])


fft2 = _udf(COMPLEX_MATRIX, lambda x: _complex_rows(np.fft.fft2(_matrix(x))))
ifft2 = _udf(COMPLEX_MATRIX, lambda x: _complex_rows(np.fft.ifft2(_complex_matrix(x))))
rfft2 = _udf(COMPLEX_MATRIX, lambda x: _complex_rows(np.fft.rfft2(_matrix(x))))


def irfft2(x, cols: int | None = None) -> Column:
    """``cols``: the columns of the result, twice those of ``x`` less two if not given."""
    return _udf(MATRIX, lambda m: _rows(np.fft.irfft2(z := _complex_matrix(m), s=(len(z), cols or 2 * (z.shape[1] - 1)))))(x)


def fftn(x, shape: Sequence[int]) -> Column:
    """Of a tensor of ``shape`` as a flat array, last axis fastest; the result is flat too."""
    return _udf(COMPLEX, lambda v: _pairs(np.fft.fftn(np.asarray(v, float).reshape(shape)).ravel()))(x)


def ifftn(x, shape: Sequence[int]) -> Column:
    return _udf(COMPLEX, lambda v: _pairs(np.fft.ifftn(_complex(v).reshape(shape)).ravel()))(x)


def rfftn(x, shape: Sequence[int]) -> Column:
    return _udf(COMPLEX, lambda v: _pairs(np.fft.rfftn(np.asarray(v, float).reshape(shape)).ravel()))(x)


def irfftn(x, shape: Sequence[int]) -> Column:
    """``shape`` is that of the result."""
    half = (*shape[:-1], shape[-1] // 2 + 1)
    return _udf(VECTOR, lambda v: np.fft.irfftn(_complex(v).reshape(half), s=tuple(shape), axes=tuple(range(len(shape)))).ravel().tolist())(x)


fft2_abs = _udf(MATRIX, lambda x: _rows(np.abs(np.fft.fft2(_matrix(x)))))


def _cosine(n: int, kind: int) -> np.ndarray:
    """The matrix of the cosine transform of a kind, 1 to 4."""
    k, m = np.arange(n)[:, None], np.arange(n)[None, :]
    if kind == 1:
        w = np.where((m == 0) | (m == n - 1), 1.0, 2.0)
        return w * np.cos(np.pi * k * m / max(n - 1, 1))
    if kind == 2:
        return 2 * np.cos(np.pi * k * (2 * m + 1) / (2 * n))
    if kind == 3:
        return np.where(m == 0, 1.0, 2.0) * np.cos(np.pi * (2 * k + 1) * m / (2 * n))
    return 2 * np.cos(np.pi * (2 * k + 1) * (2 * m + 1) / (4 * n))


def _sine(n: int, kind: int) -> np.ndarray:
    k, m = np.arange(n)[:, None], np.arange(n)[None, :]
    if kind == 1:
        return 2 * np.sin(np.pi * (k + 1) * (m + 1) / (n + 1))
    if kind == 2:
        return 2 * np.sin(np.pi * (k + 1) * (2 * m + 1) / (2 * n))
    if kind == 3:
        return np.where(m == n - 1, np.where(k % 2 == 0, 1.0, -1.0), 2 * np.sin(np.pi * (2 * k + 1) * (m + 1) / (2 * n)))
    return 2 * np.sin(np.pi * (2 * k + 1) * (2 * m + 1) / (4 * n))


def _transform(matrix, inverse: bool):
    def make(kind: int = 2):
        def f(x):
            x = np.asarray(x, float)
            m = matrix(len(x), kind)
            return (np.linalg.solve(m, x) if inverse else m @ x).tolist()

        return _udf(VECTOR, f)

    return make


def _transform_nd(matrix, inverse: bool):
    def make(x, shape: Sequence[int], kind: int = 2) -> Column:
        """Along every axis of a tensor of ``shape``, as a flat array."""

        def f(v):
            out = np.asarray(v, float).reshape(shape)
            for axis, n in enumerate(shape):
                m = matrix(n, kind)
                out = np.moveaxis(np.tensordot(np.linalg.inv(m) if inverse else m, out, (1, axis)), 0, axis)
            return out.ravel().tolist()

        return _udf(VECTOR, f)(x)

    return make


dctn, idctn = _transform_nd(_cosine, False), _transform_nd(_cosine, True)
dstn, idstn = _transform_nd(_sine, False), _transform_nd(_sine, True)
dct, idct = _transform(_cosine, False), _transform(_cosine, True)
dst, idst = _transform(_sine, False), _transform(_sine, True)


def fftfreq(n: int, d: float = 1.0) -> Column:
    half = (n - 1) // 2 + 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < half, i).otherwise(i - n) / F.lit(n * d))


def rfftfreq(n: int, d: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda i: i / F.lit(n * d))


def fftshift(a, n: int) -> Column:
    from .arrays import roll

    return roll(a, n // 2)


def ifftshift(a, n: int) -> Column:
    from .arrays import roll

    return roll(a, -(n // 2))
