"""Vector functions over array columns, as Column expressions of higher-order functions: no shuffle, no Python.

Arrays hold numbers without nulls. Empty arrays give the neutral element of a
sum or product, and null where there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar

NAN = float("nan")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _d(x) -> Column:
    return _c(x).cast("array<double>")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, not once for each element that uses it."""
    return F.get(F.transform(F.array(value), f), 0)


# --- making -------------------------------------------------------------------


def full(n: int, value) -> Column:
    return F.array_repeat(F.lit(value), n)


def zeros(n: int) -> Column:
    return full(n, 0.0)


def ones(n: int) -> Column:
    return full(n, 1.0)


def full_like(a, value) -> Column:
    return F.transform(_c(a), lambda _: F.lit(value))


def arange(start: int, stop: int, step: int = 1) -> Column:
    """Stop exclusive; a step of 0 is an error."""
    if step == 0:
        raise ValueError("step is 0")
    n = max(0, -(-(stop - start) // step))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * step + start) if n else F.array().cast("array<int>")


def linspace(start: float, stop: float, n: int, endpoint: bool = True) -> Column:
    gaps = n - 1 if endpoint else n
    if n <= 0:
        return F.array().cast("array<double>")
    step = (stop - start) / gaps if gaps else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * step)


def logspace(start: float, stop: float, n: int, base: float = 10.0, endpoint: bool = True) -> Column:
    return F.transform(linspace(start, stop, n, endpoint), lambda x: F.pow(F.lit(float(base)), x))


def geomspace(start: float, stop: float, n: int, endpoint: bool = True) -> Column:
    import math

    return F.transform(linspace(math.log(start), math.log(stop), n, endpoint), F.exp)


def one_hot(c, classes: int) -> Column:
    """All 0 for an index out of range."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == _c(c)).cast("byte"))


# --- elementwise --------------------------------------------------------------


def apply(a, f: Callable[[Column], Column]) -> Column:
    return F.transform(_c(a), f)


def apply2(a, b, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(_c(a), _c(b), f)


def where(mask, a, b) -> Column:
    zipped = F.arrays_zip(_c(mask).alias("m"), _c(a).alias("a"), _c(b).alias("b"))
    return F.transform(zipped, lambda t: F.when(t["m"], t["a"]).otherwise(t["b"]))


# --- reductions ---------------------------------------------------------------


def sum_(a) -> Column:
    return F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x)


def prod(a) -> Column:
    return F.aggregate(_d(a), F.lit(1.0), lambda s, x: s * x)


def mean(a) -> Column:
    return F.try_divide(sum_(a), F.size(_c(a)))


def var(a, ddof: int = 0) -> Column:
    """Two-pass variance; NaN if there are too few values."""
    n = F.size(_c(a)) - ddof
    squares = _let(mean(a), lambda m: F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.when(n > 0, F.try_divide(squares, n)).otherwise(NAN)


def std(a, ddof: int = 0) -> Column:
    return F.sqrt(var(a, ddof))


def max_(a) -> Column:
    """NaN if any value is: Spark orders NaN last."""
    return F.array_max(_c(a))


def min_(a) -> Column:
    return F.when(F.exists(_d(a), F.isnan), NAN).otherwise(F.array_min(_c(a)))


def all_(a) -> Column:
    return F.forall(_c(a), lambda x: x != 0)


def any_(a) -> Column:
    return F.exists(_c(a), lambda x: x != 0)


def argmax(a) -> Column:
    """0-based, the first of equals."""
    return F.array_position(_c(a), F.array_max(_c(a))) - 1


def argmin(a) -> Column:
    return F.array_position(_c(a), F.when(F.exists(_d(a), F.isnan), F.array_max(_c(a))).otherwise(F.array_min(_c(a)))) - 1


# --- cumulative ---------------------------------------------------------------


def _safe_last(out: Column) -> Column:
    return F.try_element_at(out, F.lit(-1))


def cumsum(a) -> Column:
    none = F.array().cast("array<double>")
    return F.aggregate(_d(a), none, lambda out, x: F.array_append(out, F.coalesce(_safe_last(out), F.lit(0.0)) + x))


def cumprod(a) -> Column:
    none = F.array().cast("array<double>")
    return F.aggregate(_d(a), none, lambda out, x: F.array_append(out, F.coalesce(_safe_last(out), F.lit(1.0)) * x))


def cummax(a) -> Column:
    none = F.array().cast("array<double>")
    return F.aggregate(_d(a), none, lambda out, x: F.array_append(out, F.greatest(F.coalesce(_safe_last(out), x), x)))


def cummin(a) -> Column:
    none = F.array().cast("array<double>")

    def step(out, x):
        last = F.coalesce(_safe_last(out), x)
        return F.array_append(out, F.when(F.isnan(last) | F.isnan(x), NAN).otherwise(F.least(last, x)))

    return F.aggregate(_d(a), none, step)


# --- sorting ------------------------------------------------------------------


def sort(a, descending: bool = False) -> Column:
    """NaN last ascending, first descending."""
    return F.sort_array(_c(a), asc=not descending)


def argsort(a, descending: bool = False) -> Column:
    """0-based positions in order; equals keep theirs."""
    pairs = F.transform(_d(a), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    if descending:  # NaN first, then large to small
        pairs = F.transform(_d(a), lambda x, i: F.struct(F.when(F.isnan(x), 0).otherwise(1).alias("n"), F.when(F.isnan(x), 0.0).otherwise(-x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def top_k(a, k: int) -> Column:
    return F.slice(sort(a, True), 1, k)


# --- shape and movement -------------------------------------------------------


def reshape(a, rows: int, cols: int) -> Column:
    """A flat array as rows of ``cols``."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(_c(a), i * cols + 1, cols))


def flatten(a) -> Column:
    return F.flatten(_c(a))


def transpose(a) -> Column:
    """Of an array of equally long arrays."""
    m = _c(a)
    return F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))).otherwise(m)


def squeeze(a) -> Column:
    return F.get(_c(a), 0)


def unsqueeze(a) -> Column:
    return F.array(_c(a))


def flip(a) -> Column:
    return F.reverse(_c(a))


def roll(a, n: int) -> Column:
    a = _c(a)
    size = F.size(a)
    k = F.pmod(F.lit(n), F.greatest(size, F.lit(1)))
    return F.when(size > 0, F.concat(F.slice(a, size - k + 1, k), F.slice(a, F.lit(1), size - k))).otherwise(a)


def pad(a, before: int, after: int, value) -> Column:
    return F.concat(F.array_repeat(F.lit(value), before), _c(a), F.array_repeat(F.lit(value), after))


def shrink(a, low: int, high: int) -> Column:
    return F.slice(_c(a), low + 1, high - low)


def tile(a, n: int) -> Column:
    return F.flatten(F.array_repeat(_c(a), n))


def repeat(a, n: int) -> Column:
    return F.flatten(F.transform(_c(a), lambda x: F.array_repeat(x, n)))


def concatenate(*arrays) -> Column:
    return F.concat(*map(_c, arrays))


def stack(*arrays) -> Column:
    return F.array(*map(_c, arrays))


def split(a, sections: int) -> Column:
    """Sections of equal size, the first ones longer by one if it doesn't come out even."""
    n = F.size(_c(a))
    base, extra = F.floor(n / sections).cast("int"), n % sections
    start = lambda i: i * base + F.least(i, extra)
    return F.transform(F.sequence(F.lit(0), F.lit(sections - 1)), lambda i: F.slice(_c(a), start(i) + 1, base + F.when(i < extra, 1).otherwise(0)))


# --- indexing -----------------------------------------------------------------


def get(a, i: int) -> Column:
    """Negative from the end."""
    a = _c(a)
    return F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)


def set_(a, i: int, value) -> Column:
    at = F.lit(i) if i >= 0 else F.size(_c(a)) + i
    return F.transform(_c(a), lambda x, j: F.when(j == at, F.lit(value)).otherwise(x))


def slice_(a, start: int, stop: int, step: int = 1) -> Column:
    """Stop exclusive, negative from the end."""
    a = _c(a)
    n = F.size(a)
    low = F.lit(start) if start >= 0 else n + start
    high = F.least(F.lit(stop) if stop >= 0 else n + stop, n)
    part = F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))
    return part if step == 1 else F.filter(part, lambda _, i: i % step == 0)


def take(a, indices: Column | Sequence[int], mode: str = "raise") -> Column:
    """Values at positions; beyond the ends: an error, wrapped or clipped."""
    a = _c(a)
    ids = F.array(*(F.lit(i) for i in indices)) if isinstance(indices, (list, tuple)) else _c(indices)
    n = F.size(a)
    if mode == "wrap":
        return F.transform(ids, lambda i: F.get(a, F.pmod(i, n)))
    if mode == "clip":
        return F.transform(ids, lambda i: F.get(a, F.greatest(F.lit(0), F.least(i, n - 1))))
    return F.transform(ids, lambda i: F.element_at(a, F.when(i < 0, i).otherwise(i + 1)))


def put(a, indices: Sequence[int], values: Sequence) -> Column:
    """With values set at positions; of repeated positions the last counts."""
    last = dict(zip(indices, values, strict=True))
    out = _c(a)

    def pick(x, i):
        for k, v in last.items():
            x = F.when(i == (k if k >= 0 else F.size(out) + k), F.lit(v)).otherwise(x)
        return x

    return F.transform(out, pick)


def scatter(indices, values, size: int, mode: str = "set", start=0.0) -> Column:
    """An array of ``size`` with values put, or added, at positions."""
    pairs = F.arrays_zip(_c(indices).alias("i"), _d(values).alias("v"))

    def cell(k):
        mine = F.filter(pairs, lambda p: p["i"] == k)
        if mode == "add":
            return F.aggregate(mine, F.lit(float(start)), lambda s, p: s + p["v"])
        return F.coalesce(F.try_element_at(mine, F.lit(-1))["v"], F.lit(float(start)))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell)


def broadcast_to(a, rows: int) -> Column:
    """``rows`` times the array: a matrix of equal rows."""
    return F.array_repeat(_c(a), rows)


def array_equal(a, b) -> Column:
    """Whether sizes and all values are equal (NaN equals nothing); null for a null array."""
    same = F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce((x == y) & ~F.isnan(x.cast("double")), F.lit(False)))
    return (F.size(_c(a)) == F.size(_c(b))) & F.forall(same, lambda s: s)


def categorical(logits, key, seed: int) -> Column:
    """A position drawn with probability softmax(logits), by the largest of logits plus Gumbel noise that the key fixes."""
    noisy = F.transform(_d(logits), lambda x, i: x - F.ln(-F.ln(scalar.uniform(F.xxhash64(_c(key), i), seed) + 2.0**-54)))
    return argmax(noisy)


def compress(a, mask) -> Column:
    kept = F.filter(F.arrays_zip(_c(a).alias("x"), _c(mask).alias("m")), lambda p: p["m"])
    return F.transform(kept, lambda p: p["x"])


def nonzero(a) -> Column:
    """The positions of values other than 0."""
    marked = F.transform(_c(a), lambda x, i: F.when(x != 0, i))
    return F.filter(marked, lambda i: i.isNotNull())


# --- products and norms -------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a, order: float = 2) -> Column:
    a = _d(a)
    if order == 2:
        return F.sqrt(dot(a, a))
    if order == 1:
        return sum_(F.transform(a, F.abs))
    if order == float("inf"):
        return F.array_max(F.transform(a, F.abs))
    if order == float("-inf"):
        return F.array_min(F.transform(a, F.abs))
    return F.pow(sum_(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(float(order))))), F.lit(1.0 / order))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cross(a, b) -> Column:
    """Of vectors of three."""
    a, b = _d(a), _d(b)
    g = lambda v, i: F.get(v, i)
    return F.array(*(g(a, (i + 1) % 3) * g(b, (i + 2) % 3) - g(a, (i + 2) % 3) * g(b, (i + 1) % 3) for i in range(3)))


def outer(a, b) -> Column:
    return F.transform(_d(a), lambda x: F.transform(_d(b), lambda y: x * y))


def matmul(a, b) -> Column:
    """Of small matrices as arrays of rows; large ones belong in the long form."""
    columns = transpose(_c(b).cast("array<array<double>>"))
    return F.transform(_c(a).cast("array<array<double>>"), lambda r: F.transform(columns, lambda c: dot(r, c)))


# --- normalisation ------------------------------------------------------------


def softmax(a, scale: float = 1.0) -> Column:
    a = _d(a)
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    powers = _let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp((x - m) * scale)))
    return _let(powers, lambda e: _let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def logsumexp(a) -> Column:
    a = _d(a)
    return _let(F.array_max(a), lambda m: m + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - m))))


def logmeanexp(a) -> Column:
    return logsumexp(a) - F.ln(F.size(_c(a)))


def log_softmax(a, scale: float = 1.0) -> Column:
    scaled = F.transform(_d(a), lambda x: x * scale) if scale != 1.0 else _d(a)
    return _let(logsumexp(scaled), lambda s: F.transform(scaled, lambda x: x - s))


def standardize(a, eps: float = 1e-5) -> Column:
    return _let(F.struct(mean(a).alias("m"), F.sqrt(var(a) + eps).alias("s")), lambda z: F.transform(_d(a), lambda x: (x - z["m"]) / z["s"]))


# --- windows ------------------------------------------------------------------


def extract_patches(a, size: int, stride: int = 1) -> Column:
    """All whole windows."""
    a = _c(a)
    last = F.size(a) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i + 1, size))


def combine_patches(patches, size: int, stride: int, length: int) -> Column:
    """Patches laid down at their strides, overlaps added."""
    p = _c(patches)
    terms = F.flatten(F.transform(p, lambda w, k: F.transform(w, lambda x, j: F.struct((k * stride + j).alias("i"), x.cast("double").alias("v")))))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.aggregate(F.filter(terms, lambda t: t["i"] == i), F.lit(0.0), lambda s, t: s + t["v"]))


def correlate(a, kernel, padding: str = "valid") -> Column:
    """The kernel slid along, not flipped."""
    k = _d(kernel)
    a = _d(a)
    if padding == "same":
        total = F.size(k) - 1
        left = F.floor(total / 2).cast("int")
        a = F.concat(F.array_repeat(F.lit(0.0), left), a, F.array_repeat(F.lit(0.0), total - left))
    elif padding == "full":
        edge = F.array_repeat(F.lit(0.0), F.size(k) - 1)
        a = F.concat(edge, a, edge)
    last = F.size(a) - F.size(k)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: dot(F.slice(a, i + 1, F.size(k)), k))


def convolve(a, kernel, padding: str = "valid") -> Column:
    return correlate(a, F.reverse(_c(kernel)), padding)


def _filter(a, size: int, stride: int | None, fold) -> Column:
    return F.transform(extract_patches(_d(a), size, stride or size), fold)


def maximum_filter(a, size: int, stride: int | None = None) -> Column:
    """The stride is the size unless one is given."""
    return _filter(a, size, stride, F.array_max)


def minimum_filter(a, size: int, stride: int | None = None) -> Column:
    return _filter(a, size, stride, min_)


def uniform_filter(a, size: int, stride: int | None = None) -> Column:
    return _filter(a, size, stride, mean)
