"""Images in long form: one row a pixel (image, y, x, r, g, b or v), values 0 to 1.

Point operations are projections. Neighbourhood operations join each pixel to
the kernel's offsets and sum by the target, so an image of any size spreads
over tasks; what lies outside counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AT = ("image", "y", "x")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


# --- points -------------------------------------------------------------------


def to_float(v) -> Column:
    return _c(v) / 255.0


def to_uint8(v) -> Column:
    """Clamped and truncated."""
    return (_unit(_c(v)) * 255).cast("int")


def normalize(v, mean: float, std: float) -> Column:
    return (_c(v) - mean) / std


def threshold(v, t: float) -> Column:
    return F.when(_c(v) > t, 1.0).otherwise(0.0)


def to_grayscale(r="r", g="g", b="b") -> Column:
    return 0.299 * _c(r) + 0.587 * _c(g) + 0.114 * _c(b)


def adjust_brightness(v, factor: float) -> Column:
    return _unit(_c(v) * factor)


def adjust_gamma(v, gamma: float) -> Column:
    return F.pow(_c(v), F.lit(gamma))


def invert(v) -> Column:
    return 1.0 - _c(v)


def adjust_contrast(df: DataFrame, factor: float, channels: Sequence[str] = ("v",)) -> DataFrame:
    """About each channel's mean over all pixels."""
    means = F.broadcast(df.agg(*(F.avg(c).alias(f"__{c}") for c in channels)))  # one row
    return df.crossJoin(means).withColumns({c: _unit(F.col(f"__{c}") + (F.col(c) - F.col(f"__{c}")) * factor) for c in channels}).drop(*(f"__{c}" for c in channels))


def rgb_to_hsv(df: DataFrame) -> DataFrame:
    """Columns h, s, v for r, g, b; all from 0 to 1."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    sector = F.when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    h = F.when(d == 0, 0.0).otherwise(sector / 6)
    s = F.when(top == 0, 0.0).otherwise(d / top)
    return df.withColumns({"h": h, "s": s, "v": top}).drop("r", "g", "b")


def hsv_to_rgb(df: DataFrame) -> DataFrame:
    h, s, v = F.col("h"), F.col("s"), F.col("v")

    def channel(n: int) -> Column:
        k = F.pmod(h * 6 + n, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return df.withColumns({"r": channel(5), "g": channel(3), "b": channel(1)}).drop("h", "s", "v")


def adjust_saturation(df: DataFrame, factor: float) -> DataFrame:
    return hsv_to_rgb(rgb_to_hsv(df).withColumn("s", _unit(F.col("s") * factor)))


def adjust_hue(df: DataFrame, delta: float) -> DataFrame:
    h = F.col("h") + delta
    return hsv_to_rgb(rgb_to_hsv(df).withColumn("h", h - F.floor(h)))


# --- geometry -----------------------------------------------------------------


def crop(df: DataFrame, y: int, x: int, height: int, width: int) -> DataFrame:
    inside = (F.col("y") >= y) & (F.col("y") < y + height) & (F.col("x") >= x) & (F.col("x") < x + width)
    return df.where(inside).withColumns({"y": F.col("y") - y, "x": F.col("x") - x})


def center_crop(df: DataFrame, full_height: int, full_width: int, height: int, width: int) -> DataFrame:
    return crop(df, (full_height - height) // 2, (full_width - width) // 2, height, width)


def hflip(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("x", width - 1 - F.col("x"))


def vflip(df: DataFrame, height: int) -> DataFrame:
    return df.withColumn("y", height - 1 - F.col("y"))


def rotate90(df: DataFrame, height: int, width: int, times: int = 1) -> DataFrame:
    """Counter-clockwise."""
    for _ in range(times % 4):
        df = df.withColumns({"y": width - 1 - F.col("x"), "x": F.col("y")})
        height, width = width, height
    return df


def pad(df: DataFrame, top: int, left: int) -> DataFrame:
    """Room before the pixels; absent ones are 0."""
    return df.withColumns({"y": F.col("y") + top, "x": F.col("x") + left})


def resize(df: DataFrame, height: int, width: int, new_height: int, new_width: int, bilinear: bool = False) -> DataFrame:
    """Of (image, y, x, v): each new pixel from its nearest one, or from four with weights."""
    spark = df.sparkSession
    grid = spark.range(new_height * new_width).select(F.floor(F.col("id") / new_width).cast("int").alias("ny"), (F.col("id") % new_width).cast("int").alias("nx"))
    if not bilinear:
        at = grid.select("ny", "nx", F.floor(F.col("ny") * height / new_height).cast("int").alias("y"), F.floor(F.col("nx") * width / new_width).cast("int").alias("x"), F.lit(1.0).alias("w"))
    else:
        fy = F.greatest(F.least((F.col("ny") + 0.5) * height / new_height - 0.5, F.lit(height - 1.0)), F.lit(0.0))
        fx = F.greatest(F.least((F.col("nx") + 0.5) * width / new_width - 0.5, F.lit(width - 1.0)), F.lit(0.0))
        base = grid.withColumns({"fy": fy, "fx": fx})
        parts = []
        for dy in (0, 1):
            for dx in (0, 1):
                y, x = F.floor("fy") + dy, F.floor("fx") + dx
                w = (1 - F.abs(F.col("fy") - y)) * (1 - F.abs(F.col("fx") - x))
                parts.append(base.select("ny", "nx", y.cast("int").alias("y"), x.cast("int").alias("x"), w.alias("w")))
        at = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    joined = df.join(F.broadcast(at) if new_height * new_width <= 1_000_000 else at, ["y", "x"])
    return joined.groupBy("image", F.col("ny").alias("y"), F.col("nx").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


# --- neighbourhoods: (image, y, x, v) -----------------------------------------


def _neighbours(df: DataFrame, offsets: Sequence[tuple[int, int, float]]) -> DataFrame:
    """Each pixel once for every target whose window it is in, with its weight."""
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in offsets))
    spread = df.select(*_AT, "v", F.explode(moves).alias("m"))
    return spread.select("image", (F.col("y") - F.col("m.dy")).alias("y"), (F.col("x") - F.col("m.dx")).alias("x"), "v", F.col("m.w").alias("w"))


def _offsets(kernel: Sequence[Sequence[float]]) -> list[tuple[int, int, float]]:
    h, w = len(kernel), len(kernel[0])
    return [(i - h // 2, j - w // 2, kernel[i][j]) for i in range(h) for j in range(w)]


def _at_pixels(df: DataFrame, found: DataFrame) -> DataFrame:
    return df.select(*_AT).join(found, list(_AT), "left").select(*_AT, F.coalesce("v", F.lit(0.0)).alias("v"))


def filter2d(df: DataFrame, kernel: Sequence[Sequence[float]]) -> DataFrame:
    summed = _neighbours(df, [o for o in _offsets(kernel) if o[2]]).groupBy(*_AT).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return _at_pixels(df, summed)


def box_blur(df: DataFrame, size: int) -> DataFrame:
    return filter2d(df, [[1 / size**2] * size] * size)


def gaussian_kernel(sigma: float, size: int | None = None) -> list[float]:
    size = size or 2 * round(3 * sigma) + 1
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def gaussian_blur(df: DataFrame, sigma: float, size: int | None = None) -> DataFrame:
    """Two passes, as the kernel is separable."""
    k = gaussian_kernel(sigma, size)
    return filter2d(filter2d(df, [k]), [[x] for x in k])


def unsharp_mask(df: DataFrame, sigma: float = 1.0, amount: float = 1.0) -> DataFrame:
    blurred = gaussian_blur(df, sigma).withColumnRenamed("v", "__b")
    return df.join(blurred, list(_AT)).select(*_AT, _unit(F.col("v") + amount * (F.col("v") - F.col("__b"))).alias("v"))


def median_blur(df: DataFrame, size: int) -> DataFrame:
    """Of whole windows; missing neighbours are 0."""
    cells = _neighbours(df, _offsets([[1.0] * size] * size)).groupBy(*_AT).agg(F.collect_list("v").alias("vs"))
    filled = F.array_sort(F.concat("vs", F.array_repeat(F.lit(0.0), F.lit(size * size) - F.size("vs"))))
    return _at_pixels(df, cells.select(*_AT, F.get(filled, size * size // 2).alias("v")))


def structuring_element(shape: str, size: int) -> list[list[int]]:
    """``rect``, ``cross`` or ``ellipse``."""
    c = size // 2
    test = {"rect": lambda i, j: True, "cross": lambda i, j: i == c or j == c, "ellipse": lambda i, j: (i - c) ** 2 + (j - c) ** 2 <= (c + 0.5) ** 2}[shape]
    return [[int(test(i, j)) for j in range(size)] for i in range(size)]


def _morph(df: DataFrame, element, fold) -> DataFrame:
    active = [o for o in _offsets(element) if o[2]]
    return _at_pixels(df, _neighbours(df, active).groupBy(*_AT).agg(fold("v").alias("v")))


def erode(df: DataFrame, element) -> DataFrame:
    return _morph(df, element, F.min)


def dilate(df: DataFrame, element) -> DataFrame:
    return _morph(df, element, F.max)


def opening(df: DataFrame, element) -> DataFrame:
    return dilate(erode(df, element), element)


def closing(df: DataFrame, element) -> DataFrame:
    return erode(dilate(df, element), element)


def morphological_gradient(df: DataFrame, element) -> DataFrame:
    low = erode(df, element).withColumnRenamed("v", "__e")
    return dilate(df, element).join(low, list(_AT)).select(*_AT, (F.col("v") - F.col("__e")).alias("v"))


# Fixed kernels.
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SCHARR_X = [[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]]
LAPLACIAN = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]


def _gradients(df: DataFrame, kernel) -> DataFrame:
    """(image, y, x, gx, gy)."""
    gx = filter2d(df, kernel).withColumnRenamed("v", "gx")
    gy = filter2d(df, [list(r) for r in zip(*kernel, strict=True)]).withColumnRenamed("v", "gy")
    return gx.join(gy, list(_AT))


def sobel(df: DataFrame) -> DataFrame:
    return _gradients(df, SOBEL_X)


def scharr(df: DataFrame) -> DataFrame:
    return _gradients(df, SCHARR_X)


def laplacian(df: DataFrame) -> DataFrame:
    return filter2d(df, LAPLACIAN)
