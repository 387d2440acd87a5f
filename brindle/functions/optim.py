"""Learning-rate schedules and optimiser steps as Column expressions.

A parameter table has a row a parameter; a step is a projection over its
gradient and state columns, so it is one map whatever the table's size. Norms
over all parameters are one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- schedules ----------------------------------------------------------------


def constant(value: float) -> Column:
    return F.lit(float(value))


def linear(step, start: float, end: float, steps: int) -> Column:
    s = _c(step)
    return F.when(s >= steps, F.lit(float(end))).otherwise(start + (end - start) * s / steps)


def cosine_decay(step, start: float, steps: int, alpha: float = 0.0) -> Column:
    s = _c(step)
    return F.when(s >= steps, alpha * start).otherwise(start * ((1 - alpha) * 0.5 * (1 + F.cos(s / steps * math.pi)) + alpha))


def exponential_decay(step, start: float, rate: float, steps: int) -> Column:
    return start * F.pow(F.lit(rate), _c(step) / steps)


def polynomial_decay(step, start: float, end: float, steps: int, power: float = 1.0) -> Column:
    share = F.least(_c(step) / steps, F.lit(1.0))
    return end + (start - end) * F.pow(1 - share, F.lit(power))


def warmup_cosine(step, start: float, peak: float, steps: int) -> Column:
    """Up to the peak along half a cosine, then level."""
    s = F.least(_c(step), F.lit(steps))
    return start + (peak - start) * (1 - 0.5 * (1 + F.cos(s / steps * math.pi)))


def warmup_cosine_decay(step, start: float, peak: float, warmup: int, steps: int, end: float = 0.0) -> Column:
    s = _c(step)
    share = F.least((s - warmup) / max(steps - warmup, 1), F.lit(1.0))
    return F.when(s <= warmup, start + (peak - start) * s / max(warmup, 1)).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(share * math.pi)))


def cosine_decay_restarts(step, start: float, period: int, m_mul: float = 1.0) -> Column:
    """Equal periods; the amplitude is multiplied at each restart."""
    s = _c(step)
    cycle = F.floor(s / period)
    return start * F.pow(F.lit(m_mul), cycle) * 0.5 * (1 + F.cos((s % period) / period * math.pi))


def one_cycle(step, peak: float, steps: int, pct_start: float = 0.3, div: float = 25.0, final_div: float = 10_000.0) -> Column:
    s = _c(step)
    up = max(1, int(steps * pct_start))
    share = F.least((s - up) / max(steps - up, 1), F.lit(1.0))
    low, end = peak / div, peak / final_div
    return F.when(s < up, low + (peak - low) * s / up).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(share * math.pi)))


def piecewise_constant(step, boundaries: Sequence[int], values: Sequence[float]) -> Column:
    """``values[i]`` up to and with ``boundaries[i]``, the last one after."""
    if len(values) != len(boundaries) + 1:
        raise ValueError("one value more than boundaries is needed")
    out = F.lit(float(values[-1]))
    for b, v in reversed(list(zip(boundaries, values, strict=False))):
        out = F.when(_c(step) <= b, F.lit(float(v))).otherwise(out)
    return out


def join_schedules(step, parts: Sequence, lengths: Sequence[int]) -> Column:
    """Schedules one after another; each gets the steps since its start."""
    start, out, edges = 0, None, []
    for part, n in zip(parts, lengths, strict=False):
        edges.append((start, start + n, part))
        start += n
    out = parts[-1](_c(step) - (start if len(parts) > len(lengths) else edges[-1][0]))
    for low, high, part in reversed(edges):
        out = F.when(_c(step) < high, part(_c(step) - low)).otherwise(out)
    return out


# --- gradients ----------------------------------------------------------------


def global_norm(df: DataFrame, grad: str = "g") -> DataFrame:
    return df.agg(F.sqrt(F.sum(F.col(grad) * F.col(grad))).alias("norm"))


def clip_by_global_norm(df: DataFrame, limit: float, grad: str = "g") -> DataFrame:
    norm = F.broadcast(global_norm(df, grad))  # one row
    return df.crossJoin(norm).withColumn(grad, F.col(grad) * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(limit), F.col("norm")), F.lit(1.0)))).drop("norm")


def clip_by_value(grad, limit: float) -> Column:
    return F.least(F.greatest(_c(grad), F.lit(-limit)), F.lit(limit))


def all_finite(grad) -> Column:
    g = _c(grad).cast("double")
    return F.bool_and(~F.isnan(g) & (F.abs(g) != float("inf")))


def adjust_loss_scale(scale: float, good: int, finite: bool, every: int = 2000) -> tuple[float, int]:
    """Doubled after ``every`` finite steps in a row, halved after a step that isn't."""
    if not finite:
        return scale / 2, 0
    return (scale * 2, 0) if good + 1 >= every else (scale, good + 1)


# --- steps: columns p (parameter), g (gradient) and state ----------------------


def sgd(df: DataFrame, lr: float, momentum: float = 0.0) -> DataFrame:
    """State: v."""
    v = momentum * F.col("v") + F.col("g")
    return df.withColumns({"v": v, "p": F.col("p") - lr * v})


def adam(df: DataFrame, lr: float, step: int, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.0) -> DataFrame:
    """State: m, v; ``step`` counts from 1. With ``decay`` the decoupled kind."""
    m = b1 * F.col("m") + (1 - b1) * F.col("g")
    v = b2 * F.col("v") + (1 - b2) * F.col("g") * F.col("g")
    move = (m / (1 - b1**step)) / (F.sqrt(v / (1 - b2**step)) + eps)
    return df.withColumns({"m": m, "v": v, "p": F.col("p") - lr * (move + decay * F.col("p"))})


def adamw(df: DataFrame, lr: float, step: int, decay: float = 0.01, **options) -> DataFrame:
    return adam(df, lr, step, decay=decay, **options)


def rmsprop(df: DataFrame, lr: float, decay: float = 0.9, eps: float = 1e-8) -> DataFrame:
    """State: v."""
    v = decay * F.col("v") + (1 - decay) * F.col("g") * F.col("g")
    return df.withColumns({"v": v, "p": F.col("p") - lr * F.col("g") / (F.sqrt(v) + eps)})


def adagrad(df: DataFrame, lr: float, eps: float = 1e-8) -> DataFrame:
    """State: v."""
    v = F.col("v") + F.col("g") * F.col("g")
    return df.withColumns({"v": v, "p": F.col("p") - lr * F.col("g") / (F.sqrt(v) + eps)})


def lion(df: DataFrame, lr: float, b1: float = 0.9, b2: float = 0.99, decay: float = 0.0) -> DataFrame:
    """State: m."""
    move = F.signum(b1 * F.col("m") + (1 - b1) * F.col("g")) + decay * F.col("p")
    return df.withColumns({"m": b2 * F.col("m") + (1 - b2) * F.col("g"), "p": F.col("p") - lr * move})


def radam(df: DataFrame, lr: float, step: int, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """State: m, v. Rectified once the moving average is long enough."""
    m = b1 * F.col("m") + (1 - b1) * F.col("g")
    v = b2 * F.col("v") + (1 - b2) * F.col("g") * F.col("g")
    top = 2 / (1 - b2) - 1
    rho = top - 2 * step * b2**step / (1 - b2**step)
    fair = m / (1 - b1**step)
    if rho > 5:
        r = math.sqrt((rho - 4) * (rho - 2) * top / ((top - 4) * (top - 2) * rho))
        fair = fair * r / (F.sqrt(v / (1 - b2**step)) + eps)
    return df.withColumns({"m": m, "v": v, "p": F.col("p") - lr * fair})


def trust_ratio(df: DataFrame, update: str = "u", eps: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """The update scaled by the norm of the parameters over its own, a tensor (``by``) at a time."""
    norms = df.groupBy(*by).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("__p"), F.sqrt(F.sum(F.col(update) * F.col(update))).alias("__u"))
    ratio = F.when((F.col("__p") > 0) & (F.col("__u") > 0), F.col("__p") / (F.col("__u") + eps)).otherwise(1.0)
    joined = df.join(norms, list(by)) if by else df.crossJoin(F.broadcast(norms))
    return joined.withColumn(update, F.col(update) * ratio).drop("__p", "__u")


def centralize(df: DataFrame, by: Sequence[str], grad: str = "g") -> DataFrame:
    """The gradient less its mean over each row of its tensor."""
    means = df.groupBy(*by).agg(F.avg(grad).alias("__m"))
    return df.join(means, list(by)).withColumn(grad, F.col(grad) - F.col("__m")).drop("__m")


def traced(updates: str | Column, decay: float) -> Column:
    """v = decay * v + u along an array of updates: the values after each step."""
    none = F.array().cast("array<double>")
    return F.aggregate(_c(updates).cast("array<double>"), none, lambda out, u: F.array_append(out, F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0.0)) * decay + u))


# --- chains: transforms of the update column u, which starts as the gradient ----

#: From a frame with p, u and state columns, and the number of the step (from 1), to the same columns.
Transform = Callable[[DataFrame, int], DataFrame]
Rate = float | Callable[[int], Column]


def _rate(rate: Rate, step: int) -> Column:
    return _c(rate(step) if callable(rate) else float(rate))


def chain(*transforms: Transform) -> Transform:
    """One transform after the other, each on the updates of the one before."""
    return lambda df, step: reduce(lambda d, f: f(d, step), transforms, df)


def apply_updates(df: DataFrame, transform: Transform, step: int) -> DataFrame:
    """``df`` (p, g and the state) after a step: p moves by the transformed gradient."""
    out = transform(df.withColumn("u", F.col("g").cast("double")), step)
    return out.withColumn("p", F.col("p") + F.col("u")).drop("u")


def scale(factor: Rate) -> Transform:
    return lambda df, step: df.withColumn("u", F.col("u") * _rate(factor, step))


def scale_by_learning_rate(rate: Rate) -> Transform:
    """Times minus the rate, so that applied updates descend."""
    return lambda df, step: df.withColumn("u", -_rate(rate, step) * F.col("u"))


def add_decayed_weights(rate: Rate = 0.01) -> Transform:
    return lambda df, step: df.withColumn("u", F.col("u") + _rate(rate, step) * F.col("p"))


def clip_updates(limit: float) -> Transform:
    return lambda df, step: df.withColumn("u", clip_by_value("u", limit))


def trace(decay: float = 0.9, nesterov: bool = False, state: str = "t") -> Transform:
    """State: t, the decayed sum of updates."""

    def run(df: DataFrame, step: int) -> DataFrame:
        t = decay * F.col(state) + F.col("u")
        return df.withColumns({state: t, "u": F.col("u") + decay * t if nesterov else t})

    return run


def scale_by_adam(b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> Transform:
    """State: m, v."""

    def run(df: DataFrame, step: int) -> DataFrame:
        m = b1 * F.col("m") + (1 - b1) * F.col("u")
        v = b2 * F.col("v") + (1 - b2) * F.col("u") * F.col("u")
        return df.withColumns({"m": m, "v": v, "u": (m / (1 - b1**step)) / (F.sqrt(v / (1 - b2**step)) + eps)})

    return run


def scale_by_adan(b1: float = 0.98, b2: float = 0.92, b3: float = 0.99, eps: float = 1e-8) -> Transform:
    """State: m, d (moments of gradients and of their differences), n (second moment), prev (the gradient before)."""

    def run(df: DataFrame, step: int) -> DataFrame:
        change = F.col("u") - F.col("prev")
        ahead = F.col("u") + b2 * change
        m = b1 * F.col("m") + (1 - b1) * F.col("u")
        d = b2 * F.col("d") + (1 - b2) * change
        n = b3 * F.col("n") + (1 - b3) * ahead * ahead
        return df.withColumns({"m": m, "d": d, "n": n, "prev": F.col("u"), "u": (m + b2 * d) / (F.sqrt(n) + eps)})

    return run


def scale_by_trust_ratio(by: Sequence[str] = (), eps: float = 1e-6) -> Transform:
    """``by`` tells a tensor's rows."""
    return lambda df, step: trust_ratio(df, "u", eps, by)


def apply_if_finite(inner: Transform, state: Sequence[str], by: Sequence[str] = ()) -> Transform:
    """A step with a NaN or an infinity among a tensor's updates leaves its p and state alone; state ``bad`` counts such steps in a row.

    ``state`` names the state columns of ``inner``. Null updates don't count.
    """

    def run(df: DataFrame, step: int) -> DataFrame:
        out = inner(df.withColumns({f"__old_{s}": F.col(s) for s in state}), step)
        fine = out.groupBy(*by).agg(F.coalesce(all_finite("u"), F.lit(True)).alias("__fine"))
        joined = out.join(fine, list(by)) if by else out.crossJoin(F.broadcast(fine))  # one row
        back = {s: F.when(F.col("__fine"), F.col(s)).otherwise(F.col(f"__old_{s}")) for s in state}
        moved = {"u": F.when(F.col("__fine"), F.col("u")).otherwise(0.0), "bad": F.when(F.col("__fine"), 0).otherwise(F.col("bad") + 1)}
        return joined.withColumns(back | moved).drop("__fine", *(f"__old_{s}" for s in state))

    return run


def lamb(rate: Rate, by: Sequence[str] = (), decay: float = 0.01, **options) -> Transform:
    return chain(scale_by_adam(**options), add_decayed_weights(decay), scale_by_trust_ratio(by), scale_by_learning_rate(rate))


def lars(rate: Rate, by: Sequence[str] = (), momentum: float = 0.9, decay: float = 0.01, nesterov: bool = False) -> Transform:
    return chain(trace(momentum, nesterov), add_decayed_weights(decay), scale_by_trust_ratio(by), scale_by_learning_rate(rate))


def adan(rate: Rate, decay: float = 0.02, **options) -> Transform:
    return chain(scale_by_adan(**options), add_decayed_weights(decay), scale_by_learning_rate(rate))
