"""Episodes, replay buffers and sampling diagnostics.

Steps of an episode are ordered by a column within an environment or chain;
recurrences run over one such group at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordered


def segments(df: DataFrame, env: Sequence[str], order_by: str, *ends: str, name: str = "segment") -> DataFrame:
    """``df`` with the number of each step's episode: it ends after a step where one of ``ends`` is true."""
    over = any_true(*ends)
    before = Window.partitionBy(*env).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(over.cast("int")).over(before), F.lit(0)))


def any_true(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c), F.lit(False))
    return out


def _recurrence(df: DataFrame, env: Sequence[str], order_by: str, outputs: Sequence[str], f) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns), *(f"{c} double" for c in outputs)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_by, kind="stable").reset_index(drop=True)
        return pdf.assign(**dict(zip(outputs, f(pdf), strict=True)))

    return df.groupBy(*env).applyInPandas(run, schema)


def returns(df: DataFrame, env: Sequence[str], order_by: str, reward: str = "reward", terminated: str = "terminated", truncated: str = "truncated", gamma: float = 0.99, name: str = "return") -> DataFrame:
    """Discounted rewards to come, anew after each end of an episode."""

    def f(pdf):
        r, end = pdf[reward].to_numpy(float), (pdf[terminated] | pdf[truncated]).to_numpy(bool)
        out, acc = np.zeros(len(r)), 0.0
        for t in range(len(r) - 1, -1, -1):
            acc = r[t] + gamma * acc * (not end[t])
            out[t] = acc
        return [out]

    return _recurrence(df, env, order_by, [name], f)


def gae(df: DataFrame, env: Sequence[str], order_by: str, reward: str = "reward", value: str = "value", next_value: str | None = None, terminated: str = "terminated", truncated: str = "truncated", gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Generalised advantage estimates: columns advantage and return (advantage + value).

    A terminated step is worth nothing after it; a truncated one is worth its
    next value. Without ``next_value`` that is the value of the following step.
    """

    def f(pdf):
        r, v = pdf[reward].to_numpy(float), pdf[value].to_numpy(float)
        after = pdf[next_value].to_numpy(float) if next_value else np.append(v[1:], 0.0)
        done, cut = pdf[terminated].to_numpy(bool), pdf[truncated].to_numpy(bool)
        out, acc = np.zeros(len(r)), 0.0
        for t in range(len(r) - 1, -1, -1):
            delta = r[t] + gamma * after[t] * (not done[t]) - v[t]
            acc = delta + gamma * lam * acc * (not (done[t] or cut[t]))
            out[t] = acc
        return [out, out + v]

    return _recurrence(df, env, order_by, ["advantage", "return"], f)


def normalize(df: DataFrame, column: str, name: str | None = None, eps: float = 1e-8) -> DataFrame:
    """Centred and scaled by the population deviation: two sums, then a map."""
    m = df.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    out = (F.col(column) - F.col("__m")) / (F.col("__s") + eps)
    return df.crossJoin(F.broadcast(m)).withColumn(name or column, out).drop("__m", "__s")  # one row


def episode_stats(df: DataFrame, keys: Sequence[str], reward: str = "reward") -> DataFrame:
    """One row: the episodes, mean and deviation of their rewards, and their mean length."""
    by = df.groupBy(*keys).agg(F.sum(reward).alias("total"), F.count("*").alias("steps"))
    return by.agg(F.count("*").alias("episodes"), F.avg("total").alias("mean_reward"), F.stddev_pop("total").alias("std_reward"), F.avg("steps").alias("mean_length"))


# --- replay buffer ------------------------------------------------------------


class ReplayBuffer:
    """The last ``capacity`` transitions by an order column."""

    def __init__(self, capacity: int, order_by: str, frame: DataFrame | None = None) -> None:
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity, self.order_by, self.frame = capacity, order_by, frame

    def add(self, rows: DataFrame) -> ReplayBuffer:
        both = rows if self.frame is None else self.frame.unionByName(rows)
        return ReplayBuffer(self.capacity, self.order_by, both.orderBy(F.desc(self.order_by)).limit(self.capacity))

    def clear(self) -> ReplayBuffer:
        return ReplayBuffer(self.capacity, self.order_by, None if self.frame is None else self.frame.limit(0))

    def size(self) -> int:
        return 0 if self.frame is None else self.frame.count()

    def is_full(self) -> bool:
        return self.size() == self.capacity

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        """Uniform with replacement: as many rows as asked for, but no more than there are."""
        size = self.size()
        if not size:
            raise ValueError("the buffer is empty")
        drawn = self.frame.sparkSession.range(min(n, size)).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size)).alias("__i"))
        return ordered.with_row_index(self.frame, self.order_by, "__i").join(F.broadcast(drawn), "__i").drop("__i")


# --- sampling diagnostics -----------------------------------------------------


def autocorrelation_ess(x: np.ndarray) -> float:
    """Effective sample size of one series: pairs of autocorrelations are summed while positive."""
    n = len(x)
    if n < 4:
        return float(n)
    d = x - x.mean()
    size = 1 << (2 * n - 1).bit_length()
    power = np.abs(np.fft.rfft(d, size)) ** 2
    acf = np.fft.irfft(power, size)[:n]
    if acf[0] <= 0:
        return float(n)
    rho = acf / acf[0]
    tau = 1.0
    for k in range(1, n - 1, 2):
        pair = rho[k] + rho[k + 1]
        if pair < 0:
            break
        tau += 2 * pair
    return float(n / max(tau, 1e-12))


def ess(df: DataFrame, keys: Sequence[str], order_by: str, value: str) -> DataFrame:
    """(keys, ess) of each parameter's series."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "ess double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order_by)[value].to_numpy(float)
        return pdf.iloc[:1][list(keys)].assign(ess=autocorrelation_ess(x))

    return df.groupBy(*keys).applyInPandas(run, schema)


def rhat(df: DataFrame, param: Sequence[str], chain: str, order_by: str, value: str) -> DataFrame:
    """Split R-hat of each parameter, from moments of the chains' halves: aggregates only."""
    w = Window.partitionBy(*param, chain).orderBy(order_by)
    n = F.count("*").over(Window.partitionBy(*param, chain))
    half = F.floor(n / 2)
    halves = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__h", half).where(F.col("__i") < 2 * F.col("__h"))
    by = halves.groupBy(*param, chain, (F.col("__i") >= F.col("__h")).alias("__second")).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    all_ = by.groupBy(*param).agg(F.var_samp("m").alias("b"), F.avg("v").alias("w"), F.avg("n").alias("n"))
    pooled = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")
    return all_.select(*param, F.sqrt(F.try_divide(pooled, F.col("w"))).alias("rhat"))


def hmc(df_chains: DataFrame, log_density, gradient, start: Sequence[float], samples: int, step: float = 0.1, leaps: int = 10, warmup: int = 100, seed: int = 0) -> DataFrame:
    """(chain, step, param, value): Hamiltonian Monte Carlo, one chain a task.

    ``df_chains`` has a column chain. The two functions take a numpy vector.
    """

    def leapfrog(q, p):
        p = p + 0.5 * step * gradient(q)
        for k in range(leaps):
            q = q + step * p
            p = p + step * gradient(q) * (1.0 if k < leaps - 1 else 0.5)
        return q, p

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["chain"].iloc[0])
        rng = np.random.default_rng([seed, c])
        q, rows = np.array(start, float), []
        for s in range(-warmup, samples):
            p = rng.standard_normal(len(q))
            q2, p2 = leapfrog(q, p)
            if np.log(rng.random()) < log_density(q2) - log_density(q) - 0.5 * (p2 @ p2 - p @ p):
                q = q2
            if s >= 0:
                rows += [(c, s, i, float(x)) for i, x in enumerate(q)]
        return pd.DataFrame(rows, columns=["chain", "step", "param", "value"])

    return df_chains.groupBy("chain").applyInPandas(run, "chain long, step long, param long, value double")
