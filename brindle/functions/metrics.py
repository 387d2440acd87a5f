"""Model evaluation: metrics, losses, batches and histograms, as aggregates.

Predictions are an array column of scores a class; labels are class numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordered
from . import arrays, scalar


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- classification -----------------------------------------------------------


def check_labels(df: DataFrame, predictions: str, label: str) -> None:
    """Raise for an empty table, a null, or a label that is no class."""
    n, bad = df.agg(F.count("*"), F.count_if(F.col(label).isNull() | F.col(predictions).isNull() | (F.col(label) < 0) | (F.col(label) >= F.size(predictions)))).first()
    if not n:
        raise ValueError("there are no rows")
    if bad:
        raise ValueError(f"{bad} rows have no label or one that is no class")


def predicted(predictions) -> Column:
    """The class of the highest score, the lowest of equals."""
    return arrays.argmax(predictions).cast("int")


def accuracy(predictions, label) -> Column:
    return F.avg((predicted(predictions) == _c(label)).cast("double"))


def top_k_accuracy(predictions, label, k: int) -> Column:
    """Whether fewer than ``k`` classes score higher than the label's: ties favour the label."""
    own = F.get(_c(predictions), _c(label))
    return F.avg((F.size(F.filter(_c(predictions), lambda x: x > own)) < k).cast("double"))


def confusion_matrix(df: DataFrame, predictions: str, label: str, classes: int) -> DataFrame:
    """(label, predicted, count) of all pairs of classes, absent ones 0."""
    found = df.select(F.col(label).cast("int").alias("label"), predicted(predictions).alias("predicted")).groupBy("label", "predicted").agg(F.count("*").alias("count"))
    ids = df.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("label"), (F.col("id") % classes).cast("int").alias("predicted"))
    return ids.join(found, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def class_counts(df: DataFrame, predictions: str, label: str, classes: int) -> DataFrame:
    """(class, tp, predicted, actual) of every class, from one pass: no shuffle beyond partial sums."""
    p, y = predicted(predictions), F.col(label)
    sums = [F.struct(F.lit(c).alias("class"), F.count_if((p == c) & (y == c)).alias("tp"), F.count_if(p == c).alias("predicted"), F.count_if(y == c).alias("actual")) for c in range(classes)]
    return df.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def _averaged(counts: DataFrame, top: Column, bottom: Column, average: str) -> DataFrame:
    ratio = F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    if average == "none":
        return counts.select("class", ratio.alias("value"))
    if average == "macro":
        return counts.agg(F.avg(ratio).alias("value"))
    return counts.agg(F.coalesce(F.try_divide(F.sum(top), F.sum(bottom)), F.lit(0.0)).alias("value"))


def precision(df: DataFrame, predictions: str, label: str, classes: int, average: str = "macro") -> DataFrame:
    """Macro averages run over all classes, those without rows as 0; micro pools the counts."""
    return _averaged(class_counts(df, predictions, label, classes), F.col("tp").cast("double"), F.col("predicted"), average)


def recall(df: DataFrame, predictions: str, label: str, classes: int, average: str = "macro") -> DataFrame:
    return _averaged(class_counts(df, predictions, label, classes), F.col("tp").cast("double"), F.col("actual"), average)


def f1(df: DataFrame, predictions: str, label: str, classes: int, average: str = "macro") -> DataFrame:
    return _averaged(class_counts(df, predictions, label, classes), F.col("tp") * 2.0, F.col("actual") + F.col("predicted"), average)


def auc_roc(df: DataFrame, score: str, label: str, rows_a_range: int = ordered.ROWS_A_RANGE) -> DataFrame:
    """Area under the curve by mid-ranks; NaN if a class is missing.

    Scores are counted first, so what is ranked is distinct scores, and the
    running count is cut into ranges.
    """
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) != 0).cast("long")).alias("pos"), F.count("*").alias("n"))
    run = ordered.running(by, "n", "sum", "s", name="upto", rows_a_range=rows_a_range)
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    totals = run.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    area = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    return totals.select(F.coalesce(area, F.lit(float("nan"))).alias("auc"))


# --- losses: values a row; aggregate with F.avg or F.sum ----------------------


def squared_error(prediction, target) -> Column:
    d = _c(prediction) - _c(target)
    return d * d


def absolute_error(prediction, target) -> Column:
    return F.abs(_c(prediction) - _c(target))


def huber(prediction, target, delta: float = 1.0) -> Column:
    if delta <= 0:
        raise ValueError("delta must be positive")
    d = F.abs(_c(prediction) - _c(target))
    return F.when(d <= delta, d * d * 0.5).otherwise((d - delta / 2) * delta)


def sigmoid_bce(logit, target) -> Column:
    z = _c(logit)
    return F.greatest(z, F.lit(0.0)) - z * _c(target) + F.log1p(F.exp(-F.abs(z)))


def softmax_cross_entropy(logits, targets) -> Column:
    return -arrays.dot(arrays.log_softmax(logits), targets)


def softmax_cross_entropy_sparse(logits, label) -> Column:
    return -F.get(arrays.log_softmax(logits), _c(label))


def reduced(loss: Column, reduction: str = "mean") -> Column:
    return {"mean": F.avg, "sum": F.sum, "none": lambda x: x}[reduction](loss)


# --- batches ------------------------------------------------------------------


def batches(df: DataFrame, size: int, order_by: str | Sequence[str], shuffle_seed: int | None = None, drop_last: bool = False, name: str = "batch") -> DataFrame:
    """``df`` with a batch number; in order, or in an order fixed by a seed."""
    if size <= 0:
        raise ValueError("a batch holds a row at least")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if shuffle_seed is not None:
        df = df.withColumn("__order", F.xxhash64(*keys, F.lit(shuffle_seed)))
        keys = ["__order", *keys]
    out = ordered.with_row_index(df, keys, "__i").withColumn(name, F.floor(F.col("__i") / size).cast("long"))
    if drop_last:
        whole = df.count() // size
        out = out.where(F.col(name) < whole)
    return out.drop("__i", "__order")


# --- histograms ---------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 10, low: float | None = None, high: float | None = None, density: bool = False) -> DataFrame:
    """(bin, left, right, count) of equal bins, the last one closed, empty ones 0.

    Values out of range and non-finite ones don't count. With ``density`` also
    the count over all binned values times the width.
    """
    x = F.col(column).cast("double")
    finite = df.where(scalar.isfinite(x))
    if low is None or high is None:
        found = finite.agg(F.min(x), F.max(x)).first()
        low, high = found[0] if low is None else low, found[1] if high is None else high
        if low is None:
            low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((x - low) / width).cast("int"), F.lit(bins - 1))
    counted = finite.where(x.between(low, high)).groupBy(number.alias("bin")).agg(F.count("*").alias("count"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(low) + (F.col("bin") + k) * width
    out = all_bins.join(counted, "bin", "left").select("bin", edge(0).alias("left"), edge(1).alias("right"), F.coalesce("count", F.lit(0)).alias("count"))
    if density:
        out = out.withColumn("density", F.try_divide(F.col("count").cast("double"), F.sum("count").over(Window.partitionBy()) * width))
    return out


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """(x, y, mean) of each cell: what a heat map draws."""
    return df.groupBy(x, y).agg(F.avg(value).alias("mean"))
