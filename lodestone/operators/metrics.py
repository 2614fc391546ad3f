"""Model metrics over columns of true values and predictions: one aggregation for any number of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import need, quoted, running_sums


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def expressions(y: Column, p: Column, positive: object = 1) -> dict[str, Column]:
    """The metrics that are one aggregate of (true, predicted)."""
    yes, hit = y == F.lit(positive), p == F.lit(positive)
    tp, fp, tn, fn = F.count_if(yes & hit), F.count_if(~yes & hit), F.count_if(~yes & ~hit), F.count_if(yes & ~hit)
    precision, recall = _zero(F.try_divide(tp, tp + fp)), _zero(F.try_divide(tp, tp + fn))
    a, b, c, d = (x.cast("double") for x in (tp, fp, tn, fn))
    yd, pd = y.cast("double"), p.cast("double")
    gap = yd - pd
    return {
        "accuracy": F.avg((y == p).cast("double")),
        "precision": precision,
        "recall": recall,
        "f1_score": _zero(F.try_divide(2 * precision * recall, precision + recall)),
        "matthews_corrcoef": _zero(F.try_divide(a * c - b * d, F.sqrt((a + b) * (a + d) * (c + b) * (c + d)))),
        "mse": F.avg(gap * gap),
        "rmse": F.sqrt(F.avg(gap * gap)),
        "mae": F.avg(F.abs(gap)),
        "r2": 1 - F.try_divide(F.sum(gap * gap), F.var_pop(yd) * F.count(yd)),
        "tp": tp,
        "fp": fp,
        "tn": tn,
        "fn": fn,
    }


SUPPORTED = ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "roc_auc", "matthews_corrcoef", "mse", "rmse", "mae", "r2", "tp", "fp", "tn", "fn")


def balanced_accuracy(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Mean recall of the classes that occur."""
    per = df.select(quoted(true).alias("y"), quoted(predicted).alias("p")).dropna().groupBy("y").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("r"))
    return per.agg(F.avg("r").alias("balanced_accuracy"))


def roc_auc(df: DataFrame, true: str, score: str, positive: object = 1) -> DataFrame:
    """Area under the ROC curve by rank sums: scores are counted first, and ties share a rank."""
    rows = df.select((quoted(true) == F.lit(positive)).alias("y"), quoted(score).cast("double").alias("s")).dropna()
    by = rows.groupBy("s").agg(F.count("*").alias("c"), F.count_if("y").alias("up"))
    ranked = running_sums(by, "s", ["c"])
    rank = F.col("c_upto") - F.col("c") + (F.col("c") + 1) / 2
    sums = ranked.agg(F.sum("up").alias("n1"), (F.sum("c") - F.sum("up")).alias("n0"), F.sum(rank * F.col("up")).alias("r"))
    return sums.select(F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("roc_auc"))


def calculate(df: DataFrame, true: str, predicted: str, metrics: Sequence[str], positive: object = 1, score: str | None = None) -> DataFrame:
    """One row with a column for each metric (`mcc` is matthews_corrcoef); rows with a null on either side are out.
    roc_auc takes `score`, or the predictions."""
    need(df, [true, predicted])
    metrics = ["matthews_corrcoef" if m == "mcc" else m for m in metrics]
    unknown = [m for m in metrics if m not in SUPPORTED]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}; there are {SUPPORTED}")
    known = expressions(F.col("y"), F.col("p"), positive)
    plain = [m for m in metrics if m in known]
    out = df.select(quoted(true).alias("y"), quoted(predicted).alias("p")).dropna().agg(F.count("*").alias("n"), *[known[m].alias(m) for m in plain])
    if "balanced_accuracy" in metrics:
        out = out.crossJoin(balanced_accuracy(df, true, predicted))
    if "roc_auc" in metrics:
        out = out.crossJoin(roc_auc(df, true, score or predicted, positive))
    return out.select("n", *metrics)


def by_fold(df: DataFrame, fold: str, true: str, predicted: str, metrics: Sequence[str], positive: object = 1) -> DataFrame:
    """The metrics of each fold (those that are one aggregate)."""
    known = expressions(quoted(true), quoted(predicted), positive)
    return df.where(quoted(true).isNotNull() & quoted(predicted).isNotNull()).groupBy(quoted(fold).alias("fold")).agg(*[known[m].alias(m) for m in metrics])


def fold_summary(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, std (population), min, max) over folds, nulls left out."""
    one = per_fold.agg(*[F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.min(F.col(m).cast("double")).alias("min"), F.max(F.col(m).cast("double")).alias("max")).alias(f"m{k}") for k, m in enumerate(metrics)])
    return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")
