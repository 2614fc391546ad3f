"""Outlier flags: `<column>_<method>_pass` is true for rows that pass, missing values among them.

Statistics are aggregated once over all columns, exact quantiles in a few passes (relational.quantiles); the flags are
one projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import student_t_ppf
from .relational import need, quantiles, quoted


def _number(column: str) -> Column:
    x = quoted(column).cast("double")
    return F.when(~F.isnan(x), x)


def _flagged(df: DataFrame, columns: Sequence[str], method: str, outlying: dict[str, Column], stats: DataFrame | None = None) -> DataFrame:
    wide = df if stats is None else df.crossJoin(F.broadcast(stats))
    names = [f"{c}_{method}_pass" for c in columns]
    return wide.select(*[quoted(c) for c in df.columns if c not in names], *[(~F.coalesce(outlying[c], F.lit(False))).alias(n) for c, n in zip(columns, names, strict=True)])


def zscore(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """|x - mean| / std over threshold fails; a zero std passes all."""
    need(df, columns)
    stats = df.agg(*[f(_number(c)).alias(f"_{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    return _flagged(df, columns, "zscore", {c: F.abs(F.try_divide(_number(c) - F.col(f"_m{k}"), F.col(f"_s{k}"))) > threshold for k, c in enumerate(columns)}, stats)


def modified_zscore(df: DataFrame, columns: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """0.6745 |x - median| / MAD over threshold fails; a zero MAD passes all. Both medians are exact."""
    need(df, columns)
    medians = [q[0] for q in quantiles(df, [_number(c) for c in columns], [0.5])]
    off = [F.abs(_number(c) - F.lit(m).cast("double")) for c, m in zip(columns, medians, strict=True)]
    spread = [q[0] for q in quantiles(df, off, [0.5])]
    return _flagged(df, columns, "modified_zscore", {c: 0.6745 * F.try_divide(x, F.lit(d).cast("double")) > threshold for c, x, d in zip(columns, off, spread, strict=True)})


def iqr(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Outside [Q1 - k IQR, Q3 + k IQR] fails, with linear quantiles; under four values raise."""
    need(df, columns)
    counts = df.agg(*[F.count(_number(c)) for c in columns]).first()
    if min(counts) < 4:
        raise ValueError("at least 4 values are needed for quartiles")
    edges = [(q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)) for q1, q3 in quantiles(df, [_number(c) for c in columns], [0.25, 0.75])]
    return _flagged(df, columns, "iqr", {c: (_number(c) < low) | (_number(c) > high) for c, (low, high) in zip(columns, edges, strict=True)})


def grubbs_critical(n: int, alpha: float) -> float:
    t = student_t_ppf(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def grubbs_statistics(df: DataFrame, column: str) -> DataFrame:
    """n, mean, std and g = max |x - mean| / std, in one row."""
    x = _number(column)
    base = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return base.select("n", "mean", "std", F.try_divide(F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")), "std").alias("g"))


def grubbs(df: DataFrame, columns: Sequence[str], order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """The single most extreme row (the first in order among equals) fails if its statistic is over the critical
    value."""
    need(df, [*columns, *order])
    out = df
    for c in columns:
        row = grubbs_statistics(df, c).first()
        name = f"{c}_grubbs_pass"
        out = out.drop(name)
        if row.n is None or row.n < 3 or not row.std or row.g <= grubbs_critical(row.n, alpha):
            out = out.withColumn(name, F.lit(True))
            continue
        x = _number(c)
        worst = df.agg(F.max_by(F.struct(*[quoted(o) for o in order]), F.struct(F.abs(x - F.lit(row["mean"])))).alias("k")).first().k
        ties = df.where(F.abs(x - F.lit(row["mean"])) == F.lit(abs(df.where(_same(order, worst)).select(x).first()[0] - row["mean"])))
        first = ties.agg(F.min(F.struct(*[quoted(o) for o in order])).alias("k")).first().k
        out = out.withColumn(name, ~_same(order, first))
    return out


def _same(order: Sequence[str], key) -> Column:
    same = F.lit(True)
    for k, o in enumerate(order):
        same = same & quoted(o).eqNullSafe(F.lit(key[k]))
    return same


def gesd_steps(n: int, total: float, squares: float, low: list[float], high: list[float], max_outliers: int, alpha: float) -> list[tuple[float, float, float]]:
    """(value, R, critical value) of each removal. The most extreme value is always the least or largest that is left,
    so the tails and three sums are enough."""
    steps, low, high = [], sorted(low), sorted(high, reverse=True)
    for i in range(1, max_outliers + 1):
        if n - i + 1 < 3 or not low or not high:
            break
        left = n - i + 1
        mean = total / left
        std = math.sqrt(max(0.0, (squares - left * mean * mean) / (left - 1)))
        if std == 0:
            break
        value = high[0] if high[0] - mean >= mean - low[0] else low[0]
        r = abs(value - mean) / std
        t = student_t_ppf(1 - alpha / (2 * left), n - i - 1)
        steps.append((value, r, (n - i) * t / math.sqrt((n - i - 1 + t * t) * left)))
        (high if value == high[0] else low).pop(0)
        total, squares = total - value, squares - value * value
    return steps


def gesd(df: DataFrame, columns: Sequence[str], order: Sequence[str], max_outliers: int = 10, alpha: float = 0.05) -> DataFrame:
    """Generalised extreme studentised deviates (Rosner): up to max_outliers rows fail; of equal values the first in
    order. Only the max_outliers values of each tail come to the driver."""
    need(df, [*columns, *order])
    out = df
    for c in columns:
        name = f"{c}_gesd_pass"
        clean = df.select(_number(c).alias("x"), *[quoted(o) for o in order]).where("x is not null")
        centre = clean.agg(F.avg("x").alias("m")).first().m
        out = out.drop(name)
        if centre is None:
            out = out.withColumn(name, F.lit(True))
            continue
        moved = clean.withColumn("y", F.col("x") - F.lit(centre))  # keeps the sums well conditioned
        sums = moved.agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).first()
        keys = [quoted(o) for o in order]
        low, high = (moved.orderBy(by, *keys).limit(max_outliers).collect() for by in (F.asc("y"), F.desc("y")))
        steps = gesd_steps(sums.n, sums.s, sums.q, [r.y for r in low], [r.y for r in high], max_outliers, alpha)
        last = max((i for i, (_, r, critical) in enumerate(steps, 1) if r > critical), default=0)
        removed, gone = [v for v, _, _ in steps[:last]], F.lit(False)
        for v in set(removed):
            rows = [r for r in (high if v >= 0 else low) if r.y == v][: removed.count(v)]
            for r in rows:
                gone = gone | _same(order, [r[o] for o in order])
        out = out.withColumn(name, ~gone)
    return out


def outlier_count(flagged: DataFrame, method: str) -> DataFrame:
    """total_outliers: rows that fail in any column."""
    names = [c for c in flagged.columns if c.endswith(f"_{method}_pass")]
    failed = F.lit(False)
    for n in names:
        failed = failed | ~quoted(n)
    return flagged.agg(F.count_if(failed).alias("total_outliers"))
