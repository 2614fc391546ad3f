"""Duplicates by key: how each group of equal keys should be merged, and merging them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import binomial_tail
from ..plans.tables import materialise
from .relational import group_quantiles, need, numbered, quoted

STRATEGIES = ("unique", "drop", "keep_first", "majority_vote", "mean", "median")
BOOTSTRAPS = 1000


def binary_labels(df: DataFrame, column: str, threshold: float, below: int = 1, above: int = 0) -> DataFrame:
    """`<column>_binary`: below for values up to the threshold, else above, missing values too."""
    need(df, [column])
    x = quoted(column)
    return df.withColumn(f"{column}_binary", F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (x <= threshold), F.lit(below)).otherwise(F.lit(above)))


def _majority(n: int, least: int, alpha: float) -> bool:
    return binomial_tail(least, n) < alpha


def binary_threshold(n: Column, most: Column, alpha: float) -> Column:
    """Whether a majority of `most` in n fair coins is significant (one-sided binomial). Exact: the tail sum
    sum C(n, i) / 2^n is folded from the largest term down, n - most + 1 steps; from 1,000 labels on, the normal tail
    bound decides beyond ten standard deviations, where the sum is below any usable alpha."""
    far = (2 * most - n) > 10 * F.sqrt(n)
    # log of 2^-n, then terms C(n, n), C(n, n-1) = C(n, n) * n / 1, ...
    folded = F.aggregate(
        F.sequence(F.lit(0), (n - most).cast("int")),
        F.struct((-n * F.lit(float(np.log(2)))).cast("double").alias("log"), F.lit(0.0).alias("sum")),
        lambda s, j: F.struct((s["log"] + F.when(j > 0, F.ln((n - j + 1) / F.greatest(j, F.lit(1)))).otherwise(0.0)).cast("double").alias("log"), (s["sum"] + F.exp(s["log"] + F.when(j > 0, F.ln((n - j + 1) / F.greatest(j, F.lit(1)))).otherwise(0.0))).cast("double").alias("sum")),
        lambda s: s["sum"],
    )
    return far | (F.when(~far, folded) < alpha)


#: Weights of the bootstrap: a row of a group counts in a replicate as often as a Poisson variable of mean 1 comes out,
#: which follows from a 32-bit mix of its place in the group and the replicate's number. So sums over rows may be made
#: anywhere and merged, and the same rows give the same decision on any cluster.
_M32 = 0xFFFFFFFF
POISSON = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(10)]


def weights(places: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The weight of each place in each replicate."""
    x = (places.astype(np.uint64)[:, None] * np.uint64(2654435761) + replicates.astype(np.uint64)[None] * np.uint64(2246822519)) & np.uint64(_M32)
    x ^= x >> np.uint64(16)
    x = (x * np.uint64(2246822519)) & np.uint64(_M32)
    x ^= x >> np.uint64(13)
    x = (x * np.uint64(3266489917)) & np.uint64(_M32)
    x ^= x >> np.uint64(16)
    return np.searchsorted(np.array(POISSON, np.uint64), x, side="right").astype(np.float64)


def variations(sums: np.ndarray) -> np.ndarray:
    """Coefficients of variation from the sums of weights, of weighted values and of weighted squares; NaN where fewer
    than two rows were drawn."""
    w, y, square = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = np.sqrt(np.maximum(square - y * y / w, 0) / (w - 1))
        out = np.where(y == 0, np.inf, spread / np.abs(y / w))
    return np.where(w < 2, np.nan, out)


def _upper(cvs: np.ndarray, alpha: float) -> float:
    there = cvs[~np.isnan(cvs)]
    return float(np.percentile(there, 100 * (1 - alpha / 2))) if len(there) else math.inf


def _uppers(sums: np.ndarray, alpha: float) -> list[float]:
    """_upper of the variations of each group's sums (group, sum, replicate)."""
    cvs = variations(sums.transpose(1, 0, 2))
    whole = ~np.isnan(cvs).any(1)
    out = np.empty(len(cvs))
    out[whole] = np.percentile(cvs[whole], 100 * (1 - alpha / 2), axis=1) if whole.any() else 0.0
    for i in np.flatnonzero(~whole):
        out[i] = _upper(cvs[i], alpha)
    return out.tolist()


#: Rows that are weighted at a time, and places whose weights a task keeps: they are the same in all groups.
_ROWS = 1000
_PLACES = 1024


def _known(kept: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The weights of the first places, with those of more of them where they are wanted."""
    most = int(places[places < _PLACES].max(initial=-1))
    return kept if most < len(kept) else np.vstack([kept, weights(np.arange(len(kept), most + 1), numbers)])


def _weighted(kept: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The weights of places, from those kept where all are there: a view, if they follow each other."""
    if places.max() >= len(kept):
        return weights(places, numbers)
    first = int(places[0])
    return kept[first : first + len(places)] if (np.diff(places) == 1).all() else kept[places]


def bootstrap(rows: DataFrame, keys: Sequence[str], replicates: int = BOOTSTRAPS, alpha: float = 0.05) -> DataFrame:
    """(the keys, upper): the 1 - alpha / 2 quantile of the bootstrapped coefficient of variation of each group. rows:
    keys, _at (the place in the group, from 0), y and _size (the group's rows).

    A weight follows from the place and the replicate alone, so a task finds those of the first _PLACES places once, and a
    group's sums are a product of its values and its places' weights.

    A task runs through its rows and keeps three sums a replicate for the group it is in. A group that it has seen whole
    is decided there; of others the sums go on, and are added up by replicate: a group of any size costs a task no more."""
    names, kinds = list(keys), dict(rows.dtypes)
    numbers = np.arange(replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        seen, size, sums = 0, 0, np.zeros((3, replicates))
        whole: list[tuple] = []
        open_: list[tuple] = []
        kept = np.zeros((0, replicates))

        def close() -> None:
            if now is not None:
                (whole if seen == size else open_).append((now, sums))

        def out() -> pa.RecordBatch:
            keys = [k for k, _ in whole + open_]
            upper = (_uppers(np.stack([x for _, x in whole]), alpha) if whole else []) + [None] * len(open_)
            columns = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(upper, pa.float64()), pa.array([None] * len(whole) + [x.tolist() for _, x in open_], pa.list_(pa.list_(pa.float64())))], names=[*names, "upper", "sums"])

        for batch in batches:
            schema = batch.schema
            for low in range(0, len(batch), _ROWS):
                part = batch.slice(low, _ROWS)
                of = list(zip(*(part.column(i).to_pylist() for i in range(len(names))), strict=True))
                at, y, all_ = (part.column(c).to_numpy() for c in ("_at", "y", "_size"))
                kept = _known(kept, at, numbers)
                factors = np.stack([np.ones(len(y)), y, y * y])
                starts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1])]
                for first, last in zip(starts, [*starts[1:], len(of)], strict=True):
                    if of[first] != now:
                        close()
                        now, seen, size, sums = of[first], 0, int(all_[first]), np.zeros((3, replicates))
                    places = at[first:last]
                    seen += last - first
                    sums += factors[:, first:last] @ _weighted(kept, places, numbers)
                if len(whole) + len(open_) > 100:
                    yield out()
                    whole, open_ = [], []
        close()
        if whole or open_:
            yield out()

    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    told = materialise(rows.select(*names, "_at", "y", "_size").mapInArrow(run, f"{schema}, upper double, sums array<array<double>>"))
    at = lambda i, b: F.get(F.get("sums", F.lit(i)), b)
    partial = told.where("sums IS NOT NULL").select(*names, F.posexplode(F.transform(F.get("sums", F.lit(0)), lambda w, b: F.struct(w.alias("w"), at(1, b).alias("y"), at(2, b).alias("z")))).alias("_b", "_s"))
    merged = partial.groupBy(*names, "_b").agg(*[F.sum(F.col("_s")[n]).alias(f"_{n}") for n in "wyz"])
    spread = F.sqrt(F.greatest(F.col("_z") - F.col("_y") * F.col("_y") / F.col("_w"), F.lit(0.0)) / (F.col("_w") - 1))
    cv = F.when(F.col("_w") >= 2, F.when(F.col("_y") == 0, F.lit(math.inf)).otherwise(spread / F.abs(F.col("_y") / F.col("_w"))))
    cut = merged.select(*names, cv.alias("_cv")).groupBy(*names).agg(F.coalesce(F.percentile("_cv", F.lit(1 - alpha / 2)), F.lit(math.inf)).alias("upper"))  # replicates values a group
    return told.where("sums IS NULL").select(*names, "upper").unionByName(cut)


#: Share by which a quotient of sums may pass a bound and still count as at it.
_AT = 1e-12


def regression_conflicts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(the keys, n, conflict) of each combination of keys: merge if its labels agree, else drop: where their population
    deviation is over half of the mean, or their range over three times the mean (in absolute value). A single label,
    and equal ones, agree. Aggregates with partial sums only. Sums differ in their last bits with the order of rows, so
    what is at a bound within a millionth of a millionth is not over it."""
    need(df, [*keys, label])
    x = quoted(label).cast("double")
    y = F.when(~F.isnan(x), x)
    g = df.groupBy(*[quoted(c).alias(c) for c in keys]).agg(F.count(y).alias("n"), F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_s"), (F.max(y) - F.min(y)).alias("_range"))
    far = F.when(F.col("_mean") == 0, F.col("_range") > 0).otherwise(F.col("_s") / F.abs("_mean") > 0.5 * (1 + _AT))
    drop = (F.col("n") > 1) & (far | (F.col("_range") > 3 * (1 + _AT) * F.abs("_mean")))
    return g.select(*[quoted(c) for c in keys], "n", F.when(drop, "drop").otherwise("merge").alias("conflict"))


def _key(columns: Sequence[str]) -> list[Column]:
    return [quoted(c).alias(f"_k{i}") for i, c in enumerate(columns)]


def strategies(df: DataFrame, keys: Sequence[str], label: str | None = None, binary: bool = True, alpha: float = 0.05, cv_threshold: float = 0.3, order: Sequence[str] = (), replicates: int = BOOTSTRAPS) -> DataFrame:
    """(_k0, ..., n, n_labels, merge_strategy, strategy_reason) of each combination of keys.

    A combination of one row is unique; one with a null in the first key is dropped, as is, without labels, any
    repeated one. Binary labels: equal ones keep the first, a significant majority votes, else drop. Continuous
    labels: the bootstrapped coefficient of variation decides between mean, median (if a label is beyond 1.5 quartile
    ranges) and drop. The places of rows in the bootstrap are those in the given order, then by label.
    """
    need(df, [*keys, *([label] if label else [])])
    no_key = F.col("_k0").isNull()
    if label is None:
        g = df.groupBy(*_key(keys)).agg(F.count("*").alias("n"))
        kind = F.when(no_key, "drop").when(F.col("n") == 1, "unique").otherwise("drop")
        reason = F.when(no_key, "no key").when(F.col("n") == 1, "one row").otherwise("no labels")
        return g.select("*", F.lit(0).cast("long").alias("n_labels"), kind.alias("merge_strategy"), reason.alias("strategy_reason"))
    x = quoted(label).cast("double")
    y = F.when(~F.isnan(x), x)
    if binary:
        g = df.groupBy(*_key(keys)).agg(F.count("*").alias("n"), F.count(y).alias("n_labels"), F.min(y).alias("lo"), F.max(y).alias("hi"), F.count_if(y == 1).alias("ones"))
        most = F.greatest("ones", F.col("n_labels") - F.col("ones"))
        votes = binary_threshold(F.col("n_labels"), most, alpha)
        kind = F.when(no_key | (F.col("n_labels") == 0), "drop").when(F.col("n") == 1, "unique").when(F.col("lo") == F.col("hi"), "keep_first").when(votes, "majority_vote").otherwise("drop")
        reason = F.when(no_key, "no key").when(F.col("n_labels") == 0, "no label").when(F.col("n") == 1, "one row").when(F.col("lo") == F.col("hi"), "identical labels").when(votes, "significant majority").otherwise("labels conflict")
        return g.select(*[f"_k{i}" for i in range(len(keys))], "n", "n_labels", kind.alias("merge_strategy"), reason.alias("strategy_reason"))
    rows = [quoted(c).alias(f"_o{i}") for i, c in enumerate(order)]
    names, places = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    g = materialise(df.groupBy(*_key(keys)).agg(F.count("*").alias("n"), F.count(y).alias("n_labels"), F.min(y).alias("lo"), F.max(y).alias("hi")))
    disputed = g.where((F.col("n") > 1) & (F.col("lo") < F.col("hi")) & ~no_key)
    same = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]
    labels = df.select(*_key(keys), y.alias("y"), *rows).where("y is not null").alias("l").join(disputed.alias("r"), same).select(*[f"l.{n}" for n in names], "l.y", *[f"l.{n}" for n in places], F.col("r.n_labels").alias("_size"))
    ranked = materialise(numbered(labels, [*names, *places, "y"], "_row"))
    starts = ranked.groupBy(*names).agg(F.min("_row").alias("_start"))
    placed = ranked.alias("l").join(starts.alias("r"), same).select(*[f"l.{n}" for n in names], "l.y", "l._size", (F.col("l._row") - F.col("r._start")).alias("_at"))
    upper = bootstrap(placed, names, replicates, alpha)
    quartiles = group_quantiles(ranked, names, "y", [0.25, 0.75])
    wide = 1.5 * (F.col("q1") - F.col("q0"))
    cut = disputed.alias("l").join(quartiles.alias("r"), same).select(*[f"l.{n}" for n in names], ((F.col("l.lo") < F.col("r.q0") - wide) | (F.col("l.hi") > F.col("r.q1") + wide)).alias("out"))
    agree = F.coalesce(F.col("l.upper") <= cv_threshold, F.lit(False)) & ~F.isnan("l.upper")
    decided = upper.alias("l").join(cut.alias("r"), same).select(
        *[f"l.{n}" for n in names],
        F.when(~agree, "drop").when(F.col("r.out"), "median").otherwise("mean").alias("found"),
        F.when(~agree, "labels disagree").when(F.col("r.out"), "labels agree, with outliers").otherwise("labels agree").alias("why"),
    )
    same = [F.col(f"l._k{i}").eqNullSafe(F.col(f"r._k{i}")) for i in range(len(keys))]
    both = g.alias("l").join(decided.alias("r"), same, "left").select("l.*", "r.found", "r.why")
    kind = F.when(no_key | (F.col("n_labels") == 0), "drop").when(F.col("n") == 1, "unique").when(F.col("found").isNotNull(), F.col("found")).otherwise("keep_first")
    reason = F.when(no_key, "no key").when(F.col("n_labels") == 0, "no label").when(F.col("n") == 1, "one row").when(F.col("why").isNotNull(), F.col("why")).otherwise("identical labels")
    return both.select(*[f"_k{i}" for i in range(len(keys))], "n", "n_labels", kind.alias("merge_strategy"), reason.alias("strategy_reason"))


def find_duplicates(df: DataFrame, keys: Sequence[str], label: str | None = None, **parameters) -> DataFrame:
    """df with merge_strategy and strategy_reason; rows without a label are dropped ones in any group."""
    found = strategies(df, keys, label, **parameters)
    same = [quoted(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    out = df.drop("merge_strategy", "strategy_reason").join(found, same).select(*[quoted(c) for c in df.columns if c not in ("merge_strategy", "strategy_reason")], "merge_strategy", "strategy_reason")
    if label is None:
        return out
    missing = quoted(label).isNull() | F.isnan(quoted(label).cast("double"))
    return out.withColumns({"merge_strategy": F.when(missing, "drop").otherwise(F.col("merge_strategy")), "strategy_reason": F.when(missing, "no label").otherwise(F.col("strategy_reason"))})


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str | None = None, drop_all: bool = False) -> DataFrame:
    """One row for each combination of keys, by the merge_strategy of its first row in order (or none at all for
    repeated ones, with drop_all): the first row, with the label of the smallest mode, the mean or the median.

    All strategies are aggregates with partial sums, but the median, which is found by group_quantiles; a group is never
    collected."""
    need(df, [*keys, *order, "merge_strategy"])
    extra = ("merge_strategy", "strategy_reason")
    columns = [c for c in df.columns if c not in extra]
    rank = F.struct(*[quoted(c) for c in order])
    row = F.struct(*[quoted(c).alias(c) for c in df.columns])
    aggregates = [F.min_by(row, rank).alias("_r"), F.count("*").alias("_n")]
    if label:
        aggregates.append(F.avg(quoted(label).cast("double")).alias("_mean"))
    g = df.groupBy(*_key(keys)).agg(*aggregates)
    strategy = F.col("_r.merge_strategy")
    out = g.where(strategy != "drop")
    if drop_all:
        out = out.where("_n = 1")
    if label is None:
        return out.select(*[F.col("_r")[c].alias(c) for c in columns])
    counts = df.where(quoted(label).isNotNull()).groupBy(*_key(keys), quoted(label).alias("_v")).agg(F.count("*").alias("_c"))
    modes = counts.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min(F.struct((-F.col("_c")).alias("c"), "_v")).alias("_mode"))
    same = [F.col(f"l._k{i}").eqNullSafe(F.col(f"r._k{i}")) for i in range(len(keys))]
    both = out.alias("l").join(modes.alias("r"), same, "left").select("l.*", "r._mode")
    wanted = out.where(strategy == "median").select(*[f"_k{i}" for i in range(len(keys))])
    some = df.select(*_key(keys), quoted(label).alias("_v")).alias("l").join(wanted.alias("r"), same, "left_semi")
    medians = group_quantiles(some, [f"_k{i}" for i in range(len(keys))], "_v", [0.5])
    both = both.alias("l").join(medians.alias("r"), same, "left").select("l.*", F.col("r.q0").alias("_median"))
    kind = df.schema[label].dataType
    value = F.when(strategy == "mean", F.col("_mean")).when(strategy == "median", F.col("_median"))
    if kind.simpleString() in ("double", "float"):
        merged = F.coalesce(value, F.when(strategy == "majority_vote", F.col("_mode._v")), F.col("_r")[label])
    else:
        merged = F.coalesce(F.when(strategy.isin("mean", "median"), value), F.when(strategy == "majority_vote", F.col("_mode._v")).cast("double"), F.col("_r")[label].cast("double"))
    return both.select(*[merged.alias(c) if c == label else F.col("_r")[c].alias(c) for c in columns])
