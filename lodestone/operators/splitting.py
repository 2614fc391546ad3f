"""Train, test and validation splits, and cross-validation folds, as a column.

Random orders are the orders of md5(seed|key), so a split is the same on any cluster and expressible in SQL. Exact
sizes come from row numbers over a range partitioning. Whole groups are dealt largest first; which split gets the
r-th of the groups of one size follows from r, so the driver only sees how many groups there are of each size: of n
rows, fewer than the root of 2 n sizes differ.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialise
from .relational import need, numbered, quantiles, quoted, running_sums


def random_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(c).cast("string") for c in columns]))


def _check(train: float, test: float, val: float) -> None:
    if abs(train + test + val - 1) > 1e-6 or min(train, test, val) < 0:
        raise ValueError("the ratios must be at least 0 and sum to 1")


def random_split(df: DataFrame, key: Sequence[str], seed: int, test_size: float = 0.2, val_size: float = 0.0) -> DataFrame:
    """df with split: ceil(n * test_size) rows are test, ceil of val_size of the rest's share validation, by hash."""
    if not 0 < test_size < 1 or not 0 <= val_size < 1 - test_size:
        raise ValueError("test_size and val_size must leave rows for training")
    n = df.count()
    n_test = math.ceil(n * test_size)
    n_val = math.ceil((n - n_test) * (val_size / (1 - test_size))) if val_size else 0
    ranked = numbered(df.withColumn("_key", random_key(seed, *key)), ["_key", *key], "_rank")
    split = F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_key", "_rank")


def quantile_bins(df: DataFrame, label: str, n_bins: int) -> DataFrame:
    """df with _stratum: the label itself, or, for more than n_bins different ones, its quantile bin."""
    x = quoted(label).cast("double")
    row = df.agg(F.approx_count_distinct(quoted(label)).alias("u")).first()
    if row.u <= n_bins:
        return df.withColumn("_stratum", quoted(label).cast("string"))
    edges = [q for q in quantiles(df, [x], [k / n_bins for k in range(1, n_bins)])[0] if q is not None]
    return df.withColumn("_stratum", sum((F.coalesce((F.lit(e) < x).cast("int"), F.lit(0)) for e in edges), F.lit(0)).cast("string"))


def _stratum_rank(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """_rank of each row in its stratum by hash, and the stratum's size _size. Ranks are global row numbers less the
    rows of the strata before, so a stratum of most rows is still dealt to all tasks."""
    ranked = numbered(df.withColumn("_key", random_key(seed, *key)), ["_stratum", "_key", *key], "_at")
    sizes = df.groupBy("_stratum").agg(F.count("*").alias("_size"))
    starts = running_sums(sizes, "_stratum", ["_size"]).select(F.col("_stratum").alias("_s"), "_size", (F.col("_size_upto") - F.col("_size")).alias("_start"))
    return ranked.join(starts, F.col("_stratum").eqNullSafe(F.col("_s"))).withColumn("_rank", F.col("_at") - F.col("_start")).drop("_key", "_at", "_s", "_start")


def stratified_split(df: DataFrame, label: str, key: Sequence[str], seed: int, train: float = 0.8, test: float = 0.2, val: float = 0.0, n_bins: int = 5) -> DataFrame:
    """df with split, in equal shares of each label (or quantile bin of many labels). Missing labels raise."""
    _check(train, test, val)
    need(df, [label, *key])
    if df.where(quoted(label).isNull()).limit(1).count():
        raise ValueError("labels are missing")
    ranked = _stratum_rank(quantile_bins(df, label, n_bins), key, seed)
    n_test = F.round(F.col("_size") * test)
    split = F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + F.round(F.col("_size") * val), "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_stratum", "_rank", "_size")


def deal_runs(runs: Sequence[tuple[int, int]], need: Sequence[int], scale: int) -> list[tuple[int, int, list[int]]]:
    """Deals groups one by one, each to the side that needs most (ties to the first side) and needs size * scale less
    then. runs: (size, groups of that size), in the order of dealing. Out comes (size, first rank, sides in turn): groups
    of that size from that rank on, up to the next entry's, go to these sides by turns.

    Within a run every side loses the same with each group, so the sides that are within one step of the neediest take
    turns, until they have come down to the next one: whole rounds are jumped over."""
    need, out = list(need), []
    for size, count in runs:
        step, rank = size * scale, 0
        while rank < count:
            order = sorted(range(len(need)), key=lambda k: (-need[k], k))
            turn = [k for k in order if need[k] > need[order[0]] - step]
            rest = order[len(turn) :]
            # Rounds in which the last of the turn still needs more than the first of the rest.
            rounds = -(-(need[turn[-1]] - need[rest[0]]) // step) if rest else count
            rounds = min(rounds, (count - rank) // len(turn))
            if rounds > 0:
                out.append((size, rank, turn))
                rank += rounds * len(turn)
                for k in turn:
                    need[k] -= rounds * step
            else:
                out.append((size, rank, order[:1]))
                rank += 1
                need[order[0]] -= step
    return out


def _dealt(sizes: DataFrame, need: Callable[[int], list[int]], scale: int) -> DataFrame:
    """(_g, _side) of groups (_g, n), largest first, ties by name."""
    runs = sorted(((r.n, r.groups) for r in sizes.groupBy("n").agg(F.count("*").alias("groups")).collect()), reverse=True)
    segments: dict[int, list[tuple[int, list[int]]]] = {}
    for size, rank, turn in deal_runs(runs, need(sum(n * c for n, c in runs)), scale):
        segments.setdefault(size, []).append((rank, turn))
    starts, at = [], 0
    for size, count in runs:
        starts.append((size, at, segments[size]))
        at += count
    plan = sizes.sparkSession.createDataFrame(starts, "n long, start long, segments array<struct<rank: long, turn: array<int>>>")
    ranked = numbered(sizes, [F.desc("n"), "_g"], "_at").join(plan, "n").withColumn("_rank", F.col("_at") - F.col("start"))
    mine = F.element_at(F.filter("segments", lambda s: s["rank"] <= F.col("_rank")), -1)
    return ranked.withColumn("_s", mine).select("_g", F.get("_s.turn", ((F.col("_rank") - F.col("_s.rank")) % F.size("_s.turn")).cast("int")).alias("_side"))


def group_split(df: DataFrame, group: str, seed: int = 0, train: float = 0.8, test: float = 0.2, val: float = 0.0, method: str = "balanced", missing: str = "train") -> DataFrame:
    """df with split, no group in two of them. balanced: groups, largest first (ties by name), each to the split that is
    furthest below its share, in exact arithmetic; random: groups by hash, filling train, then test, then validation,
    each up to its share and with the group that crosses it. Rows without a group go to train, or by
    hash of the row (missing='random')."""
    _check(train, test, val)
    need(df, [group])
    ratios = {k: v for k, v in (("train", train), ("test", test), ("val", val)) if v > 0}
    name = quoted(group).cast("string")
    if method == "balanced":
        shares = [Fraction(str(v)) for v in ratios.values()]
        scale = math.lcm(*[x.denominator for x in shares])
        sizes = materialise(df.where(name.isNotNull()).groupBy(name.alias("_g")).agg(F.count("*").alias("n")))
        sides = _dealt(sizes, lambda total: [int(x * scale) * total for x in shares], scale)
        dealt = sides.select("_g", F.get(F.array(*map(F.lit, ratios)), "_side").alias("split"))
    elif method == "random":
        sizes = df.where(name.isNotNull()).groupBy(name.alias("_g")).agg(F.count("*").alias("n")).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "_g")))
        before = running_sums(sizes, "_h", ["n"]).withColumn("before", F.col("n_upto") - F.col("n"))
        total = sizes.agg(F.sum("n").alias("total"))
        place, edge, split = F.col("before") / F.col("total"), 0.0, F.lit(list(ratios)[-1])
        for k, v in reversed(list(ratios.items())[:-1]):
            edge = sum(list(ratios.values())[: list(ratios).index(k) + 1])
            split = F.when(place < edge - 1e-12, k).otherwise(split)
        dealt = before.crossJoin(F.broadcast(total)).select("_g", split.alias("split"))
    else:
        raise ValueError(f"unknown method: {method}")
    out = df.drop("split").join(dealt, name == F.col("_g"), "left").drop("_g")
    if missing == "random":
        share = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(c).cast("string") for c in df.columns])), 1, 8), 16, 10).cast("double") / 2**32
        return out.withColumn("split", F.coalesce("split", F.when(share < train, "train").when(share < train + test, "test").otherwise("val")))
    return out.withColumn("split", F.coalesce("split", F.lit("train")))


def kfold(df: DataFrame, key: Sequence[str], k: int, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """df with fold (0 to k - 1): runs of equal length, within one row, of the hash order (or of the key's)."""
    n = df.count()
    if not 2 <= k <= n:
        raise ValueError(f"{k} folds of {n} rows")
    order = ["_key", *key] if shuffle else list(key)
    ranked = numbered(df.withColumn("_key", random_key(seed, *key)), order, "_rank")
    return ranked.withColumn("fold", F.floor(F.col("_rank") * k / n).cast("int")).drop("_key", "_rank")


def stratified_kfold(df: DataFrame, label: str, key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """df with fold: rows of each label (or of k quantile bins, for more than two) dealt in turn."""
    ranked = _stratum_rank(quantile_bins(df, label, max(2, k)), key, seed)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_stratum", "_rank", "_size")


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """df with fold, no group in two: the largest group goes to the lightest fold (ties to the first). Rows without a
    group are one."""
    name = F.coalesce(quoted(group).cast("string"), F.lit(""))
    sizes = materialise(df.groupBy(name.alias("_g")).agg(F.count("*").alias("n")))
    groups = sizes.count()
    if groups < k:
        raise ValueError(f"{k} folds of {groups} groups")
    dealt = _dealt(sizes, lambda _: [0] * k, 1).withColumnRenamed("_side", "fold")
    return df.drop("fold").join(dealt, name == F.col("_g")).drop("_g")


def monte_carlo(df: DataFrame, key: Sequence[str], n_splits: int, val_size: float, seed: int = 0) -> DataFrame:
    """A copy of df for each of n_splits independent splits: split_id and is_val (ceil(n * val_size) rows each)."""
    n = df.count()
    most = math.ceil(n * val_size)
    copies = df.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("_key", F.md5(F.concat_ws("|", (F.lit(seed) + F.col("split_id")).cast("string"), *[quoted(c).cast("string") for c in key])))
    ranked = numbered(copies, ["split_id", "_key", *key], "_rank")
    return ranked.withColumn("is_val", F.col("_rank") - F.col("split_id") * n < most).drop("_key", "_rank")


def leave_p_out(df: DataFrame, key: str, p: int = 1, max_splits: int | None = None) -> DataFrame:
    """(split_id, key): the rows left out by all combinations of p rows in the order of the key, or by the first
    max_splits of them. Combinations are made from their numbers, in parallel."""
    need(df, [key])
    rows = numbered(df.select(quoted(key).alias(key)), [quoted(key)], "_at")
    n = rows.count()
    total = math.comb(n, p)
    if p < 1 or total >= 1 << 63:
        raise ValueError(f"{total} splits of {p} out of {n} rows")
    splits = df.sparkSession.range(total if max_splits is None else min(total, max_splits)).withColumnRenamed("id", "split_id")
    if p == 1:
        return splits.join(rows, F.col("split_id") == F.col("_at")).select("split_id", quoted(key))

    def unranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start in range(0, len(ids), max(1, 100_000 // p)):
                part = ids[start : start + max(1, 100_000 // p)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i in part for _ in range(p)], pa.int64()), pa.array([x for i in part for x in combination(i, n, p)], pa.int64())], names=["split_id", "_at"])

    return splits.mapInArrow(unranked, "split_id long, _at long").join(rows, "_at").select("split_id", quoted(key))


def combination(number: int, n: int, p: int) -> list[int]:
    """The number-th (from 0) of the combinations of p out of 0 .. n - 1, in lexicographic order."""
    left, out = math.comb(n, p) - 1 - number, []
    for size in range(p, 0, -1):
        # the largest x with comb(x, size) <= left: the combinatorial number system, counted from the end
        x = bisect_right(range(n), left, key=lambda v, s=size: math.comb(v, s)) - 1
        left -= math.comb(x, size)
        out.append(n - 1 - x)
    return out


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Different keys in both: exact duplicates across splits."""
    return a.select(quoted(key).alias(key)).intersect(b.select(quoted(key).alias(key))).where(quoted(key).isNotNull())


def split_characteristics(df: DataFrame, split: str = "split", label: str | None = None) -> DataFrame:
    """(split, n, share, n_labels, mean_label) of each split."""
    g = df.groupBy(quoted(split).alias("split")).agg(F.count("*").alias("n"), *([F.count_distinct(quoted(label)).alias("n_labels"), F.avg(quoted(label).cast("double")).alias("mean_label")] if label else []))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def group_leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """(a, b, n_shared, pct_of_b, severity): groups in two splits; over 50 % HIGH, over 20 % MEDIUM, any LOW."""
    groups = df.where(quoted(group).isNotNull()).select(quoted(split).alias("s"), quoted(group).alias("g")).distinct()
    sizes = groups.groupBy("s").agg(F.count("*").alias("n"))
    both = groups.alias("x").join(groups.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.s") > F.col("y.s"))).groupBy(F.col("x.s").alias("a"), F.col("y.s").alias("b")).agg(F.count("*").alias("n_shared"))
    pairs = sizes.alias("p").join(sizes.alias("q"), F.col("p.s") > F.col("q.s")).select(F.col("p.s").alias("a"), F.col("q.s").alias("b"), F.col("q.n").alias("n_b"))
    out = pairs.join(both, ["a", "b"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    pct = 100 * F.col("n_shared") / F.col("n_b")
    return out.select("a", "b", "n_shared", pct.alias("pct_of_b"), F.when(pct > 50, "HIGH").when(pct > 20, "MEDIUM").when(pct > 0, "LOW").otherwise("OK").alias("severity"))


Strategy = Callable[..., DataFrame]
_STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Decorator that makes a function of a data set and parameters known to cv_splits under a name."""

    def add(f: Strategy) -> Strategy:
        if name in _STRATEGIES:
            raise ValueError(f"strategy {name!r} is there already")
        _STRATEGIES[name] = f
        return f

    return add


for _name, _f in (("kfold", kfold), ("stratified", stratified_kfold), ("cluster", group_kfold), ("scaffold", group_kfold), ("montecarlo", monte_carlo), ("leavepout", leave_p_out)):
    register_strategy(_name)(_f)


def cv_splits(df: DataFrame, strategy: str, **parameters) -> DataFrame:
    """The rows with their folds or splits by a named strategy: kfold, stratified, cluster, scaffold (by a column of
    groups), montecarlo, leavepout, or one of register_strategy."""
    if strategy not in _STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {sorted(_STRATEGIES)}")
    return _STRATEGIES[strategy](df, **parameters)


def guidance() -> dict[str, str]:
    """When to use which strategy."""
    return {
        "kfold": "rows are independent of each other; five or ten folds",
        "stratified": "labels are rare or skewed: every fold has the same share of each",
        "cluster": "new rows will be unlike the known ones: whole clusters are held out, scores are lower and more honest",
        "scaffold": "new molecules will have other scaffolds than the known ones: whole scaffolds are held out",
        "montecarlo": "independent repeats, of any share: for the spread of a score",
        "leavepout": "few rows: every one is held out once (p = 1), or every combination",
    }
