"""Similarity of feature vectors: pairs, nearest neighbours, statistics, training-set distance, activity cliffs.

All comparisons of everything with everything go block by block: rows are dealt to blocks of about BLOCK rows, each
pair of blocks meets in one task (an equi-join on the pair's number, no cross join), and NumPy compares them. Results
that need only sums or the best k are reduced inside the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..plans.tables import discard, materialise
from . import simjoin
from .relational import need, quoted

BLOCK = 2048
METRICS = ("tanimoto", "dice", "cosine", "euclidean", "manhattan")


def matrix(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of the rows of a and b."""
    if metric == "tanimoto":
        if not (((a == 0) | (a == 1)).all() and ((b == 0) | (b == 1)).all()):
            raise ValueError("tanimoto needs vectors of 0 and 1")
        both = (a.astype(np.float32) @ b.astype(np.float32).T).astype(float)  # exact: sums of ones
        union = a.sum(1)[:, None] + b.sum(1)[None, :] - both
        return both / np.maximum(union, 1)
    if metric == "dice":
        total = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
        return 2 * (a @ b.T) / np.where(total == 0, 1e-10, total)
    if metric == "cosine":
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        return np.where(norms > 0, (a @ b.T) / np.where(norms == 0, 1, norms), 0.0)
    if metric == "euclidean":
        total = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
        square = total - 2 * (a @ b.T)
        near = square < 1e-3 * total  # what the difference of large numbers would spoil
        for i in np.flatnonzero(near.any(1)):
            square[i, near[i]] = ((b[near[i]] - a[i]) ** 2).sum(1)
        return 1 / (1 + np.sqrt(square))
    if metric == "manhattan":
        far, step = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
        for x, y in zip(a.T, b.T, strict=True):
            np.abs(np.subtract(x[:, None], y[None], out=step), out=step)
            far += step
        return 1 / (1 + far)
    raise ValueError(f"unknown metric: {metric}; there are {METRICS}")


def kernel(metric: str, a: np.ndarray, b: np.ndarray) -> Callable[[slice, slice], np.ndarray]:
    """matrix() of slices of the rows of a and b, prepared once. Tanimoto similarities and cosines are put where those
    of the call before were: what a call gives holds until the next one."""
    if metric not in ("tanimoto", "cosine"):
        return lambda r, c: matrix(metric, a[r], b[c])
    room: dict[type, np.ndarray] = {}

    def place(kind: type, shape: tuple[int, int]) -> np.ndarray:
        if kind not in room or room[kind].size < shape[0] * shape[1]:
            room[kind] = np.empty(shape[0] * shape[1], kind)
        return room[kind][: shape[0] * shape[1]].reshape(shape)

    if metric == "cosine":
        x, y = (v / np.where((n := np.sqrt((v * v).sum(1))) > 0, n, np.inf)[:, None] for v in (a, b))
        return lambda r, c: np.matmul(x[r], y[c].T, out=place(np.float64, (len(x[r]), len(y[c]))))
    if not (((a == 0) | (a == 1)).all() and ((b == 0) | (b == 1)).all()):
        raise ValueError("tanimoto needs vectors of 0 and 1")
    x, y, n, m = a.astype(np.float32), b.astype(np.float32), a.sum(1), b.sum(1)
    empty = not n.all() and not m.all()

    def tanimoto(r: slice, c: slice) -> np.ndarray:
        shape = len(n[r]), len(m[c])
        both, out = place(np.float32, shape), place(np.float64, shape)
        np.matmul(x[r], y[c].T, out=both)  # exact: sums of ones
        np.add(n[r][:, None], m[c][None], out=out)
        np.subtract(out, both, out=out)
        if empty:
            np.maximum(out, 1, out=out)
        return np.divide(both, out, out=out)

    return tanimoto


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """The same as a column expression, for a few pairs of a row."""
    if metric == "tanimoto":
        both = _dot(a, b)
        return F.coalesce(F.try_divide(both, _dot(a, a) + _dot(b, b) - both), F.lit(0.0))
    if metric == "dice":
        total = _dot(a, a) + _dot(b, b)
        return 2 * _dot(a, b) / F.when(total == 0, 1e-10).otherwise(total)
    if metric == "cosine":
        return F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))
    if metric == "euclidean":
        return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, F.lit(2))), F.lit(0.0), lambda s, x: s + x)))
    if metric == "manhattan":
        return 1 / (1 + F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"unknown metric: {metric}")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _side(df: DataFrame, key: str, vector: str) -> DataFrame:
    need(df, [key, vector])
    return df.select(quoted(key).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")


def _blocks(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def _arrays(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part.column("id").to_numpy(), kind="stable")
    ids = part.column("id").to_numpy()[order]
    lists = part.column("v").combine_chunks()
    width = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(width) > 1:
        raise ValueError("all vectors must have one length")
    rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), int(width[0]) if len(ids) else 0)
    return ids, np.asarray(rows, float)[order]


#: Strips that rows are dealt to where all meet all, rows of the smallest strip, and values of a vector that a strip may
#: hold. A row is copied once a strip, so what is shuffled grows with the rows, until strips are full.
_STRIPS = 10
_LEAST = 512
_STRIP = 8_000_000
#: Rows and columns of a tile, the similarities that a task looks at at a time.
_TILE = 512


def _strip(rows: DataFrame) -> int:
    """Rows of a strip of rows (id, v)."""
    first = rows.select(F.size("v").alias("n")).first()
    return max(1, min(max(_LEAST, -(-rows.count() // _STRIPS)), _STRIP // max(1, first.n if first else 1)))


def _symmetric(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows dealt to every pair of blocks that theirs is in: lo, hi, b (own block), id, v."""
    side = _side(df, key, vector)
    n = _blocks(side.count(), size)
    dealt = side.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return dealt.select("*", other.alias("o")).select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "id", "v")


def _meet(metric: str, emit: Callable[[np.ndarray, np.ndarray, np.ndarray, bool], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """For one pair of blocks: emit(ids of rows, ids of columns, similarities, whether they are one block)."""

    def run(part: pa.Table) -> pa.Table:
        b, lo, hi = part.column("b").to_numpy(), part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        ids, v = _arrays(part.filter(pa.array(b == lo)))
        others, w = (ids, v) if lo == hi else _arrays(part.filter(pa.array(b == hi)))
        s = matrix(metric, v, w) if len(ids) and len(others) else np.zeros((len(ids), len(others)))
        return emit(ids, others, s, lo == hi)

    return run


def all_pairs(df: DataFrame, key: str, vector: str, metric: str = "tanimoto", at_least: float | None = None, size: int | None = None) -> DataFrame:
    """(i, j, sim) with i < j, of all pairs or those of at least a similarity. Keys must be unique integers. With a
    Tanimoto similarity to reach, only vectors that can reach it meet (simjoin)."""
    if metric == "tanimoto" and at_least is not None and 0 < at_least <= 1:
        one, members = simjoin.classes(_side(df, key, vector))
        return simjoin.expanded(simjoin.pairs(one, at_least, size), one, members)

    def emit(ids: np.ndarray, others: np.ndarray, s: np.ndarray, same: bool) -> pa.Table:
        keep = np.ones(s.shape, bool) if at_least is None else s >= at_least
        if same:
            keep &= np.triu(np.ones(s.shape, bool), 1)
        r, c = np.nonzero(keep)
        return pa.table({"i": np.minimum(ids[r], others[c]), "j": np.maximum(ids[r], others[c]), "sim": s[r, c]})

    return _symmetric(df, key, vector, size or BLOCK).groupBy("lo", "hi").applyInArrow(_meet(metric, emit), "i long, j long, sim double")


def nodes_of(df: DataFrame, key: str, vector: str, metric: str, at_least: float) -> tuple[DataFrame, DataFrame]:
    """(id, v, copies) of the classes of equal vectors by their smallest key, as a table, and (id, rep) of all rows. What
    is told of a class holds for each of its rows, so copies are never expanded into pairs. Other metrics than Tanimoto
    have a class for each row."""
    side = _side(df, key, vector)
    if metric == "tanimoto" and 0 < at_least <= 1:
        return simjoin.classes(side)
    return materialise(side.select("id", "v", F.lit(1).cast("long").alias("copies"))), side.select("id", F.col("id").alias("rep"))


#: How near to a bound a cosine of single precision may be without being computed again.
_NEAR = 1e-5


def meetings(rows: DataFrame, metric: str, at_least: float, step: simjoin.Step, schema: str, over: bool = False, plain: bool = False, size: int | None = None) -> DataFrame:
    """What step makes of the meetings of all rows (id, v, more), see simjoin.Step: which pairs are at least so similar,
    or, with over, more. No pair need ever be a row. Tanimoto similarities over zero meet in the cells of simjoin, unless
    it is to be plain: in strips, as others do."""
    if metric == "tanimoto" and 0 < at_least <= 1 and not plain:
        return simjoin.meetings(rows, at_least, size, None, step, schema, over)
    n = _blocks(rows.count(), size or _strip(rows))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    spread = dealt.select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", *rows.columns)

    def meet(part: pa.Table) -> pa.Table:
        lo, hi = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        part = part.sort_by("id")
        v = _arrays(part)[1]
        if metric == "tanimoto":
            order = np.argsort(v.sum(1), kind="stable")
            part, v = part.take(pa.array(order)), v[order]
        b, compare = part.column("b").to_numpy(), comparison(metric, v, at_least, over)

        def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            keep = compare(x, y)
            return keep & (x[:, None] < y[None]) if lo == hi and len(x) and len(y) and x.max() >= y.min() else keep

        return step(part, simjoin.cut(b, lo, hi), close, lambda x, y: np.array([matrix(metric, v[[i]], v[[j]])[0, 0] for i, j in zip(x, y, strict=True)], float))

    return spread.groupBy("lo", "hi").applyInArrow(meet, schema)


def comparison(metric: str, v: np.ndarray, at_least: float, over: bool = False) -> simjoin.Close:
    """For rows of v by their places: which of them are at least so similar, or, with over, more, as matrix() has it.
    Cosines are told in single precision, and computed again where that could matter."""
    beyond = np.greater if over else np.greater_equal
    if metric == "tanimoto":
        if not ((v == 0) | (v == 1)).all():
            raise ValueError("tanimoto needs vectors of 0 and 1")
        bits, n, least = v.astype(np.float32), v.sum(1).astype(np.int64), simjoin.least_common(v.shape[1], at_least, over)
        return lambda x, y: simjoin.reaching(bits[x], n[x], bits[y], n[y], least)
    norm = np.sqrt((v * v).sum(1)) if metric == "cosine" else np.zeros(0)
    if metric != "cosine" or not np.isfinite(norm).all():
        return lambda x, y: beyond(matrix(metric, v[x], v[y]), at_least)
    unit = (v / np.where(norm == 0, 1, norm)[:, None]).astype(np.float32)

    def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = unit[x] @ unit[y].T
        keep = s >= np.float32(at_least)
        i, j = np.nonzero(np.abs(s - np.float32(at_least)) <= _NEAR)
        if len(i):
            a, b = x[i], y[j]
            both = norm[a] * norm[b]
            keep[i, j] = beyond(np.where(both > 0, (v[a] * v[b]).sum(1) / np.where(both == 0, 1, both), 0.0), at_least)
        return keep

    return cosines


def degrees(rows: DataFrame, metric: str, at_least: float, of: str | None = None, plain: bool = False, size: int | None = None) -> DataFrame:
    """(id, n, k) of rows (id, v, copies) with close ones: how many rows and how many classes are close. With a boolean
    column `of` only those of the other rows, where it is not set, and close ones where it is set are counted. Sums leave
    a task, no pair."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k", pa.int64())])

    def step(part: pa.Table, tiles: Iterator[tuple[np.ndarray, np.ndarray]], close: simjoin.Close, sims: Callable) -> pa.Table:
        copies = part.column("copies").to_numpy()
        exact = np.float32 if copies.max(initial=1) * simjoin.TILE < 1 << 24 else np.float64
        weight = np.stack([copies, np.ones(len(copies))], 1).astype(exact)
        chosen = None if of is None else part.column(of).to_numpy(zero_copy_only=False).astype(bool)
        out = np.zeros((part.num_rows, 2))
        for left, right in tiles:
            if chosen is None:
                keep = close(left, right).astype(exact)
                out[left] += keep @ weight[right]
                out[right] += keep.T @ weight[left]
                continue
            for x, y in ((left[~chosen[left]], right[chosen[right]]), (left[chosen[left]], right[~chosen[right]])):
                if len(x) and len(y):
                    keep = close(x, y).astype(exact)
                    if chosen[x[0]]:
                        out[y] += keep.T @ weight[x]
                    else:
                        out[x] += keep @ weight[y]
        some = np.flatnonzero(out[:, 1])
        return pa.table([part.column("id").to_numpy()[some], *out[some].T.astype(np.int64)], schema=schema)

    found = meetings(rows, metric, at_least, step, "id long, n long, k long", plain=plain, size=size)
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def links(one: DataFrame, metric: str, at_least: float) -> DataFrame:
    """(i, j, sim) with i < j of the classes (id, v) that are at least so similar."""
    return simjoin.pairs(one, at_least) if metric == "tanimoto" and 0 < at_least <= 1 else all_pairs(one, "id", "v", metric, at_least)


def join_report(df: DataFrame, key: str, vector: str, at_least: float, size: int | None = None) -> DataFrame:
    """(n_rows, n_classes, by_bits, n_cells, n_candidates, n_all_pairs, n_pairs, n_row_pairs): one row on the work of the
    threshold join: how many comparisons its cells make, how many all pairs of classes would be, and how many pairs of
    classes and of rows match."""
    side = _side(df, key, vector)
    one, _ = simjoin.classes(side)
    how = simjoin.plan(one, at_least, size)
    counts = simjoin.counted(one, at_least, size, how)
    told = side.agg(F.count("*").alias("n_rows"), F.lit(one.count()).alias("n_classes"), F.lit(how.by_bits).alias("by_bits"), F.lit(len(how.cells)).alias("n_cells"), F.lit(how.candidates).alias("n_candidates"), F.lit(how.all_pairs).alias("n_all_pairs"))
    return told.crossJoin(counts)  # one row each


#: Bins of a round of an order statistic.
_ROUND = 1 << 14


def pair_statistics(df: DataFrame, key: str, vector: str, metric: str = "tanimoto", size: int | None = None) -> DataFrame:
    """(n_pairs, mean, median, min, max): one row on the similarities of all pairs; null without a pair.

    Strips of rows meet tile by tile, and a meeting gives sums and counts of bins: no pair is ever a row. The bin that
    holds the middle is binned again, by its least and largest value, until it is one value: a few rounds."""
    rows = materialise(_side(df, key, vector))
    size = size or _strip(rows)
    low, high = (-1.0, 1.0) if metric in ("cosine", "dice") else (0.0, 1.0)
    schema = pa.schema([("bin", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("low", pa.float64()), ("high", pa.float64())])
    met = _symmetric(rows, "id", "v", size).groupBy("lo", "hi")

    def values(part: pa.Table) -> Iterator[np.ndarray]:
        b, lo, hi = part.column("b").to_numpy(), part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        ids, v = _arrays(part.filter(pa.array(b == lo)))
        others, w = (ids, v) if lo == hi else _arrays(part.filter(pa.array(b == hi)))
        for r in range(0, len(ids), _TILE):
            for c in range(r if lo == hi else 0, len(others), _TILE):
                s = matrix(metric, v[r : r + _TILE], w[c : c + _TILE])
                x = s[np.triu_indices(len(s), 1)] if lo == hi and r == c else s.ravel()
                yield np.where(np.isnan(x), 2.0, x)  # in order, NaN comes last, after all similarities

    def places(x: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip((x - low) * (_ROUND / (high - low)), 0, _ROUND - 1).astype(np.int64)

    def summed(part: pa.Table) -> pa.Table:
        n, total, least, most = np.zeros(_ROUND, np.int64), 0.0, np.inf, -np.inf
        for x in values(part):
            if len(x):
                n += np.bincount(places(x, low, high), minlength=_ROUND)
                total, least, most = total + x.sum(), min(least, x.min()), max(most, x.max())
        full = np.flatnonzero(n)
        rest = [None] * len(full)
        return pa.table([[-1, *full], [n.sum(), *n[full]], [total, *rest], [least, *rest], [most, *rest]], schema=schema)

    def inside(chosen: int | None, low: float, high: float) -> Callable[[pa.Table], pa.Table]:
        """Of the values from low to high, or of those in one bin of the first round: bins with their least and largest."""

        def run(part: pa.Table) -> pa.Table:
            n, least, most = np.zeros(_ROUND, np.int64), np.full(_ROUND, np.inf), np.full(_ROUND, -np.inf)
            for x in values(part):
                x = np.sort(x[(x >= low) & (x <= high)] if chosen is None else x[places(x, *whole) == chosen])
                if len(x):
                    at = places(x, low, high)
                    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    last = np.r_[first[1:], len(x)] - 1
                    n[at[first]] += last - first + 1
                    least[at[first]] = np.minimum(least[at[first]], x[first])
                    most[at[first]] = np.maximum(most[at[first]], x[last])
            full = np.flatnonzero(n)
            return pa.table([full, n[full], np.zeros(len(full)), least[full], most[full]], schema=schema)

        return run

    whole = (low, high)
    kinds = "bin int, n long, total double, low double, high double"
    told = lambda rows: rows.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("bin").collect()
    merged = lambda f, met: told(met.applyInArrow(f, kinds))

    def at(place: int, first: list, met: GroupedData = met) -> float:
        found, below, chosen, (low, high) = first, 0, None, whole
        while True:
            for r in found:
                if below + r.n > place:
                    break
                below += r.n
            if r.low is not None and r.low == r.high:
                return r.low
            if r.low is None:  # a bin of the first round
                chosen, step = r.bin, (high - low) / _ROUND
                low, high = low + r.bin * step, low + (r.bin + 1) * step
            else:
                chosen, low, high = None, r.low, r.high
            found = merged(inside(chosen, low, high), met)

    out = "n_pairs long, mean double, median double, min double, max double"
    if rows.count() >= _MANY and (around := _enclosed(rows, met, metric, schema, lambda part: merged(summed, part), at, told)) is not None:
        return df.sparkSession.createDataFrame([around], out)
    sums, *first = merged(summed, met) or [None]
    if sums is None or not sums.n:
        return df.sparkSession.createDataFrame([(0, None, None, None, None)], out)
    middle = at((sums.n - 1) // 2, first)
    if sums.n % 2 == 0:
        middle = (middle + at(sums.n // 2, first)) / 2
    values_ = [math.nan if x > 1.4 else x for x in (2.0 if sums.high > 1.4 else sums.total / sums.n, middle, sums.low, sums.high)]
    return df.sparkSession.createDataFrame([(sums.n, *values_)], out)


def _enclosed(rows: DataFrame, met: GroupedData, metric: str, schema: pa.Schema, summed: Callable, at: Callable, told: Callable) -> tuple | None:
    """(n_pairs, mean, median, min, max) from one meeting of all strips; None where the middle lies elsewhere, or a
    similarity is none. The pairs of small groups, in which each row is as often as others, tell about where the middle
    is. The meeting counts what is under that, and gives what is in it value by value: the median is exactly that of all
    pairs, or is looked for in rounds instead."""
    groups = _blocks(rows.count(), _GROUP)
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    part = dealt.select(F.col("b").alias("lo"), F.col("b").alias("hi"), "b", "id", "v").groupBy("lo", "hi")
    sums, *first = summed(part) or [None]
    if sums is None or not sums.n or sums.high > 1.4:
        return None
    room = 4 * math.sqrt(sums.n)
    low, high = (at(int(min(max(sums.n / 2 + x, 0), sums.n - 1)), first, part) for x in (-room, room))
    found = materialise(met.applyInArrow(_around(metric, low, high, schema), "bin int, n long, total double, low double, high double"))
    whole = {r.bin: r for r in told(found)}
    if -1 not in whole or whole[-1].high > 1.4:
        return None
    sums, below, inside = whole[-1], whole[-2].n, whole[-3].n if -3 in whole else 0
    places = [p - below for p in ((sums.n - 1) // 2, sums.n // 2)]
    if places[0] < 0 or places[1] >= inside:
        return None

    def value(place: int, low: float, high: float) -> float:
        while low < high:
            cut = F.least(F.floor((F.col("low") - low) / (high - low) * _ROUND), F.lit(_ROUND - 1)).cast("int")
            for r in told(found.where((F.col("bin") == -3) & F.col("low").between(low, high)).withColumn("bin", cut)):
                if place < r.n:
                    break
                place -= r.n
            low, high = r.low, r.high
        return low

    middle = sum(value(p, whole[-3].low, whole[-3].high) for p in places) / 2
    return sums.n, sums.total / sums.n, middle, sums.low, sums.high


#: Rows from which the middle of all pairs is enclosed first, rows of a group whose pairs tell where it lies about, and
#: rows of a side that are compared in single precision.
_MANY, _GROUP, _SIDE = 20_000, 512, 1024


def _rough_manhattan(x: np.ndarray, y: np.ndarray, side: int) -> Callable[[int, int], np.ndarray]:
    """For the starts of `side` rows of each: out[o, i], the similarity of row i of the one to row (i + o) % side of the
    other in single precision, from |a - b| = a + b - 2 min(a, b): whole rows are compared, no value is repeated."""
    a, b = x.astype(np.float32), y.astype(np.float32)
    sa, sb, one = x.sum(1).astype(np.float32), y.sum(1).astype(np.float32), np.ones(x.shape[1], np.float32)
    step, out = np.empty((side, x.shape[1]), np.float32), np.empty((side, side), np.float32)

    def run(r: int, c: int) -> np.ndarray:
        own, twice = a[r : r + side], np.concatenate([b[c : c + side]] * 2)
        for o in range(side):
            np.minimum(own, twice[o : o + side], out=step)
            np.matmul(step, one, out=out[o])
        sums = np.lib.stride_tricks.sliding_window_view(np.concatenate([sb[c : c + side]] * 2), side)[:side]
        np.multiply(out, np.float32(-2), out=out)
        np.add(out, sums, out=out)
        np.add(out, sa[r : r + side] + np.float32(1), out=out)
        return np.divide(np.float32(1), out, out=out)

    return run


def _around(metric: str, low: float, high: float, kinds: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Of one meeting of strips: (-1, n, total, low, high) of its similarities, (-2, n) of those under `low`, and (-3, n,
    value) of each from `low` to `high`. Manhattan similarities are told in single precision, and computed again where
    that could matter: near the bounds, and for the least and largest."""

    def run(part: pa.Table) -> pa.Table:
        b, lo, hi = part.column("b").to_numpy(), part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        if not (b == lo).any() or not (b == hi).any():
            return kinds.empty_table()
        v = _arrays(part.filter(pa.array(b == lo)))[1]
        w = v if lo == hi else _arrays(part.filter(pa.array(b == hi)))[1]
        n, below, total, least, most = 0, 0, 0.0, np.inf, -np.inf
        found: list[np.ndarray] = []

        def exact(x: np.ndarray) -> None:
            nonlocal below, least, most
            if len(x):
                below += int((x < low).sum())
                found.append(x[(x >= low) & (x <= high)])
                least, most = min(least, x.min()), max(most, x.max())

        def whole(r: slice, c: slice, upper: bool) -> None:
            nonlocal n, total
            s = matrix(metric, v[r], w[c])
            x = s[np.triu_indices(len(s), 1)] if upper else s.ravel()
            x = np.where(np.isnan(x), 2.0, x)
            n, total = n + len(x), total + x.sum()
            exact(x)

        large = max(np.abs(v).sum(1).max(), np.abs(w).sum(1).max())
        bound = 6e-8 * (v.shape[1] + 4) * 4 * large  # of an error of the distance
        fast = metric == "manhattan" and np.isfinite(large) and bound < 1e-3
        rows, columns = (len(x) // _SIDE * _SIDE if fast else 0 for x in (v, w))
        rough = _rough_manhattan(v, w, _SIDE) if rows and columns else None
        for r in range(0, rows, _SIDE):
            for c in range(r if lo == hi else 0, columns, _SIDE):
                s = rough(r, c)
                if lo == hi and r == c:  # each pair once
                    s = s[1 : _SIDE // 2 + 1].copy()
                    s[-1, _SIDE // 2 :] = np.nan
                shift = int(lo == hi and r == c)
                there = s.size - (_SIDE // 2 if shift else 0)
                n, total = n + there, total + float(np.nansum(s, dtype=np.float64) if shift else s.sum(dtype=np.float64))
                # A similarity s changes by s * s times the error of its distance at most; twice that is left as room.
                near = lambda x: np.float32(2 * bound * x * x)
                lower, upper = np.float32(low) - near(low) - np.float32(1e-7), np.float32(high) + near(high) + np.float32(1e-7)
                first, last = np.nanmin(s), np.nanmax(s)
                below += int((s < lower).sum())
                keep = (s >= lower) & (s <= upper)
                ends = np.zeros(s.shape, bool)
                if first - near(first) - 1e-7 <= least:
                    ends |= s <= first + 2 * near(first) + np.float32(2e-7)
                if last + near(last) + 1e-7 >= most:
                    ends |= s >= last - 2 * near(last) - np.float32(2e-7)
                for which, inside in ((keep, True), (ends, False)):
                    o, i = np.nonzero(which)
                    for k in range(0, len(o), 65536):
                        p, q = i[k : k + 65536], (i[k : k + 65536] + o[k : k + 65536] + shift) % _SIDE
                        x = 1 / (1 + np.abs(v[r + p] - w[c + q]).sum(1))
                        if inside:
                            exact(x)
                        else:
                            least, most = min(least, x.min()), max(most, x.max())
        for r in range(0, len(v), _TILE):
            for c in range(r if lo == hi else 0, len(w), _TILE):
                if not (r < rows and c < columns):
                    whole(slice(r, r + _TILE), slice(c, c + _TILE), lo == hi and r == c)
        x, number = np.unique(np.concatenate(found) if found else np.zeros(0), return_counts=True)
        none = np.zeros(len(x))
        return pa.table([np.r_[-1, -2, np.full(len(x), -3)], np.r_[n, below, number], np.r_[total, 0.0, none], np.r_[least, 0.0, x], np.r_[most, 0.0, x]], names=kinds.names).cast(kinds)

    return run


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", "sim").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def similarity_statistics(df: DataFrame, key: str, vector: str, metric: str = "tanimoto", threshold: float = 0.8, size: int | None = None) -> DataFrame:
    """(i, mean_sim, median_sim, max_sim, min_sim, n_similar) of each row with all others; n_similar counts those over
    the threshold. A row without another has none."""
    side = _side(df, key, vector)
    if metric == "tanimoto" and size is None:
        side = materialise(side)
        n, first = side.count(), side.select(F.size("v").alias("n")).first()
        if n <= _PACKED and first and (first.n + 1) ** 2 <= _CODES:
            return _bit_statistics(side, first.n, n, threshold)
    return _row_statistics(side, side, metric, threshold, True, size).select(F.col("q").alias("i"), "mean_sim", "median_sim", "max_sim", "min_sim", "n_similar")


#: Rows that a task may hold as packed bits, pairs of common bits and bits of the other row that are counted for a row,
#: rows that ask in a task, and rows that are compared at a time.
_PACKED, _CODES, _ASKING, _SLICE = 4_000_000, 8192, 16384, (32, 8192)


def _bit_statistics(side: DataFrame, width: int, n: int, threshold: float) -> DataFrame:
    """similarity_statistics of short bit vectors (id, v), in one pass: a row's similarities follow from how many others
    have so many bits, and so many in common with it. A strip of rows meets all rows as packed bits (a few bytes each)
    and counts that, so its medians are found there: no pair, bin or sum leaves the task, only the results."""
    base = width + 1
    codes = base * base
    schema = pa.schema([("i", pa.int64()), *[(c, pa.float64()) for c in ("mean_sim", "median_sim", "max_sim", "min_sim")], ("n_similar", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            if (np.diff(batch.column(1).offsets.to_numpy()) != width).any():
                raise ValueError("all vectors must have one length")
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            if not ((v == 0) | (v == 1)).all():
                raise ValueError("tanimoto needs vectors of 0 and 1")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(v.astype(np.uint8), axis=1)], pa.binary())], names=["id", "bits"])

    def unpacked(bits: np.ndarray) -> np.ndarray:
        return np.unpackbits(bits, axis=1, count=width).astype(np.float32)

    def run(part: pa.Table) -> pa.Table:
        mine = part.column("id").is_valid().to_numpy()
        bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(part.num_rows, -1)
        ids, own, others = part.column("id").drop_null().to_numpy(), bits[mine], bits[~mine]
        few, many = _SLICE
        place = np.empty(few * many, np.int64)
        rows = []
        for top in range(0, len(own), few):
            x = unpacked(own[top : top + few])
            # The product is the number of the row, the bits in common and the other's bits in one: exact up to 2^24.
            left = np.column_stack([x * base, np.ones(len(x)), np.arange(len(x)) * codes]).astype(np.float32)
            counts = np.zeros(len(x) * codes, np.int64)
            for low in range(0, len(others), many):
                y = unpacked(others[low : low + many])
                right = np.column_stack([y, y.sum(1), np.ones(len(y))]).astype(np.float32)
                at = place[: len(x) * len(y)]
                np.copyto(at.reshape(len(x), len(y)), left @ right.T, casting="unsafe")
                counts += np.bincount(at, minlength=len(counts))
            for k, (row, a) in enumerate(zip(counts.reshape(len(x), codes), x.sum(1).astype(np.int64), strict=True)):
                row[a * base + a] -= 1  # itself
                some = np.flatnonzero(row)
                if len(some):
                    both, bits_ = np.divmod(some, base)
                    s = both / np.maximum(a + bits_ - both, 1)
                    order = np.argsort(s)
                    s, number = s[order], row[some][order]
                    upto = np.cumsum(number)
                    middle = s[np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], side="right")].mean()
                    rows.append((int(ids[top + k]), float(s @ number / upto[-1]), float(middle), float(s[-1]), float(s[0]), int(number[s > threshold].sum())))
        return pa.table([list(c) for c in zip(*rows, strict=True)], schema=schema) if rows else schema.empty_table()

    packed = materialise(side.select("id", "v").mapInArrow(pack, "id long, bits binary"))
    strips = max(32, _blocks(n, _ASKING))
    asking = packed.select(F.pmod(F.xxhash64("id"), F.lit(strips)).cast("int").alias("lo"), "id", "bits")
    asked = packed.select(F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("lo"), F.lit(None).cast("long").alias("id"), "bits")
    return asking.unionByName(asked).groupBy("lo").applyInArrow(run, "i long, mean_sim double, median_sim double, max_sim double, min_sim double, n_similar long")


#: Bins of a round of a row's median.
_BINS = 32


Tiles = Iterator[tuple[slice, np.ndarray, np.ndarray]]


def _tiles(metric: str, exclude_self: bool, emit: Callable[[pa.Table, np.ndarray, Tiles], pa.Table], none: pa.Table) -> Callable[[pa.Table], pa.Table]:
    """For one meeting of a strip of queries with one of rows: emit(table of the queries, their ids in the order of
    similarities, (which queries, ids of rows, similarities) tile by tile, rows in the order of keys). A row's similarity
    with itself is NaN if it is left out."""

    def run(part: pa.Table) -> pa.Table:
        side = part.column("side").to_numpy()
        mine = part.filter(pa.array(side == 0))
        (a, v), (b, w) = _arrays(mine), _arrays(part.filter(pa.array(side == 1)))
        if not len(a) or not len(b):
            return none

        sims = kernel(metric, v, w)

        def tiles() -> Tiles:
            for top in range(0, len(a), _TILE):
                own = slice(top, min(top + _TILE, len(a)))
                for low in range(0, len(b), _TILE):
                    ids = b[low : low + _TILE]
                    s = sims(own, slice(low, low + _TILE))
                    if exclude_self:
                        at = np.searchsorted(ids, a[own])
                        same = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == a[own])
                        s[same, at[same]] = np.nan
                    yield own, ids, s

        return emit(mine.sort_by("id"), a, tiles())

    return run


def _row_statistics(queries: DataFrame, rows: DataFrame, metric: str, threshold: float, exclude_self: bool, size: int | None = None) -> DataFrame:
    """(q, n, mean_sim, median_sim, max_sim, min_sim, n_similar, nearest) of each query with all rows.

    Strips of queries meet strips of rows, and only sums leave a task: one row for each query and strip, or, for the
    median, one for each bin that isn't empty. A median is enclosed between two values that exist: the bins between them
    are counted with their least and largest value in all strips at once, the bin that holds the place takes over, and
    a round ends those whose bin is one value. So there are a few rounds over the strips, and no pair is ever a row."""
    queries, rows = materialise(queries), materialise(rows) if rows is not queries else None
    rows = queries if rows is None else rows
    size = size or _strip(rows)
    nq, nb = _blocks(queries.count(), size), _blocks(rows.count(), size)

    def met(columns: Sequence[str], q: DataFrame) -> DataFrame:
        own = [F.lit(0).alias("side"), "id", "v"]
        left = q.withColumn("lo", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("hi", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select("lo", "hi", *own, *columns)
        right = rows.withColumn("hi", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
        return left.unionByName(right.select("lo", "hi", F.lit(1).alias("side"), "id", "v", *[F.lit(None).cast("double").alias(c) for c in columns])).groupBy("lo", "hi")

    sums = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("total", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("similar", pa.int64()), ("nearest", pa.int64())])

    def summed(mine: pa.Table, ids: np.ndarray, tiles: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        n, similar = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        total, low, high, nearest = np.zeros(len(ids)), np.full(len(ids), np.inf), np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
        for own, others, s in tiles:
            there = ~np.isnan(s)
            n[own] += there.sum(1)
            total[own] += np.where(there, s, 0).sum(1)
            low[own] = np.minimum(low[own], np.where(there, s, np.inf).min(1))
            most = np.where(there, s, -np.inf)
            best = most.argmax(1)  # rows are in the order of keys: the smallest of equal ones
            top = most[np.arange(len(most)), best]
            nearest[own] = np.where(top > high[own], others[best], nearest[own])
            high[own] = np.maximum(high[own], top)
            similar[own] += (most > threshold).sum(1)
        kept = n > 0
        return pa.table([x[kept] for x in (ids, n, total, low, high, similar, nearest)], schema=sums)

    parts = met([], queries).applyInArrow(_tiles(metric, exclude_self, summed, sums.empty_table()), "q long, n long, total double, low double, high double, similar long, nearest long")
    base = materialise(parts.groupBy("q").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_sim"), F.min("low").alias("min_sim"), F.max("high").alias("max_sim"), F.sum("similar").alias("n_similar"), F.min(F.struct((-F.col("high")).alias("s"), "nearest"))["nearest"].alias("nearest")))

    counted = pa.schema([("q", pa.int64()), ("bin", pa.int32()), ("n", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])

    def binned(mine: pa.Table, ids: np.ndarray, tiles: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        low, high = (np.asarray(mine.column(c).to_numpy(zero_copy_only=False), float) for c in ("low", "high"))
        n = np.zeros((len(ids), _BINS), np.int64)
        least, most = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for own, _, s in tiles:
            at = np.flatnonzero((s >= low[own, None]) & (s <= high[own, None]))
            row, x = at // s.shape[1], s.ravel()[at]
            place = row * _BINS + np.minimum((x - low[own][row]) / (high[own] - low[own])[row] * _BINS, _BINS - 1).astype(np.int64)
            n[own] += np.bincount(place, minlength=len(s) * _BINS).reshape(len(s), _BINS)
            np.minimum.at(least[own].reshape(-1), place, x)
            np.maximum.at(most[own].reshape(-1), place, x)
        row, place = np.nonzero(n)
        return pa.table([ids[row], place.astype(np.int32), n[row, place], least[row, place], most[row, place]], schema=counted)

    # below: values under the interval; after: the least value above it, if there is one.
    open_ = base.select("q", "n", F.floor((F.col("n") - 1) / 2).alias("place"), F.lit(0).cast("long").alias("below"), F.col("min_sim").alias("low"), F.col("max_sim").alias("high"), F.lit(None).cast("double").alias("after"), F.col("n").alias("inside"))
    state = materialise(open_)
    while not state.where("low < high").isEmpty():
        # Queries that are done have an empty interval: the strips stay the same, and so do the similarities.
        carried = state.select("q", F.when(F.col("low") < F.col("high"), F.col("low")).alias("low"), F.when(F.col("low") < F.col("high"), F.col("high")).alias("high"))
        q = queries.join(carried, F.col("id") == F.col("q"), "left").select("id", "v", "low", "high")
        bins = met(["low", "high"], q).applyInArrow(_tiles(metric, exclude_self, binned, counted.empty_table()), "q long, bin int, n long, least double, most double")
        whole = bins.groupBy("q", "bin").agg(F.sum("n").alias("k"), F.min("least").alias("least"), F.max("most").alias("most"))
        ordered = Window.partitionBy("q").orderBy("bin")  # _BINS rows at most
        run = whole.select("*", F.sum("k").over(ordered).alias("upto"), F.lead("least").over(ordered).alias("next"))
        placed = run.join(state.select("q", "place", "below", "after", F.col("n").alias("all")), "q").where(F.col("below") + F.col("upto") > F.col("place"))
        chosen = placed.groupBy("q").agg(F.min_by(F.struct("all", "place", (F.col("below") + F.col("upto") - F.col("k")).alias("below"), "least", "most", F.coalesce("next", "after").alias("after"), "k"), "bin").alias("s"))
        moved = chosen.select("q", F.col("s.all").alias("n"), "s.place", "s.below", F.col("s.least").alias("low"), F.col("s.most").alias("high"), "s.after", F.col("s.k").alias("inside"))
        old, state = state, materialise(state.where("low >= high").unionByName(moved))
        discard(old)
    second = F.when((F.col("n") % 2 == 0) & (F.col("place") + 1 >= F.col("below") + F.col("inside")), F.col("after")).otherwise(F.col("low"))
    median = F.when(F.col("n") % 2 == 0, (F.col("low") + second) / 2).otherwise(F.col("low"))
    return base.join(state.select("q", median.alias("median_sim")), "q")


#: Places of a similarity that are told apart where links are put in order, and links of a row that are kept.
_DIGITS, _NEAREST = 12, 8


def near_links(rows: DataFrame, metric: str, k: int | None = None, size: int | None = None) -> DataFrame:
    """(i, near, last) of rows (id, v): the k most similar other rows of each, as (-sim, j) in order, ties to the smaller
    key, and the last of them, null where these are all. Strips meet tile by tile, and a meeting gives k links a row."""
    k = k or _NEAREST
    n = _blocks(rows.count(), size or _strip(rows))
    dealt = rows.select("id", "v").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    spread = dealt.select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "id", "v")
    schema = pa.schema([("i", pa.int64()), ("d", pa.float64()), ("j", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        b, lo, hi = part.column("b").to_numpy(), part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        (a, v), (c, w) = (_arrays(part.filter(pa.array(b == x))) if (b == x).any() else (np.zeros(0, np.int64), np.zeros((0, 0))) for x in (lo, hi))
        if not len(a) or not len(c):
            return schema.empty_table()
        sims = kernel(metric, v, w)
        kept = [(np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)) for x in ((a,) if lo == hi else (a, c))]

        def put(far: np.ndarray, ids: np.ndarray, others: np.ndarray, s: np.ndarray) -> None:
            # What may be under the k-th so far; equal ones are decided by their keys.
            i, j = np.nonzero(s >= (-far[:, -1] - 4 * 10.0**-_DIGITS)[:, None])
            if len(i) > 4 * s.shape[0] * k:  # at first, when all may be
                top = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                i, j = np.nonzero(s >= (top - 4 * 10.0**-_DIGITS)[:, None])
            if not len(i):
                return
            rows_ = np.unique(i)
            i, d, o = np.r_[i, np.repeat(rows_, k)], np.r_[-np.round(s[i, j], _DIGITS), far[rows_].ravel()], np.r_[others[j], ids[rows_].ravel()]
            order = np.lexsort((o, d, i))
            i, d, o = i[order], d[order], o[order]
            first = np.searchsorted(i, rows_)
            at = first[:, None] + np.arange(k)
            far[rows_], ids[rows_] = d[at], o[at]

        for r in range(0, len(a), _TILE):
            for q in range(r if lo == hi else 0, len(c), _TILE):
                own, to = slice(r, min(r + _TILE, len(a))), slice(q, min(q + _TILE, len(c)))
                s = sims(own, to)
                same = lo == hi and r == q
                if same:
                    np.fill_diagonal(s, -np.inf)
                put(kept[0][0][own], kept[0][1][own], c[to], s)
                if not same:
                    put(kept[-1][0][to], kept[-1][1][to], a[own], s.T)
        out = []
        for ids, (far, others) in zip((a, c), kept, strict=False):
            x, y = np.nonzero(np.isfinite(far))
            out.append(pa.table([ids[x], far[x, y], others[x, y]], schema=schema))
        return pa.concat_tables(out)

    found = spread.groupBy("lo", "hi").applyInArrow(run, "i long, d double, j long")
    near = found.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near"))  # k links for each strip
    return near.select("i", F.slice("near", 1, k).alias("near")).select("i", "near", F.when(F.size("near") == k, F.element_at("near", -1)["d"]).alias("last"))


def best_links(rows: DataFrame, metric: str, size: int | None = None) -> DataFrame:
    """(head, i, j, sim) of rows (id, v, head): of each row and strip the most similar row with another head, ties to the
    smaller pair of keys."""
    n = _blocks(rows.count(), size or _strip(rows))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = dealt.select("*", other.alias("o")).select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "id", "v", "head")
    schema = pa.schema([("head", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("sim", pa.float64())])

    def run(part: pa.Table) -> pa.Table:
        b, lo, hi = part.column("b").to_numpy(), part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        left, right = (part.filter(pa.array(b == x)).sort_by("id") for x in (lo, hi))
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (a, v), (c, w) = _arrays(left), _arrays(right)
        h, g = left.column("head").to_numpy(), right.column("head").to_numpy()
        best = [(np.full(len(x), -np.inf), np.zeros(len(x), np.int64)) for x in (a, c)]
        sims = kernel(metric, v, w)
        for r in range(0, len(a), _TILE):
            for q in range(0, len(c), _TILE):
                own, to = slice(r, min(r + _TILE, len(a))), slice(q, min(q + _TILE, len(c)))
                if h[own].min() == h[own].max() == g[to].min() == g[to].max():
                    continue
                s = np.where(h[own, None] == g[None, to], -np.inf, np.round(sims(own, to), _DIGITS))
                for (high, where), at, others, t in ((best[0], own, c[to], s), *(() if lo == hi else ((best[1], to, a[own], s.T),))):
                    # The first of equal ones is the one with the smallest key, as rows are in that order: of the links
                    # of one row the smaller pair.
                    first = t.argmax(1)
                    top = t[np.arange(len(t)), first]
                    where[at] = np.where(top > high[at], others[first], where[at])
                    high[at] = np.maximum(high[at], top)
        out = []
        for ids, heads, (high, where) in ((a, h, best[0]), *(() if lo == hi else ((c, g, best[1]),))):
            kept = high > -np.inf
            out.append(pa.table([heads[kept], ids[kept], where[kept], high[kept]], schema=schema))
        return pa.concat_tables(out)

    return spread.groupBy("lo", "hi").applyInArrow(run, "head long, i long, j long, sim double")


def mean_similarity(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, mean_sim): the mean cosine of each row with all others, from the sum of all unit vectors: no pairs. The sum is
    one row as wide as a vector, broadcast. Zero vectors are like nothing."""
    side = _side(df, key, vector)
    norm = F.sqrt(_dot(F.col("v"), F.col("v")))
    unit = side.select("id", F.transform("v", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))).alias("u"))
    sums = unit.select(F.posexplode("u").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"))
    whole = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("sum"), F.lit(side.count()).alias("n"))
    both = unit.crossJoin(F.broadcast(whole)).where("n > 1")
    return both.select(F.col("id").alias("i"), ((_dot(F.col("u"), F.col("sum")) - _dot(F.col("u"), F.col("u"))) / (F.col("n") - 1)).alias("mean_sim"))


def nearest_neighbors(queries: DataFrame, df: DataFrame, key: str, vector: str, k: int = 10, metric: str = "tanimoto", exclude_self: bool = True, size: int | None = None) -> DataFrame:
    """(q, i, sim, rank): the k most similar rows of each query, ties to the smaller key. Strips of queries meet strips
    of rows tile by tile; each meeting keeps k rows a query."""
    q, rows = _side(queries, key, vector), materialise(_side(df, key, vector))
    size = size or _strip(rows)
    nq, nb = _blocks(q.count(), size), _blocks(rows.count(), size)
    left = q.withColumn("lo", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("hi", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("side", F.lit(0))
    right = rows.withColumn("hi", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("side", F.lit(1))

    def run(part: pa.Table) -> pa.Table:
        side = part.column("side").to_numpy()
        (a, v), (b, w) = (_arrays(part.filter(pa.array(side == x))) for x in (0, 1))
        if not len(a) or not len(b):
            return pa.table({"q": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        out = []
        for top in range(0, len(a), _TILE):
            own = a[top : top + _TILE]
            best, sims = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0))
            for low in range(0, len(b), _TILE):
                ids = b[low : low + _TILE]
                s = matrix(metric, v[top : top + _TILE], w[low : low + _TILE])
                if exclude_self:
                    s = np.where(own[:, None] == ids[None, :], -np.inf, s)
                # What is less than the k-th so far can't matter; columns are in the order of keys, and stay so.
                least = sims[:, -1:] if sims.shape[1] == k else np.full((len(own), 1), -np.inf)
                some = np.flatnonzero((s > least).any(0))
                if len(some):
                    both, names = np.hstack([sims, s[:, some]]), np.hstack([best, np.broadcast_to(ids[some], (len(own), len(some)))])
                    order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                    best, sims = np.take_along_axis(names, order, 1), np.take_along_axis(both, order, 1)
            r, c = np.nonzero(sims > -np.inf)
            out.append(pa.table({"q": own[r], "i": best[r, c], "sim": sims[r, c]}))
        return pa.concat_tables(out)

    found = left.unionByName(right).groupBy("lo", "hi").applyInArrow(run, "q long, i long, sim double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "i"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def training_set_similarity(test: DataFrame, train: DataFrame, key: str, vector: str, k: int = 5, metric: str = "tanimoto", size: int | None = None) -> DataFrame:
    """(q, mean_sim, median_sim, max_sim, min_sim, top_k_mean, nearest): each test row against all training rows; ties
    for the nearest go to the smaller key."""
    stats = _row_statistics(_side(test, key, vector), _side(train, key, vector), metric, math.inf, False, size)
    top = nearest_neighbors(test, train, key, vector, k, metric, exclude_self=False, size=size).groupBy("q").agg(F.avg("sim").alias("top_k_mean"))
    return stats.join(top, "q").select("q", "mean_sim", "median_sim", "max_sim", "min_sim", "top_k_mean", "nearest")


def fold_difference(a: Column, b: Column) -> Column:
    """Larger over smaller; infinite if either is zero."""
    return F.when((a == 0) | (b == 0), F.lit(math.inf)).otherwise(F.greatest(a, b) / F.least(a, b))


def _cliffs(fold: float) -> simjoin.Step:
    """(k, n, f, j) of rows (id, v, y, n): for each with partners how many rows these are, and the least (-fold, id)."""
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("f", pa.float64()), ("j", pa.int64())])

    def step(part: pa.Table, tiles: Iterator[tuple[np.ndarray, np.ndarray]], close: simjoin.Close, sims: Callable) -> pa.Table:
        ids, y, n = (part.column(c).to_numpy() for c in ("id", "y", "n"))
        total, least, best = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        for left, right in tiles:
            x, z = np.nonzero(close(left, right))
            x, z = left[x], right[z]
            with np.errstate(divide="ignore", invalid="ignore"):
                f = np.where((y[x] == 0) | (y[z] == 0), np.inf, np.maximum(y[x], y[z]) / np.minimum(y[x], y[z]))
            some = np.flatnonzero((f > fold) | np.isnan(f))  # as in fold_difference, NaN is over all, and comes last
            x, z, f = x[some], z[some], np.where(np.isnan(f[some]), np.inf, -f[some])
            for own, other in ((x, z), (z, x)):
                np.add.at(total, own, n[other])
                order = np.lexsort((ids[other], f, own))
                own, s, j = own[order], f[order], ids[other][order]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else order
                own, s, j = own[first], s[first], j[first]
                better = (s < least[own]) | ((s == least[own]) & (j < best[own]))
                least[own[better]], best[own[better]] = s[better], j[better]
        some = np.flatnonzero(total)
        return pa.table([ids[some], total[some], least[some], best[some]], schema=schema)

    return step


def activity_cliffs(df: DataFrame, key: str, vector: str, activity: str, metric: str = "tanimoto", similar: float = 0.8, fold: float = 10.0) -> DataFrame:
    """df with is_activity_cliff_molecule (yes, no), n_activity_cliff_partners and strongest_cliff_partner: partners
    are more similar than `similar` and more than `fold` times as active or less; the strongest has the largest fold,
    ties to the smaller key.

    Classes of equal vectors meet as the different activities of their rows, each with its number of rows and smallest
    key; copies are not expanded, and a meeting gives a row for each of them at most, no link. Of rows without activity (a fold of zero by zero is infinite, too) one is not its own
    partner, so those of a class are told the two smallest keys."""
    need(df, [activity])
    values = df.select(quoted(key).cast("long").alias("k"), quoted(activity).cast("double").alias("y")).where("y is not null and not isnan(y)")
    nodes, members = nodes_of(df, key, vector, metric, similar)
    rows = members.join(values, F.col("id") == F.col("k")).select("id", "rep", (F.col("y") + 0.0).alias("y"))
    levels = materialise(rows.groupBy("rep", "y").agg(F.count("*").alias("n"), F.min("id").alias("k")))
    met = levels.join(nodes.select(F.col("id").alias("rep"), "v"), "rep").select(F.col("k").alias("id"), "v", "y", "n")
    told = meetings(met, metric, similar, _cliffs(fold), "k long, n long, f double, j long", over=True)
    each = told.groupBy("k").agg(F.sum("n").alias("n"), F.min(F.struct("f", "j")).alias("s")).join(levels.select("rep", "y", "k"), "k").select("rep", "y", "n", "s")
    zeros = levels.where((F.col("y") == 0) & (F.col("n") > 1)).select("rep", "y", (F.col("n") - 1).alias("more"), F.col("k").alias("first"))
    zeros = zeros if similar < 1 else zeros.limit(0)
    second = rows.where("y = 0").join(zeros, ["rep", "y"]).where(F.col("id") != F.col("first")).groupBy("rep", "y").agg(F.min("id").alias("second"))
    told = rows.join(each, ["rep", "y"], "left").join(zeros.join(second, ["rep", "y"]), ["rep", "y"], "left")
    among = F.when(F.col("first").isNotNull(), F.struct(F.lit(-math.inf).alias("f"), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("j")))
    found = told.select("id", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("_n"), F.least("s", among).alias("_s")).where("_n > 0")
    out = df.join(found, quoted(key).cast("long") == F.col("id"), "left")
    return out.select(*[quoted(c) for c in df.columns], F.when(F.col("_n") > 0, "yes").otherwise("no").alias("is_activity_cliff_molecule"), F.coalesce("_n", F.lit(0)).alias("n_activity_cliff_partners"), F.col("_s.j").alias("strongest_cliff_partner"))


def standardise(train: DataFrame, others: Sequence[DataFrame], key: str, vector: str) -> list[DataFrame]:
    """train and others with vector scaled by train's mean and population deviation of each place; places without
    deviation are only centred. The scale is one row as wide as a vector, broadcast."""
    long = train.select(F.posexplode(quoted(vector)).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = long.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))), lambda r: F.struct(r["m"].alias("m"), r["s"].alias("s"))).alias("_scale"))
    put = lambda df: df.crossJoin(F.broadcast(scale)).withColumn(vector, F.zip_with(quoted(vector), F.col("_scale"), lambda x, r: (x.cast("double") - r["m"]) / r["s"])).drop("_scale")
    return [put(df) for df in (train, *others)]
