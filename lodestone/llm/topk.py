"""Exact top-k by inner product over integer vectors, with norm buckets.

Vectors are grouped by dimension and length into blocks of near-equal norm. Queries, in blocks of their own, walk the
blocks of candidates from the longest down with a running threshold, the k-th best score so far. For a block whose
longest vector has norm m, a query q needs a cosine of at least t = threshold / (|q| m). Above 1 the block is passed
over; at high t only vectors whose coordinate lies in the feasible interval about q's largest coordinate are kept
(coordinate pruning); else those long enough (length pruning). What is left is verified with exact products.

Query blocks are held in ranges: a range meets the longest block alone first, and its thresholds settle,
by numbers only, which candidate blocks can matter to it. Those are dealt to tasks by (range, run of blocks) and
streamed in order of norm, so a task holds a range of queries and one Arrow batch of candidates, and a vector is copied
once a range, not once a query block. Vectors travel in the smallest integers that hold them. Products are exact: in
doubles where bounds show that they stay below 2**53, else in Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, materialise

SCALE = 64
K = 20


@dataclass(frozen=True)
class Sizes:
    """How the work is cut; results do not depend on it."""

    query_block: int = 4096  # a power of two: a query's number is that of its block and its place there
    block: int = 1024
    range: int = 32  # query blocks that one task holds,
    range_bytes: int = 64_000_000  # and the bytes that they may take as doubles
    run: tuple[int, int] = (16, 1024)  # candidate blocks that one task walks for one range, so that there are tasks enough
    most_ranges: int = 200_000  # ranges whose numbers (40 bytes each) are broadcast; more are joined by a salt


#: From this local cosine threshold on, coordinates prune.
COORDINATE_FROM = 0.8
_SLACK = 1e-9

#: Types of packed vectors by their number; the last is for integers beyond a long, which doubles hold exactly.
_TYPES = (np.int8, np.int16, np.int32, np.int64, np.float64)
_LIMITS = (2.0**7, 2.0**15, 2.0**31, 2.0**63, np.inf)
_BLOCKS = "side int, block long, dim int, n int, max_norm double, kind int, ids binary, vectors binary"
_COLUMNS = ["dim", "range", "run", "side", "block", "n", "max_norm", "kind", "ids", "vectors", "bounds"]
_FOUND = "query_row long, query_id long, vec_id long, score long, beyond string, own boolean"


def _kind(v: np.ndarray) -> int:
    most = float(np.abs(v).max(initial=0))
    return next(k for k, limit in enumerate(_LIMITS) if most < limit)


def _norm(v: np.ndarray) -> float:
    """Length of a vector, of large components as well."""
    most = float(np.abs(v).max(initial=0))
    return most * float(np.sqrt(((v / most) ** 2).sum())) if most else 0.0


def _vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, norm, kind and packed integers of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
            with np.errstate(over="ignore"):
                values = np.floor(values * scale)
            holes = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            kept: list[tuple[int, int, float, int, bytes]] = []
            for k, (vec_id, there) in enumerate(zip(ids, column.is_valid().to_pylist(), strict=True)):
                low, high = offsets[k], offsets[k + 1]
                if vec_id is None or not there or holes[high] > holes[low]:
                    continue
                v = values[low:high]
                kind = _kind(v)
                kept.append((vec_id, len(v), _norm(v), kind, v.astype(_TYPES[kind]).tobytes()))
            columns = list(zip(*kept, strict=True)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "dim", "norm", "kind", "vector"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, dim int, norm double, kind int, vector binary")


def _packed(vectors: DataFrame, side: int, size: int, blocks: int) -> DataFrame:
    """Blocks of at most size rows of one dimension, near-equal in norm; one row each. blocks: how many a partition
    should hold, so that ranges of them are whole."""
    vectors = materialise(vectors)
    parts = max(1, min(buckets(vectors.sparkSession), -(-vectors.count() // (size * blocks))))
    dealt = vectors.repartitionByRange(parts, "dim", F.desc("norm"), F.xxhash64("vec_id")).sortWithinPartitions("dim", F.desc("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held: list[tuple[int, float, int, bytes]] = []
        dim = n = 0

        def block() -> pa.RecordBatch:
            nonlocal held, n
            kind = max(x[2] for x in held)
            rows = b"".join(x[3] if x[2] == kind else np.frombuffer(x[3], _TYPES[x[2]]).astype(_TYPES[kind]).tobytes() for x in held)
            row = [[side], [first + n], [dim], [len(held)], [held[0][1]], [kind], [np.array([x[0] for x in held], np.int64).tobytes()], [rows]]
            held, n = [], n + 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["side", "block", "dim", "n", "max_norm", "kind", "ids", "vectors"])

        for batch in batches:
            for vec_id, d, norm, kind, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (d != dim or len(held) == size):
                    yield block()
                dim = d
                held.append((vec_id, norm, kind, v))
        if held:
            yield block()

    return materialise(dealt.mapInArrow(run, _BLOCKS))


class _Search:
    """A query block walking candidate blocks."""

    def __init__(self, first: int, ids: np.ndarray, vectors: np.ndarray, k: int, bounds: np.ndarray | None) -> None:
        self.first, self.ids, self.vectors, self.k = first, ids, vectors, k  # first: the number of its first query
        self.most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.plain = vectors.astype(np.float64)
        self.norms = np.array([_norm(v) for v in self.plain]) if self.most > 1e150 else np.sqrt((self.plain**2).sum(axis=1))
        self.bound = np.full(len(ids), -np.inf) if bounds is None else bounds[: len(ids)].copy()
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # query, candidate id, score

    def products(self, rows: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Exact: doubles below 2**53, else Python integers."""
        plain = candidates.astype(np.float64)
        if self.most * float(np.abs(plain).max(initial=0)) * max(1, candidates.shape[1]) < 2**53:
            return self.plain[rows] @ plain.T
        whole = lambda x: np.array([[int(y) for y in v] for v in x.tolist()], object).reshape(len(x), -1)
        return whole(self.vectors[rows]) @ whole(candidates).T

    def walk(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, max_norm: float) -> None:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            reach = self.norms * max_norm
            active = np.flatnonzero(reach * (1 + _SLACK) >= self.bound)
            local = np.where((reach[active] > 0) & np.isfinite(reach[active]), self.bound[active] / reach[active], -np.inf)
        if not len(active):
            return
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_length = active[local < COORDINATE_FROM]
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.norms[by_length] > 0, self.bound[by_length] / self.norms[by_length], -np.inf).min()
            keep = np.flatnonzero(norms * (1 + _SLACK) >= least)
            if len(keep):
                found.append(self.top(by_length, self.products(by_length, vectors[keep]), ids[keep]))
        for row, t in zip(active[local >= COORDINATE_FROM].tolist(), local[local >= COORDINATE_FROM].tolist(), strict=True):
            q = self.plain[row] / self.norms[row]
            c = int(np.argmax(np.abs(q)))
            t = min(1.0, t)
            spread = np.sqrt(max(0.0, 1 - q[c] ** 2) * max(0.0, 1 - t**2))
            # Of all vectors, scaled to the block's longest, those of cosine t and over have this coordinate at least.
            sign = 1.0 if q[c] >= 0 else -1.0
            keep = np.flatnonzero(sign * vectors[:, c].astype(np.float64) >= (abs(q[c]) * t - spread) * norms - 1e-6 * max_norm - 1e-9)
            if len(keep):
                one = np.array([row])
                found.append(self.top(one, self.products(one, vectors[keep]), ids[keep]))
        if found:
            self.best = [np.concatenate([old, *new]) for old, new in zip(self.best, zip(*found, strict=True), strict=True)]
            self.cut()

    def top(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of a block for each query, ties to the smaller id."""
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], scores[:, order]
        n = len(ids)
        if n <= self.k:
            pick = np.broadcast_to(np.arange(n), (len(rows), n))
        elif scores.dtype == np.float64 and np.abs(scores).max(initial=0) < 2**52 / n:
            pick = np.argpartition(-(scores * n + np.arange(n - 1, -1, -1)), self.k - 1, axis=1)[:, : self.k]
        else:
            pick = np.array([sorted(range(n), key=lambda x: (-int(scores[r, x]), x))[: self.k] for r in range(len(rows))])
        values = np.take_along_axis(scores, pick, 1)
        at = np.nonzero(values >= self.bound[rows][:, None])
        return rows[at[0]], ids[pick[at]], values[at].astype(np.int64) if values.dtype == np.float64 else values[at]

    def cut(self) -> None:
        rows, ids, scores = self.best
        if scores.dtype == object:
            order = np.array(sorted(range(len(rows)), key=lambda x: (rows[x], -scores[x], ids[x])))
        else:
            order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        full = place == self.k - 1
        least = np.array([np.nextafter(float(x), -np.inf) for x in scores[full]]) if scores.dtype == object else scores[full].astype(np.float64)
        self.bound[rows[full]] = np.maximum(self.bound[rows[full]], least)
        self.best = [rows[keep], ids[keep], scores[keep]]

    def rows(self) -> pa.RecordBatch:
        rows, ids, scores = self.best
        plain = scores.dtype != object
        low, high = -(2**63), 2**63 - 1
        held = scores.astype(np.int64) if plain else np.array([min(max(int(x), low), high) for x in scores], np.int64)
        beyond = [None] * len(rows) if plain else [None if low < int(x) < high else str(abs(int(x))) for x in scores]
        mine = np.flatnonzero(ids == self.ids[rows])
        own = np.zeros(len(rows), bool)
        for k in mine.tolist():  # a row of the query's own id with the query's own product stands for the query's row
            own[k] = int(scores[k]) == sum(int(x) * int(x) for x in self.vectors[rows[k]].tolist())
        return pa.RecordBatch.from_arrays(
            [pa.array(self.first + rows, pa.int64()), pa.array(self.ids[rows], pa.int64()), pa.array(ids, pa.int64()), pa.array(held, pa.int64()), pa.array(beyond, pa.string()), pa.array(own, pa.bool_())],
            names=["query_row", "query_id", "vec_id", "score", "beyond", "own"],
        )


def _walked(units: DataFrame, k: int, sizes: Sizes) -> DataFrame:
    """The best of each query in each run of blocks. units: _COLUMNS, sorted with the queries of a unit first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Search] = []
        key = None
        for batch in batches:
            for x in batch.to_pylist():
                vectors = np.frombuffer(x["vectors"], _TYPES[x["kind"]]).reshape(x["n"], x["dim"])
                ids = np.frombuffer(x["ids"], np.int64)
                if (x["dim"], x["range"], x["run"]) != key:
                    yield from (s.rows() for s in held)
                    held, key = [], (x["dim"], x["range"], x["run"])
                if x["side"] == 0:
                    held.append(_Search(x["block"] * sizes.query_block, ids, vectors, k, None if x["bounds"] is None else np.frombuffer(x["bounds"], np.float64)))
                elif held:
                    plain = vectors.astype(np.float64)
                    norms = np.array([_norm(v) for v in plain]) if x["kind"] == 4 else np.sqrt((plain**2).sum(axis=1))
                    for s in held:
                        s.walk(ids, vectors, norms, x["max_norm"])
        yield from (s.rows() for s in held)

    parts = buckets(units.sparkSession)
    return units.select(*_COLUMNS).repartition(parts, "dim", "range", "run").sortWithinPartitions("dim", "range", "run", "side", F.desc("max_norm"), "block").mapInArrow(run, _FOUND)


def search(embeddings: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, own: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """The k highest inner products of every row of queries with the rows of embeddings of its dimension, ties to the
    smaller vec_id: query_id, rank (from 1), vec_id, score. Components are floor(scale * x). own: the queries are rows
    of embeddings, and each is no candidate for itself; other rows of the same vec_id are.

    Both need vec_id and embedding; other columns are ignored. Rows take no part if the vec_id or the vector is null,
    or a component is null or not finite, scaled as well. Repeated rows count each, as queries and as candidates. Ranks
    go by exact scores; those beyond a long are shown as its bounds. Empty vectors have product 0. A query without
    candidates has no rows, and no rows give none.
    """
    spark, best_of = embeddings.sparkSession, k + own
    candidates = _packed(_vectors(embeddings, scale), 1, sizes.block, 1)
    asked = _packed(_vectors(queries, scale), 0, sizes.query_block, sizes.range)
    # As many blocks as fit; their numbers count up within a partition.
    held = F.greatest(F.lit(1), F.least(F.lit(sizes.range), F.floor(F.lit(sizes.range_bytes) / (sizes.query_block * 8 * F.greatest("dim", F.lit(1))))))
    asked = asked.withColumn("range", F.col("block") - F.pmod(F.col("block").bitwiseAND(0xFFFFFFFF), held))
    blank = F.lit(None).cast("binary").alias("bounds")
    numbers = candidates.select("block", "dim", "max_norm")

    longest = numbers.groupBy("dim").agg(F.max_by("block", F.struct("max_norm", "block")).alias("block"))
    seeds = candidates.join(longest, ["dim", "block"])
    run = F.lit(-1).cast("long").alias("run")
    ranges = asked.select("dim", "range").distinct()
    seeded = asked.withColumns({"run": run, "bounds": blank}).select(*_COLUMNS).unionByName(seeds.join(ranges, "dim").withColumns({"run": run, "bounds": blank}).select(*_COLUMNS))
    kth = _walked(seeded, best_of, sizes).groupBy("query_row").agg(F.count("*").alias("c"), F.min("score").alias("s"), F.count("beyond").alias("beyond")).where((F.col("c") == best_of) & (F.col("beyond") == 0))
    size = sizes.query_block
    bits = size.bit_length() - 1
    places = kth.select(F.shiftright("query_row", bits).alias("block"), F.col("query_row").bitwiseAND(size - 1).cast("int").alias("place"), F.col("s").cast("double").alias("s"))

    def pack(part: pa.Table) -> pa.Table:
        bounds = np.full(size, -np.inf)
        # Bounds keep ties: what is equal to them comes again in the walk itself. A double may be above its long.
        bounds[part.column("place").to_numpy()] = np.nextafter(part.column("s").to_numpy(), -np.inf)
        return pa.table({"block": part.column("block").slice(0, 1), "bounds": pa.array([bounds.tobytes()], pa.binary()), "known": pa.array([part.num_rows], pa.int32()), "least": pa.array([bounds[np.isfinite(bounds)].min()], pa.float64())})

    bounds = materialise(places.groupBy("block").applyInArrow(pack, "block long, bounds binary, known int, least double"))
    asked = asked.join(bounds, "block", "left")

    # Candidate blocks that can matter to a range, by numbers only.
    least = F.when(F.min(F.coalesce(F.col("known") == F.col("n"), F.lit(False))), F.min("least"))
    ranges = materialise(asked.groupBy("dim", "range").agg(F.max("max_norm").alias("q_norm"), least.alias("least")))
    total, n = numbers.groupBy("dim").agg(F.count("*").alias("blocks")), ranges.count()
    wish = F.floor(F.col("blocks") * n / F.lit(4 * buckets(spark)))
    runs = materialise(total.select("dim", F.ceil(F.col("blocks") / F.greatest(F.lit(sizes.run[0]), F.least(F.lit(sizes.run[1]), wish))).alias("runs")))
    can = F.col("least").isNull() | (F.col("q_norm") * F.col("max_norm") * (1 + _SLACK) >= F.col("least"))

    def meeting(blocks: DataFrame) -> DataFrame:
        blocks = blocks.join(runs.hint("broadcast") if n <= sizes.most_ranges else runs, "dim").withColumn("run", F.pmod(F.xxhash64(F.lit(7), "block"), F.col("runs")))
        if n <= sizes.most_ranges:  # a range has a dimension, so there are no more of those
            return blocks.join(F.broadcast(ranges), "dim").where(can)
        salts = buckets(spark)  # a dimension is one key for all rows
        salted = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(salted, ["dim", "salt"]).where(can)

    heads = meeting(numbers).select("dim", "range", "run").distinct().join(asked, ["dim", "range"])
    best = _walked(heads.select(*_COLUMNS).unionByName(meeting(candidates).withColumn("bounds", blank).select(*_COLUMNS)), best_of, sizes)

    above, below = F.when(F.col("score") > 0, F.col("beyond")), F.when(F.col("score") < 0, F.col("beyond"))
    order: list[Column] = [F.desc("score"), F.length(above).desc_nulls_last(), above.desc_nulls_last(), F.length(below).asc_nulls_first(), below.asc_nulls_first(), F.asc("vec_id"), F.desc("own")]
    ordered = Window.partitionBy("query_row").orderBy(*order)
    rank = F.row_number().over(ordered)
    if own:
        mine = F.sum(F.col("own").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        best = best.withColumns({"_mine": mine, "_rank": rank}).where(~(F.col("own") & (F.col("_mine") == 1)))
        rank = F.col("_rank") - F.least("_mine", F.lit(1))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def every(embeddings: DataFrame, divisor: int = 20, k: int = K, sizes: Sizes = Sizes()) -> DataFrame:
    """search with the rows whose vec_id is divisible by divisor as queries, each no candidate for itself."""
    return search(embeddings, embeddings.where(F.col("vec_id") % divisor == 0), k, own=True, sizes=sizes)
