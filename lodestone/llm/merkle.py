"""Merkle manifests of tables: a hash tree for each group of rows, and one over the groups' roots.

Rows are dealt by range to partitions of bounded size in the order of the trees. A partition reduces its leaves to a
sparse forest: nodes whose siblings lie elsewhere, keyed by tree, level and index. Forests form a monoid: merging two
joins the runs of siblings that are complete then (the size of each tree is known, so the size of each run is), and
neighbouring partitions are merged in a tree of rounds, each written to the shared folder. Only neighbours merge, so a
forest holds the ends of a contiguous range at any time: some thirty nodes a level, however many leaves it stands for.

Defined results: null values are the text "-"; a null group is a group of its own and the first; in a group, leaves
ascend by the order column (null first), ties by leaf, so repeated rows are leaves of their own whichever comes first;
an empty table has no root and no rows. Only the named columns are read, whatever else there is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import quoted
from .common import discard, fold, materialise

#: Children of a node.
ARITY = 16
#: Leaves that a partition may have; where the shuffle partitions are too few for that, more are taken.
LEAVES = 200_000
#: Neighbouring forests merged in one task of a round.
MERGED = 16
#: The tree over the roots of the others.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple[int, int, int, int, str]  # tree, its leaves, level, index, hash


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: Iterable[Column]) -> Column:
    """sha256 in hex of the values one after the other: "-" for null, else the length in bytes, ":" and the value."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in as_text]).cast("binary"), 256)


def width(leaves: int, level: int) -> int:
    """How many nodes a tree has on a level."""
    return -(-leaves // ARITY**level)


def height(leaves: int) -> int:
    """How many levels a tree has above its leaves."""
    return next(level for level in range(64) if width(leaves, level) == 1)


def climbed(value: str, steps: Iterable[tuple[str, str]]) -> str:
    """What a node's hash comes to with what stands left and right of it, level by level."""
    for before, after in steps:
        value = digest(before + value + after)
    return value


class Forest:
    """Nodes that wait for their siblings, and what was made on the way. trees: how many trees there are in all."""

    def __init__(self, trees: int) -> None:
        self.trees = trees
        self.waiting: dict[tuple[int, int, int], dict[int, str]] = {}  # (tree, level, run): its nodes by index
        self.leaves: dict[int, int] = {}  # of the trees of waiting nodes
        self.made: list[Node] = []
        self.root: str | None = None

    def add(self, node: Node) -> None:
        """Take a node in, and join each run that it completes, up to the root of all."""
        tree, n, level, index, value = node
        while True:
            there = width(n, level)
            if there == 1:
                if tree == TOP:
                    self.root = value
                    return
                tree, n, level, index = TOP, self.trees, 0, tree
                self.made.append((tree, n, level, index, value))
                continue
            run = index // ARITY
            siblings = self.waiting.setdefault((tree, level, run), {})
            siblings[index] = value
            self.leaves[tree] = n
            if len(siblings) < min(ARITY, there - run * ARITY):
                return
            del self.waiting[tree, level, run]
            value = digest("".join(siblings[i] for i in sorted(siblings)))
            level, index = level + 1, run
            self.made.append((tree, n, level, index, value))

    def nodes(self) -> Iterator[Node]:
        for (tree, level, _), siblings in self.waiting.items():
            for index, value in siblings.items():
                yield tree, self.leaves[tree], level, index, value

    def runs(self) -> set[tuple[int, int, int]]:
        """The runs that wait, and those of all their ancestors."""
        out = set()
        for tree, level, run in self.waiting:
            n = self.leaves[tree]
            while (tree, level, run) not in out:
                out.add((tree, level, run))
                level, index = level + 1, run
                if width(n, level) == 1:
                    if tree == TOP:
                        break
                    tree, n, level, index = TOP, self.trees, 0, tree
                    if n == 1:
                        break
                run = index // ARITY
        return out


_NODES = "part long, kind int, tree long, n long, level int, at long, hash string"
#: Kinds of rows: a waiting node, one made by this merge, the root, and a run that the partition's proofs need.
_WAITING, _MADE, _ROOT, _NEEDED = range(4)


def _rows(part: int, forest: Forest, made: bool, needed: bool) -> pa.Table:
    rows = [(part, _WAITING, *x) for x in forest.nodes()]
    if made:
        rows += [(part, _MADE, *x) for x in forest.made]
    if needed:
        rows += [(part, _NEEDED, tree, 0, level, run, None) for tree, level, run in forest.runs()]
    if forest.root is not None:
        rows.append((part, _ROOT, TOP, forest.trees, 0, 0, forest.root))
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    names = ("part", "kind", "tree", "n", "level", "at", "hash")
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, types, strict=True))})


def _leaves(part: pa.Table) -> tuple[list[tuple[int, int, int]], list[str], list[str], pa.Table]:
    """(tree, its leaves, index) and hash and claim of each row of a partition, in order."""
    part = part.sort_by("number")
    first = {name: part.column(name)[0].as_py() for name in ("rank", "before", "n_first", "n_last")}
    groups = part.column("g").to_pylist()
    places: list[tuple[int, int, int]] = []
    starts = [0, *(k for k in range(1, len(groups)) if groups[k] != groups[k - 1]), len(groups)]
    for j, (low, high) in enumerate(zip(starts, starts[1:], strict=False)):
        n = first["n_first"] if j == 0 else first["n_last"] if high == len(groups) else high - low
        base = first["before"] if j == 0 else 0
        places.extend((first["rank"] + j, n, base + k) for k in range(high - low))
    return places, part.column("leaf").to_pylist(), part.column("claim").to_pylist(), part


@dataclass
class Manifest:
    """leaves: the rows in order with the place of their partition; known: nodes that were not joined where their
    leaves lie; needed: the runs of siblings that partitions lack for proofs; root: of all trees, None without rows."""

    leaves: DataFrame
    known: DataFrame
    needed: DataFrame
    trees: int
    root: str | None
    order: str
    _tables: tuple[DataFrame, ...] = ()

    def _walk(self, schema: str, emit) -> DataFrame:
        trees = self.trees
        run = F.floor(F.col("at") / ARITY).cast("long")
        siblings = self.known.groupBy("tree", "level", run.alias("run")).agg(F.collect_list(F.struct("at", "hash")).alias("nodes"))  # ARITY at most
        lacking = self.needed.select("part", "tree", "level", F.col("at").alias("run")).join(siblings, ["tree", "level", "run"]).select("part", "tree", "level", F.inline("nodes"))

        def run_part(part: pa.Table, outside: pa.Table) -> pa.Table:
            places, leaves, claims, part = _leaves(part)
            forest = Forest(trees)
            nodes: dict[tuple[int, int], dict[int, str]] = {}
            sizes = {TOP: trees}
            for (tree, n, index), value in zip(places, leaves, strict=True):
                nodes.setdefault((tree, 0), {})[index] = value
                sizes[tree] = n
                forest.add((tree, n, 0, index, value))
            for tree, _, level, index, value in forest.made:
                nodes.setdefault((tree, level), {})[index] = value
            for tree, level, index, value in zip(*(outside.column(c).to_pylist() for c in ("tree", "level", "at", "hash")), strict=True):
                nodes.setdefault((tree, level), {})[index] = value
            above: dict[tuple[int, int, int], list[tuple[str, str]]] = {}

            def path(tree: int, level: int, index: int) -> list[tuple[str, str]]:
                """What stands left and right of a node among its siblings, and so on up to the root."""
                found = above.get((tree, level, index)) if level else None
                if found is None:
                    there = width(sizes[tree], level)
                    if there == 1:
                        found = [] if tree == TOP else path(TOP, 0, tree)
                    else:
                        run = index // ARITY
                        row, low, high = nodes[tree, level], run * ARITY, min(run * ARITY + ARITY, there)
                        found = [("".join(row[i] for i in range(low, index)), "".join(row[i] for i in range(index + 1, high))), *path(tree, level + 1, run)]
                    if level:
                        above[tree, level, index] = found
                return found

            return emit(part, places, leaves, claims, path)

        return self.leaves.groupBy("part").cogroup(lacking.groupBy("part")).applyInArrow(run_part, schema)

    def proofs(self) -> DataFrame:
        """(order column, leaf, path): of each leaf, what stands left and right of it and of its ancestors among their
        siblings, digests in hex one after the other, up to the root."""
        kind, order = dict(self.leaves.dtypes)["o"], self.order

        def emit(part, places, leaves, claims, path) -> pa.Table:
            paths = [[{"before": a, "after": b} for a, b in path(tree, 0, index)] for tree, _, index in places]
            return pa.table({order: part.column("o"), "leaf": leaves, "path": pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))})

        return self._walk(f"`{order}` {kind}, leaf string, path array<struct<before: string, after: string>>", emit)

    def audit(self) -> DataFrame:
        """(order column, leaf, subroot, root, proof_sha256, folded_root, verified): the leaf's proof as one digest, and
        what the claim, if there is one, or the leaf itself comes to with that proof, and whether that is the root."""
        kind, order = dict(self.leaves.dtypes)["o"], self.order

        def emit(part, places, leaves, claims, path) -> pa.Table:
            proofs, subroots, folded, tops = [], [], [], {}
            for (tree, n, index), own, claim in zip(places, leaves, claims, strict=True):
                steps = path(tree, 0, index)
                proofs.append(digest("".join([x for step in steps for x in step])))
                if tree not in tops:
                    tops[tree] = climbed(own, steps[: height(n)])
                subroots.append(tops[tree])
                folded.append(climbed(own if claim is None else claim, steps))
            return pa.table({order: part.column("o"), "leaf": leaves, "subroot": subroots, "proof_sha256": proofs, "folded_root": folded})

        checked = self._walk(f"`{order}` {kind}, leaf string, subroot string, proof_sha256 string, folded_root string", emit)
        root = F.lit(self.root).cast("string")
        return checked.select(quoted(order), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))

    def discard(self) -> None:
        """Delete the manifest's tables."""
        discard(*self._tables)


def build(df: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", claim: Column | None = None) -> Manifest:
    """The manifest of df: trees of the rows of each group in the order of a column, and a tree of their roots.

    claim: for each row the hash that someone gives for it, which audit() holds against the manifest; null for the row
    itself. A partition tells its number of rows, of groups, and the rows of its first and last group: these few numbers
    a partition are all that the driver sees, and give every leaf its index."""
    spark = df.sparkSession
    narrow = materialise(
        df.select(
            quoted(group).cast("string").alias("g"),
            quoted(order).alias("o"),
            leaf([quoted(c) for c in fields]).alias("leaf"),
            (F.lit(None).cast("string") if claim is None else claim).alias("claim"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // LEAVES))
    keys = ["g", "o", "leaf", "place"]
    dealt = materialise(narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id()).drop("place"))
    discard(narrow)
    part = F.shiftright("number", 33)
    counts = dealt.groupBy(part.alias("part"), "g").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    name = F.coalesce(F.sha2(F.col("g").cast("binary"), 256), F.lit("null")).alias("g")
    ends = counts.groupBy("part").agg(F.min(F.struct("first", "n", name)).alias("a"), F.max(F.struct("first", "n", name)).alias("z"), F.count("*").alias("groups"))
    told = sorted(((r.part, r.groups, r.a.g, r.a.n, r.z.g, r.z.n) for r in ends.collect()), key=lambda r: r[0])
    places, trees = _places(told)
    known_places = spark.createDataFrame(places, "part long, rank long, before long, n_first long, n_last long")
    leaves = dealt.withColumn("part", part).join(F.broadcast(known_places), "part")

    def local(table: pa.Table) -> pa.Table:
        at = table.column("part")[0].as_py()
        places, values, _, _ = _leaves(table)
        forest = Forest(trees)
        for (tree, n, index), value in zip(places, values, strict=True):
            forest.add((tree, n, 0, index, value))
        return _rows(at, forest, made=False, needed=True)

    def merge(table: pa.Table) -> pa.Table:
        forest = Forest(trees)
        for node in zip(*(table.column(c).to_pylist() for c in ("tree", "n", "level", "at", "hash")), strict=True):
            forest.add(node)
        return _rows(table.column("part")[0].as_py(), forest, made=True, needed=False)

    rounds = [materialise(leaves.groupBy("part").applyInArrow(local, _NODES))]
    needed = rounds[0].where(F.col("kind") == _NEEDED)
    known = rounds[0].where(F.col("kind") == _WAITING)
    neighbours = max((r[0] for r in told), default=0) + 1
    while neighbours > 1:
        waiting = rounds[-1].where(F.col("kind") == _WAITING).withColumn("part", F.floor(F.col("part") / MERGED).cast("long"))
        rounds.append(materialise(waiting.groupBy("part").applyInArrow(merge, _NODES)))
        known = known.union(rounds[-1].where(F.col("kind") == _MADE))
        neighbours = -(-neighbours // MERGED)
    roots = [r.hash for table in rounds for r in table.where(F.col("kind") == _ROOT).select("hash").collect()]
    return Manifest(leaves, known, needed, trees, roots[0] if roots else None, order, (dealt, *rounds))


def _places(told: list[tuple]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """For each partition the rank of its first group, how many of that group's rows lie before, and the whole sizes of
    its first and last group; and the number of groups. told: by partition, (part, groups, first group and its rows,
    last group and its rows)."""
    sizes: list[int] = []  # of the groups at the ends of partitions, in order; inner groups stand for themselves
    ranks: list[tuple[int, int, int, int]] = []  # rank of the first group, rows before, places of both in sizes
    last, rank = None, -1
    for _, groups, first, n_first, final, n_final in told:
        if first != last:
            rank += 1
            sizes.append(0)
        before, at = sizes[-1], len(sizes) - 1
        sizes[-1] += n_first
        ranks.append((rank, before, at, at))
        if groups > 1:
            rank += groups - 1
            sizes.append(n_final)
            ranks[-1] = (*ranks[-1][:3], len(sizes) - 1)
        last = final
    return [(t[0], r, before, sizes[a], sizes[z]) for t, (r, before, a, z) in zip(told, ranks, strict=True)], rank + 1


def tampered(fields: Sequence[str] = FIELDS, text: str = "text", order: str = "doc_id") -> Column:
    """A claim for every row whose crc32(order as text) is divisible by five: the leaf with A-Z of the text in lower case."""
    lower = F.translate(quoted(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(fold(order, 5) == 0, leaf([lower if c == text else quoted(c) for c in fields]))
