"""Near-duplicate classes by BagMinHash.

A text is a bag of shingles of WIDTH words with their counts. For every shingle, Poisson processes run over its
weight axis, cut into the dyadic parts (0,1], (1,2], (2,4], (4,8] ...; a part of width w has points at rate w for each
signature component, each with a time, a component and a discrete weight in the part. A text of count c has the points
of weight at most c, and a component keeps its earliest point. Two bags agree in a component with the probability of
their weighted Jaccard similarity. Points come in order of time, so only those before a time by which all components
are likely filled are drawn (about ln(components) for each component, whatever the length), and drawing goes on where
one is not.

Equal word sequences are collapsed first. Components are banded; texts that share a band with the band's smallest
text form candidate groups, found as connected components. Groups are split into cells of at most CELL shingles and
CELL_TEXTS texts, the only thing a task ever holds; a group of one cell is verified there, exactly. The cells of larger
groups all get the group's centres, up to CENTRES of its texts, and give each text's best similarity to each class of
centres. The distance 1 - J is a metric: with C linked to A, a text below 0.6 to C has no link to A. So a text stays
pending only if it is linked to no centre, or is at 0.6 to 0.8 to centres of another class. What is pending then, as
where many texts share a template, is joined with the texts of its groups by a prefix filter: two texts of the threshold's similarity share one of their
rarest shingles, at places that bound what they can have in common. No bucket emits its pairs, and no link is lost to
a cap. Only texts of candidate groups are shuffled; a bitmap of bounded size tells them from the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, components, discard, materialise, mixed, named_columns, numbered_columns, rolling, slices, thrifty, thrifty_group, with_row, without, word_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
#: Shingles and texts in a cell, but that a longer text is a cell of its own.
CELL = 2_000_000
CELL_TEXTS = 128
#: Centres of a larger group.
CENTRES = 32
#: Counters of shingles by hash that order them by rarity: 4 MB.
_COUNTERS = 1 << 20
#: Bits of the parity map of a bag, in longs.
_MAP = 16
#: Rarest shingles that a row of a prefix has beside it.
_LEAD = 32
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xA0761D6478BD642F)
_SECOND = np.uint64(0xE7037ED1A0B428DB)


def shingles(words: list[list[bytes]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of all shingles of the texts; one shingle for a text of fewer words, none for one without."""
    sizes = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    flat = np.concatenate([word_hashes(w) for w in words]) if len(words) else np.zeros(0, np.uint64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero(place + width <= np.repeat(sizes, sizes))
    found = rolling(flat, width, _BASE)[starts] if len(starts) else np.zeros(0, np.uint64)
    short = [k for k in np.flatnonzero((sizes > 0) & (sizes < width)).tolist()]
    extra = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[k])) for k in short], np.uint64)
    return np.concatenate([owner[starts], np.array(short, np.int64)]), np.concatenate([found, extra])


def bags(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, value, count) of each text's different shingles, in order."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new], np.diff(np.append(np.flatnonzero(new), len(owner)))


def signatures(owner: np.ndarray, values: np.ndarray, counts: np.ndarray, texts: int, size: int) -> np.ndarray:
    """The times of the earliest points, texts x size; infinite for texts without shingles."""
    out = np.full((texts, size), np.inf)
    entries, part = [], 0
    while True:  # dyadic parts of the weight axis
        lower = 0 if part == 0 else 1 << (part - 1)
        inside = np.flatnonzero(counts > lower)
        if not len(inside):
            break
        entries.append((inside, np.full(len(inside), lower), np.full(len(inside), max(1, lower)), np.full(len(inside), part)))
        part += 1
    if not entries:
        return out
    at, lower, width, parts = (np.concatenate(x) for x in zip(*entries, strict=True))
    total = np.bincount(owner, weights=counts, minlength=texts)
    seeds = mixed(values[at] + parts.astype(np.uint64) * _SECOND)
    holder, weight, rate = owner[at], counts[at], width * float(size)
    until = (np.log(size) + 4) / np.maximum(total, 1)
    waiting = total > 0
    while waiting.any():
        live = np.flatnonzero(waiting[holder])
        fresh = np.full((texts, size), np.inf)
        time, k = np.zeros(len(live)), 0
        while len(live):
            draw = mixed(seeds[live] + np.uint64((k + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[live]
            early = time <= until[holder[live]]
            live, time, draw = live[early], time[early], draw[early]
            spot = mixed(draw ^ _SECOND)
            component = ((spot >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            level = lower[live] + 1 + ((spot & np.uint64(0xFFFFFFFF)) * width[live].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            good = level <= weight[live]
            np.minimum.at(fresh.reshape(-1), holder[live[good]] * size + component[good], time[good])
            k += 1
        full = np.isfinite(fresh).all(axis=1)
        out[waiting & full] = fresh[waiting & full]
        waiting &= ~full
        until = np.where(waiting, until * 2, until)
    return out


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys, texts x bands."""
    bits = times.view(np.uint64).reshape(len(times), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _SECOND, (len(times), bands)).copy()
    for k in range(rows):
        keys = mixed(keys * _STEP + bits[:, :, k])
    return keys.view(np.int64)


def _signed(documents: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """_file, _row, doc_id, digest of the word sequence (null without words), shingles and bands of each row."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, 1_000_000):
                words = [(x or b"").split() for x in part.column(3).to_pylist()]
                bag = bags(*shingles(words, width))
                keys = band_keys(signatures(*bag, len(words), bands * rows), bands, rows)
                digests = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1)))
                sizes = pa.array([max(1, len(w) - width + 1) if w else 0 for w in words], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests, pa.binary()), sizes, listed], names=["_file", "_row", "doc_id", "digest", "shingles", "bands"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("_file", "_row", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"_file long, _row long, doc_id {kind}, digest binary, shingles long, bands array<long>")


def elements(text: bytes, width: int) -> np.ndarray:
    """The bag of a text as a sorted set: the n-th copy of a shingle is an element of its own."""
    _, values, counts = bags(*shingles([text.split()], width))
    several = counts > 1
    parts = [values, *[mixed(values[k] + np.arange(1, c, dtype=np.uint64) * _SECOND) for k, c in zip(np.flatnonzero(several).tolist(), counts[several].tolist(), strict=True)]]
    return np.sort(np.concatenate(parts))


def parities(values: np.ndarray) -> np.ndarray:
    """_MAP longs: for each hash value of that many bits, whether an odd number of elements has it. Two maps differ in
    at most as many bits as elements stand in one bag only."""
    found = np.bincount((mixed(values) % np.uint64(64 * _MAP)).astype(np.int64), minlength=64 * _MAP) & 1
    return np.packbits(found.astype(np.uint8)).view(np.int64)


class Cell:
    """Texts held together, to be compared with centres."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def similarity(self, centre: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of centre and each text."""
        at = np.minimum(np.searchsorted(centre, self.flat), len(centre) - 1)
        common = np.bincount(self.owner[centre[at] == self.flat], minlength=len(self.sizes))
        return common / (self.sizes + len(centre) - common)


def classes_of(sets: list[np.ndarray], similarity: float = SIMILARITY, pivots: int = 8) -> np.ndarray:
    """Class (its smallest place) of each text of a group small enough for one task; no link is missed.

    Every text is compared with the later ones of other classes, but those that cannot be linked: by size, or because
    the distances 1 - J of both to some pivot differ by more than a link allows."""
    cell, n = Cell(sets), len(sets)
    label, reach = np.arange(n), 1 - similarity + 1e-9
    distances: list[np.ndarray] = []
    pivot, nearest = 0, np.full(n, np.inf)
    for _ in range(min(pivots, n)):
        d = 1 - cell.similarity(sets[pivot])
        distances.append(d)
        _join(label, np.append(np.flatnonzero(d <= 1 - similarity), pivot))
        nearest = np.minimum(nearest, d)
        pivot = int(np.argmax(nearest))
    far = np.stack(distances)
    for c in range(n):
        able = np.flatnonzero(label[c + 1 :] != label[c]) + c + 1
        able = able[np.minimum(cell.sizes[able], cell.sizes[c]) >= similarity * np.maximum(cell.sizes[able], cell.sizes[c]) - 1e-9]
        if len(able):
            able = able[(np.abs(far[:, able] - far[:, c : c + 1]) <= reach).all(axis=0)]
        if len(able):
            linked = able[Cell([sets[k] for k in able]).similarity(sets[c]) >= similarity]
            if len(linked):
                _join(label, np.append(linked, c))
    return label


def _join(label: np.ndarray, texts: np.ndarray) -> None:
    same = np.unique(label[texts])
    if len(same) > 1:
        label[np.isin(label, same)] = same[0]


def _verified(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(digest, head) of groups of one cell. texts: group, digest, text."""

    @thrifty_group
    def run(part: pa.Table) -> pa.Table:
        order = np.argsort(np.array([x.hex() for x in part.column("digest").to_pylist()]))
        part = part.take(pa.array(order))
        label = classes_of([elements(x, width) for x in part.column("text").to_pylist()], similarity)
        return pa.table({"digest": part.column("digest"), "head": part.column("digest").take(pa.array(label))})

    return texts.groupBy("group").applyInArrow(run, "digest binary, head binary")


def _links(texts: DataFrame, centres: DataFrame, width: int, similarity: float) -> DataFrame:
    """(digest, centre, s): of each text and class of its group's centres, named by its least one, the best similarity,
    where it is at least 2 * similarity - 1. texts: group, cell, digest, text; centres: the same columns, in each cell
    of their group. Every cell finds the same classes of centres."""

    @thrifty_group
    def run(part: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes, float]] = []
        rows = sorted(zip(part.column("side").to_pylist(), part.column("digest").to_pylist(), part.column("text").to_pylist(), strict=True))
        sets = [elements(x, width) for _, _, x in rows]
        n = sum(side == 0 for side, _, _ in rows)
        if n < len(rows):
            label = classes_of(sets[:n], similarity)
            cell = Cell(sets[n:])
            best = {c: np.zeros(len(rows) - n) for c in np.unique(label).tolist()}
            for k in range(n):
                best[label[k]] = np.maximum(best[label[k]], cell.similarity(sets[k]))
            for c, s in best.items():
                out += [(rows[n + k][1], rows[c][1], float(s[k])) for k in np.flatnonzero(s >= 2 * similarity - 1 - 1e-9).tolist()]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"digest": pa.array(columns[0], pa.binary()), "centre": pa.array(columns[1], pa.binary()), "s": pa.array(columns[2], pa.float64())})

    both = texts.withColumn("side", F.lit(1)).unionByName(centres.withColumn("side", F.lit(0)))
    return both.groupBy("group", "cell").applyInArrow(run, "digest binary, centre binary, s double")


def _prefix_links(texts: DataFrame, pending: DataFrame, label: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): all pairs of different classes, one of them pending, whose similarity is at least the threshold.

    texts: group, digest, text; pending: digest; label: group, digest, head. Shingles are ordered by a counter of their
    hash, so nearly by rarity, and any order gives whole results. Of two such texts the smaller one's first shingles,
    as many as it may miss of the union's half, hold one of the larger one's first shingles. Pairs that meet so are held
    to a second exact bound, by the parity maps of their bags."""
    groups = label.join(pending, "digest", "left_semi").select("group").distinct()
    held = texts.join(groups, "group", "left_semi").join(pending.select("digest", F.lit(True).alias("open")), "digest", "left")
    held = materialise(held.join(label.select("digest", "head"), "digest").select("digest", "head", F.coalesce("open", F.lit(False)).alias("open"), "text"))

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount((elements(text, width) % np.uint64(_COUNTERS)).astype(np.int64), minlength=_COUNTERS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([zstandard.compress(total.tobytes())], pa.binary())], names=["salt", "counters"])

    @thrifty_group
    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in part.column("counters"))
        return pa.table({"salt": pa.array([0], pa.int32()), "counters": pa.array([zstandard.compress(total.tobytes())], pa.binary())})

    # A row a partition, added in two steps; one row comes to the driver.
    schema = "salt int, counters binary"
    told = held.select("text").mapInArrow(count, schema).groupBy("salt").applyInArrow(add, schema).groupBy("salt").applyInArrow(add, schema).first()
    total = np.frombuffer(zstandard.decompress(bytes(told.counters)), np.int64) if told else np.zeros(_COUNTERS, np.int64)
    counters = np.minimum(total, 2**32 - 1).astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(counters)

    @thrifty
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, head, open_, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                values = elements(text, width)
                n = len(values)
                keep = n - int(np.ceil(similarity * n - 1e-9)) + 1
                counted = shared.value[(values % np.uint64(_COUNTERS)).astype(np.int64)]
                order = np.lexsort((values, counted))[:keep]
                at = np.flatnonzero(counted[order] > 1)  # what is counted once stands in no other text
                order, m = order[at], len(at)
                lead = values[order[:_LEAD]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[order].view(np.int64)), pa.array(at, pa.int32()), pa.array(np.arange(m), pa.int32()), pa.array([n] * m, pa.int32()), pa.array([digest] * m, pa.binary()), pa.array([head] * m, pa.binary()), pa.array([open_] * m, pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * _MAP, pa.int32()), pa.array(np.tile(parities(values), m))),
                     pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(lead), pa.int32()), pa.array(np.tile(lead, m)))],
                    names=["token", "at", "k", "n", "digest", "head", "open", "map", "lead"],
                )

    tokens = materialise(held.mapInArrow(prefix, "token long, at int, k int, n int, digest binary, head binary, open boolean, map array<long>, lead array<long>"))
    half = 2 * similarity / (1 + similarity)
    smaller = tokens.where(F.col("at") <= F.col("n") - F.ceil(half * F.col("n") - 1e-9)).select(*[F.col(c).alias(f"{c}_a") if c != "token" else F.col(c) for c in tokens.columns])
    both = (half / 2) * (F.col("n_a") + F.col("n"))
    fits = (F.struct("n_a", "digest_a") < F.struct("n", "digest")) & (F.col("open_a") | F.col("open")) & (F.col("head_a") != F.col("head")) & (F.col("n_a") >= similarity * F.col("n") - 1e-9)
    meets = F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at")) >= both - 1e-9
    # What the parity maps show to stand in one bag only bounds what is common: no link is lost, and texts that share a
    # template but too little else mostly end here.
    apart = F.aggregate(F.zip_with("map_a", "map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    alike = (F.col("n_a") + F.col("n") - apart) / 2 >= both - 1e-9
    # A pair that met before, at a rarer shingle, passed these bounds there, too: of _LEAD shingles each, it is put out
    # at the first, and what meets later more than once goes with the distinct.
    before = F.arrays_overlap(F.slice("lead_a", F.lit(1), F.col("k_a")), F.slice("lead", F.lit(1), F.col("k")))
    pairs = materialise(smaller.join(tokens, "token").where(fits & meets & alike & ~before).select(F.col("digest_a").alias("a"), F.col("digest").alias("b")).distinct())
    sides = pairs.join(held.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a").join(held.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")

    @thrifty
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            good = [float(Cell([elements(x, width)]).similarity(elements(y, width))[0]) >= similarity for x, y in zip(text_a, text_b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    found = materialise(sides.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a binary, b binary"))
    discard(held, tokens, pairs)
    return found


def _verified_in_cells(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(digest, head) of groups of several cells. texts: group, cells, centres (how many), digest, text."""
    texts = materialise(texts.withColumn("cell", F.pmod(F.xxhash64("digest"), F.col("cells")).cast("int")).drop("cells"))
    members = texts.select("group", "digest", "centres")
    # The least texts of each group, by a hash; aggregated in parts before they meet.
    parts = members.select("group", "digest", F.xxhash64("digest").alias("h"), F.pmod(F.xxhash64(F.lit(1), "digest"), F.col("centres")).alias("salt"))
    chosen = materialise(parts.groupBy("group", "salt").agg(F.min(F.struct("h", "digest")).alias("c")).select("group", F.col("c.digest").alias("digest")))
    sent = texts.drop("cell", "centres").join(chosen, ["group", "digest"]).join(texts.select("group", "cell").distinct(), "group").select("group", "cell", "digest", "text")
    links = materialise(_links(texts.select("group", "cell", "digest", "text"), sent, width, similarity))
    certain = links.where(F.col("s") >= similarity)
    least = certain.groupBy("digest").agg(F.min("centre").alias("least"))
    # Classes of centres that a text joins, as a rule very few: components of those alone.
    joined = materialise(certain.join(least, "digest").where("centre != least").select("centre", "least").distinct())
    own = members.select("group", "digest").join(least, "digest", "left").select("group", "digest", F.coalesce("least", "digest").alias("head"), F.col("least").isNull().alias("free"))
    other = links.where(F.col("s") < similarity).select("digest", F.col("centre").alias("other"))
    if not joined.isEmpty():
        same = components(joined, "centre", "least")
        own = own.join(same.withColumnRenamed("head", "whole").withColumnRenamed("node", "head"), "head", "left").select("group", "digest", F.coalesce("whole", "head").alias("head"), "free")
        other = other.join(same.withColumnRenamed("head", "whole").withColumnRenamed("node", "other"), "other", "left").select("digest", F.coalesce("whole", "other").alias("other"))
    label = materialise(own)
    ambiguous = other.join(label.select("digest", "head"), "digest").where("head != other").select("digest")
    pending = label.where("free").select("digest").union(ambiguous).distinct()
    pending = materialise(pending.join(chosen.select("digest"), "digest", "left_anti"))  # centres have met all texts
    if pending.isEmpty():
        return label.select("digest", "head")
    more = _prefix_links(texts.select("group", "digest", "text"), pending, label.select("group", "digest", "head"), width, similarity)
    heads = label.select("digest", "head")
    edges = more.join(heads.withColumnsRenamed({"digest": "a", "head": "head_a"}), "a").join(heads.withColumnsRenamed({"digest": "b", "head": "head_b"}), "b").select("head_a", "head_b")
    whole = components(edges, "head_a", "head_b").withColumnsRenamed({"head": "whole", "node": "head"})
    return heads.join(whole, "head", "left").select("digest", F.coalesce("whole", "head").alias("head"))


def classes(documents: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, cell: int = CELL, cell_texts: int = CELL_TEXTS, centres: int = CENTRES) -> DataFrame:
    """_file, _row, doc_id, class_id (the smallest doc_id of the class), class_size (rows), n_texts (different word
    sequences) and kept (true for one row of each class, the first by doc_id, then by place in the table) of every row
    of documents (with _file and _row; doc_id and text; others are ignored).

    Words are runs of anything but ASCII blanks, unchanged. Rows without words (null, empty, blank) are classes of their
    own; a text of fewer words than the shingles' width is one shingle; texts of any length are taken whole. Similarity
    at the threshold links. Repeated rows are one class. Null ids sort first; a class of only null ids has a null
    class_id. No rows give no rows.
    """
    signed = materialise(_signed(documents, bands, rows, width))
    place = F.struct("doc_id", "_file", "_row")
    texts = materialise(signed.where("digest is not null").groupBy("digest").agg(F.min(place).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("shingles").alias("shingles"), F.first("bands").alias("bands")))

    dealt = texts.select("digest", F.explode("bands").alias("band"))
    heads = materialise(dealt.groupBy("band").agg(F.min("digest").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head"))
    edges = dealt.join(heads, "band").where("digest != head").select("digest", "head")
    groups = materialise(components(edges, "digest", "head")).select(F.col("node").alias("digest"), F.col("head").alias("group"))
    weighed = groups.join(texts.select("digest", "first", "shingles"), "digest")
    cells = F.greatest(F.ceil(F.col("shingles") / cell), F.ceil(F.col("n") / cell_texts))
    most = F.greatest(F.lit(1), F.least(F.lit(centres), F.floor(cell * F.col("n") / F.col("shingles"))))
    sizes = materialise(weighed.groupBy("group").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles")).select("group", cells.alias("cells"), most.alias("centres")))
    wanted = materialise(weighed.join(sizes, "group").select("group", "cells", "centres", "digest", F.col("first._file").alias("_file"), F.col("first._row").alias("_row")))
    source = documents.select("_file", "_row", F.col("text").cast("binary").alias("text"))
    held = materialise(among(source, ["_file", "_row"], wanted, wanted.count()).select("group", "cells", "centres", "digest", "text"))
    head = _verified(held.where("cells = 1").select("group", "digest", "text"), width, similarity)
    if not sizes.where("cells > 1").isEmpty():
        head = head.unionByName(_verified_in_cells(held.where("cells > 1"), width, similarity))
    head = materialise(head)
    discard(held, wanted, sizes)

    named = texts.select("digest", "first", "least", "n").join(head, "digest", "left").withColumn("head", F.coalesce("head", "digest"))
    summed = named.groupBy("head").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts"), F.min("first").alias("keeper"))
    by_digest = named.select("digest", "head").join(summed, "head").select("digest", "class_id", "class_size", "n_texts", "keeper")
    out = signed.drop("bands").join(by_digest, "digest", "left")
    alone = F.col("digest").isNull()
    kept = alone | ((F.col("keeper._file") == F.col("_file")) & (F.col("keeper._row") == F.col("_row")))
    return out.select("_file", "_row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"), kept.alias("kept"))


def near_duplicates(documents: DataFrame, **parameters) -> DataFrame:
    """classes of documents, without the places of the rows."""
    return classes(with_row(documents.select("doc_id", "text")), **parameters).drop("_file", "_row")


def deduplicate(documents: DataFrame, **parameters) -> DataFrame:
    """The rows of documents that stay: one of each class, with their columns (any, also of the names used here)."""
    placed, at = with_row(numbered_columns(documents)), documents.columns.index
    own = placed.select(F.col(f"c{at('doc_id')}").alias("doc_id"), F.col(f"c{at('text')}").alias("text"), "_file", "_row")
    gone = materialise(classes(own, **parameters).where("not kept").select("_file", "_row"))
    return named_columns(without(placed, ["_file", "_row"], gone, gone.count()), documents.columns)
