"""Substring dedup with difference-cover anchors.

Two equal windows of WINDOW words at places i and j share an anchor: for some d below the period, i + d and j + d are
both places of the difference cover modulo the period, so a run of WINDOW - period + 1 words hashed there is equal in
both. Only the cover's places are hashed (5 of 21), dealt to buckets by hash, and marked if another has their hash.
Anchors extend to the windows that hold a marked anchor; those are hashed whole (96 bits), dealt and marked likewise,
and only windows with an equal one elsewhere remove words.

Documents travel in blocks of about BLOCK bytes. A block sends each bucket its different hashes once, so a passage in a
third of all documents costs a hash a block and no bucket grows with it; a bucket sends back a bit for each hash.
Texts move twice at most: all once with the marks of their anchors, and those with marked anchors once more.
The input is read twice and must give the same rows in the same order both times (a table does); a changed block is
noticed by its number of anchors and fails the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import buckets, mixed, rolling, thrifty, thrifty_group, word_hashes

WINDOW = 35
BLOCK = 4_000_000
#: Bytes of the documents' files for each bucket: a bucket's hashes are about a third of it.
BUCKET = 64_000_000
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xC2B2AE3D27D4EB4F

_ROW = "block long, bucket int, payload binary, flags binary"
_FIELDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("flags", pa.binary())])
#: Values of bucket in rows that hold no hashes: documents, results.
_TEXT, _RESULT = -1, -2


def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of places whose differences take every value modulo period."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return (0, *rest)
    raise ValueError(period)


def period_for(window: int) -> int:
    """A period that leaves anchors of some length: 21 from 30 words on, less for short windows."""
    return next(p for p in (21, 13, 7, 3, 1) if p <= max(1, 2 * window // 3))


class Block:
    """Consecutive documents as word hashes, with the anchors and windows of each."""

    def __init__(self, texts: list[bytes], window: int, period: int, cover: tuple[int, ...]) -> None:
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.values = np.concatenate([word_hashes(w) for w in self.words]) if texts else np.zeros(0, np.uint64)
        self.window, self.period, self.width = window, period, window - period + 1
        n = len(self.values)
        place = np.arange(n) - np.repeat(self.starts[:-1], self.sizes)
        left = np.repeat(self.sizes, self.sizes) - place
        in_cover = np.zeros(period, bool)
        in_cover[list(cover)] = True
        # An anchor matters only in documents that hold a window.
        self.anchors = np.flatnonzero(in_cover[place % period] & (left >= self.width) & (place + left >= window))
        self.anchor_hashes = rolling(self.values, self.width, _BASE)[self.anchors] if len(self.anchors) else np.zeros(0, np.uint64)
        self.opens = left >= window

    def candidates(self, marked: np.ndarray) -> np.ndarray:
        """Places of windows that hold a marked anchor, given which anchors are marked."""
        n = len(self.values)
        seen = np.zeros(n + self.period + 1, np.int64)
        seen[self.anchors[marked] + 1] = 1
        total = np.cumsum(seen)
        return np.flatnonzero(self.opens & (total[np.arange(n) + self.period] > total[:n]))

    def window_hashes(self, places: np.ndarray) -> np.ndarray:
        """Two columns: 64 and 32 bits of the hash of the whole window at each place."""
        if not len(places):
            return np.zeros((0, 2), np.uint64)
        two = [rolling(v, self.window, b)[places] for v, b in ((self.values, _BASE), (mixed(self.values), _BASE2))]
        return np.stack([two[0], two[1] >> np.uint64(32)], axis=1)


def _dealt(block: int, hashes: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows for the buckets: the different hashes in order, and a flag for those that the block has several of.
    hashes: one column of 64 bits, or two, of which 12 bytes are sent."""
    for bucket, _, distinct, counts in _by_bucket(hashes, n):
        yield block, bucket, _pack(distinct), np.packbits(counts > 1).tobytes()


def _pack(distinct: np.ndarray) -> bytes:
    if distinct.ndim == 1:
        return distinct.tobytes()
    return distinct[:, 0].tobytes() + distinct[:, 1].astype(np.uint32).tobytes()


def _by_bucket(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, for each hash in it its place and the number of its value, the different values, their counts)."""
    if not len(hashes):
        return
    first = hashes if hashes.ndim == 1 else hashes[:, 0]
    order = np.argsort(first, kind="stable") if hashes.ndim == 1 else np.lexsort((hashes[:, 1], first))
    rows = hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1] if rows.ndim == 1 else (rows[1:] != rows[:-1]).any(axis=1)
    number = np.cumsum(new) - 1
    distinct, counts = rows[new], np.bincount(number)
    bucket = ((distinct if distinct.ndim == 1 else distinct[:, 0]) % np.uint64(n)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[by]) > 0, [True])))
    where = np.empty(len(distinct), np.int64)
    where[by] = np.arange(len(by))
    at = where[number]  # of each sorted row, the place of its value by bucket
    rows_by = np.argsort(at, kind="stable")
    row_edges = np.searchsorted(at[rows_by], edges)
    for k in range(len(edges) - 1):
        low, high = edges[k], edges[k + 1]
        part = rows_by[row_edges[k] : row_edges[k + 1]]
        yield int(bucket[by[low]]), np.stack([order[part], at[part] - low]), distinct[by[low:high]], counts[by[low:high]]


def _marks(hashes: np.ndarray, n: int, flags: dict[int, bytes]) -> np.ndarray:
    """Which hashes are marked, by the flags that the buckets sent back."""
    out = np.zeros(len(hashes), bool)
    for bucket, places, distinct, _ in _by_bucket(hashes, n):
        sent = flags.get(bucket)
        if sent is None or int.from_bytes(sent[:8], "little") != len(distinct):
            raise RuntimeError("the documents changed between two reads of them; give a table")
        bits = np.unpackbits(np.frombuffer(sent, np.uint8, offset=8), count=len(distinct)).astype(bool)
        out[places[0]] = bits[places[1]]
    return out


def _judge(width: int) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: a bit for each hash of each block, set if another block or place has it too."""

    def run(part: pa.Table) -> pa.Table:
        blocks, sent = part.column("block"), part.column("payload").to_pylist()
        sizes = np.array([len(x) // width for x in sent], np.int64)
        several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=s) for f, s in zip(part.column("flags").to_pylist(), sizes.tolist(), strict=True)]).astype(np.int64)
        first = np.concatenate([np.frombuffer(x, np.uint64, count=s) for x, s in zip(sent, sizes.tolist(), strict=True)])
        keys = (first,) if width == 8 else (np.concatenate([np.frombuffer(x, np.uint32, offset=8 * s) for x, s in zip(sent, sizes.tolist(), strict=True)]), first)
        order = np.lexsort(keys)
        new = np.ones(len(first), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        number = np.cumsum(new) - 1
        total = np.bincount(number, weights=1 + several[order])
        marked = np.zeros(len(first), bool)
        marked[order] = total[number] > 1
        edges = np.concatenate(([0], np.cumsum(sizes)))
        flags = [int(s).to_bytes(8, "little") + np.packbits(marked[a:b]).tobytes() for s, a, b in zip(sizes, edges[:-1], edges[1:], strict=True)]
        return pa.table([blocks, part.column("bucket"), pa.nulls(len(sent), pa.binary()), pa.array(flags, pa.binary())], schema=_FIELDS)

    return run


def _batch(rows: list[tuple[int, int, bytes | None, bytes | None]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """(number, ids, texts) of runs of rows of about size bytes; no row is split."""
    from pyspark import TaskContext

    number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or b"")
            held += len(texts[-1])
            if held >= size or len(ids) >= 20_000:
                yield number, ids, texts
                number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def _packed(ids: list, texts: list[bytes]) -> bytes:
    table = pa.table({"id": pa.array(ids), "text": pa.array(texts, pa.large_binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def _unpacked(payload: bytes) -> tuple[list, list[bytes]]:
    table = pa.ipc.open_stream(zstandard.decompress(payload)).read_all()
    return table.column("id").to_pylist(), table.column("text").to_pylist()


def _result(ids: list, words: list[list[bytes]], removed: list[np.ndarray | None]) -> bytes:
    """Result rows, packed: id, number of words, of removed ones, the kept text."""
    kept = [b" ".join(w) if r is None else b" ".join([x for x, gone in zip(w, r.tolist(), strict=True) if not gone]) for w, r in zip(words, removed, strict=True)]
    table = pa.table({"id": pa.array(ids), "n": pa.array(map(len, words), pa.int64()), "gone": pa.array([0 if r is None else int(r.sum()) for r in removed], pa.int64()), "sha": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _buckets(documents: DataFrame) -> int:
    """How many buckets hashes are dealt to: by the size of the input, at least two for each shuffle partition."""
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = buckets(documents.sparkSession, 2)
    return max(least, -(-size // BUCKET)) if size < 1 << 60 else least  # the most stands for an unknown size


def dedup(documents: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each row of documents (doc_id, text; others are ignored): doc_id, n_words, n_removed (words inside
    a window whose words also start anywhere else), kept_sha256 of the other words, joined by spaces.

    Null and empty texts have no words and the hash of the empty string. Repeated rows are windows elsewhere for each
    other. Texts of fewer words than the window keep all of theirs; longer ones are read whole. No rows give no rows.
    Windows are equal if 96 bits of their hashes are: among 1e13 windows that share an anchor, the chance of any wrong
    pair is under one in a thousand.
    """
    spark, kind = documents.sparkSession, dict(documents.dtypes)["doc_id"]
    period = period_for(window)
    source = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    cover, n = difference_cover(period), _buckets(source)

    def open_block(texts: list[bytes]) -> Block:
        return Block(texts, window, period, cover)

    @thrifty
    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in _blocks(batches, block):
            yield _batch([(number, _TEXT, _packed(ids, texts), None)])

    @thrifty
    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _blocks(batches, block):
            yield _batch(list(_dealt(number, open_block(texts).anchor_hashes, n)))

    def opened(part: pa.Table) -> tuple[int, list, list[bytes], Block, np.ndarray]:
        """A block, its documents, and the places of its candidate windows."""
        flags = {b: f for b, f in zip(part.column("bucket").to_pylist(), part.column("flags").to_pylist(), strict=True) if b >= 0}
        payload = next(p for b, p in zip(part.column("bucket").to_pylist(), part.column("payload").to_pylist(), strict=True) if b == _TEXT)
        ids, texts = _unpacked(payload)
        held = open_block(texts)
        return part.column("block")[0].as_py(), ids, texts, held, held.candidates(_marks(held.anchor_hashes, n, flags))

    @thrifty_group
    def windows_of(part: pa.Table) -> pa.Table:
        number, _, _, held, places = opened(part)
        return pa.Table.from_batches([_batch(list(_dealt(number, held.window_hashes(places), n)))])

    @thrifty_group
    def settled_of(part: pa.Table) -> pa.Table:
        """Results of the documents without candidate windows; the others, packed, with the candidates' places."""
        number, ids, texts, held, places = opened(part)
        touched = np.zeros(len(ids), bool)
        touched[np.searchsorted(held.starts, places, side="right") - 1] = True
        rest = np.flatnonzero(~touched)
        rows = [(number, _RESULT, _result([ids[k] for k in rest], [held.words[k] for k in rest], [None] * len(rest)), None)]
        if touched.any():
            open_ = np.flatnonzero(touched)
            moved = places - held.starts[:-1][np.searchsorted(held.starts, places, side="right") - 1]
            shift = np.concatenate(([0], np.cumsum(held.sizes[open_])))[:-1]
            new = moved + shift[np.searchsorted(open_, np.searchsorted(held.starts, places, side="right") - 1)]
            rows.append((number, _TEXT, _packed([ids[k] for k in open_], [texts[k] for k in open_]), zstandard.compress(np.diff(new, prepend=0).astype(np.int32).tobytes(), 3)))
        return pa.Table.from_batches([_batch(rows)])

    @thrifty_group
    def removed_of(part: pa.Table) -> pa.Table:
        rows = list(zip(part.column("bucket").to_pylist(), part.column("payload").to_pylist(), part.column("flags").to_pylist(), strict=True))
        number = part.column("block")[0].as_py()
        out = [(number, _RESULT, p, None) for b, p, _ in rows if b == _RESULT]
        for b, payload, coded in rows:
            if b == _TEXT:
                ids, texts = _unpacked(payload)
                held = open_block(texts)
                places = np.cumsum(np.frombuffer(zstandard.decompress(coded), np.int32).astype(np.int64))
                marked = _marks(held.window_hashes(places), n, {x: f for x, _, f in rows if x >= 0})
                edge = np.zeros(len(held.values) + 1, np.int64)
                np.add.at(edge, places[marked], 1)
                np.add.at(edge, places[marked] + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                out.append((number, _RESULT, _result(ids, held.words, [gone[a:z] for a, z in zip(held.starts[:-1], held.starts[1:], strict=True)]), None))
        return pa.Table.from_batches([_batch(out)])

    @thrifty
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                table = pa.ipc.open_stream(payload).read_all()
                for x in table.to_batches():
                    yield pa.RecordBatch.from_arrays([x.column(0).cast(target) if x.schema.field(0).type != target else x.column(0), *x.columns[1:]], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    target = to_arrow_type(documents.schema["doc_id"].dataType)
    marked_anchors = source.mapInArrow(anchors_of, _ROW).groupBy("bucket").applyInArrow(_judge(8), _ROW)
    with_anchors = source.mapInArrow(texts_of, _ROW).unionByName(marked_anchors).groupBy("block")
    marked_windows = with_anchors.applyInArrow(windows_of, _ROW).groupBy("bucket").applyInArrow(_judge(12), _ROW)
    done = with_anchors.applyInArrow(settled_of, _ROW).unionByName(marked_windows).groupBy("block").applyInArrow(removed_of, _ROW)
    return done.select("payload").mapInArrow(rows_of, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
