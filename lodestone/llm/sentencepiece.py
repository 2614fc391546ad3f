"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents.

Texts are normalised by the library; segmentation and decoding are done here, by one algorithm for texts of all lengths.
A text is a row of steps from piece to piece, and its segmentation the best way over them. At a place that no piece of
the vocabulary crosses, as before a word, all ways meet: what lies between two such places is segmented on its own, and
remembered. Documents of up to GIANT characters are one chunk. Longer ones are cut into chunks of CHUNK characters and
dealt to all tasks. A boundary between chunks can be crossed in few ways: its state is the last piece that starts before
it and how far that piece reaches beyond. Each chunk yields its transfer matrix, the best weight of a way from every
state at its start to every state at its end, in the max-plus semiring. The product of matrices is associative: they are
combined in a tree of FAN branches, a level a round, over all tasks; the states of the best way go down the same tree,
and then every chunk is backtraced on its own, between its two states. No task holds the matrices of a whole document.

Weights: for a unigram model the scores of the pieces, in whole units of 2**-30, so that sums do not depend on brackets.
Of ways of equal weight the one with the longest last piece is taken, then the longest before it, as the library does;
a matrix has the order of its ways by that rule, so chunks do not change it. A BPE segmentation is the only one in which
each pair of neighbouring pieces is what BPE makes of the pair's own text, so for a BPE model a step weighs zero if its
pair is such, else minus infinity: the one way of weight zero gives exactly the library's pieces, and between two places
that none crosses it is what BPE makes of that text.

The model file is read once by the driver (its path is a parameter) and broadcast; it is at most MAX_MODEL bytes. Models
with symbols that users define, with marks at word ends, or of other kinds (word, char) are refused.
"""

from __future__ import annotations

import struct
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, materialise, numbered_columns, slices, thrifty, thrifty_group, with_row

GIANT = 32_768
CHUNK = 16_384
#: Matrices that one task combines.
FAN = 64
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_GAP = "▁"
#: A model file is at most so large: it is broadcast.
MAX_MODEL = 64_000_000

State = tuple[int, str]  # how far the last piece reaches beyond the boundary, the piece (empty: any)
#: Of each pair of states the best weight, and the place of its way among those to the same end: less is taken first.
Matrix = dict[State, dict[State, tuple[int, int]]]
_START: State = (0, "")
_UNIT = 2.0**30
_WORDS = re.compile(f"{_GAP}*[^{_GAP}]+|{_GAP}+")
#: Words that a worker remembers.
_REMEMBERED = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class _Words(dict):
    """The ids of words, as bytes of 32-bit integers, made when they are first asked for."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        inside, low, parts = self.model.inside, 0, []
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in inside:  # no piece crosses this place
                parts.append(word[low:k])
                low = k
        if parts:
            ids = b"".join(map(self.__getitem__, [*parts, word[low:]]))
        else:
            ids = array("i", self.model.numbers_of(self.model.pieces_of(word))).tobytes()
        if len(word) <= 64:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Model:
    """A SentencePiece model: the library's normaliser and the parts that segmentation and decoding need."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.kind, self.fallback, self.prefix, self.trims, suffix = UNIGRAM, False, True, True, False
        self.unknown_surface = " \u2047 "
        pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0], x.get(3, _NORMAL)))
            elif number == 2:
                x = dict(_fields(value))
                self.kind, self.fallback, suffix = x.get(3, UNIGRAM), bool(x.get(35, 0)), bool(x.get(24, 0))
                self.unknown_surface = x[44].decode() if 44 in x else self.unknown_surface
            elif number == 3:
                x = dict(_fields(value))
                self.prefix, self.trims = bool(x.get(3, 1)), bool(x.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or suffix or any(t == _USER for _, _, t in pieces):
            raise ValueError("only unigram and BPE models without symbols that users define or marks at word ends are supported")
        unit = _UNIT if self.kind == UNIGRAM else 1.0
        self.scores = {p: float(round(s * unit)) if unit > 1 else s for p, s, t in pieces if t == _NORMAL}
        self.ids = {p: k for k, (p, _, t) in enumerate(pieces) if t == _NORMAL}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.unknown = next((k for k, (_, _, t) in enumerate(pieces) if t == _UNKNOWN), 0)
        self.surfaces = np.array([p if t == _NORMAL else self.unknown_surface if t == _UNKNOWN else "" for p, _, t in pieces], object)
        self.is_byte = np.array([t == _BYTE for *_, t in pieces], bool)
        self.longest = max(map(len, self.scores), default=1)
        self.inside = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}
        self.crossed = {x[0] for x in self.inside if x[1] == _GAP and x[0] != _GAP}
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0 * unit
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)

    def merged(self, text: str) -> list[str]:
        """BPE of a text: the best pair first, the leftmost of equals."""
        parts: list[str] = list(text)
        scores = self.scores
        if len(parts) <= 64:
            none, get = -np.inf, scores.get
            pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while pairs and (best := max(pairs)) > none:
                at = pairs.index(best)
                parts[at] += parts.pop(at + 1)
                del pairs[at]
                if at < len(pairs):
                    pairs[at] = get(parts[at] + parts[at + 1], none)
                if at:
                    pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(parts) and (score := scores.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(waiting, (-score, k, parts[k], parts[after[k]]))

        for k in range(len(parts) - 1):
            offer(k)
        while waiting:
            _, k, left, right = heapq.heappop(waiting)
            n = after[k]
            if parts[k] != left or n >= len(parts) or parts[n] != right:  # one of them has grown since
                continue
            parts[k], parts[n] = left + right, ""
            after[k] = after[n]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [x for x in parts if x]

    def pieces_of(self, text: str) -> list[str]:
        """The pieces of a text between two places that no piece crosses."""
        return self.merged(text) if self.kind == BPE else self.between(text, 0, "", len(text), len(text), None)

    def segmented(self, text: str) -> np.ndarray:
        """The ids of a text between two places that no piece crosses, by its words."""
        words = _WORDS.findall(text)
        if self.crossed:  # a piece goes on over the start of a word
            joined: list[str] = []
            for word in words:
                if joined and word[0] == _GAP and joined[-1][-1] in self.crossed:
                    joined[-1] += word
                else:
                    joined.append(word)
            words = joined
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def runs(self, flat: np.ndarray) -> np.ndarray:
        """Ids with each run of unknown characters as one piece, where bytes do not stand for them."""
        if self.fallback or not len(flat):
            return flat
        return flat[np.concatenate(([True], (flat[1:] != self.unknown) | (flat[:-1] != self.unknown)))]

    def encode(self, text: str) -> np.ndarray:
        return self.runs(self.segmented(self.processor.normalize(text)))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with blanks for gaps, runs of bytes as UTF-8 with a replacement for each that is
        none, nothing for control symbols; the gap that normalising puts first is taken off."""
        surfaces, byte_of = self.surfaces, self.byte_of
        coded = self.is_byte[ids]
        if not coded.any():
            return self._plain(surfaces[ids].tolist(), True)
        edges = np.flatnonzero(np.diff(coded, prepend=~coded[:1], append=~coded[-1:])).tolist()
        out: list[str] = []
        for low, high in zip(edges, edges[1:], strict=False):
            if coded[low]:
                out.append(_utf8(bytes(byte_of[k] for k in ids[low:high].tolist())))
            else:
                out.append(self._plain(surfaces[ids[low:high]].tolist(), not any(out)))
        return "".join(out)

    def _plain(self, parts: list[str], first: bool) -> str:
        """The text of pieces; first: nothing stands before them."""
        at = next((k for k, x in enumerate(parts) if x), None) if first and (self.prefix or self.trims) else None
        if at is not None and parts[at].startswith(_GAP):
            parts[at] = parts[at].lstrip(_GAP) if self.trims else parts[at][1:]
        return "".join(parts).replace(_GAP, " ")

    def weight(self, before: str, piece: str) -> float:
        """Of a step from a piece (empty: none, or beyond a place that none crosses) to the next."""
        if self.kind == UNIGRAM:
            return self.scores.get(piece, self.unknown_score)
        key = (before, piece)
        if key not in self.pairs:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[key] = self.merged(before + piece) == ([before] if before else []) + [piece]
        return 0.0 if self.pairs[key] else -np.inf

    def label(self, piece: str) -> str:
        return piece if self.kind == BPE else ""

    def starting(self, text: str, at: int) -> Iterator[str]:
        """Pieces that start at a place of text; a character in none of them stands for itself."""
        if text[at] not in self.scores:
            yield text[at]
        for size in range(1, min(self.longest, len(text) - at) + 1):
            if text[at : at + size] in self.scores:
                yield text[at : at + size]

    def crossing(self, text: str, at: int) -> list[State]:
        """States that a boundary at a place of text can have."""
        out = {}
        for start in range(max(0, at - self.longest), at):
            for piece in self.starting(text, start):
                if start + len(piece) >= at:
                    out[start + len(piece) - at, self.label(piece)] = None
        return list(out)

    def word_starts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and last place in (low, high) that starts a word and that no piece crosses."""
        start = lambda k: text[k] == _GAP and text[k - 1] != _GAP and text[k - 1] + _GAP not in self.inside
        first = next((k for k in range(low + 1, high) if start(k)), None)
        if first is None:
            return None
        return first, next(k for k in range(high - 1, low, -1) if start(k))

    def ways(self, text: str, sources: dict[tuple[int, str], np.ndarray], stop: int, ranked: bool = False) -> tuple[dict[int, dict[str, np.ndarray]], dict, dict[int, dict[str, np.ndarray]]]:
        """Best weights of ways from sources, (place, last piece) with a weight for each origin, over pieces that
        start before stop; for each (place, piece label) the step of the last origin's best way; and if ranked, which
        only models with ties need, for each the starts of its pieces as bits of a number for each origin."""
        best: dict[int, dict[str, np.ndarray]] = {}
        starts: dict[int, dict[str, np.ndarray]] = {}
        low = min((place for place, _ in sources), default=stop)
        ranked = ranked and self.kind == UNIGRAM
        for (place, last), w in sources.items():
            best.setdefault(place, {})[last] = w
            starts.setdefault(place, {})[last] = np.array([0] * len(w), object)
        came: dict[tuple[int, str], tuple[int, str, str]] = {}
        given = {p for p, _ in sources}
        for place in range(min(best, default=stop), stop):
            here = best.get(place)
            if not here:
                continue
            for piece in self.starting(text, place):
                end, label = place + len(piece), self.label(piece)
                for last, w in here.items():
                    step = self.weight(last, piece)
                    if step == -np.inf:
                        continue
                    there, reach = best.setdefault(end, {}), w + step
                    old = there.get(label)
                    if old is None or (reach[-1] > old[-1]):
                        came[end, label] = (place, last, piece)
                    if ranked:
                        bits, had = starts[place][last] + (1 << (place - low)), starts.setdefault(end, {})
                        if old is None:
                            had[label] = bits
                        else:
                            better = (reach > old) | ((reach == old) & (bits < had[label]).astype(bool))
                            had[label] = np.where(better, bits, had[label])
                    there[label] = reach if old is None else np.maximum(old, reach)
            if place not in given:
                del best[place]
                starts.pop(place, None)
        return best, came, starts

    def transfer(self, text: str, low: int, high: int) -> Matrix:
        """The matrix of the chunk [low, high) of text, which has some characters more on both sides."""
        into = self.crossing(text, low) if low else [_START]
        cut = self.word_starts(text, low, high)
        one, none = np.eye(len(into)), np.array([0] * len(into), object)
        sources = {(low + k, label): np.where(one[j] > 0, 0.0, -np.inf) for j, (k, label) in enumerate(into)}
        if cut is None:
            ends, _, starts = self.ways(text, sources, high, True)
            return self._rows(into, {(p - high, label): (w, starts.get(p, {}).get(label, none)) for p, x in ends.items() if p >= high for label, w in x.items()})
        if cut[0] <= low + max(k for k, _ in into):  # a state beyond the cut leads nowhere
            sources = {s: w for s, w in sources.items() if s[0] <= cut[0]}
        heads, _, starts = self.ways(text, sources, cut[0], True)
        reached, bits = np.full(len(into), -np.inf), none
        for label, w in heads.get(cut[0], {}).items():
            better = w > reached
            reached, bits = np.maximum(reached, w), np.where(better, starts.get(cut[0], {}).get(label, none), bits)
        tails, _, _ = self.ways(text, {(cut[1], ""): np.zeros(1)}, high)
        out = {(p - high, label): float(w[0]) for p, x in tails.items() if p >= high for label, w in x.items()}
        return self._rows(into, {s: (reached + w, bits) for s, w in out.items()})

    @staticmethod
    def _rows(into: list[State], columns: dict[State, tuple[np.ndarray, np.ndarray]]) -> Matrix:
        rows: Matrix = {s: {} for s in into}
        for end, (w, bits) in columns.items():
            there = [j for j in range(len(into)) if w[j] > -np.inf]
            for place, j in enumerate(sorted(there, key=lambda j: (bits[j], j))):
                rows[into[j]][end] = (int(w[j]), place)
        return {s: x for s, x in rows.items() if x}

    def between(self, text: str, start: int, last: str, stop: int, end: int, label: str | None) -> list[str]:
        """The pieces of the best way from a place, after a piece, to another."""
        if end == start:
            return []
        best, came, _ = self.ways(text, {(start, last): np.zeros(1)}, stop)
        if label is None:
            label = max(best[end], key=lambda x: best[end][x][0])
        found = []
        while end > start:
            end, label, piece = came[end, label]
            found.append(piece)
        return found[::-1]

    def backtrace(self, text: str, low: int, high: int, into: State, out: State) -> tuple[list[str], str, list[str]]:
        """The pieces of the chunk between two states: those up to its first place that none crosses, the text from
        there to the last such place, and the pieces from there on."""
        start = low + into[0]
        cut = self.word_starts(text, low, high)
        if cut is None:
            return self.between(text, start, into[1], high, high + out[0], out[1]), "", []
        return self.between(text, start, into[1], cut[0], cut[0], None), text[cut[0] : cut[1]], self.between(text, cut[1], "", high, high + out[0], out[1])

    def numbers(self, piece: str) -> list[int]:
        """Ids of a piece, of the bytes of an unknown character."""
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in piece.encode()] if self.fallback else [self.unknown]

    def numbers_of(self, pieces: list[str]) -> list[int]:
        try:
            return list(map(self.ids.__getitem__, pieces))
        except KeyError:
            return list(chain.from_iterable(map(self.numbers, pieces)))

    def chunk_ids(self, text: str, low: int, high: int, into: State, out: State) -> np.ndarray:
        head, middle, tail = self.backtrace(text, low, high, into, out)
        return np.concatenate([np.array(self.numbers_of(head), np.int32), self.segmented(middle), np.array(self.numbers_of(tail), np.int32)])


def _utf8(data: bytes) -> str:
    """Text of bytes, with a replacement character for each byte that belongs to no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


def combined(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices; of equal ways the first by the order of the second matrix."""
    found: dict[State, dict[State, tuple[int, int, int]]] = {}
    for s, row in a.items():
        new: dict[State, tuple[int, int, int]] = {}
        for t, (w, place) in row.items():
            for u, (x, after) in b.get(t, {}).items():
                if (old := new.get(u)) is None or (w + x, -after) > (old[0], -old[1]):
                    new[u] = (w + x, after, place)
        if new:
            found[s] = new
    out: Matrix = {s: {} for s in found}
    for u in {u for row in found.values() for u in row}:
        ordered = sorted((s for s in found if u in found[s]), key=lambda s: (*found[s][u][1:], s))
        for place, s in enumerate(ordered):
            out[s][u] = (found[s][u][0], place)
    return out


def product(matrices: list[Matrix]) -> Matrix:
    out = matrices[0]
    for m in matrices[1:]:
        out = combined(out, m)
    return out


def boundary_states(matrices: list[Matrix], first: State = _START, last: State | None = None) -> list[State]:
    """The states of the best way at each boundary, from one to another: the ends among them. Without a last state the
    best end that has no overhang is taken."""
    sums: list[dict[State, int]] = [{s: w for s, (w, _) in matrices[0].get(first, {}).items()}]
    for m in matrices[1:]:
        new: dict[State, int] = {}
        for t, w in sums[-1].items():
            for u, (x, _) in m.get(t, {}).items():
                if u not in new or w + x > new[u]:
                    new[u] = w + x
        sums.append(new)
    if last is None:
        last = max((s for s in sums[-1] if s[0] == 0), key=lambda s: (sums[-1][s], s))
    states = [last]
    for k in range(len(matrices) - 1, 0, -1):
        options = [(sums[k - 1][s] + row[states[-1]][0], -row[states[-1]][1], s) for s, row in matrices[k].items() if s in sums[k - 1] and states[-1] in row]
        states.append(max(options)[2])
    return [first, *states[::-1]]


def _coded(matrix: Matrix) -> str:
    return json.dumps([[*s, [[*t, w, place] for t, (w, place) in row.items()]] for s, row in matrix.items()])


def _decoded(text: str) -> Matrix:
    return {(k, p): {(a, b): (w, place) for a, b, w, place in row} for k, p, row in json.loads(text)}


def read_model(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MAX_MODEL:
        raise ValueError(f"{path} is over {MAX_MODEL} bytes")
    return data


def _lists(ids: list[list[int] | np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
    flat = [np.asarray(x, np.int32) for x in ids if x is not None]
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))
    gone = pa.array([x is None for x in ids], pa.bool_())
    return pa.compute.if_else(gone, pa.nulls(len(ids), listed.type), listed) if any(x is None for x in ids) else listed


def _solved(matrices: DataFrame, fan: int) -> DataFrame:
    """(_file, _row, chunk, states): the states of each document's best way at both ends of each chunk.

    matrices: _file, _row, chunk, matrix. Runs of fan matrices are combined to one, level by level, until a document
    has at most fan; then the states go down the levels. Only the number of levels comes to the driver."""
    keys = ["_file", "_row"]
    matrices = materialise(matrices.withColumnRenamed("chunk", "node"))
    most = matrices.agg(F.max("node")).first()[0]
    levels, n = [matrices], 0 if most is None else most + 1

    @thrifty_group
    def up(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        whole = product([_decoded(x) for x in part.column("matrix").to_pylist()])
        return pa.table({"_file": part.column("_file").slice(0, 1), "_row": part.column("_row").slice(0, 1), "node": part.column("parent").slice(0, 1), "matrix": pa.array([_coded(whole)], pa.string())})

    while n > fan:
        dealt = levels[-1].withColumn("parent", F.expr(f"node div {fan}"))
        levels.append(materialise(dealt.groupBy(*keys, "parent").applyInArrow(up, "_file long, _row long, node long, matrix string")))
        n = -(-n // fan)

    @thrifty_group
    def down(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        ends = part.column("ends")[0].as_py()
        first, last = ((int(ends[0]), ends[1]), (int(ends[2]), ends[3])) if ends else (_START, None)
        states = boundary_states([_decoded(x) for x in part.column("matrix").to_pylist()], first, last)
        both = [[str(a[0]), a[1], str(b[0]), b[1]] for a, b in zip(states, states[1:], strict=False)]
        return part.select([*keys, "node"]).append_column("states", pa.array(both, pa.list_(pa.string())))

    schema = "_file long, _row long, node long, states array<string>"
    states = levels[-1].withColumns({"parent": F.lit(0).cast("long"), "ends": F.lit(None).cast("array<string>")}).groupBy(*keys, "parent").applyInArrow(down, schema)
    for level in levels[-2::-1]:
        parents = states.select(*keys, F.col("node").alias("parent"), F.col("states").alias("ends"))
        states = level.withColumn("parent", F.expr(f"node div {fan}")).join(parents, [*keys, "parent"]).groupBy(*keys, "parent").applyInArrow(down, schema)
    return states.withColumnRenamed("node", "chunk")


def encode(documents: DataFrame, model: bytes, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN, decoded: bool = False) -> DataFrame:
    """documents (text, others stay) with ids, the pieces' numbers, in place of any column of that name; null text has
    null ids, the empty text none. decoded: with the text decoded from ids, too. Ids do not depend on giant, chunk and
    fan; of equal segmentations that with the longest last pieces is taken. Repeated rows stay; no rows give no rows."""
    spark = documents.sparkSession
    Model(model)  # refuses what it does not support before any job starts
    own = documents.drop("ids", "decoded").columns
    placed = with_row(numbered_columns(documents.drop("ids", "decoded")))
    columns, at = [c for c in placed.columns if c not in ("_file", "_row")], own.index("text")
    text = F.col(f"c{at}")
    shared, kinds = spark.sparkContext.broadcast(model), {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    quoted = lambda names: ", ".join(f"`{c.replace('`', '``')}` {kinds[c]}" for c in names)
    more = ["ids", "decoded"] if decoded else ["ids"]

    @thrifty
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for batch in batches:
            for part in slices(batch, at):
                ids = [None if x is None else known.encode(x) for x in part.column(at).to_pylist()]
                extra = [pa.array([None if x is None else known.decode(x) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids), *extra], names=[*columns, *more])

    long = F.length(text) > giant
    short = placed.where(text.isNull() | ~long).select(*columns).mapInArrow(whole, f"{quoted(columns)}, ids array<int>" + ", decoded string" * decoded)

    @thrifty
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for batch in batches:
            for file, row, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                normal = known.processor.normalize(text)
                for k in range(max(1, -(-len(normal) // chunk))):
                    low, high = max(0, k * chunk - known.longest), min(len(normal), (k + 1) * chunk)
                    one = (file, row, k, normal[low : min(len(normal), high + known.longest)], k * chunk - low, high - low)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["_file", "_row", "chunk", "part", "low", "high"])

    parts = buckets(spark)
    giants = placed.where(long).select("_file", "_row", text.alias("text"))
    chunks = giants.mapInArrow(cut, "_file long, _row long, chunk long, part string, low int, high int")
    chunks = materialise(chunks.repartition(parts, "_file", "_row", "chunk"))  # read for the matrices and the backtrace

    @thrifty
    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for batch in batches:
            found = [_coded(known.transfer(*x)) for x in zip(*[batch.column(c).to_pylist() for c in ("part", "low", "high")], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], names=["_file", "_row", "chunk", "matrix"])

    states = _solved(chunks.mapInArrow(transfers, "_file long, _row long, chunk long, matrix string"), fan)

    @thrifty
    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("part", "low", "high", "states")], strict=True)
            ids = [known.chunk_ids(p, low, high, (int(s[0]), s[1]), (int(s[2]), s[3])) for p, low, high, s in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_file", "_row", "chunk")], _lists(ids)], names=["_file", "_row", "chunk", "ids"])

    # One join plan at all sizes: chunks and giants grow with the documents.
    traced = chunks.join(states.hint("merge"), ["_file", "_row", "chunk"]).select("_file", "_row", "chunk", "part", "low", "high", "states").mapInArrow(backtrace, "_file long, _row long, chunk long, ids array<int>")

    @thrifty_group
    def joined(part: pa.Table) -> pa.Table:
        flat = part.sort_by("chunk").column("ids").combine_chunks().flatten()
        return pa.table({"_file": part.column("_file").slice(0, 1), "_row": part.column("_row").slice(0, 1), "ids": _lists([_known(shared.value).runs(flat.to_numpy(zero_copy_only=False))])})

    # A document's ids are one row of the result, so they meet in one task.
    whole_ids = traced.groupBy("_file", "_row").applyInArrow(joined, "_file long, _row long, ids array<int>")
    joint = placed.where(long).join(whole_ids.hint("merge"), ["_file", "_row"]).select(*columns, "ids")
    return short.unionByName(decode(joint, model) if decoded else joint).toDF(*own, *more)


_models: dict[int, Model] = {}


def _known(data: bytes) -> Model:
    """The model of a file, held by a worker for its later tasks with the words that it remembers."""
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded (ids, others stay) with decoded, the text of the ids, in place of any column of that name; null stays
    null, no ids give the empty text, and repeated rows stay."""
    encoded = encoded.drop("decoded")
    columns, shared = encoded.columns, encoded.sparkSession.sparkContext.broadcast(model)
    at = columns.index("ids")

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([known.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in part.column(at)], pa.string())], names=[*columns, "decoded"])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")


def round_trip(documents: DataFrame, model: bytes, **parameters) -> DataFrame:
    """doc_id, n_tokens, ids, decoded and lossless (decoded equals text) of every row of documents (doc_id, text;
    others are ignored). Null text: null ids, null decoded, no tokens, lossless; the empty text: no ids. Repeated rows
    stay, texts of any length are taken whole, and no rows give no rows."""
    both = encode(documents.select("doc_id", "text"), model, decoded=True, **parameters)
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
