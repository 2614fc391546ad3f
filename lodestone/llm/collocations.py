"""Collocations: phrases of two to four words that stand together more often than their parts would have it.

Texts are read once, in chunks, and kept as numbers of the chunk's own words. Words frequent in their language get
numbers in a dictionary; all others break a text as punctuation does. Phrases are counted level by level: the key of a
phrase of n words is the number of its first n - 1, in the upper 32 bits, and the number of its last word. A chunk
gives each of its keys once, with a count; keys are range-partitioned, radix-sorted (one long column), and runs of
equal keys added up. Those frequent enough are numbered in that order and go back to their chunks, where a phrase of
n + 1 words can only stand where two frequent ones of n words overlap. So rare phrases are never extended, no key is
hashed, and a task holds a chunk, or streams a range of keys.

Defined results: null and empty texts have no words; a null language is `und`; a text of any length is cut into chunks
(between pieces, or in a piece with the last words repeated for context); repeated rows count each time; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import numbered, quoted
from .common import among, discard, materialise, slices, thrifty, thrifty_group

#: Bytes of text in a chunk.
CHUNK = 12_000_000
#: Words of a phrase, the least occurrences, the rows of a language, and the share (in hundredths) of a phrase's
#: occurrences in a longer one that makes it a mere part of that.
WORDS = 4
LEAST = 30
ROWS = 2000
PART = 80
UNKNOWN = "und"
#: A score is this many times a / (l + r).
SCALE = 2_000_000
#: Numbers of words and phrases are 32 bits wide, and 0 is none.
_MOST = (1 << 32) - 2

#: Pieces end at these, which become full stops; tabs become blanks.
_PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _near(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their steps, byte by byte of all, compressed; the length stands before."""
    planes = np.ascontiguousarray(np.diff(x.astype("<i8"), prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _far(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").reshape(-1))


def segments(text: str, size: int = CHUNK, context: int = WORDS - 1) -> Iterator[tuple[int, list[bytes]]]:
    """(words that only give context, words and full stops) of a text, in parts of about size bytes."""
    plain = text.encode("utf-8", "surrogatepass").lower().translate(_PLAIN)
    low, before = 0, []
    while low < len(plain) or low == 0:
        high, whole = len(plain), True
        if high - low > size:
            high = plain.rfind(b".", low, low + size) + 1
            if high <= low:
                whole = False
                high = plain.rfind(b" ", low, low + size) + 1
                if high <= low:  # one long word
                    high = min((at for at in (plain.find(b" ", low + size), plain.find(b".", low + size)) if at >= 0), default=len(plain))
        words = plain[low:high].replace(b".", b" . ").split()
        yield len(before), before + words
        before = [] if whole else (before + words)[-context:]
        low = max(high, 1)


class _Words(dict):
    """Numbers of a language's words in a chunk, by order of arrival; a full stop is the number with all bits set."""

    def __init__(self, lang: str, chunk: list[tuple[str, bytes]]) -> None:
        super().__init__({b".": 0xFFFFFFFF})
        self.lang, self.chunk = lang, chunk

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.chunk)
        self.chunk.append((self.lang, word))
        return number


class _Chunk:
    def __init__(self, skip: int = 0) -> None:
        self.skip, self.size = skip, 0
        self.words: list[tuple[str, bytes]] = []
        self.langs: dict[str, _Words] = {}
        self.codes: list[np.ndarray] = []

    def add(self, lang: str, tokens: list[bytes]) -> None:
        numbers = self.langs.get(lang)
        if numbers is None:
            numbers = self.langs[lang] = _Words(lang, self.words)
        codes = np.empty(len(tokens) + 1, np.uint32)
        codes[:-1] = np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens))
        codes[-1] = 0xFFFFFFFF
        self.codes.append(codes)
        self.size += sum(map(len, tokens)) + len(tokens)

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """The chunk's numbers, and a row for each of its words with how often it is there."""
        codes = np.concatenate(self.codes)
        self.codes = []
        self.langs = {}
        own = codes[self.skip :]
        counts = np.bincount(own[own != 0xFFFFFFFF], minlength=len(self.words))
        # Frequent words get small numbers, which pack well; a break is 0.
        order = np.argsort(-counts, kind="stable")
        place = np.zeros(len(order) + 1, np.uint32)
        place[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        yield _row_batch(number, codes=[_packed(place[np.minimum(codes, len(order))])], size=[len(codes)], skip=[self.skip])
        for low in range(0, len(order), 20_000):
            part = order[low : low + 20_000]
            words = [self.words[k] for k in part.tolist()]
            yield _row_batch(number, lang=[lang for lang, _ in words], word=[w.decode("utf-8", "surrogatepass") for _, w in words], local=np.arange(low + 1, low + len(part) + 1, dtype=np.int32), n=counts[part])


_CHUNKS = "chunk long, codes binary, size int, skip int, lang string, word string, local int, n long"
_CHUNK_TYPES = {"codes": pa.binary(), "size": pa.int32(), "skip": pa.int32(), "lang": pa.string(), "word": pa.string(), "local": pa.int32(), "n": pa.int64()}


def _row_batch(number: int, **columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    arrays = [pa.array(columns[n], kind) if n in columns else pa.nulls(rows, kind) for n, kind in _CHUNK_TYPES.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, number), pa.int64()), *arrays], names=["chunk", *_CHUNK_TYPES])


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number = _Chunk(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, 1):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for skip, tokens in segments(text, size):
                        if skip or chunk.size >= size:
                            if chunk.codes:
                                yield from chunk.batches(number)
                            chunk, number = _Chunk(skip), number + 1
                        if tokens:
                            chunk.add(lang, tokens)
        if chunk.codes:
            yield from chunk.batches(number)

    return thrifty(run)


_STATE = "chunk long, skip int, size int, pos binary, id binary, last binary"
_STATE_NAMES = ["chunk", "skip", "size", "pos", "id", "last"]


def _state(chunk: int, skip: int, pos: np.ndarray, ids: np.ndarray, last: np.ndarray | None = None) -> pa.Table:
    """Where frequent phrases start in a chunk, their numbers and those of their last words (the same for words). Only
    what a longer phrase can be made of: starts next to another, numbers that one follows, last words that follow one."""
    beside = pos[1:] == pos[:-1] + 1
    after, before = np.r_[beside, False][: len(pos)], np.r_[False, beside][: len(pos)]
    kept = np.flatnonzero(after | before)
    words = b"" if last is None else _packed(np.where(before, last, 0)[kept])
    ids = _packed((ids if last is None else np.where(after, ids, 0))[kept])
    return pa.table(dict(zip(_STATE_NAMES, ([chunk], pa.array([skip], pa.int32()), pa.array([len(kept)], pa.int32()), [_packed(np.diff(pos[kept], prepend=0))], [ids], [words]), strict=True)))


_NO_STATE = pa.table({n: pa.array([], t) for n, t in zip(_STATE_NAMES, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})


def _encode(chunk: pa.Table, words: pa.Table) -> pa.Table:
    """Level 1: the places of frequent words."""
    if not chunk.num_rows or not words.num_rows:
        return _NO_STATE
    row = {n: chunk.column(n)[0].as_py() for n in ("chunk", "codes", "size", "skip")}
    codes = _unpacked(row["codes"], row["size"])
    table = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    table[words.column("local").to_numpy()] = words.column("id").to_numpy()
    ids = table[codes]
    pos = np.flatnonzero(ids)
    return _state(row["chunk"], row["skip"], pos, ids[pos])


def _read(batch) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    chunk, skip, n, pos, ids, last = (batch.column(c)[0].as_py() for c in _STATE_NAMES)
    ids = _unpacked(ids, n)
    return chunk, skip, np.cumsum(_unpacked(pos, n)), ids, _unpacked(last, n) if last else ids


def _keys(pos: np.ndarray, ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, key) of the phrases one word longer: where the next place starts a frequent one, too."""
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    return at, (ids[at] << 32) | last[at + 1]


def _counted(words: int):
    """(chunk, key, n) of the phrases of so many words in each chunk. Those of nothing but context aren't its own and count
    zero times, but longer ones may begin with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                chunk, skip, pos, ids, last = _read(batch.slice(k, 1))
                at, keys = _keys(pos, ids, last)
                context = keys[pos[at] + words <= skip]
                del pos, ids, last, at
                keys, n = np.unique(keys, return_counts=True)
                np.subtract.at(n, np.searchsorted(keys, context), 1)
                for low in range(0, len(keys), 100_000):
                    part = slice(low, low + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), chunk)), pa.array(keys[part]), pa.array(n[part].astype(np.int64))], names=["chunk", "key", "n"])

    return thrifty(run)


def _longer(before: dict[int, int]):
    """The next level's places, from those of this one and the chunk's frequent keys. before: the frequent keys in the
    range partitions before each, as keys are numbered within theirs."""

    def run(state: pa.Table, known: pa.Table) -> pa.Table:
        if not state.num_rows or not known.num_rows:
            return _NO_STATE
        chunk, skip, pos, ids, last = _read(state)
        at, keys = _keys(pos, ids, last)
        parts = list(zip(*(known.column(c).to_pylist() for c in ("part", "keys", "nths")), strict=True))
        wanted = np.concatenate([_far(x) for _, x, _ in parts])
        numbers = np.concatenate([_far(x) + before[part] + 1 for part, _, x in parts])
        order = np.argsort(wanted)
        wanted, numbers = wanted[order], numbers[order]
        place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        there = wanted[place] == keys
        at = at[there]
        return _state(chunk, skip, pos[at], numbers[place[there]], last[at + 1])

    return run


#: Places that a task holds before it gives them out by chunk.
_HELD = 1_000_000
_RUNS = "key long, nth long, f long, of long, keys binary, nths binary"


def _runs(least: int, held: int = _HELD):
    """Adds up runs of equal keys in a sorted stream of (chunk, key, n). Of keys with at least so many occurrences: a row
    (key, nth, f), where nth counts them, and rows (of, keys, nths) with many keys of a chunk in each. Of a run that is
    still below, the chunks are held: fewer than least, and those where it only gives context."""

    def totals(key, nth, f) -> pa.RecordBatch:
        n = len(key)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, nth, f)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["key", "nth", "f", "of", "keys", "nths"])

    def packed(places: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        chunk, key, nth = (np.concatenate(x) for x in zip(*places, strict=True))
        order = np.argsort(chunk, kind="stable")
        chunk, key, nth = chunk[order], key[order].astype("<i8"), nth[order].astype("<i8")
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        for low, high in zip(starts, np.r_[starts[1:], len(chunk)], strict=True):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.array([chunk[low]], pa.int64()), pa.array([_near(key[low:high])], pa.binary()), pa.array([_near(nth[low:high])], pa.binary())], names=["key", "nth", "f", "of", "keys", "nths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, size = 0, 0
        places: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_, total, waiting = None, 0, []  # the last key so far, its count, and its chunks until it is frequent
        for batch in batches:
            if not len(batch):
                continue
            key, chunk, n = (batch.column(c).to_numpy() for c in ("key", "chunk", "n"))
            if open_ is not None and key[0] != open_:
                if total >= least:
                    yield totals([open_], [nth], [total])
                    nth += 1
                open_, total, waiting = None, 0, []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums = np.add.reduceat(n, starts)
            sums[0] += total
            frequent = sums >= least
            numbers = nth + np.cumsum(frequent) - 1
            sizes = np.diff(np.r_[starts, len(key)])
            if frequent[0] and waiting:
                places.append((np.array(waiting), np.full(len(waiting), key[0]), np.full(len(waiting), nth)))
                size += len(waiting)
            kept = np.flatnonzero(np.repeat(frequent, sizes))
            places.append((chunk[kept], key[kept], np.repeat(numbers, sizes)[kept]))
            size += len(kept)
            whole = np.flatnonzero(frequent[:-1])
            yield totals(key[starts[whole]], numbers[whole], sums[whole])
            nth += len(whole)
            waiting = (waiting if len(starts) == 1 else []) + chunk[starts[-1] :].tolist() if not frequent[-1] else []
            open_, total = key[-1], int(sums[-1])
            if size >= held:
                yield from packed(places)
                places, size = [], 0
        if total >= least:
            yield totals([open_], [nth], [total])
        if size:
            yield from packed(places)

    return run


def _frequent(keys: DataFrame, least: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """(key, f, id) of frequent keys, numbered from 1 in their order; (of, part, keys, nths) of where they stand, and how
    many there are before each range partition. keys: a table of (chunk, key, n)."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    summed = materialise(sorted_.mapInArrow(thrifty(_runs(least)), _RUNS).withColumn("part", F.spark_partition_id()))
    sizes = sorted(summed.where("key IS NOT NULL").groupBy("part").agg(F.count("*")).collect())  # one row a partition
    before, places = 0, {}
    for part, n in sizes:
        places[part] = before
        before += n
    if before > _MOST:
        raise ValueError(f"{before} frequent phrases; numbers have 32 bits")
    known = F.broadcast(spark.createDataFrame(list(places.items()), "part int, before long"))
    whole = summed.where("key IS NOT NULL").join(known, "part").select("key", "f", (F.col("before") + F.col("nth") + 1).alias("id"))
    where = summed.where("key IS NULL").select("of", "part", "keys", "nths")
    whole._written = summed._written
    return whole, where, places


def _dictionary(chunks: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, word, f, id) of frequent words, (lang, n) of all words, and (of, local, id) of the chunks."""
    words = chunks.where("codes IS NULL").select("chunk", "local", "lang", "word", "n")
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    frequent = materialise(counts.where(F.col("f") >= least))
    dictionary = materialise(numbered(frequent, ["lang", "word"], "id").select("lang", "word", "f", (F.col("id") + 1).alias("id")))
    n = dictionary.count()
    if n > _MOST:
        raise ValueError(f"{n} frequent words; numbers have 32 bits")
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")))
    known = among(words.select("chunk", "local", "lang", "word"), ["lang", "word"], dictionary.select("lang", "word", "id"), n)
    discard(frequent)
    return dictionary, totals, known.select(F.col("chunk").alias("of"), "local", "id")


def packed_key(*numbers: Column) -> Column:
    """Up to WORDS numbers as one binary key of four bytes each, zeros after them."""
    return F.unhex(F.concat(*[F.lpad(F.hex(x.cast("long")), 8, "0") for x in numbers], F.lit("0" * 8 * (WORDS - len(numbers)))))


def _part(key: str, low: Column, n: Column) -> Column:
    """The words low .. low + n - 1 of a phrase, as a key."""
    return F.rpad(F.substring(F.col(key), 4 * low - 3, 4 * n), 4 * WORDS, F.lit(b"\0"))


def phrases(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, size: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(words, n, f) of all frequent words and phrases, (lang, word, f, id) and (lang, n) of the words; and the tables
    that hold them. words: the packed_key of the n numbers of the dictionary."""
    texts = df.select(F.coalesce(quoted(lang), F.lit(UNKNOWN)).alias("lang"), quoted(text).alias("text")).where("text IS NOT NULL AND text != ''")
    chunks = materialise(texts.mapInArrow(_chunks(size), _CHUNKS))
    dictionary, totals, known = _dictionary(chunks, least)
    state = materialise(chunks.where("codes IS NOT NULL").select("chunk", "codes", "size", "skip").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(thrifty_pair(_encode), _STATE))
    discard(chunks)
    found = [dictionary.select(packed_key(F.col("id")).alias("words"), F.lit(1).alias("n"), "f", "id")]
    tables = [dictionary, totals]
    for n in range(2, WORDS + 1):
        keys = materialise(state.mapInArrow(_counted(n), "chunk long, key long, n long"))
        whole, where, before = _frequent(keys, least)
        discard(keys)
        first, last = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(0xFFFFFFFF)
        named = whole.select(first.alias("first"), last.alias("last"), "f", F.col("id").alias("own"))
        made = materialise(named.join(found[-1].select("words", F.col("id").alias("first")), "first").select(F.rpad(F.concat(F.substring("words", 1, 4 * n - 4), F.unhex(F.lpad(F.hex("last"), 8, "0"))), 4 * WORDS, F.lit(b"\0")).alias("words"), F.lit(n).alias("n"), "f", F.col("own").alias("id")))
        found.append(made)
        tables.append(made)
        if n < WORDS:
            old, state = state, materialise(state.groupBy("chunk").cogroup(where.groupBy("of")).applyInArrow(thrifty_pair(_longer(before)), _STATE))
            discard(old)
        discard(whole)
    discard(state)
    union = found[0]
    for table in found[1:]:
        union = union.unionByName(table)
    return union.select("words", "n", "f"), dictionary, totals, tables


def thrifty_pair(f):
    """As thrifty_group, for cogrouped tables."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return thrifty_group(lambda _: f(a, b))(a)

    return run


def scored(counts: DataFrame) -> DataFrame:
    """(words, n, a, l, r, score) of every phrase of counts that isn't a mere part of a longer one: the cut with the
    lowest floor(SCALE * a / (l + r)), ties to the shortest first part. Products are decimals of 38 digits."""
    several = counts.where("n > 1")
    f = counts.select(F.col("words").alias("part"), F.col("f").alias("of"))
    cut = several.select("words", "n", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    parts = cut.select("*", _part("words", F.lit(1), F.col("k")).alias("head"), _part("words", F.col("k") + 1, F.col("n") - F.col("k")).alias("tail"))
    both = parts.join(f.withColumnsRenamed({"part": "head", "of": "l"}), "head").join(f.withColumnsRenamed({"part": "tail", "of": "r"}), "tail")
    score = F.expr(f"CAST((CAST(a AS DECIMAL(20, 0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS LONG)")
    best = both.select("words", "n", "a", F.struct(score.alias("score"), "k", "l", "r").alias("s")).groupBy("words", "n", "a").agg(F.min("s").alias("s"))
    # Every shorter phrase of two words or more in a longer one, with the largest count of those.
    inner = several.where("n > 2").select("words", "f", F.col("n").alias("whole"), F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("n")).select("words", "f", "n", F.explode(F.sequence(F.lit(1), F.col("whole") - F.col("n") + 1)).alias("at"))
    longest = inner.select(_part("words", F.col("at"), F.col("n")).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer"))
    mere = F.coalesce(F.col("longer").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * PART, F.lit(False))
    return best.join(longest, "words", "left").where(~mere).select("words", "n", "a", "s.l", "s.r", "s.score")


def mine(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, rows: int = ROWS, size: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first rows of each language by score and a, both descending, and
    phrase. a: occurrences; l, r: those of the two parts at the worst cut; n: words of the language. Ranks are row
    numbers over a range partitioning less those of the languages before, so no task holds a whole language."""
    counts, dictionary, totals, tables = phrases(df, lang, text, least, size)
    chosen = scored(counts)
    spelled = chosen.select(F.monotonically_increasing_id().alias("row"), "words", "n", "a", "l", "r", "score")
    spelled = materialise(spelled)
    numbers = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.conv(F.hex(F.substring("words", 4 * k - 3, F.lit(4))), 16, 10).cast("long"))
    names = spelled.select("row", F.posexplode(numbers).alias("at", "id")).join(dictionary.select("id", "lang", "word"), "id")
    texts = names.groupBy("row").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # WORDS at most
    ordered = materialise(numbered(spelled.join(texts, "row").select("lang", "phrase", "a", "l", "r", "score"), ["lang", F.desc("score"), F.desc("a"), "phrase"], "at"))
    starts = ordered.groupBy("lang").agg(F.min("at").alias("start")).join(totals, "lang")
    rank = F.col("at") - F.col("start") + 1
    out = ordered.join(starts, "lang").where(rank <= rows).select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
    discard(spelled, *tables[:1], *tables[2:])
    return out
