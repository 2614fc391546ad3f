"""Personal data by fixed patterns, and further identifiers by bootstrapped contexts.

The fixed patterns give e-mail addresses, IP addresses, card and phone numbers; these are seeds, and so are strings of
the shape of keys (long hexadecimal or mixed ones), which are no finding by themselves. The words around a seed induce
lexical patterns: the word before it, the two words before it, the word before and the word after, and for keys their
shape. Other words that look like identifiers (four digits and more, or an @) are candidates. Seeds, candidates and
patterns form a bipartite graph, counted over all documents; its scores are iterated: a pattern is as good as the share
of its occurrences held by known identifiers, a candidate as good as its patterns together (noisy or). A pattern's
occurrences include those before ordinary words, counted in a scan of their own, so a common phrase is never confident.
A candidate is confident if its score is, and if it stands in confident patterns far more often than in those that are
mostly around ordinary words, so a common number is not. Confident candidates are seeds of the next round, of the kind
of the pattern, and make patterns count that had too few seeds before; it ends after ROUNDS rounds without a new one.
Candidates that stand in confident patterns, and confident candidates wherever they stand, join the result.

Words are runs of anything but blanks, an equals sign being a word of its own, without signs at their edges and in lower
case; contexts are made of whole words of whole texts, in the graph and in the counts alike.

Texts are never shuffled: scans emit only (pattern, instance) counts. Up to BLOCK confident patterns and candidates (16
bytes each) are broadcast and applied where the base spans are made; more are applied in blocks, one narrow pass a block.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mixed, named_columns, numbered_columns, slices, thrifty

#: The kinds of the fixed patterns, then that of keys, which only contexts give.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
SECRET = 4
#: Patterns in one broadcast.
BLOCK = 500_000
#: So many without a new identifier are the last ones.
ROUNDS = 3
#: A pattern needs so many different seeds of one kind, and this score.
MIN_SEEDS = 3
CONFIDENT = 0.7

Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"=|[^\s=]+")
_SIGN = re.compile(r"[0-9@]")
_EDGES = ".,;:!?()[]{}\"'<>|*#&%$"
#: Strings of the shape of keys, of one alphabet.
_KEY = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=(?:[^0-9]*[0-9]){3})[A-Za-z0-9_-]{20,}")
#: Kinds of patterns: the last two bits of their keys.
ONE, TWO, AROUND, SHAPE = range(4)
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = 0xFFFFFFFFFFFFFFFF


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and kind; linear in the text."""
    found: list[Span] = []
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL_SET:  # the leftmost match starts where the run of such characters does
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            pos = m.end()
        else:
            pos = at + 1
        at = text.find("@", pos)
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and m.end() - m.start() < 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class _Hashes(dict):
    """Hashes of words as they stand in a text: without signs at the edges, in lower case."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(_EDGES).lower().encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def _keys(kind: int, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Pattern keys, positive longs: of the word before, the two words before, or the words before and after."""
    total = first * np.uint64(_A) + np.uint64(kind + 1)
    if second is not None:
        total = total + second * np.uint64(_B)
    return (mixed(total) >> np.uint64(3) << np.uint64(2) | np.uint64(kind)).astype(np.int64)


def _key(kind: int, first: int, second: int | None = None) -> int:
    return int(_keys(kind, np.array([first], np.uint64), None if second is None else np.array([second], np.uint64))[0])


def shape(token: str) -> str:
    """Of a key: its alphabet and length; empty for other tokens."""
    if len(token) < 20 or not _KEY.fullmatch(token):
        return ""
    if set(token) <= set("0123456789abcdefABCDEF"):
        return f"hex{len(token)}" if not token.isdigit() else ""
    return f"mixed{len(token)}"


def _instance(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.lower().encode("utf-8", "surrogatepass")) >> 1


class Lexed:
    """The words of a text, their places, and the candidates among them: (start, end) of each."""

    def __init__(self, text: str, base: list[Span]) -> None:
        self.text = text
        self.places = [m.span() for m in _WORD.finditer(text)]
        self.starts = np.array([a for a, _ in self.places], np.int64)
        signs = np.array([m.start() for m in _SIGN.finditer(text)], np.int64)
        words, counts = np.unique(np.searchsorted(self.starts, signs, side="right") - 1, return_counts=True)
        taken = sorted((s, e) for s, _, e in base)
        firsts, ends = [s for s, _ in taken], np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else np.zeros(0, np.int64)
        self.candidates: list[tuple[int, int]] = []
        for k, n in zip(words.tolist(), counts.tolist(), strict=True):
            low, high = self.places[k]
            token = text[low:high]
            start, end = low + len(token) - len(token.lstrip(_EDGES)), high - (len(token) - len(token.rstrip(_EDGES)))
            if start >= end or n < 4 and "@" not in token and not shape(text[start:end]):
                continue
            before = int(np.searchsorted(firsts, end))  # spans that start before its end
            if not before or ends[before - 1] <= start:
                self.candidates.append((start, end))

    def around(self, start: int, end: int) -> tuple[list[int], bool]:
        """Hashes of the two words before a span and of the one after, -1 where there is none; whether the span is in
        one word."""
        first = int(np.searchsorted(self.starts, start, side="right")) - 1
        last = int(np.searchsorted(self.starts, end - 1, side="right")) - 1
        word = lambda k: _hashes[self.text[slice(*self.places[k])]] if 0 <= k < len(self.places) else -1
        return [word(first - 2), word(first - 1), word(last + 1)], first == last

    def patterns(self, start: int, end: int) -> list[int]:
        """The keys of the patterns that a span stands in."""
        (two, one, after), single = self.around(start, end)
        out = []
        if one >= 0:
            out.append(_key(ONE, one))
            if two >= 0:
                out.append(_key(TWO, two, one))
            if after >= 0 and single:
                out.append(_key(AROUND, one, after))
        if form := shape(self.text[start:end]):
            out.append(_key(SHAPE, xxhash.xxh3_64_intdigest(form.encode())))
        return out


def lexed(text: str, base: list[Span]) -> Lexed | None:
    """The words of a text that has a span or may have a candidate."""
    return Lexed(text, base) if base or _SIGN.search(text) else None


def graph(documents: DataFrame) -> DataFrame:
    """(pattern, instance, kind, n): kind is the place in KINDS for seeds, -1 for candidates."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: Counter[tuple[int, int, int]] = Counter()
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                if (words := lexed(text, base)) is None:
                    continue
                for start, kind, end in base:
                    for p in words.patterns(start, end):
                        edges[p, _instance(text[start:end]), kind] += 1
                for start, end in words.candidates:
                    kind = SECRET if shape(text[start:end]) else -1
                    for p in words.patterns(start, end):
                        edges[p, _instance(text[start:end]), kind] += 1
            keys = list(edges)
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32()))] + [pa.array([edges[k] for k in keys], pa.int64())], names=["pattern", "instance", "kind", "n"])

    edges = documents.select("text").where("text is not null").mapInArrow(run, "pattern long, instance long, kind int, n long")
    return edges.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n"))


def _blocks(patterns: DataFrame) -> Iterator[np.ndarray]:
    """Sorted pattern keys in blocks of at most BLOCK."""
    n = patterns.count()
    parts = -(-n // BLOCK)
    for k in range(parts):
        part = patterns if parts == 1 else patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        yield np.sort(part.toPandas()["pattern"].to_numpy(np.int64))


def counted(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): how often the contexts of the wanted patterns (sorted keys) stand in texts."""
    words = [t.replace("=", " = ").split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    h = np.fromiter((x for w in words for x in map(_hashes.__getitem__, w)), np.uint64, n)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n) - 1  # words after each in its text
    seen = np.zeros(1 << 20, bool)
    spot = lambda keys: (keys >> 2) & ((1 << 20) - 1)
    seen[spot(wanted)] = True
    found = []
    for kind, keys in (
        (ONE, _keys(ONE, h[left > 0]) if n else np.zeros(0, np.int64)),
        (TWO, _keys(TWO, h[:-1][left[:-1] > 1], h[1:][left[:-1] > 1]) if n > 1 else np.zeros(0, np.int64)),
        (AROUND, _keys(AROUND, h[:-2][left[:-2] > 1], h[2:][left[:-2] > 1]) if n > 2 else np.zeros(0, np.int64)),
    ):
        keys = keys[seen[spot(keys)]]
        if len(keys) and len(wanted):
            at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            found.append(at[wanted[at] == keys])
    counts = np.bincount(np.concatenate(found), minlength=len(wanted)) if found else np.zeros(len(wanted), np.int64)
    there = np.flatnonzero(counts)
    return wanted[there], counts[there]


def occurrences(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the context of each pattern stands in all texts, whatever it surrounds."""
    spark, out = documents.sparkSession, None
    for keys in _blocks(patterns.select("pattern")):
        shared = spark.sparkContext.broadcast(keys)

        @thrifty
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 0):
                    found, counts = counted(part.column(0).to_pylist(), shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts, pa.int64())], names=["pattern", "total"])

        part = documents.select("text").where("text is not null").mapInArrow(run, "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "pattern long, total long")


def learn(documents: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT) -> DataFrame | None:
    """The confident patterns that have candidates, and the confident candidates (pattern, kind, score: a candidate's hash
    is in the place of the pattern's), or None if there are none."""
    edges = materialise(graph(documents))
    seeds = materialise(edges.where("kind >= 0").select("instance", "kind").distinct())
    if seeds.isEmpty():
        return None
    to_find = (F.col("kind") < 0) | (F.col("kind") == SECRET)
    pairs = edges.groupBy("pattern", "instance").agg(F.max("n").alias("n"), F.min("kind").alias("kind"))
    # Only patterns with instances enough and one to find can ever add anything.
    useful = pairs.groupBy("pattern").agg(F.count("*").alias("instances"), F.max(to_find).alias("finds"), F.sum("n").alias("held")).where((F.col("instances") >= min_seeds) & F.col("finds"))
    useful = materialise(useful.select("pattern", "held"))
    if useful.isEmpty():
        return None
    kind_of = F.col("pattern").bitwiseAND(3)
    # Every token of a shape is in the graph; other patterns stand around ordinary words as well.
    totals = useful.join(occurrences(documents, useful.where(kind_of != SHAPE)), "pattern", "left").select("pattern", "held", F.coalesce("total", F.lit(0)).alias("total"))
    # Whether a pattern can be confident at all, were all it holds known; if not, it speaks against what stands in it,
    # but a single word is too common to speak.
    able = (F.col("held") / (F.greatest("total", "n") + 1) >= confident) | (kind_of == ONE)
    kept = materialise(pairs.join(totals, "pattern").select("pattern", "instance", "n", F.greatest("total", "held", "n").alias("total"), able.alias("able")))
    against = materialise(kept.where("not able").groupBy("instance").agg(F.sum("n").alias("against")))
    anchors = seeds.where(F.col("kind") != SECRET)
    # Keys are known by their shape alone, so they are no evidence for a shape before a context has shown them.
    priors = seeds.select("instance", "kind", F.lit(1.0).alias("s"), (F.col("kind") != SECRET).alias("shown"))

    def scored(evidence: DataFrame) -> DataFrame:
        """(pattern, kind, score) of the patterns with seeds enough of their best kind."""
        held = kept.join(evidence, "instance").where((kind_of != SHAPE) | F.col("shown"))
        held = held.groupBy("pattern", "kind").agg(F.count_if(F.col("shown") | (F.col("kind") == SECRET)).alias("c"), (F.sum(F.col("n") * F.col("s")) / (F.max("total") + 1)).alias("score")).where(F.col("c") >= min_seeds)
        # A seed of another kind is no evidence for the pattern's.
        best = held.groupBy("pattern").agg(F.max(F.struct("c", (-F.col("kind")).alias("k"), "score")).alias("b"))
        return best.select("pattern", (-F.col("b.k")).alias("kind"), F.least("b.score", F.lit(1.0)).alias("score"))

    evidence, n_known, quiet = priors, -1, 0
    while quiet < rounds:
        miss = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        raised = kept.join(scored(evidence), "pattern").groupBy("instance", "kind").agg((1 - F.exp(miss)).alias("s"), F.sum(F.when(F.col("score") >= confident, F.col("n")).otherwise(0)).alias("for"))
        sure = (F.col("s") >= confident) & (F.col("for") > 0) & (F.col("for") >= confident * (F.col("for") + F.coalesce("against", F.lit(0))))
        raised = raised.join(against, "instance", "left").select("instance", "kind", "s", sure.alias("shown"))
        known = evidence.where("shown").withColumn("s", F.lit(0.0))
        evidence = materialise(priors.union(known).union(raised).groupBy("instance", "kind").agg(F.max("s").alias("s"), F.max("shown").alias("shown")))
        before, n_known = n_known, evidence.where("shown").count()
        quiet = quiet + 1 if n_known == before else 0
    own = evidence.where("shown").join(anchors, ["instance", "kind"], "left_anti")
    own = own.groupBy("instance").agg(F.max(F.struct("s", (-F.col("kind")).alias("k"))).alias("b")).select(F.col("instance").alias("pattern"), (-F.col("b.k")).alias("kind"), F.col("b.s").alias("score"))
    found = materialise(scored(evidence).where(F.col("score") >= confident).union(own))
    return None if found.isEmpty() else found


def _found_by(text: str, base: list[Span]) -> Iterator[tuple[int, int, list[int]]]:
    """The candidates of a text, and what learn() may have found each by."""
    if (words := lexed(text, base)) is not None:
        for start, end in words.candidates:
            yield start, end, [*words.patterns(start, end), _instance(text[start:end])]


def annotate(documents: DataFrame, patterns: DataFrame | None, at: int) -> DataFrame:
    """documents, with the text at a place, with _pii_base and _pii_spans (arrays of start, kind, end) after its own
    columns; null text has none."""
    spark = documents.sparkSession
    names = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in documents.schema.fields]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans], kind)
    schema = ", ".join([*names, "_pii_base array<struct<start:int,kind:int,end:int>>", "_pii_spans array<struct<start:int,kind:int,end:int>>"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = as_rows([base_spans(x) if x else [] for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, spans, spans], names=[*batch.schema.names, "_pii_base", "_pii_spans"])

    out = documents.mapInArrow(first, schema)
    for k in range(len(KINDS)) if patterns is not None else ():
        for keys in _blocks(patterns.where(F.col("kind") == k)):
            shared = spark.sparkContext.broadcast(keys)

            def more(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
                wanted = set(shared.value.tolist())
                for batch in batches:
                    spans = []
                    for text, base, had in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                        all_of = {(x["start"], x["kind"], x["end"]) for x in had}
                        for start, end, keys in _found_by(text, [(x["start"], x["kind"], x["end"]) for x in base]) if text else ():
                            if any(p in wanted for p in keys):
                                all_of.add((start, k, end))
                        spans.append(sorted(all_of))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], as_rows(spans)], names=batch.schema.names)

            out = out.mapInArrow(more, schema)
    return out


def _spans_of(patterns: DataFrame | None, spark: SparkSession):
    """A function of a text: its base spans and all spans; None if the patterns do not fit one broadcast."""
    n = 0 if patterns is None else patterns.count()
    if n > BLOCK:
        return None
    rows = [] if not n else sorted((r.pattern, r.kind) for r in patterns.select("pattern", "kind").collect())
    shared = spark.sparkContext.broadcast((np.array([p for p, _ in rows], np.int64), np.array([k for _, k in rows], np.int64)))

    def of(text: str | None) -> tuple[list[Span], list[Span]]:
        base = base_spans(text) if text else []
        keys, kinds = shared.value
        found = set(base)
        for start, end, by in _found_by(text, base) if text and len(keys) else ():
            for p in by:
                at = int(np.searchsorted(keys, p))
                if at < len(keys) and keys[at] == p:
                    found.add((start, int(kinds[at]), end))
        return base, sorted(found)

    return of


def _listed(row: list[dict[str, int]]) -> list[Span]:
    return [(x["start"], x["kind"], x["end"]) for x in row]


def find(documents: DataFrame) -> DataFrame:
    """One row for each row of documents (doc_id, text; others are ignored): doc_id, n_email, n_ip, n_card, n_phone
    (base matches), base_sha256 of the base spans, spans, all as kind:start:end in code points, and n_added, how many of
    them are no base spans. Null and empty texts: zeros, the hash of the empty string, no spans. Texts of any length are
    read whole. Repeated rows stay and count as often; a span that several patterns give is one of each kind they
    give. No rows give no rows."""
    documents = documents.select("doc_id", "text")
    patterns = learn(documents)
    of = _spans_of(patterns, documents.sparkSession)
    source = documents if of else annotate(documents, patterns, 1)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                if of:
                    both = [of(x) for x in part.column(1).to_pylist()]
                else:
                    both = [(_listed(b), _listed(s)) for b, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                text = [[",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in row[j]) for row in both] for j in (0, 1)]
                counts = [[sum(k == j for _, k, _ in base) for base, _ in both] for j in range(BASE)]
                added = pa.array([len(spans) - len(base) for base, spans in both], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text[0]], pa.string()), pa.array(text[1], pa.string()), added], names=["doc_id", *[f"n_{k}" for k in KINDS[:BASE]], "base_sha256", "spans", "n_added"])

    kind = dict(documents.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS[:BASE]) + ", base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, at, end = [], 0, -1
    for start, kind, stop in sorted(spans):
        if start >= end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end = max(end, stop)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """documents with every span of text masked; the columns, rows and nulls stay as they are."""
    columns, plain = documents.columns, numbered_columns(documents)
    at, patterns = columns.index("text"), learn(documents.select("text"))
    of = _spans_of(patterns, documents.sparkSession)
    source, names = plain if of else annotate(plain, patterns, at), plain.columns

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                spans = [of(x)[1] for x in texts] if of else map(_listed, part.column(len(columns) + 1).to_pylist())
                texts = [x if not x else masked(x, s) for x, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(len(columns))], names=names)

    return named_columns(source.mapInArrow(run, plain.schema), columns)
