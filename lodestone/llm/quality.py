"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: its words in lower case, hashed to WORDS terms; pairs of neighbouring character classes
(letters, capitals, digits, blanks and each other ASCII sign by itself); and soft bins of some ratios (repeated words,
repeated lines, length and the like). Square roots of relative frequencies, weighted by rarity and projected on the
leading singular vectors of a labelled sample, scaled to length one, make its latent vector. The sample's vectors and
labels are broadcast: at most SAMPLE rows of RANK floats. Every document is multiplied with all of them, a block at a
time, and its NEIGHBOURS nearest vote with their cosines.

The sample, SAMPLE labelled rows by the least hash of doc_id, then of the text, is the only bounded part; every document
is scored from its whole text in one narrow pass, and nothing but the sample's features is moved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

SAMPLE = 4096
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
_BLOCK = 512


def _classes() -> tuple[bytes, int]:
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    number = dict.fromkeys(range(256), 0)  # letters, and all beyond ASCII
    number |= {c: 1 for c in range(65, 91)} | {c: 2 for c in range(48, 58)} | dict.fromkeys((9, 32), 3) | dict.fromkeys((10, 13), 4)
    number |= {c: 6 + k for k, c in enumerate(signs)} | {c: 5 for c in (*range(9), 11, 12, *range(14, 32), 127)}
    return bytes(number[c] for c in range(256)), 6 + len(signs)


_TABLE, _N = _classes()
_BINS = 12
_RATIOS = 8
#: Terms that words are hashed to, and what the words weigh beside the pairs of classes.
WORDS = 2048
_WORD_WEIGHT = 1.0
_PAIRS = _N * _N
_STYLE = _PAIRS + _RATIOS * _BINS
TERMS = _STYLE + WORDS


class _Terms(dict):
    """The terms of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        term = self[word] = xxhash.xxh3_64_intdigest(word.lower().strip(b".,;:!?()[]\"'")) % WORDS
        return term


_terms = _Terms()


def features(text: str | None) -> np.ndarray:
    """The term vector of a text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, np.float32)
    codes = np.frombuffer(raw.translate(_TABLE), np.uint8).astype(np.int64)
    if len(codes) > 1:
        pairs = np.bincount(codes[:-1] * _N + codes[1:], minlength=_N * _N)
        out[:_PAIRS] = np.sqrt(pairs / (len(codes) - 1))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    counts = Counter(words)
    by_class = np.bincount(codes, minlength=_N) / max(1, len(codes))
    ratios = (
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log1p(len(words)) / 10),
        min(1.0, len(raw) / n / 16),
        by_class[1],
        by_class[5:].sum(),
    )
    for k, x in enumerate(ratios):
        place = float(np.sqrt(x)) * (_BINS - 1)
        low = min(int(place), _BINS - 2)
        base = _PAIRS + k * _BINS
        out[base + low] = 0.5 * (1 - (place - low))
        out[base + low + 1] = 0.5 * (place - low)
    if counts:
        places = np.fromiter(map(_terms.__getitem__, counts), np.int64, len(counts))
        out[_STYLE:] = _WORD_WEIGHT * np.sqrt(np.bincount(places, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=WORDS) / n)
    return out


def teaching(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Term vectors and labels of at most sample rows that may be learned from (crc32 of doc_id modulo 5 is not 0), in
    an order that does not depend on partitions. Of an id's several labels the mean counts, of its several texts the
    first ones by hash."""
    rows = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    chosen = rows.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([features(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), terms, batch.column(2)], names=["doc_id", "terms", "quality"])

    kind = dict(documents.dtypes)["doc_id"]
    taught = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, f"doc_id {kind}, terms binary, quality double")
    # Repeated ids in documents: at most sample rows in all.
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("terms"), "terms").limit(sample).toPandas()
    return np.frombuffer(b"".join(taught["terms"]), np.float32).reshape(-1, TERMS), taught["quality"].to_numpy(np.float64)


def leading(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors of x as columns, by subspace iteration from fixed random vectors; the largest
    component of each is positive."""
    rank = min(rank, *x.shape)
    basis = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, *x.shape)))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    found = basis @ turn[:rank].T
    return found * np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1.0, 1.0)


def fit(terms: np.ndarray, quality: np.ndarray, rank: int = RANK) -> dict[str, np.ndarray]:
    """Term weights, the projection to latent vectors, the sample's latent vectors and labels."""
    if not len(terms):
        return {"project": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": quality}
    x = terms.astype(np.float64)
    weights = np.sqrt(np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1)  # rare terms weigh more
    project = (leading(x * weights, rank) * weights[:, None]).astype(np.float32)
    return {"project": project, "vectors": _unit(terms @ project), "labels": quality}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(terms: np.ndarray, model: dict[str, np.ndarray], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of a block of term vectors: means of the neighbours' labels, weighted by cosines (at least 1e-9); 0.5 if
    nothing was learned. Neighbours that tie for the last places share them."""
    if not len(model["vectors"]):
        return np.full(len(terms), 0.5)
    cosines = _unit(terms @ model["project"]) @ model["vectors"].T
    k = min(neighbours, cosines.shape[1])
    least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    # Of neighbours that tie for the last places each has the share of them that is left.
    above, level = cosines > least, cosines == least
    share = above + level * ((k - above.sum(axis=1, keepdims=True)) / level.sum(axis=1, keepdims=True))
    weights = share * np.maximum(cosines.astype(np.float64), 1e-9)
    return np.clip((weights * model["labels"]).sum(axis=1) / weights.sum(axis=1), 0, 1)


def score(documents: DataFrame, model: dict[str, np.ndarray], neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents; null text counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = batch.column(2), []
            for low in range(0, len(texts), _BLOCK):
                scores.append(vote(np.stack([features(x) for x in texts.slice(low, _BLOCK).to_pylist()]), shared.value, neighbours))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Learn from labels (doc_id, quality) and score all rows of documents (doc_id, text); others are ignored.

    Rows of labels with a null, or without their document, teach nothing; several labels of one id are averaged.
    Without any, every score is 0.5. A null text counts as empty, a longer one is read whole. Repeated documents are
    scored each; an empty table gives no rows.
    """
    return score(documents, fit(*teaching(documents, labels, sample), rank), neighbours)
