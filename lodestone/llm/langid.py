"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, drawn from its code point. A letter
trigram abc is bound to one vector, the elementwise product of a rotated by two places, b rotated by one, and c.
A document is the bundle (sum) of the vectors of all its trigrams, a language the bundle of its documents, each
weighted by the inverse of its length. A document gets the language whose prototype has the largest cosine.

Bundling is linear, so profiles are counted as sparse trigram counts first and multiplied by the trigram vectors
once a batch. Each input partition gives a sum a language; those are added in two steps, so no task gets the sums of all
partitions. Only the prototypes (languages x dimensions) travel through the driver. Documents are read twice, nothing
but sums is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, thrifty

DIMENSIONS = 512
#: The most languages that may be learned: bounds what is broadcast (a prototype has DIMENSIONS doubles).
MAX_LANGUAGES = 4096
UNDETERMINED = "und"
#: Tasks that add a language's sums of partitions first.
_SALTS = 1024
_BATCH_LETTERS = 300_000
_DENSE_TRIGRAMS = 4_000_000
_GAP = 32

_is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(int(code).to_bytes(4, "little"))
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Profiler:
    """Turns texts into sparse trigram counts and those into hypervectors."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.known: dict[int, np.ndarray] = {}

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        for c in codes.tolist():
            if c not in self.known:
                self.known[c] = _letter_vector(c, self.dimensions)
        return np.stack([self.known[c] for c in codes.tolist()])

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, trigram numbers, letter codes of each trigram number): one entry for each trigram occurrence."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.where(_is_letter[codes], codes, _GAP)
            codes = np.concatenate(([_GAP], codes, [_GAP]))
            codes = codes[np.concatenate(([True], (codes[1:] != _GAP) | (codes[:-1] != _GAP)))]
            if len(codes) >= 3:
                parts.append(codes)
                owner.append(k)
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        sizes = np.array([len(x) for x in parts])
        codes = np.concatenate(parts).astype(np.int64)
        rows = np.repeat(np.array(owner), sizes)
        used = np.zeros(0x110000, bool)
        used[codes] = True
        alphabet = np.flatnonzero(used)
        place = np.zeros(0x110000, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        k, at = len(alphabet), place[codes]
        trigrams = at[:-2] * k * k + at[1:-1] * k + at[2:]
        inside = rows[2:] == rows[:-2]
        trigrams, rows = trigrams[inside], rows[2:][inside]
        if k**3 <= _DENSE_TRIGRAMS:
            seen = np.zeros(k**3, bool)
            seen[trigrams] = True
            distinct = np.flatnonzero(seen)
            number = np.zeros(k**3, np.int64)
            number[distinct] = np.arange(len(distinct))
            numbers = number[trigrams]
        else:
            distinct, numbers = np.unique(trigrams, return_inverse=True)
        return rows, numbers, alphabet[np.stack([distinct // (k * k), distinct // k % k, distinct % k], axis=1)]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vector of each trigram, given its three letter codes."""
        alphabet, places = np.unique(codes, return_inverse=True)
        places = places.reshape(codes.shape)
        c = self._letters(alphabet)
        b, a = np.roll(c, 1, axis=1), np.roll(c, 2, axis=1)
        return (a[places[:, 0]] * b[places[:, 1]] * c[places[:, 2]]).astype(np.float32)

    def matrix(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, past the last, counts of each text and trigram, letter codes), over runs of texts."""
        first, letters = 0, 0
        for k, text in enumerate([*texts, ""]):
            if k == len(texts) or letters and letters + len(text) > _BATCH_LETTERS:
                if k > first:
                    rows, numbers, codes = self.counts(texts[first:k])
                    for low in range(0, k - first, 128):  # bounds the dense matrix
                        high = min(low + 128, k - first)
                        part = (rows >= low) & (rows < high)
                        flat = (rows[part] - low) * len(codes) + numbers[part]
                        yield first + low, first + high, np.bincount(flat, minlength=(high - low) * len(codes)).reshape(high - low, len(codes)), codes
                first, letters = k, 0
            letters += len(text)


def learn(documents: DataFrame, dimensions: int = DIMENSIONS, max_languages: int = MAX_LANGUAGES) -> pd.DataFrame:
    """Prototypes (lang, vector), by name, from the columns text and lang of documents; rows with a null in either, or
    without a letter, teach nothing. Repeated rows teach as often. No rows give no prototypes."""

    @thrifty
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dimensions), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for low, high, counts, codes in profiler.matrix(texts):
                if not len(codes):
                    continue
                weights = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
                here = langs[low:high]
                names = sorted(set(here))
                by_lang = np.stack([weights[here == x].sum(axis=0) for x in names]).astype(np.float32) @ profiler.bound(codes)
                for name, v in zip(names, by_lang, strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        names, salt = sorted(sums), TaskContext.get().partitionId() % _SALTS
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([salt] * len(names), pa.int32()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64()))], names=["lang", "salt", "vector"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.asarray(x.as_py()) for x in part.column("vector"))
        return pa.table({"lang": part.column("lang").slice(0, 1), "salt": part.column("salt").slice(0, 1), "vector": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "lang string, salt int, vector array<double>"
    taught = documents.select("text", "lang").where("text is not null and lang is not null").mapInArrow(bundle, schema)
    found = taught.groupBy("lang", "salt").applyInArrow(add, schema).groupBy("lang").applyInArrow(add, schema).drop("salt").orderBy("lang").limit(max_languages + 1).toPandas()
    if len(found) > max_languages:
        raise ValueError(f"over {max_languages} languages to learn")
    return found


def predict(documents: DataFrame, prototypes: pd.DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """documents with lang_pred and score (the largest cosine, at least 0) after its own columns; columns of those
    two names are replaced. `und` and 0 if the text is null or has no letter, or nothing was learned; of equal cosines
    the language that sorts first."""
    documents = documents.drop("lang_pred", "score")
    languages = prototypes["lang"].tolist()
    profiles = np.stack(prototypes["vector"].to_list()).astype(np.float64) if languages else np.zeros((0, dimensions))
    profiles /= np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-300)
    shared = documents.sparkSession.sparkContext.broadcast(profiles.astype(np.float32))
    at = documents.columns.index("text")

    @thrifty
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, prototypes = Profiler(dimensions), shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if len(prototypes):
                for low, _, counts, codes in profiler.matrix(texts):
                    if len(codes):
                        bundles = counts.astype(np.float32) @ profiler.bound(codes)
                        cosines = bundles @ prototypes.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-30)
                        for k in np.flatnonzero(counts.sum(axis=1)).tolist():
                            best = int(np.argmax(cosines[k]))  # languages are sorted: ties go to the smaller
                            names[low + k], scores[low + k] = languages[best], min(max(float(cosines[k, best]), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    names = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(label, f"{names}, lang_pred string, score double")


def teaching(documents: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id modulo 3 is not 1."""
    return documents.where(fold("doc_id", 3) != 1)


def identify(documents: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from the teaching rows of documents (doc_id, text, lang, others are ignored), then label all rows.

    Returns doc_id, held_out, lang_pred, score. Null text, or one without a letter: `und`, 0. Null lang: not learned
    from. Texts of any length are read whole. Of equal cosines the language that sorts first wins. Repeated rows are
    labelled each. An empty table gives no rows.
    """
    documents = documents.select("doc_id", "text", "lang")
    prototypes = learn(teaching(documents), dimensions)
    return predict(documents.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), prototypes, dimensions).select("doc_id", "held_out", "lang_pred", "score")
