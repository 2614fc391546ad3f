"""Benchmark decontamination: a prefix-filtered join of item windows with document words, in DataFrame functions only.

A window (WINDOW consecutive words of an item, or all words of a shorter one) occurs in a document only if each of
its words does. So one necessary word is joined, the window's rarest by its count over all documents: full
containment leaves a prefix of length one. A document word equal to it fixes the place where the window would start;
length and position bounds drop what would not fit, and the words there are compared one by one.

The windows are broadcast in blocks of at most BLOCK bytes, without their items; a benchmark of any size is handled in
as many passes. Documents are not shuffled: what moves is a row for each document, and its hits merged before the
exchange. Items are joined to the hits of the documents that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, named_columns, numbered_columns, with_row, without

WINDOW = 10
#: Bytes of windows or words in one broadcast, as they are counted by _weight.
BLOCK = 64_000_000

_WORD_CHARS = {chr(c) for c in range(128) if chr(c).isdigit() or "a" <= chr(c) <= "z"}
_UPPER = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
_GAPS = "".join(chr(c) for c in range(128) if chr(c) not in _WORD_CHARS and chr(c) not in _UPPER)
#: No text has it as a word: it stands for the document itself in the join.
_WHOLE = "\x00"


def words(text: Column) -> Column:
    """Words of a text: A to Z in lower case, runs of digits, letters a to z and all beyond ASCII. Null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(spaced, " "), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of benchmark (item_id, text): seq (their words), item (ids as text; a null id is empty)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("seq")).distinct()


def _weight(words_: Column) -> Column:
    """Bytes that a row with some words takes in a broadcast, or a little more."""
    return F.octet_length(F.concat_ws("", words_)) + 24 * F.size(words_) + 120


def _parts(weighed: DataFrame, block: int) -> int:
    """Into how many broadcasts rows are split, by their sizes."""
    return max(1, -(-(weighed.agg(F.sum("weight")).first()[0] or 0) // block))


def _word_counts(documents: DataFrame, vocabulary: DataFrame, block: int) -> DataFrame:
    """(token, n): how often each word of the vocabulary stands in all documents."""
    parts, out = _parts(vocabulary, block), None
    for k in range(parts):
        side = F.broadcast((vocabulary if parts == 1 else vocabulary.where(F.pmod(F.xxhash64("token"), F.lit(parts)) == k)).select("token"))
        part = documents.select(F.explode(words(F.col("text"))).alias("token")).join(side, "token").groupBy("token").agg(F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


def prefixes(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The join side made of the benchmark: token (the rarest word of a window), offset of its first place in the
    window, seq, window (its number) and weight; and (window, item). Rarity is counted over all documents; ties go to
    the smaller word."""
    items = materialise(item_windows(benchmark, window))
    windows = materialise(items.select("seq").distinct().withColumn("window", F.monotonically_increasing_id()))
    vocabulary = materialise(windows.select(F.explode("seq").alias("token")).distinct().withColumn("weight", _weight(F.array("token"))))
    counts = materialise(_word_counts(documents, vocabulary, block))
    ranked = windows.select("seq", "window", F.posexplode("seq").alias("offset", "token")).join(counts, "token", "left")
    # A word that no document has settles that its windows occur nowhere.
    best = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("b"), F.first("seq").alias("seq"))
    prefix = materialise(best.where("b.n > 0").select("b.token", "b.offset", "seq", "window", _weight(F.col("seq")).alias("weight")))
    return prefix, windows.join(items, "seq").select("window", "item")


def _matches(documents: DataFrame, prefix: DataFrame, block: int) -> DataFrame:
    """documents (with its array column w) with a row for each hit (start, stop, window) and one (nulls) for itself."""
    whole = documents.sparkSession.range(1).select(F.lit(_WHOLE).alias("token"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("seq"), F.lit(None).cast("long").alias("window"))
    parts, out = _parts(prefix, block), None
    for k in range(parts):
        side = (prefix if parts == 1 else prefix.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)).drop("weight")
        side = F.broadcast(side.unionByName(whole) if k == 0 else side)
        exploded = documents.select("*", F.posexplode(F.concat("w", F.array(F.lit(_WHOLE)))).alias("p", "token"))
        start = F.col("p") - F.col("offset")
        fits = (start >= 0) & (start + F.size("seq") <= F.size("w"))
        joined = exploded.join(side, "token").where((F.col("token") == _WHOLE) | fits & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("seq")) == F.col("seq")))
        part = joined.select(*[c for c in documents.columns if c != "w"], F.size("w").cast("long").alias("n_words"), F.when(F.col("token") != _WHOLE, F.struct(start.alias("a"), (start + F.size("seq")).alias("b"))).alias("hit"), "window")
        out = part if out is None else out.union(part)
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each row of documents (doc_id, text; others are ignored): doc_id, n_words, n_hit (words inside an
    occurrence of a window), n_items and items_sha256 (items with occurring windows), contaminated (n_hit > 0).

    Null and empty texts have no words; items without words are ignored; repeated rows stay; a null doc_id is kept.
    Texts of any length are read whole. Without documents there are no rows, without a benchmark nothing is hit.
    """
    placed = with_row(documents.select("doc_id", "text"))
    prefix, items = prefixes(placed, benchmark, window, block)
    rows = placed.select("_file", "_row", "doc_id", words(F.col("text")).alias("w"))
    found = _matches(rows, prefix, block).groupBy("_file", "_row", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("window").alias("windows"))
    merged = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["b"] - F.greatest(h["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], h["b"]).alias("upto")),
        lambda s: s["n"].cast("long"),
    )
    found = materialise(found.select("_file", "_row", "doc_id", "n_words", merged.alias("n_hit"), "windows"))
    hit = found.where("n_hit > 0").select("_file", "_row", F.explode("windows").alias("window"))
    listed = hit.join(items, "window").groupBy("_file", "_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = found.where("n_hit = 0").withColumn("items", F.array().cast("array<string>"))
    both = none.drop("windows").unionByName(found.where("n_hit > 0").drop("windows").join(listed, ["_file", "_row"]))
    return both.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of documents whose text holds no window of the benchmark, with their columns (any, also of the names
    used here). Matching carries the places of rows only, and no text but of rows that may be hit is shuffled."""
    placed = with_row(numbered_columns(documents))
    text = F.col(f"c{documents.columns.index('text')}")
    prefix, _ = prefixes(documents.select("text"), benchmark, window, block)
    rows = placed.select("_file", "_row", words(text).alias("w"))
    hit = materialise(_matches(rows, prefix, block).where("hit is not null").select("_file", "_row").distinct())
    return named_columns(without(placed, ["_file", "_row"], hit, hit.count()), documents.columns)
