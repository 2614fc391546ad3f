"""Tokens of SMILES and other texts: tokenising, vocabularies, indices, one-hot rows, coverage and entropy."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import need, quoted

# The token pattern of SMILES, and the default vocabulary.
SMILES_TOKEN = r"(\[[^\]]+\]|@@|%\d{2}|Br|Cl|[BCNOPSFIHbcnopsfi]|[=#@+\-\\/().\[\]]|\d)"
DEFAULT_TOKENS = tuple("C N O S P F Cl Br I B c n o s p ( ) [ ] = # @ @@ + - / \\ . 1 2 3 4 5 6 7 8 9 0 %10 %11 %12 [nH] [C@H] [C@@H]".split())
SPECIAL = {"pad": "<pad>", "start": "<start>", "end": "<end>", "unk": "<unk>"}


def tokens(text: Column, pattern: str = SMILES_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def token_counts(df: DataFrame, column: str, min_frequency: int = 1, max_tokens: int | None = None, pattern: str = SMILES_TOKEN) -> DataFrame:
    """(token, n), most frequent first, ties by token."""
    need(df, [column])
    counts = df.select(F.explode(tokens(quoted(column), pattern)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "token")
    return counts.limit(max_tokens) if max_tokens else counts


def vocabulary(words: Sequence[str], pad: bool = False, start: bool = False, end: bool = False, unk: bool = False) -> dict[str, int]:
    """Special tokens, then words, numbered from 0; repeated words count once."""
    asked = {"pad": pad, "start": start, "end": end, "unk": unk}
    return {t: k for k, t in enumerate(dict.fromkeys([SPECIAL[s] for s, there in asked.items() if there] + list(words)))}


def default_vocabulary(**special: bool) -> dict[str, int]:
    return vocabulary(DEFAULT_TOKENS, **({"pad": True, "unk": True} | special))


def save_vocabulary(vocab: dict[str, int], path: str, metadata: dict[str, Any] | None = None) -> None:
    special = {s: t for s, t in SPECIAL.items() if t in vocab}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"vocab": vocab, "vocab_size": len(vocab), "special_tokens": special, "metadata": metadata or {}}, f, ensure_ascii=False, indent=2)


def load_vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["vocab"]
    if sorted(vocab.values()) != list(range(len(vocab))):
        raise ValueError("the numbers of a vocabulary must run from 0")
    return vocab


def inspect_vocabulary(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    lengths = [len(t) for t in data["vocab"]]
    return {"vocab_size": len(lengths), "special_tokens": data.get("special_tokens", {}), "longest_token": max(lengths, default=0), "multi_character": sum(n > 1 for n in lengths)}


def _map(vocab: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair])


def indices(df: DataFrame, column: str, vocab: dict[str, int], max_length: int | None = None, name: str = "indices", pattern: str = SMILES_TOKEN) -> DataFrame:
    """df with the numbers of the tokens: start and end are added if the vocabulary has them, unknown tokens are <unk>
    or, without it, raise; with max_length, cut or padded (by <pad>, which must be there)."""
    known, unk = _map(vocab), vocab.get(SPECIAL["unk"])
    found = tokens(quoted(column), pattern)
    if unk is None:
        number = lambda t: F.coalesce(F.try_element_at(known, t), F.raise_error(F.concat(F.lit("token not in the vocabulary: "), t)).cast("int"))
    else:
        number = lambda t: F.coalesce(F.try_element_at(known, t), F.lit(unk))
    out = F.transform(found, number)
    if SPECIAL["start"] in vocab:
        out = F.concat(F.array(F.lit(vocab[SPECIAL["start"]])), out)
    if SPECIAL["end"] in vocab:
        out = F.concat(out, F.array(F.lit(vocab[SPECIAL["end"]])))
    if max_length is not None:
        cut = F.slice(out, 1, max_length)
        pad = vocab.get(SPECIAL["pad"])
        fill = F.lit(pad) if pad is not None else F.raise_error(F.lit("padding needs <pad> in the vocabulary")).cast("int")
        out = F.when(F.size(cut) < max_length, F.concat(cut, F.array_repeat(fill, max_length - F.size(cut)))).otherwise(cut)
    return df.withColumn(name, out)


def one_hot(df: DataFrame, column: str, vocab: dict[str, int], max_length: int | None = None, name: str = "one_hot", pattern: str = SMILES_TOKEN) -> DataFrame:
    """df with max_length rows of 0 and 1 (the longest text's tokens, if not given)."""
    if max_length is None:
        extra = (SPECIAL["start"] in vocab) + (SPECIAL["end"] in vocab)
        max_length = (df.agg(F.max(F.size(tokens(quoted(column), pattern)))).first()[0] or 0) + extra
    numbered_ = indices(df.where(quoted(column).isNotNull()), column, vocab, max_length, "_indices", pattern)
    places = F.sequence(F.lit(0), F.lit(len(vocab) - 1))
    return numbered_.withColumn(name, F.transform("_indices", lambda i: F.transform(places, lambda j: (i == j).cast("float")))).drop("_indices")


def coverage(df: DataFrame, column: str, vocab: dict[str, int], pattern: str = SMILES_TOKEN) -> DataFrame:
    """df with vocab_status (passed, unknown token, failed for null or no token) and vocab_coverage (per cent)."""
    need(df, [column])
    known = F.array(*[F.lit(t) for t in vocab])
    found = tokens(quoted(column), pattern)
    n = F.size(found)
    inside = F.size(F.filter(found, lambda t: F.array_contains(known, t)))
    status = F.when(quoted(column).isNull() | (n == 0), "failed").when(inside == n, "passed").otherwise("unknown token")
    return df.withColumn("vocab_status", status).withColumn("vocab_coverage", F.when(n > 0, 100 * inside / n))


def missing_tokens(df: DataFrame, column: str, vocab: dict[str, int], pattern: str = SMILES_TOKEN) -> DataFrame:
    """(token, n) of tokens that are not in the vocabulary."""
    return token_counts(df, column, pattern=pattern).where(~F.col("token").isin(list(vocab)))


def _plogp(counts: Column, total: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, c: s - (c / total) * F.log2(c / total))


def entropy(found: Column) -> Column:
    """Shannon entropy of an array of tokens, in bits; 0 for none."""
    n = F.size(found)
    runs = F.transform(F.array_distinct(found), lambda t: (n - F.size(F.array_remove(found, t))).cast("double"))
    return F.when(n > 0, _plogp(runs, n)).when(found.isNotNull(), 0.0)


def token_entropy(text: Column, pattern: str = SMILES_TOKEN) -> Column:
    return entropy(tokens(text, pattern))


def complexity(df: DataFrame, column: str, metrics: Sequence[str] = ("branches", "num_tokens", "smiles_entropy")) -> DataFrame:
    """df with counts of branches, of tokens and the entropy of the tokens."""
    known = {"branches": F.length(quoted(column)) - F.length(F.replace(quoted(column), F.lit("("), F.lit(""))), "num_tokens": F.size("_tokens"), "smiles_entropy": entropy(F.col("_tokens"))}
    unknown = [m for m in metrics if m not in known]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}; there are {list(known)}")
    read = df.withColumn("_tokens", tokens(quoted(column)))  # once a row, for all metrics
    return read.withColumns({m: F.when(quoted(column).isNotNull(), known[m]) for m in metrics}).drop("_tokens")
