"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, most):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least:
            found[lang, g] = min(((2_000_000 * a) // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
    out = []
    for (lang, g), (score, k) in found.items():
        longer = [f[lang, h] for (other, h) in found if other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if not any(100 * x >= 80 * f[lang, g] for x in longer):
            out.append((lang, " ".join(g), f[lang, g], f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = "a b c dd E é \x01 a\x01 New York city 日本 x y".split(" ")
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " new york city "]) for _ in range(rng.randrange(60)))
        rows.append((k, rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("size", [40, 700, 16_000_000])
def test_against_plain_in_chunks_of_any_size(spark, size):
    rows = corpus(1) + [(None, "big city hall " * 60, "de"), (7, "x" * 300 + " new york. city" * 5, "en"), (7, None, None)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", chunk int, words string")
    found = c.mine(df, least=6, rows=25, size=size)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(rows, 6, 25)


def test_no_rows_and_no_frequent_word(spark, no_documents, awkward):
    assert c.mine(no_documents).count() == 0
    assert c.mine(spark.createDataFrame([(1, "one two three", "en"), (2, None, None)], SCHEMA)).count() == 0
    assert c.mine(awkward, least=2).count() > 0


def test_segments_keep_every_word_once():
    rng = random.Random(2)
    for size in (1, 5, 17, 100, 10_000):
        text = "".join(rng.choice(["ab", "c", "é" * 9, " ", " ", ". ", "\n"]) for _ in range(400))
        whole = text.lower().translate({ord(x): "." for x in ",;:!?\n\x0b\x0c\r"}).replace(".", " . ").split()
        out = []
        for skip, words in c.segments(text, size):
            assert words[:skip] == out[len(out) - skip :] and skip <= 3
            out += words[skip:]
        assert [w.decode() for w in out] == whole


@pytest.mark.parametrize("batch,held", [(1, 5), (2, 1), (7, 40), (1000, 10**6)])
def test_runs_of_any_batches(batch, held):
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(-5, 60, 900) ** 3)
    chunk, n = rng.integers(0, 9, 900), rng.integers(1, 4, 900)
    whole = pa.table({"key": key, "chunk": chunk, "n": n}).to_batches(max_chunksize=batch)
    rows = [r for b in c._runs(30, held)(iter(whole)) for r in b.to_pylist()]
    total = Counter()
    for k, x in zip(key.tolist(), n.tolist()):
        total[k] += x
    keys = sorted(k for k in total if total[k] >= 30)
    assert [(r["key"], r["f"], r["nth"]) for r in rows if r["key"] is not None] == [(k, total[k], i) for i, k in enumerate(keys)]
    places = [(k, r["of"], i) for r in rows if r["of"] is not None for k, i in zip(c._far(r["keys"]).tolist(), c._far(r["nths"]).tolist())]
    assert sorted(places) == sorted((k, at, keys.index(k)) for k, at in zip(key.tolist(), chunk.tolist()) if k in keys)


def test_scores_beyond_64_bits(spark):
    huge = 9 * 10**17
    counts = spark.createDataFrame([([1], 1, huge + 3), ([2], 1, huge + 2), ([1, 2], 2, huge)], "w array<long>, n int, f long")
    keys = [counts.where(f"n = {n}").select(c.packed_key(*[counts["w"][k] for k in range(n)]).alias("words"), "n", "f") for n in (1, 2)]
    (row,) = c.scored(keys[0].unionByName(keys[1])).collect()
    assert bytes(row.words) == bytes([0, 0, 0, 1, 0, 0, 0, 2]) + bytes(8)
    assert (row.score, row.l, row.r) == (2_000_000 * huge // (2 * huge + 5), huge + 3, huge + 2)
