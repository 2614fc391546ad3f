import collections
import hashlib
import random
import re

import pytest

from lodestone.llm import substrings


def brute(docs, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21])
def test_cover_has_every_difference(period):
    cover = substrings.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


@pytest.mark.parametrize("window", [35, 8])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    base = [" ".join(rng.choice("a b cé dd".split()) for _ in range(rng.randint(0, 200))) for _ in range(12)]
    docs = [(i, rng.choice([None, "", base[i % 12], base[i % 12][:150] + "\n" + base[(i * 5) % 12], "x\x0b" * rng.randint(0, 90), "a b"])) for i in range(80)] + [(None, base[3]), (5, base[3]), (5, base[3])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup(d, window, block=2000).collect()), key=str) == brute(docs, window)


def test_awkward_rows(awkward, no_documents):
    got = sorted(map(tuple, substrings.dedup(awkward).collect()), key=str)
    assert got == brute([tuple(r) for r in awkward.select("doc_id", "text").collect()], 35)
    assert substrings.dedup(no_documents).count() == 0
    assert substrings.dedup(no_documents).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_a_changed_input_is_noticed():
    with pytest.raises(RuntimeError):
        import numpy as np

        substrings._marks(np.arange(5, dtype=np.uint64), 1, {0: (3).to_bytes(8, "little") + b"\0"})
