"""Licence notices against an edit-distance table over whole texts."""

import random
import re
from itertools import combinations

import pytest

from lodestone.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def least_edits(notice, words):
    """The fewest edits of any place of words: a row of the table for each character of the notice."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(notice, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def plain(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    base = []
    for name, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = name.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    joined, labels, score = " ".join(words), {label for _, label in base}, 1.0 if base else 0.0
    for label, notice in licences.NOTICES:
        if licences.edits(notice):
            wrong = least_edits(notice, joined)
            there = wrong <= licences.edits(notice)
        else:
            wrong, there = 0, f" {notice} " in f" {joined} "
        if there:
            labels.add(label)
            score = max(score, 1 - wrong / len(notice))
    places = [i for i, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)


def damaged(notice, n, rng):
    x = list(notice)
    for _ in range(n):
        at = rng.randrange(1, len(x) - 1)
        rng.choice([lambda: x.__setitem__(at, rng.choice("abcxyz")), lambda: x.pop(at), lambda: x.insert(at, rng.choice("abcxyz"))])()
    return "".join(x)


def texts():
    rng = random.Random(3)
    fill = "the river ran over old stones license public general licensed under mit gnu cc by and the software permission".split()
    out = [None, "", " \n", "MIT License", "cc by cc by cc by", "GNU General Public License, GNU GENERAL PUBLIC LICENSE", "x" * 30_000, "Öl é mit license 日本 cc-by-nc"]
    for k in range(180):
        parts = [" ".join(rng.choice(fill) for _ in range(rng.randrange(20)))]
        for _ in range(rng.randrange(3)):
            _, notice = rng.choice(licences.NOTICES)
            parts += [damaged(notice, rng.randrange(licences.edits(notice) + 3) if licences.edits(notice) else 0, rng), rng.choice([" ", ", ", "\n"]), " ".join(rng.choice(fill) for _ in range(rng.randrange(12)))]
        out.append(" ".join(parts).title() if k % 3 == 0 else " ".join(parts))
    return out


def test_scan_against_edit_distance(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, labels string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == plain(t), t
        for s in r.spans:
            notice = [n for label, n in licences.NOTICES if label == s.label]
            inside = licences.normal(t[s.start : s.end])
            assert min(least_edits(n, inside) for n in notice) <= s.edits <= licences.MOST_EDITS


def test_pieces_find_every_allowed_damage():
    rng = random.Random(5)
    scanner = licences.Scanner()
    for _ in range(1500):
        k = rng.randrange(len(licences.NOTICES))
        notice = licences.NOTICES[k][1]
        n = rng.randrange(licences.edits(notice) + 1)
        text = f"some words {damaged(notice, n, rng)} and others"
        found = [m for m in scanner.matches(text) if m[0] == k]
        assert found and min(m[3] for m in found) <= n, text


def test_notices_of_different_labels_are_apart():
    for (a, x), (b, y) in combinations(licences.NOTICES, 2):
        if a != b and licences.edits(x) and licences.edits(y):
            assert least_edits(x, y) > licences.edits(x), (x, y)


def test_awkward_rows(awkward, no_documents):
    found = licences.scan(awkward).collect()
    assert len(found) == awkward.count() and all(r.score == 0 and r.labels == "" for r in found)
    assert licences.scan(no_documents).count() == 0


@pytest.mark.parametrize("copies", [3000])
def test_a_notice_many_times_in_one_text(copies):
    r = licences.found(licences.Scanner(), "Licensed under the Apache License, Version 2.0.\n" * copies)
    assert r["n_base"] == copies and len(r["spans"]) == copies and (r["first_word"], r["last_word"]) == (3, 3 + 8 * (copies - 1))
