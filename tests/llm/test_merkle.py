"""Merkle manifests against a plain tree."""

import hashlib
import random
import zlib

import pytest

from lodestone.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row[:5]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def walk(tree, i):
    """(before, after) on each level."""
    steps = []
    for row in tree[:-1]:
        low = i // 16 * 16
        steps.append(("".join(row[low:i]), "".join(row[i + 1 : low + 16])))
        i //= 16
    return steps


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = levels([plain_leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            steps = walk(trees[g], i) + walk(top, k)
            folded = plain_leaf(row, zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0)
            for a, b in steps:
                folded = h(a + folded + b)
            out.append((row[0], plain_leaf(row), trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def made(sizes, seed=1):
    random.seed(seed)
    rows = []
    for g, n in sizes.items():
        rows += [(len(rows) + k, random.choice(["", "Öl A", "lower", "UPPER", None]), random.choice(["en", None]), g, random.choice([None, 3])) for k in range(n)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {None: 257, "": 2, "é": 40, "z": 16, "Z": 1}, {f"s{k}": 1 + k % 3 for k in range(290)}])
def test_against_plain(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 40)
    rows = made(sizes)
    found = merkle.build(spark.createDataFrame(rows, SCHEMA), claim=merkle.tampered()).audit()
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(found.collect()) == ordered(plain(rows))


def test_repeated_rows_null_ids_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 10)
    rows = [(7, "Same", "en", "s", 4)] * 40 + [(None, None, None, None, None)] * 3 + [(None, "x", "en", "s", 1)]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA + ", part int, leaf string, `a.b` int")
    assert ordered(merkle.build(df, claim=merkle.tampered()).audit().collect()) == ordered(plain(rows))


def test_empty_table(spark):
    manifest = merkle.build(spark.createDataFrame([], SCHEMA))
    assert manifest.root is None and manifest.audit().count() == 0 and manifest.proofs().count() == 0


def test_proofs_fold_to_the_root_and_show_any_change(spark):
    rows = made({"a": 300, "b": 20})
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA))
    proofs = manifest.proofs().collect()
    assert {merkle.climbed(r.leaf, r.path) for r in proofs} == {manifest.root}
    assert all(merkle.climbed(h("other"), r.path) != manifest.root for r in proofs[:20])
    assert all(r.verified for r in manifest.audit().collect())
    changed = [(r[0], "changed", *r[2:]) if r[0] == rows[0][0] else r for r in rows]
    assert merkle.build(spark.createDataFrame(changed, SCHEMA)).root != manifest.root
    manifest.discard()


def test_forests_merge_in_any_grouping():
    leaves = [(0, 600, 0, i, h(str(i))) for i in range(600)] + [(1, 5, 0, i, h(f"b{i}")) for i in range(5)]
    want = levels([levels([x[4] for x in leaves[:600]])[-1][0], levels([x[4] for x in leaves[600:]])[-1][0]])[-1][0]
    for cuts in ([0, 605], [0, 1, 2, 300, 605], [0, 250, 599, 601, 605]):
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            f = merkle.Forest(2)
            for x in leaves[a:b]:
                f.add(x)
            parts.append(list(f.nodes()))
            assert len(parts[-1]) <= 2 * 15 * 4
        whole = merkle.Forest(2)
        for x in (y for p in reversed(parts) for y in p):
            whole.add(x)
        assert (whole.root or f.root) == want
