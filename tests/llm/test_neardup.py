import collections
import random

import numpy as np
import pytest

from lodestone.llm import common, neardup
from lodestone.llm.common import components


def shingles(words, width=5):
    return collections.Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else collections.Counter()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def brute(docs):
    words, parent = [(t or "").encode().split() for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if words[i] and words[j] and find(i) != find(j) and jaccard(words[i], words[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [docs[i][0] for i in members if docs[i][0] is not None]
        out += [(str(docs[i][0]), str(min(ids) if ids else None), len(members)) for i in members]
    return sorted(out), len(groups)


@pytest.fixture(scope="module")
def family():
    rng, docs = random.Random(4), []
    for _ in range(14):
        base = [f"g{rng.randint(0, 300)}" for _ in range(rng.choice([3, 4, 5, 30, 150, 300]))]
        for _ in range(rng.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9)}"
            docs.append((len(docs), rng.choice([" ", "\n"]).join(copy)))
    return docs + [(900, None), (901, ""), (902, "  "), (5, docs[5][1]), (None, docs[7][1]), (None, None)]


def _rows(spark, docs, **parameters):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, digest int")
    return neardup.near_duplicates(d, **parameters).collect()


@pytest.mark.parametrize("parameters", [{}, {"cell": 800, "cell_texts": 4, "centres": 3}, {"cell": 800, "cell_texts": 3, "centres": 1}])
def test_classes_against_brute_force(spark, family, parameters):
    rows = _rows(spark, family, **parameters)
    want, groups = brute(family)
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in rows) == want
    assert sum(r.kept for r in rows) == groups


def test_a_template_that_many_texts_share(spark):
    """One group of texts that are alike but not linked, with some linked ones among them: no round finds an end."""
    rng, docs = random.Random(6), []
    template = [f"t{k}" for k in range(60)]
    for k in range(150):
        at = rng.randrange(60)
        own = [f"u{k}x{j}" for j in range(11)]
        docs.append((k, " ".join(template[:at] + own + template[at:])))
        if k % 15 == 0:
            docs.append((1000 + k, " ".join(template[:at] + own[:-1] + ["other"] + template[at:])))
    rows = _rows(spark, docs, bands=60, rows=2, cell_texts=16, centres=2)
    want, groups = brute(docs)
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in rows) == want and 100 < groups < 160


def test_prefixes_lose_no_link(spark):
    rng, texts = random.Random(2), []
    base = [rng.randrange(40) for _ in range(60)]
    for k in range(120):
        base = [rng.randrange(40) if rng.random() < 0.03 else x for x in base][: rng.randint(45, 60)] + [rng.randrange(40) for _ in range(rng.randrange(4))]
        texts.append((b"g", b"%d" % k, b" ".join(b"%d" % x for x in base), k % 3 == 0))
    d = spark.createDataFrame(texts, "group binary, digest binary, text binary, open boolean")
    found = neardup._prefix_links(d.drop("open"), d.where("open").select("digest"), d.select("group", "digest", d.digest.alias("head")), 2, 0.6)
    got = {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in found.collect()}
    sets = [set(neardup.elements(x[2], 2).tolist()) for x in texts]
    want = {tuple(sorted((texts[i][1], texts[j][1]))) for i in range(120) for j in range(i) if (texts[i][3] or texts[j][3]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6 - 1e-12}
    assert got == want and len(want) > 40


def test_bitmaps_mark_what_is_wanted(spark):
    d = spark.range(20_000).selectExpr("id as a", "id % 7 as b", "id as _byte")
    wanted = d.where("a % 9 = 0").select("a", "b")
    n = wanted.count()
    assert {r.a for r in common.among(d, ["a", "b"], wanted, n).collect()} == set(range(0, 20_000, 9))
    assert {r.a for r in common.without(d.drop("_byte"), ["a", "b"], wanted, n).collect()} == set(range(20_000)) - set(range(0, 20_000, 9))
    told = common.marked(d.drop("_byte"), ["a", "b"], wanted, n).where("_maybe").count()
    assert n <= told < n + 3_000
    assert common.without(d, ["a"], wanted.where("false"), 0).count() == 20_000


def test_signatures_estimate_the_weighted_similarity():
    rng = random.Random(1)
    a = [b"w%d" % rng.randint(0, 400) for _ in range(400)] + [b"r"] * 80
    b = list(a)[:-40]
    for k in rng.sample(range(400), 12):
        b[k] = b"zz"
    s = neardup.signatures(*neardup.bags(*neardup.shingles([a, b])), 2, 6000)
    assert abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.03


def test_pivots_lose_no_link():
    rng = random.Random(8)
    base = [rng.randint(0, 1 << 60) for _ in range(120)]
    sets = []
    for _ in range(150):
        base = [rng.randint(0, 1 << 60) if rng.random() < 0.06 else x for x in base]
        sets.append(np.unique(np.array(base, np.uint64)))
    label, n = neardup.classes_of(sets), len(sets)
    want = np.arange(n)
    for i in range(n):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                want[want == want[i]] = want[j]
    pairs = lambda x: {(i, j) for i in range(n) for j in range(i) if x[i] == x[j]}
    assert pairs(label) == pairs(want)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r["head"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_deduplicate_keeps_one_row_of_each_class(spark, awkward, no_documents):
    kept = neardup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == ids[4] == ids[5] == 1
    assert neardup.deduplicate(no_documents).count() == 0
    assert neardup.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize(("nodes", "edges"), [(30, 20), (100, 300), (50, 0)])
def test_components_of_random_graphs(spark, nodes, edges):
    draw = random.Random(nodes)
    pairs = [(a, b) for a, b in ((draw.randrange(nodes), draw.randrange(nodes)) for _ in range(edges)) if a != b]
    wanted = {x: x for pair in pairs for x in pair}
    for _ in wanted:
        for a, b in pairs:
            wanted[a] = wanted[b] = min(wanted[a], wanted[b])
    got = [tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert len(got) == len(wanted) and dict(got) == wanted
