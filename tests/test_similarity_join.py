"""The threshold join and what is built on it, against comparing all with all."""

import random

import numpy as np
import pytest

from lodestone.operators import clustering, similarity, simjoin


def bits(seed, n, width, share, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in rng.random(width) < share]) for k in rng.permutation(n * 2)[:n]]
    base = rows[0][1]
    rows += [(1000 + k, list(base)) for k in range(copies)] + [(5000 + k, [0.0] * width) for k in range(2)]
    for k in range(n // 3):  # near copies
        v = list(rows[k][1])
        v[k % width] = 1.0 - v[k % width]
        rows.append((2000 + k, v))
    return rows


def tanimoto(a, b):
    both = sum(x and y for x, y in zip(a, b))
    union = sum(bool(x or y) for x, y in zip(a, b))
    return both / union if union else 0.0


def plain_pairs(rows, t):
    return {(min(i, j), max(i, j)): tanimoto(v, w) for n, (i, v) in enumerate(rows) for j, w in rows[:n] if tanimoto(v, w) >= t}


CASES = [(40, 24, 0.2, 6, 0.8), (40, 40, 0.1, 3, 0.5), (30, 16, 0.6, 4, 0.3), (30, 30, 0.3, 9, 1.0)]


@pytest.mark.parametrize("n,width,share,copies,t", CASES)
@pytest.mark.parametrize("block", [7, 2048])
def test_join_loses_nothing(spark, n, width, share, copies, t, block):
    rows = bits(n + width, n, width, share, copies)
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = similarity.all_pairs(df, "k", "v", at_least=t, size=block).collect()
    assert len({(r.i, r.j) for r in got}) == len(got)
    assert {(r.i, r.j): round(r.sim, 9) for r in got} == {p: round(s, 9) for p, s in plain_pairs(rows, t).items()}


def test_both_plans_give_the_same(spark):
    rows = bits(5, 60, 32, 0.15)
    one, _ = simjoin.classes(spark.createDataFrame(rows, "id long, v array<double>"))
    how = simjoin.plan(one, 0.6)
    assert how.by_bits and how.candidates < how.all_pairs / 2
    found = {(r.i, r.j) for r in simjoin.pairs(one, 0.6, how=how).collect()}
    counts = one.selectExpr("id", "v").mapInArrow(simjoin._deal(how.ranks, 0.6, False), "r int, c long, side int, id long, bits binary").groupBy("r", "c").count().collect()
    other = simjoin.Plan(False, [(r.r, r.c, r["count"], 0, 2) for r in counts], 0, 0, how.ranks, 0.6)
    assert {(r.i, r.j) for r in simjoin.pairs(one, 0.6, how=other).collect()} == found
    (report,) = similarity.join_report(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 0.6).collect()
    assert report.n_candidates == how.candidates and report.n_pairs == len(found) and report.n_rows == len(rows)


@pytest.mark.parametrize("block", [7, 2048])
def test_report_counts_pairs_of_rows(spark, block):
    rows = bits(6, 40, 24, 0.2, copies=9)
    (report,) = similarity.join_report(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 0.5, block).collect()
    assert report.n_row_pairs == len(plain_pairs(rows, 0.5)) > report.n_pairs


def test_join_refuses_other_numbers(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.0, 1.0])], "k long, v array<double>")
    with pytest.raises(Exception, match="vectors of 0 and 1"):
        similarity.all_pairs(df, "k", "v", at_least=0.5).collect()


def test_nothing_to_join(spark):
    df = spark.createDataFrame([], "k long, v array<double>")
    assert similarity.all_pairs(df, "k", "v", at_least=0.5).count() == 0
    assert clustering.butina(df, "k", "v").count() == 0 and clustering.dbscan(df, "k", "v").count() == 0
    single = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "k long, v array<double>")
    assert sorted((r.k, r.cluster) for r in clustering.butina(single, "k", "v").collect()) == [(1, 0), (2, None)]


def plain_butina(rows, distance):
    near = {i: {j for j, w in rows if j != i and tanimoto(v, w) >= 1 - distance - 1e-12} for i, v in rows}
    left, out, number = set(near), {}, 0
    while left:
        centre = min(left, key=lambda k: (-len(near[k] & left), k))
        for k in {centre} | near[centre] & left:
            out[k] = number
        left -= {centre} | near[centre]
        number += 1
    return out


@pytest.mark.parametrize("seed,distance", [(1, 0.3), (2, 0.5), (3, 0.7), (4, 0.9)])
def test_butina_is_the_sequential_one(spark, seed, distance):
    rows = bits(seed, 50, 20, 0.3, copies=seed * 3)
    df = spark.createDataFrame(rows, "k long, v array<double>")
    for last in (0, 60, clustering.LINKS):  # in rounds, in rounds and then in one task, in one task
        assert {r.k: r.cluster for r in clustering.butina(df, "k", "v", distance, last=last).collect()} == plain_butina(rows, distance)


@pytest.mark.parametrize("metric,tile", [("tanimoto", 7), ("cosine", 512), ("euclidean", 5)])
def test_butina_of_crowded_rows_writes_no_links(spark, metric, tile, monkeypatch):
    rng = np.random.default_rng(7)
    v = np.array([x for _, x in bits(5, 60, 20, 0.4, copies=12)]) if metric == "tanimoto" else rng.normal(size=(60, 6))
    distance = {"tanimoto": 0.7, "cosine": 0.8, "euclidean": 0.75}[metric]
    near = similarity.matrix(metric, v, v) >= 1 - distance - 1e-12
    want, left, number = {}, set(range(len(v))), 0
    while left:
        centre = min(left, key=lambda k: (-sum(j in left for j in np.flatnonzero(near[k])), k))
        took = {centre} | set(np.flatnonzero(near[centre])) & left
        want |= dict.fromkeys((int(k) for k in took), number)
        left, number = left - took, number + 1
    written, links = [], similarity.links
    monkeypatch.setattr(simjoin, "TILE", tile)
    monkeypatch.setattr(similarity, "_LEAST", 13)
    monkeypatch.setattr(clustering, "_CROWDED", 2)
    monkeypatch.setattr(similarity, "links", lambda rest, *more: written.append(rest.count()) or links(rest, *more))
    df = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "k long, v array<double>")
    assert {r.k: r.cluster for r in clustering.butina(df, "k", "v", distance, metric, last=0).collect()} == want
    assert written[0] < len(v) / 2


def test_dbscan_counts_copies(spark):
    rows = [(k, [1.0, 1.0, 0.0, 0.0]) for k in range(4)] + [(9, [1.0, 1.0, 1.0, 0.0]), (10, [0.0, 0.0, 0.0, 1.0])]
    got = {r.k: r.cluster for r in clustering.dbscan(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 0.4, 5).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 0, 10: -1}


@pytest.mark.parametrize("metric", ["cosine", "tanimoto"])
def test_dbscan_without_links(spark, metric, monkeypatch):
    """Blobs, their border and noise, in strips of a few rows; no table of links is made."""
    monkeypatch.setattr(similarity, "_LEAST", 11)
    monkeypatch.setattr(similarity, "all_pairs", None)
    monkeypatch.setattr(simjoin, "pairs", None)
    rng = np.random.default_rng(3)
    v = np.vstack([c + rng.normal(size=(22, 5)) * 0.35 for c in rng.normal(size=(3, 5))]) if metric == "cosine" else np.array([x for _, x in bits(4, 50, 14, 0.3, copies=6)])
    keys, eps = rng.permutation(500)[: len(v)] - 100, 0.12 if metric == "cosine" else 0.45
    near = similarity.matrix(metric, v, v) >= 1 - eps - 1e-12
    np.fill_diagonal(near, True)
    core = near.sum(1) >= 5
    head = {int(i): int(keys[i]) for i in np.flatnonzero(core)}
    while any(head[i] > head[j] for i in head for j in head if near[i, j]):
        head = {i: min(head[j] for j in head if near[i, j]) for i in head}
    numbers = {h: c for c, h in enumerate(sorted(set(head.values())))}
    want = {int(keys[i]): numbers[min((head[j] for j in head if near[i, j]))] if i in head or any(near[i, j] for j in head) else -1 for i in range(len(v))}
    df = spark.createDataFrame([(int(k), [float(y) for y in x]) for k, x in zip(keys, v)], "k long, v array<double>")
    assert {r.k: r.cluster for r in clustering.dbscan(df, "k", "v", eps, 5, metric).collect()} == want
    assert len(numbers) > 1 and -1 in want.values()


@pytest.mark.parametrize("metric,similar", [("tanimoto", 0.4), ("cosine", 0.5)])
def test_cliffs_without_links(spark, metric, similar, monkeypatch):
    monkeypatch.setattr(similarity, "_LEAST", 9)
    monkeypatch.setattr(similarity, "all_pairs", None)
    monkeypatch.setattr(simjoin, "pairs", None)
    rng = np.random.default_rng(12)
    v = np.array([x for _, x in bits(7, 40, 14, 0.4, copies=8)]) if metric == "tanimoto" else rng.normal(size=(50, 4))
    y = rng.choice([0.5, 1.0, 3.0, 20.0, 700.0], len(v))
    s = similarity.matrix(metric, v, v)
    want = {}
    for i in range(len(v)):
        best = sorted((-max(y[i], y[j]) / min(y[i], y[j]), j) for j in range(len(v)) if j != i and s[i, j] > similar and max(y[i], y[j]) / min(y[i], y[j]) > 10)
        want[i] = (len(best), best[0][1] if best else None)
    df = spark.createDataFrame([(k, [float(t) for t in x], float(z)) for k, (x, z) in enumerate(zip(v, y))], "k long, v array<double>, y double")
    assert {r.k: (r.n_activity_cliff_partners, r.strongest_cliff_partner) for r in similarity.activity_cliffs(df, "k", "v", "y", metric, similar).collect()} == want


@pytest.mark.parametrize("similar", [0.5, 0.8])
def test_cliffs_with_copies_and_zero_activities(spark, similar):
    rng = random.Random(8)
    rows = [(k, v, rng.choice([0.0, 0.0, 1.0, 2.0, 15.0, 300.0, None])) for k, v in bits(9, 40, 16, 0.3, copies=10)]
    df = spark.createDataFrame(rows, "k long, v array<double>, y double")
    want = {}
    for i, v, y in rows:
        best = []
        for j, w, z in rows:
            if i != j and y is not None and z is not None and tanimoto(v, w) > similar:
                f = float("inf") if y == 0 or z == 0 else max(y, z) / min(y, z)
                if f > 10:
                    best.append((-f, j))
        want[i] = ("yes" if best else "no", len(best), min(best)[1] if best else None)
    got = {r.k: (r.is_activity_cliff_molecule, r.n_activity_cliff_partners, r.strongest_cliff_partner) for r in similarity.activity_cliffs(df, "k", "v", "y", similar=similar).collect()}
    assert got == want


@pytest.mark.parametrize("metric,n,size", [("tanimoto", 41, 9), ("cosine", 40, 13), ("euclidean", 33, 5), ("tanimoto", 2, 9)])
def test_statistics_of_rows_in_strips_of_any_size(spark, metric, n, size, monkeypatch):
    monkeypatch.setattr(similarity, "_TILE", 4)
    monkeypatch.setattr(similarity, "_BINS", 3)
    rng = np.random.default_rng(n)
    v = (rng.random((n, 12)) < 0.4).astype(float) if metric == "tanimoto" else rng.normal(size=(n, 12)).round(2)
    keys = rng.permutation(1000)[:n]
    df = spark.createDataFrame([(int(k), x.tolist()) for k, x in zip(keys, v)], "k long, v array<double>")
    s = similarity.matrix(metric, v, v)
    others = [np.delete(s[i], i) for i in range(n)]
    want = {int(keys[i]): (x.mean(), np.median(x), x.max(), x.min(), int((x > 0.8).sum())) for i, x in enumerate(others)}
    got = {r.i: tuple(r)[1:] for r in similarity.similarity_statistics(df, "k", "v", metric, size=size).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    if metric == "cosine":
        mean = {r.i: r.mean_sim for r in similarity.mean_similarity(df, "k", "v").collect()}
        assert mean == pytest.approx({k: x[0] for k, x in want.items()}, abs=1e-9)


@pytest.mark.parametrize("metric,n", [("cosine", 41), ("euclidean", 30), ("manhattan", 24), ("dice", 2), ("tanimoto", 40)])
def test_statistics_of_pairs_are_never_rows(spark, metric, n, monkeypatch):
    monkeypatch.setattr(similarity, "_TILE", 4)
    monkeypatch.setattr(similarity, "_ROUND", 8)
    monkeypatch.setattr(similarity, "all_pairs", None)
    v = np.random.default_rng(n).normal(size=(n, 6)).round(1)
    v = (v > 0.5).astype(float) if metric == "tanimoto" else np.r_[v[:-1], v[:1] + 1e-9]
    df = spark.createDataFrame([(3 * k, x.tolist()) for k, x in enumerate(v)], "k long, v array<double>")
    s = similarity.matrix(metric, v, v)[np.triu_indices(n, 1)]
    got = similarity.pair_statistics(df, "k", "v", metric, size=11).first()
    assert tuple(got) == pytest.approx((len(s), s.mean(), np.median(s), s.min(), s.max()), abs=1e-12)
    assert tuple(similarity.pair_statistics(df.limit(1), "k", "v", metric).first()) == (0, None, None, None, None)


def test_a_task_looks_at_a_tile_at_a_time(spark, monkeypatch):
    plain = similarity.matrix

    def small(metric, a, b):
        assert len(a) <= 4 and len(b) <= 4
        return plain(metric, a, b)

    monkeypatch.setattr(similarity, "_TILE", 4)
    monkeypatch.setattr(similarity, "matrix", small)
    v = np.random.default_rng(1).normal(size=(21, 3))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "k long, v array<double>")
    s = plain("cosine", v, v)
    top = similarity.training_set_similarity(df, df, "k", "v", 3, "cosine", 30).collect()
    assert {r.q: r.top_k_mean for r in top} == pytest.approx({k: np.sort(s[k])[-3:].mean() for k in range(21)})
    rows = df.selectExpr("k as id", "v", "k % 2 as head")
    assert {r.i: r.sim for r in similarity.best_links(rows, "cosine", 30).collect()} == pytest.approx({k: s[k, 1 - k % 2 :: 2].max() for k in range(21)})


def test_statistics_without_others(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "k long, v array<double>")
    assert similarity.similarity_statistics(one, "k", "v").count() == 0 and similarity.mean_similarity(one, "k", "v").count() == 0
    assert similarity.training_set_similarity(one.limit(0), one, "k", "v").count() == 0
    (row,) = similarity.training_set_similarity(one, one, "k", "v").collect()
    assert (row.q, row.mean_sim, row.median_sim, row.nearest) == (1, 1.0, 1.0, 1)


@pytest.mark.parametrize("metric,n,k", [("cosine", 60, 4), ("euclidean", 35, 1), ("cosine", 7, 7)])
def test_single_linkage_is_the_dense_one(spark, metric, n, k, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 5)) + 4 * rng.integers(0, 4, n)[:, None] * np.eye(5)[rng.integers(0, 5, n)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(n, None)], "k long, v array<double>")
    got = {r.k: r.cluster for r in clustering.hierarchical(df, "k", "v", k, "single", metric).collect()}
    assert got.pop(n) is None
    assert [got[i] for i in range(n)] == clustering.linkage_labels(1 - similarity.matrix(metric, v, v), k, "single").tolist()


def test_spanning_forest_with_ties(spark):
    rows = [(k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(9)]
    tree = clustering.spanning_forest(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", "cosine").collect()
    assert len(tree) == 8 and sum(r.sim < 0.5 for r in tree) == 1
    assert clustering.spanning_forest(spark.createDataFrame(rows[:1], "k long, v array<double>"), "k", "v").count() == 0


def test_silhouette_against_distances(spark):
    rng = np.random.default_rng(3)
    v, c = rng.normal(size=(40, 3)), rng.integers(0, 4, 40)
    c[c == 3] = 1
    c[0] = 3
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    want = []
    for i in range(40):
        own = (c == c[i]) & (np.arange(40) != i)
        a, b = d[i][own].mean() if own.any() else 0, min(d[i][c == o].mean() for o in set(c) - {c[i]})
        want.append((b - a) / max(a, b) if own.any() else 0)
    rows = [(x.tolist(), int(k)) for x, k in zip(v, c)] + [([9.0, 9.0, 9.0], -1), (None, 1)]
    df = spark.createDataFrame(rows, "v array<double>, c int")
    assert tuple(clustering.silhouette(df, "v", "c", noise=-1).first()) == (40, 4, pytest.approx(np.mean(want)))
    assert clustering.silhouette(df.where("c = 1"), "v", "c").first().silhouette is None


@pytest.mark.parametrize("method,k", [("average", 4), ("complete", 3)])
def test_linkage_in_rounds_is_the_dense_one(spark, method, k, monkeypatch):
    monkeypatch.setattr(clustering, "DENSE_ROWS", 20)
    monkeypatch.setattr(clustering, "_FINISH", 12)
    monkeypatch.setattr(similarity, "_LEAST", 9)
    monkeypatch.setattr(similarity, "_TILE", 5)
    v = np.random.default_rng(k).normal(size=(60, 4))
    v[0], v[1] = [40, 0, 0, 0], [0, 40, 0, 0]  # each other's nearest, and far
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    got = {r.k: r.cluster for r in clustering.hierarchical(df, "k", "v", k, method, "euclidean").collect()}
    assert [got[i] for i in range(60)] == clustering.linkage_labels(1 - similarity.matrix("euclidean", v, v), k, method).tolist()


def test_spectral_in_rounds_is_the_dense_one(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_LEAST", 9)
    monkeypatch.setattr(similarity, "_TILE", 5)
    rng = np.random.default_rng(1)
    v = np.eye(4)[np.arange(40) % 3] + rng.random((40, 4)) / 4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    for k in (3, None):
        monkeypatch.setattr(clustering, "DENSE_ROWS", 5000)
        dense = {r.k: r.cluster for r in clustering.spectral(df, "k", "v", k, "cosine").collect()}
        monkeypatch.setattr(clustering, "DENSE_ROWS", 20)
        got = {r.k: r.cluster for r in clustering.spectral(df, "k", "v", k, "cosine").collect()}
        assert len(got) == 40 and len({(dense[i], got[i]) for i in range(40)}) == len(set(dense.values())) == len(set(got.values()))


def test_a_round_of_linkage_writes_mergers_and_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(clustering, "DENSE_ROWS", 20)
    monkeypatch.setattr(clustering, "_FINISH", 12)
    written, real = [], clustering.materialise
    monkeypatch.setattr(clustering, "materialise", lambda df: written.append(df.columns) or real(df))
    bits = np.random.default_rng(7).integers(0, 2, (30, 12)).astype(float)
    bits[:2] = 0  # rows without a bit, and copies
    bits[10:14] = bits[9]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(bits)], "k long, v array<double>")
    got = {r.k: r.cluster for r in clustering.hierarchical(df, "k", "v", 4, "average", "tanimoto").collect()}
    assert len(got) == 30 and len(set(got.values())) == 4
    rounds = written.count(["i", "j", "d"])
    assert rounds and ["head", "other", "d"] not in written


@pytest.mark.parametrize("metric", ["manhattan", "cosine"])
def test_statistics_of_many_pairs_take_one_meeting(spark, metric, monkeypatch):
    for name, x in (("_MANY", 50), ("_GROUP", 40), ("_SIDE", 8), ("_TILE", 8), ("_LEAST", 30)):
        monkeypatch.setattr(similarity, name, x)
    meetings, real = [], similarity._around
    monkeypatch.setattr(similarity, "_around", lambda *a: meetings.append(a) or real(*a))
    v = np.random.default_rng(6).normal(size=(90, 5)) / 8
    v[40] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    got = similarity.pair_statistics(df, "k", "v", metric).first()
    x = similarity.matrix(metric, v, v)[np.triu_indices(90, 1)]
    assert got.n_pairs == len(x) and tuple(got)[1:] == pytest.approx((x.mean(), np.median(x), x.min(), x.max()), abs=1e-7)
    assert (got.median, got.min, got.max) == pytest.approx((np.median(x), x.min(), x.max()), abs=1e-14)
    assert len(meetings) == 1


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    written, real = [], clustering.materialise
    monkeypatch.setattr(clustering, "materialise", lambda df: written.append(1) or real(df))
    chain = np.random.default_rng(1).permutation(300).tolist()
    pairs = [(a, b) for a, b in zip(chain, chain[1:], strict=False) if chain.index(a) not in (99, 199)] + [(500, 500)]
    got = {r.node: r.head for r in clustering._components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {x: min(part) for part in (chain[:100], chain[100:200], chain[200:], [500]) for x in part}
    assert got == want and len(written) <= 45


@pytest.mark.parametrize("nearest", [2, 3])
def test_single_linkage_takes_few_meetings_of_all_rows(spark, nearest, monkeypatch):
    monkeypatch.setattr(similarity, "_NEAREST", nearest)
    monkeypatch.setattr(similarity, "_LEAST", 9)
    monkeypatch.setattr(similarity, "_TILE", 5)
    meetings, real = [], clustering.best_links
    monkeypatch.setattr(clustering, "best_links", lambda *a: meetings.append(1) or real(*a))
    rng = np.random.default_rng(nearest)
    v = rng.normal(size=(40, 3))
    v[:20] += [30, 0, 0] if nearest == 2 else [0, 0, 0]
    v[30:35] = v[29]  # copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    tree = clustering.spanning_forest(df, "k", "v", "cosine").collect()
    s, head, want = np.round(similarity.matrix("cosine", v, v), 12), list(range(40)), set()
    for _, i, j in sorted((-s[i, j], i, j) for i in range(40) for j in range(i + 1, 40)):
        if head[i] != head[j]:
            want.add((i, j))
            head = [head[i] if h == head[j] else h for h in head]
    assert {(r.i, r.j) for r in tree} == want and len(tree) == 39
    assert len(meetings) <= 2


@pytest.mark.parametrize("n", [2, 41])
def test_statistics_of_short_bit_vectors_take_one_meeting(spark, n, monkeypatch):
    monkeypatch.setattr(similarity, "_SLICE", (4, 7))
    monkeypatch.setattr(similarity, "_ASKING", 9)
    v = np.random.default_rng(n).integers(0, 2, (n, 10)).astype(float)
    v[1] = 0
    v[n // 2 :][:3] = v[0]
    df = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    monkeypatch.setattr(similarity, "_row_statistics", None)  # rounds of bins
    got = {r.i: tuple(r)[1:] for r in similarity.similarity_statistics(df, "k", "v", threshold=0.5).collect()}
    s = similarity.matrix("tanimoto", v, v)
    for i in range(n):
        x = np.delete(s[i], i)
        assert got[i * 3] == pytest.approx((x.mean(), np.median(x), x.max(), x.min(), (x > 0.5).sum()), abs=1e-12)
    assert len(got) == n


@pytest.mark.parametrize("metric", similarity.METRICS)
def test_kernel_is_the_matrix(metric):
    v = np.random.default_rng(2).integers(0, 2, (9, 6)).astype(float)
    v[4] = 0
    sims = similarity.kernel(metric, v, v[:7])
    for r, c in ((slice(0, 4), slice(0, 4)), (slice(4, 9), slice(2, 7)), (slice(3, 4), slice(6, 7))):
        assert np.allclose(sims(r, c), similarity.matrix(metric, v[r], v[:7][c]), rtol=0, atol=1e-15)


@pytest.mark.parametrize("method", ["average", "complete"])
def test_merges_are_those_of_all_distances(method):
    v = np.random.default_rng(4).normal(size=(60, 3))
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    merged = clustering._merges(d, np.ones(60), method)
    assert len(merged) == 59 and [h for _, _, h in merged] == sorted(h for _, _, h in merged)
    top = {i: i for i in range(60)}
    for i, j, _ in merged[:-5]:
        top[next(clustering._up(top, j))] = next(clustering._up(top, i))
    heads = [next(clustering._up(top, i)) for i in range(60)]
    want = clustering.linkage_labels(d, 6, method)
    assert len(set(zip(heads, want.tolist(), strict=True))) == 6 == len(set(heads))


def test_spectral_rounds_are_few_where_eigenvalues_are_close(spark, monkeypatch):
    monkeypatch.setattr(clustering, "DENSE_ROWS", 20)
    products, real = [], clustering._times
    monkeypatch.setattr(clustering, "_times", lambda *a: products.append(a[2]) or real(*a))
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (300, 40)).astype(float)
    bits[:, :20] = np.repeat(np.eye(2), 10, axis=1)[np.arange(300) % 2]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(bits)], "k long, v array<double>")
    got = {r.k: r.cluster for r in clustering.spectral(df, "k", "v", 2).collect()}
    assert [got[i] for i in range(300)] == [i % 2 for i in range(300)]
    products.clear()
    monkeypatch.setattr(clustering, "_BASIS", 40)  # and with the leading columns kept alone
    clustering.spectral(df, "k", "v", 6).collect()
    assert len(products) <= 30


def test_kmeans_leaves_keeping_rows_to_spark(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    stored, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, data: stored.append(data.storageLevel) or fit(self, data))
    df = spark.createDataFrame([(k, [float(k % 3 * 50 + k % 2), 1.0]) for k in range(30)], "k long, v array<double>")
    out, told = clustering.kmeans(df, "v", 3, n_init=2)
    assert len({(r.k % 3, r.cluster) for r in out.collect()}) == 3 and told["inertia"] == pytest.approx(7.5)
    assert len(stored) == 2 and not any(s.useMemory or s.useDisk for s in stored)
