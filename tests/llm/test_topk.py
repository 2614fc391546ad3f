import math
import random

from lodestone.llm import topk


def brute(rows, asked, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if not asked(q):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for k, (i, w) in enumerate(ok) if k != at and len(w) == len(v))[:k]
        out += [(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(8)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 440)]  # ties
    rows += [(500, None), (520, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [1.0] * 8), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (620, [0.0] * 8), (640, [1e200] * 8), (641, [1e200] * 7 + [2e200]), (642, [-1e200] * 8), (643, [-3e200] * 8), (660, [3e17, -1.0] * 4), (661, [2.5e17, 7.0] * 4), (680, [1e307] * 8)]
    rows += [(700, [0.3] * 8)] * 3 + [(701, [0.3] * 8)] * 2 + [(720, []), (721, [])] + [(740, [9.0] * 8), (740, [9.0] * 8), (1, [9.0] * 8)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, query string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.every(d).collect())
    assert got == brute([r for r in rows if r[0] != 680], lambda q: q % 20 == 0, 20)  # 680 is infinite once scaled


def test_repeated_rows_are_candidates_for_each_other(spark):
    d = spark.createDataFrame([(20, [5.0]), (20, [5.0]), (1, [5.0]), (20, [4.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.every(d).collect())
    big, small = 320 * 320, 320 * 256
    assert got == sorted([(20, 1, 1, big), (20, 2, 20, big), (20, 3, 20, small)] * 2 + [(20, 1, 1, small), (20, 2, 20, small), (20, 3, 20, small)])


def test_ranges_and_runs(spark):
    """Many blocks of queries and candidates, with and without the salted join of ranges."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(rng.choice([3, 4]))]) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda q: q % 3 == 0, 4)
    for most in (1000, 1):
        sizes = topk.Sizes(query_block=8, block=7, range=3, run=(2, 3), most_ranges=most)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.every(d, 3, 4, sizes).collect()) == want


def test_few_rows_and_none(spark):
    d = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.every(d).orderBy("rank").collect()] == [(0, 1, 1, 64 * 128), (0, 2, 3, -64 * 64)]
    assert topk.every(d.where("false")).count() == 0


def test_coordinate_pruning_keeps_everything_needed():
    import numpy as np

    rng = np.random.default_rng(3)
    q = rng.integers(-60, 60, (1, 6))
    near = (q * 3 + rng.integers(-8, 8, (200, 6))).astype(np.int64)
    s = topk._Search(0, np.array([-1]), q.astype(np.int64), 5, None)
    order = np.argsort(-np.sqrt((near**2).sum(1)))
    for part in np.array_split(order, 8):
        norms = np.sqrt((near[part] ** 2).sum(1))
        s.walk(part.astype(np.int64), near[part], norms, float(norms.max()))
    want = sorted(((-int(q[0] @ near[i]), int(i)) for i in range(200)))[:5]
    assert [(-int(x), int(i)) for i, x in zip(s.best[1], s.best[2], strict=True)] == want
