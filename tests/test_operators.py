import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import special as sp
from lodestone.functions.expressions import ExpressionError, assignment, to_sql
from lodestone.operators import clustering, duplicates, encoding, metrics, outliers, relational, reports, similarity, splitting, statistics


@pytest.fixture(scope="module")
def small(spark):
    rows = [(0, 1.0, "a", True), (1, 2.0, "b", False), (2, None, "a", True), (3, float("nan"), None, None), (4, 5.0, "it's", True)]
    return relational.nan_to_null(spark.createDataFrame(rows, "k long, x double, `exp mean` string, ok boolean"))


class TestExpressions:
    @pytest.mark.parametrize(
        "text, keys",
        [
            ("x > 1 and k < 4", [1]),
            ("1 <= x <= 2", [0, 1]),
            ("`exp mean` == \"a\" or x == 5", [0, 2, 4]),
            ("`exp mean` != 'a'", [1, 3, 4]),
            ("x.isnull()", [2, 3]),
            ("not ok == True", [1, 3]),
            ("k in [1, 3]", [1, 3]),
            ("k not in [1, 3] and ok", [0, 2, 4]),
            ("`exp mean`.str.contains('t')", [4]),
            ("k.between(1, 2)", [1, 2]),
            ("`exp mean` == \"it's\"", [4]),
        ],
    )
    def test_filters(self, small, text, keys):
        assert sorted(r.k for r in relational.subset(small, text).collect()) == keys

    @pytest.mark.parametrize("text", ["__import__('os')", "x.foo()", "x; y", "lambda: 1", "x ==", "f(x)", "x[0]"])
    def test_refused(self, text):
        with pytest.raises(ExpressionError):
            to_sql(text)

    def test_transforms(self, small):
        out = relational.transform(relational.transform(small, "y = x / (k - 1) + 2 ** 3"), "`exp mean` = `exp mean`.fillna('?').str.upper().replace('A', 'first')")
        rows = {r.k: r for r in out.collect()}
        assert rows[0].y == 7 and rows[1].y is None and rows[4].y == pytest.approx(5 / 3 + 8)
        assert [rows[k]["exp mean"] for k in range(5)] == ["first", "B", "first", "?", "IT'S"]
        with pytest.raises(ExpressionError):
            assignment("x == 1")


class TestRelational:
    def test_numbered_is_dense_and_ordered(self, spark):
        df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
        got = relational.numbered(df, ["v"]).collect()
        assert all(r.v == r[relational.ROW_ID] for r in got) and len(got) == 1000

    def test_running_sums(self, spark):
        df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"), F.lit(2).alias("n"))
        assert all(r.n_upto == 2 * (r.v + 1) for r in relational.running_sums(df, "v", ["n"]).collect())

    def test_average_ranks_with_ties_and_nulls(self, spark):
        df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (3.0,)], "x double")
        assert sorted((r.x or 0, r.r) for r in relational.average_ranks(df, "x", "r").collect() if r.x) == [(1, 1), (2, 2.5), (2, 2.5), (3, 4)]

    def test_summary_and_missing(self, small):
        rows = {r["column"]: r for r in relational.summary(small).collect()}
        assert (rows["x"]["count"], rows["x"].n_missing, rows["x"].median) == (3, 2, 2.0)
        assert (rows["exp mean"].n_unique, rows["exp mean"].top_value, rows["exp mean"].top_freq) == (3, "a", 2)

    def test_rows_and_columns(self, small):
        assert relational.drop_where(small, "exp mean").count() == 4 and relational.drop_where(small, "exp mean", "a").count() == 3
        assert relational.inspect(small, ["k"], row_indices=[4, 0]).count() == 2
        with pytest.raises(ValueError):
            relational.inspect(small, ["k"], row_indices=[9])
        with pytest.raises(ValueError):
            relational.drop_columns(small, small.columns)
        first = relational.drop_duplicate_rows(small, ["exp mean"], ["k"])
        assert sorted(r.k for r in first.collect()) == [0, 1, 3, 4]

    def test_unions_and_joins(self, small):
        with pytest.raises(ValueError):
            relational.combine_vertical([small, small], "raise")
        assert relational.combine_vertical([small, small], "drop").count() == 5
        with pytest.raises(ValueError):
            relational.combine_horizontal(small, small, ["k"], ["k"])
        other = small.select(F.col("k").alias("j")).where("j < 3")
        with pytest.raises(ValueError):
            relational.combine_horizontal(small, other, ["k"], ["j"])
        assert relational.combine_horizontal(small, other, ["k"], ["j"], "pad").where("j is null").count() == 2
        m = relational.merge(small, small, "exp mean", "exp mean", "inner", key_name="key")
        assert m.columns[0] == "key" and "x_x" in m.columns and m.count() == 6

    def test_scramble_is_a_permutation(self, spark):
        df = spark.range(200).select("id", F.col("id").alias("v"))
        rows = relational.scramble(df, "v", ["id"], 1).collect()
        assert sorted(r.v for r in rows) == list(range(200)) and sum(r.v == r.id for r in rows) < 20

    def test_histogram_and_density(self, spark):
        df = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 2, 10)], "x double")
        h = sorted(relational.histogram(df, "x", 5).collect())
        assert [r.n for r in h] == [3, 1, 0, 0, 1]
        d = sorted(relational.density(df, "x", 2001, margin=5.0).collect())
        assert sum(r.density for r in d) * (d[1].x - d[0].x) == pytest.approx(1, abs=1e-3)
        assert relational.histogram(df.where("false"), "x").count() == 0


class TestOutliers:
    def test_flags(self, spark):
        df = spark.createDataFrame([(k, float(k % 5)) for k in range(40)] + [(40, 100.0), (41, None)], "k long, x double")
        for f, name in ((outliers.iqr, "iqr"), (outliers.zscore, "zscore"), (outliers.modified_zscore, "modified_zscore")):
            bad = [r.k for r in f(df, ["x"]).where(f"not x_{name}_pass").collect()]
            assert bad == [40]
        assert [r.k for r in outliers.grubbs(df, ["x"], ["k"]).where("not x_grubbs_pass").collect()] == [40]
        assert outliers.outlier_count(outliers.iqr(df, ["x"]), "iqr").first()[0] == 1

    def test_gesd_against_the_full_algorithm(self, spark):
        import random

        rng = random.Random(2)
        x = [rng.gauss(0, 1) for _ in range(60)] + [6.0, 6.5, -7.0, 6.0]
        df = spark.createDataFrame(list(enumerate(x)), "k long, x double")
        bad = sorted(r.k for r in outliers.gesd(df, ["x"], ["k"]).where("not x_gesd_pass").collect())
        left, r, order = list(enumerate(x)), [], []
        for i in range(1, 11):
            n = len(left)
            mean = sum(v for _, v in left) / n
            std = math.sqrt(sum((v - mean) ** 2 for _, v in left) / (n - 1))
            k, v = max(left, key=lambda p: (abs(p[1] - mean), -p[0]))
            t = sp.student_t_ppf(1 - 0.05 / (2 * n), n - 2)
            r.append(abs(v - mean) / std > (n - 1) * t / math.sqrt((n - 2 + t * t) * n))
            order.append(k)
            left.remove((k, v))
        assert bad == sorted(order[: max(i + 1 for i, x in enumerate(r) if x)])

    def test_constant_and_few(self, spark):
        df = spark.createDataFrame([(k, 1.0) for k in range(6)], "k long, x double")
        for f in (outliers.iqr, outliers.zscore, outliers.modified_zscore):
            assert f(df, ["x"]).columns[:2] == ["k", "x"] and f(df, ["x"]).where("not " + f(df, ["x"]).columns[-1]).count() == 0
        with pytest.raises(Exception, match="4 values"):
            outliers.iqr(df.limit(3), ["x"]).collect()


class TestSpecial:
    def test_tables(self):
        assert sp.student_t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
        assert sp.student_t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
        assert sp.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9) and sp.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
        assert sp.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
        assert sp.kolmogorov_sf(1.3580986) == pytest.approx(0.05, abs=1e-6) and sp.kolmogorov_sf(0.5) == pytest.approx(0.9639452, abs=1e-6)
        assert sp.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)

    def test_exact_small_samples(self):
        assert sp.ks_two_sample_sf(1.0, 3, 3) == pytest.approx(0.1)
        assert sp.rank_sum_sf(9, 3, 3) == pytest.approx(1 / 20) and sp.signed_rank_sf(15, 5) == pytest.approx(1 / 32)
        assert sp.fisher_exact_p(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)
        assert sp.binomial_tail(9, 10) == pytest.approx(11 / 1024)
        w, p = sp.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
        assert (w, p) == (pytest.approx(0.7888, abs=1e-4), pytest.approx(0.006704, abs=1e-5))


class TestStatistics:
    def test_normal_cdf_column(self, spark):
        df = spark.range(-100, 101).select((F.col("id") / 12.5).alias("z"))
        assert all(r.p == pytest.approx(sp.normal_cdf(r.z), rel=1e-9, abs=1e-15) for r in df.select("z", statistics.normal_cdf(F.col("z")).alias("p")).collect())

    def test_two_samples(self, spark):
        a = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(None,)], "x double")
        b = spark.createDataFrame([(float(x),) for x in (5, 6, 7, 9)], "x double")
        t = statistics.independent_ttest(a, "x", b, "x")
        assert t["significant"] and t["statistic"] == pytest.approx(-3.9704, abs=1e-4) and t["effect"] == "large"
        u = statistics.mann_whitney(a, "x", b, "x")
        assert (u["statistic"], u["p_value"], u["cliffs_delta"]) == (0, pytest.approx(2 / 70), -1)
        assert statistics.ks_two_sample(a, "x", b, "x")["p_value"] == pytest.approx(2 / 70)

    def test_pairs_groups_and_tables(self, spark):
        df = spark.createDataFrame([(k % 3, float(k), float(k * 2 + k % 2), k % 2, (k // 2) % 2) for k in range(24)], "g long, x double, y double, a long, b long")
        assert statistics.pearson(df, "x", "y")["statistic"] > 0.99 and statistics.spearman(df, "x", "y")["p_value"] < 1e-6
        assert statistics.paired_ttest(df, "y", "x")["significant"] and statistics.wilcoxon(df, "y", "x")["significant"]
        assert not statistics.one_way_anova(df, "x", "g")["significant"] and not statistics.kruskal_wallis(df, "x", "g")["significant"]
        assert statistics.chi_square(df, "a", "b")["p_value"] == pytest.approx(1.0) and statistics.fisher_exact(df, "a", "b")["p_value"] == pytest.approx(1.0)
        assert statistics.mcnemar(df, "a", "b")["table"] == [[6, 6], [6, 6]]
        for test in (statistics.shapiro_wilk, statistics.ks_normal, statistics.anderson_darling):
            assert test(df, "x")["is_normal"]


class TestDuplicates:
    def test_binary_strategies(self, spark):
        rows = [("one", 1), ("same", 0), ("same", 0), ("tie", 0), ("tie", 1), (None, 1), ("none", None)] + [("most", 1)] * 9 + [("most", 0)]
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, s string, y int")
        found = duplicates.find_duplicates(df, ["s"], "y")
        got = {r.s: r.merge_strategy for r in found.collect()}
        assert got == {"one": "unique", "same": "keep_first", "tie": "drop", None: "drop", "none": "drop", "most": "majority_vote"}
        kept = {r.s: (r.k, r.y) for r in duplicates.deduplicate(found, ["s"], ["k"], "y").collect()}
        assert kept == {"one": (0, 1), "same": (1, 0), "most": (7, 1)}
        assert {r.s for r in duplicates.deduplicate(found, ["s"], ["k"], "y", drop_all=True).collect()} == {"one"}

    @pytest.mark.parametrize("n, most", [(10, 9), (10, 8), (10, 7), (100, 59), (100, 58), (3000, 1600), (5, 5), (5, 3)])
    def test_majorities_match_the_binomial_tail(self, spark, n, most):
        got = spark.range(1).select(duplicates.binary_threshold(F.lit(n), F.lit(most), 0.05)).first()[0]
        assert got == (sp.binomial_tail(most, n) < 0.05)

    def test_continuous_strategies(self, spark):
        rows = [("near", x) for x in (10.0, 10.5, 9.8, 10.2)] + [("far", x) for x in (1.0, 100.0, 3.0)] + [("same", 2.0)] * 3 + [("out", x) for x in (10.0, 10.0, 10.1, 9.9, 10.0, 12.0)]
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, s string, y double")
        found = duplicates.find_duplicates(df, ["s"], "y", binary=False, order=["k"])
        assert {r.s: r.merge_strategy for r in found.collect()} == {"near": "mean", "far": "drop", "same": "keep_first", "out": "median"}
        kept = {r.s: r.y for r in duplicates.deduplicate(found, ["s"], ["k"], "y").collect()}
        assert kept == {"near": pytest.approx(10.125), "same": 2.0, "out": 10.0}

    def test_bootstrap_is_the_same_however_rows_are_dealt(self, spark, monkeypatch):
        monkeypatch.setattr(duplicates, "_ROWS", 7)
        rng = random.Random(2)
        rows = [("hot", 10 + rng.random()) for _ in range(300)] + [(f"g{k % 20}", rng.choice([5.0, 5.5, 6.0, 40.0])) for k in range(90)] + [(None, 1.0), (None, 2.0)]
        groups = {}
        for s, y in rows:
            groups.setdefault(s, []).append(y)
        placed = [(s, k, y, len(v)) for s, v in groups.items() for k, y in enumerate(v)]
        want = {}
        for s, v in groups.items():
            w = duplicates.weights(np.arange(len(v)), np.arange(1000))
            y = np.array(v)
            want[s] = duplicates._upper(duplicates.variations(np.stack([w.sum(0), (w * y[:, None]).sum(0), (w * (y * y)[:, None]).sum(0)])), 0.05)
        for parts in (1, 5):
            for order in (placed, rng.sample(placed, len(placed))):
                df = spark.createDataFrame(order, "s string, _at long, y double, _size long").repartition(parts)
                got = {r.s: r.upper for r in duplicates.bootstrap(df, ["s"]).collect()}
                assert got == pytest.approx(want, abs=1e-9)

    def test_bootstrap_weighs_a_place_once(self, monkeypatch):
        numbers, weighed, weights = np.arange(50), [], duplicates.weights
        monkeypatch.setattr(duplicates, "_PLACES", 40)
        monkeypatch.setattr(duplicates, "weights", lambda places, n: weighed.append(len(places)) or weights(places, n))
        kept = np.zeros((0, 50))
        for places in (np.arange(30), np.arange(30), np.array([3, 1, 29]), np.arange(20, 40), np.arange(5, 39)):
            kept = duplicates._known(kept, places, numbers)
            assert (duplicates._weighted(kept, places, numbers) == weights(places, numbers)).all()
        assert sum(weighed) == 40
        far = np.array([39, 40, 1000])  # beyond what is kept
        kept = duplicates._known(kept, far, numbers)
        assert len(kept) == 40 and (duplicates._weighted(kept, far, numbers) == weights(far, numbers)).all()

    def test_weights_are_poisson(self):
        w = duplicates.weights(np.arange(2000), np.arange(500))
        assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
        assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15

    def test_bootstrap_variance_is_that_of_resampling(self):
        y = np.random.default_rng(1).lognormal(3, 0.3, 60)
        w = duplicates.weights(np.arange(60), np.arange(1000))
        ours = duplicates.variations(np.stack([w.sum(0), (w * y[:, None]).sum(0), (w * (y * y)[:, None]).sum(0)]))
        rng = np.random.default_rng(2)
        plain = [x.std(ddof=1) / x.mean() for x in (rng.choice(y, 60) for _ in range(1000))]
        assert abs(ours.mean() - np.mean(plain)) < 0.01 and abs(ours.std() / np.std(plain) - 1) < 0.2

    def test_conflicts(self, spark):
        rows = [("a", 10.0), ("a", 11.0), ("b", 1.0), ("b", 9.0), ("c", 5.0), ("z", 0.0), ("z", 0.0), ("m", -1.0), ("m", 1.0), ("n", None), (None, 2.0), (None, 2.0)]
        got = {r.s: (r.n, r.conflict) for r in duplicates.regression_conflicts(spark.createDataFrame(rows, "s string, y double"), ["s"], "y").collect()}
        assert got == {"a": (2, "merge"), "b": (2, "drop"), "c": (1, "merge"), "z": (2, "merge"), "m": (2, "drop"), "n": (0, "merge"), None: (2, "merge")}

    def test_conflicts_at_a_bound_in_any_order(self, spark):
        rows = [(str(k), x / 100) for k, v in enumerate(([3, 3, 1, 1], [1, 1, 3, 3], [1, 3, 1, 3], [3, 3, 1, 1, 3, 1])) for x in v]  # deviation is half a mean
        found = duplicates.regression_conflicts(spark.createDataFrame(rows, "s string, y double").coalesce(1), ["s"], "y")
        assert {r.conflict for r in found.collect()} == {"merge"}

    def test_group_quantiles(self, spark):
        rng = random.Random(4)
        rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([1.0, 2.0, 2.0, 3.5, 7.0, None, float("nan"), -0.0])) for _ in range(200)] + [("one", 1, 4.0), ("none", 1, None)]
        groups = {}
        for a, b, y in rows:
            if y is not None and not math.isnan(y):
                groups.setdefault((a, b), []).append(y)
        got = {(r.a, r.b): (r.n, r.q0, r.q1, r.q2, r.q3) for r in relational.group_quantiles(spark.createDataFrame(rows, "a string, b int, y double"), ["a", "b"], "y", [0, 0.25, 0.61, 1]).collect()}
        assert got.keys() == groups.keys()
        for g, v in groups.items():
            assert got[g] == pytest.approx((len(v), *np.percentile(v, [0, 25, 61, 100])))

    def test_labels(self, spark):
        df = spark.createDataFrame([(1.0,), (5.0,), (None,), (float("nan"),)], "x double")
        assert [r.x_binary for r in duplicates.binary_labels(df, "x", 2.0).collect()] == [1, 0, 0, 0]


class TestSimilarity:
    @pytest.fixture(scope="class")
    def vectors(self, spark):
        import random

        rng = random.Random(3)
        return spark.createDataFrame([(k, [float(rng.random() < 0.4) for _ in range(12)]) for k in range(40)], "k long, v array<double>")

    @pytest.mark.parametrize("metric", similarity.METRICS)
    def test_blocks_match_columns(self, vectors, metric):
        got = {(r.i, r.j): r.sim for r in similarity.all_pairs(vectors, "k", "v", metric, size=7).collect()}
        a, b = vectors.alias("a"), vectors.alias("b")
        want = {(r.i, r.j): r.s for r in a.join(b, F.col("a.k") < F.col("b.k")).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), similarity.similarity(metric, F.col("a.v"), F.col("b.v")).alias("s")).collect()}
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-12) for p in got)
        assert all(0 <= s <= 1 + 1e-12 for s in got.values())

    def test_neighbours_and_training_set(self, vectors):
        q = vectors.where("k < 5")
        near = similarity.nearest_neighbors(q, vectors, "k", "v", 3, size=9)
        assert near.count() == 15 and near.where("q = i").count() == 0
        t = similarity.training_set_similarity(q, vectors, "k", "v", 1, size=9).collect()
        assert all(r.max_sim == r.top_k_mean == 1.0 for r in t)

    def test_clusters(self, spark):
        rows = [(k, [float(k // 10 == g) for g in range(3)] + [0.01 * (k % 10)]) for k in range(30)] + [(99, [-1.0, -1.0, -1.0, 5.0])]
        df = spark.createDataFrame(rows, "k long, v array<double>")
        truth = {frozenset(range(g * 10, g * 10 + 10)) for g in range(3)}

        def groups(out):
            by = {}
            for r in out.collect():
                by.setdefault(r.cluster, set()).add(r.k)
            return {frozenset(x) for x in by.values()}

        assert groups(clustering.dbscan(df, "k", "v", 0.2, 3, "cosine")) == truth | {frozenset([99])}
        assert clustering.dbscan(df, "k", "v", 0.2, 3, "cosine").where("k = 99").first().cluster == -1
        assert groups(clustering.butina(df, "k", "v", 0.2, "cosine")) == truth | {frozenset([99])}
        assert groups(clustering.hierarchical(df, "k", "v", 4, metric="cosine")) == truth | {frozenset([99])}
        assert groups(clustering.kmeans(df, "v", 4, n_init=3)[0]) == truth | {frozenset([99])}
        inner = df.where("k < 30")
        assert groups(clustering.spectral(inner, "k", "v", 3, "cosine")) == truth
        out, shares = clustering.pca(df, "v")
        assert out.columns == ["k", "v", "PC1", "PC2"] and 0 < shares[1] <= shares[0] <= 1
        assert clustering.tsne(inner, "k", "v", 5, 50).count() == 30

    def test_scaler(self, spark):
        df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "k long, v array<double>")
        a, b = similarity.standardise(df, [df.limit(1)], "k", "v")
        assert sorted(r.v for r in a.collect()) == [[-1.0, 0.0], [1.0, 0.0]] and b.count() == 1

    def test_cliffs(self, spark):
        df = spark.createDataFrame([(1, [1.0, 1.0, 0.0], 1.0), (2, [1.0, 1.0, 0.0], 50.0), (3, [0.0, 0.0, 1.0], 1.0), (4, [1.0, 1.0, 0.0], 0.0)], "k long, v array<double>, y double")
        got = {r.k: (r.is_activity_cliff_molecule, r.n_activity_cliff_partners, r.strongest_cliff_partner) for r in similarity.activity_cliffs(df, "k", "v", "y").collect()}
        assert got == {1: ("yes", 2, 4), 2: ("yes", 2, 4), 3: ("no", 0, None), 4: ("yes", 2, 1)}


class TestSplitting:
    @pytest.fixture(scope="class")
    def rows(self, spark):
        return spark.range(103).select("id", (F.col("id") % 7).alias("g"), (F.col("id") % 2).alias("y"))

    def test_sizes(self, rows):
        count = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
        assert count(splitting.random_split(rows, ["id"], 1, 0.2, 0.1), "split") == {"test": 21, "val": 11, "train": 71}
        assert sorted(count(splitting.kfold(rows, ["id"], 5, 1), "fold").values()) == [20, 20, 21, 21, 21]
        s = splitting.stratified_split(rows, "y", ["id"], 1)
        assert count(s.where("y = 0"), "split") == {"test": 10, "train": 42}
        k = splitting.stratified_kfold(rows, "y", ["id"], 5, 1)
        assert max(abs(v - 10) for v in count(k.where("y = 1"), "fold").values()) <= 1

    @pytest.mark.parametrize("method", ["balanced", "random"])
    def test_groups_stay_together(self, rows, method):
        s = splitting.group_split(rows, "g", 3, 0.6, 0.2, 0.2, method)
        assert s.count() == 103 and s.select("g", "split").distinct().count() == 7
        assert splitting.group_leakage(s, "g").where("severity != 'OK'").count() == 0
        f = splitting.group_kfold(rows, "g", 3)
        assert f.count() == 103 and f.select("g", "fold").distinct().count() == 7

    def test_runs_of_equal_groups_are_dealt_as_one_by_one(self):
        for seed in range(300):
            rng = random.Random(seed)
            runs = [(n, rng.randrange(1, 40)) for n in sorted(rng.sample(range(1, 30), rng.randrange(1, 6)), reverse=True)]
            start, scale = [rng.randrange(500) for _ in range(rng.randrange(1, 6))], rng.choice([1, 10])
            need, segments = list(start), {}
            for size, rank, turn in splitting.deal_runs(runs, start, scale):
                segments.setdefault(size, []).append((rank, turn))
            for size, count in runs:
                for r in range(count):
                    side = max(range(len(need)), key=lambda k: (need[k], -k))
                    need[side] -= size * scale
                    rank, turn = [x for x in segments[size] if x[0] <= r][-1]
                    assert turn[(r - rank) % len(turn)] == side
        assert len(splitting.deal_runs([(3, 10**9), (1, 10**12)], [8 * 10**12, 2 * 10**12, 10**12], 10)) < 20

    def test_many_groups_of_few_sizes(self, spark):
        df = spark.range(3000).selectExpr("id", "CASE WHEN id < 900 THEN concat('s', id) WHEN id < 2400 THEN concat('p', id div 2) ELSE concat('t', id div 3) END AS g")
        got = {r.split: r["count"] for r in splitting.group_split(df, "g", train=0.5, test=0.3, val=0.2).groupBy("split").count().collect()}
        assert got == {"train": 1500, "test": 900, "val": 600}
        assert [r["count"] for r in splitting.group_kfold(df, "g", 4).groupBy("fold").count().collect()] == [750] * 4

    def test_other_folds(self, rows):
        m = splitting.monte_carlo(rows, ["id"], 4, 0.25, 1)
        assert {r[0]: r[1] for r in m.where("is_val").groupBy("split_id").count().collect()} == dict.fromkeys(range(4), 26)
        assert splitting.leave_p_out(rows, "id", 2, 5).count() == 10
        with pytest.raises(ValueError):
            splitting.kfold(rows, ["id"], 1)

    def test_leaks(self, rows):
        assert splitting.shared_keys(rows.where("id < 60"), rows.where("id > 50"), "id").count() == 9


class TestMetricsTokensReports:
    def test_metrics(self, spark):
        df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.1), (0, 1, 0.4), (1, 1, 0.8), (None, 1, 0.5)], "y int, p int, s double")
        r = metrics.calculate(df, "y", "p", ["accuracy", "precision", "recall", "f1_score", "mcc", "balanced_accuracy", "tp", "roc_auc"], score="s").first()
        assert (r.accuracy, r.tp, r.n) == (0.6, 2, 5) and r.roc_auc == pytest.approx(11 / 12) and r.balanced_accuracy == pytest.approx((2 / 3 + 0.5) / 2)
        with pytest.raises(ValueError):
            metrics.calculate(df, "y", "p", ["nope"])

    def test_tokens(self, spark, tmp_path):
        df = spark.createDataFrame([("CC(=O)Oc1ccccc1C(=O)O",), ("[nH]1cccc1Br",), (None,), ("~~",)], "s string")
        counts = {r.token: r.n for r in encoding.token_counts(df, "s").collect()}
        assert counts["Br"] == 1 and counts["[nH]"] == 1 and counts["c"] == 10
        vocab = encoding.default_vocabulary()
        encoding.save_vocabulary(vocab, str(tmp_path / "v.json"))
        assert encoding.load_vocabulary(str(tmp_path / "v.json")) == vocab and encoding.inspect_vocabulary(str(tmp_path / "v.json"))["vocab_size"] == len(vocab)
        status = [r.vocab_status for r in encoding.coverage(df, "s", vocab).collect()]
        assert status == ["passed", "passed", "failed", "failed"]
        hot = encoding.one_hot(df, "s", vocab).collect()
        assert len(hot) == 3 and all(sum(row) == 1 for r in hot for row in r.one_hot) and len({len(r.one_hot) for r in hot}) == 1
        with pytest.raises(Exception, match="not in the vocabulary"):
            encoding.indices(df, "s", encoding.vocabulary(["C"])).collect()
        r = encoding.complexity(df.limit(1), "s").first()
        assert (r.branches, r.num_tokens) == (2, 21)

    def test_reports(self, spark):
        df = spark.createDataFrame([(k, "big" if k < 30 else f"g{k}", k % 2, float(k)) for k in range(60)], "k long, g string, y long, x double")
        r = reports.scaffold_report(df, "g", "y")
        assert r["diversity"]["n_groups"] == 31 and r["top"][0] == {"g": "big", "n": 30}
        q = reports.quality_report(df, "g", "x", ["k"])
        assert q["n_duplicate_keys"] == 29 and q["correlations"]["k"]["pearson"]["statistic"] == pytest.approx(1)
        s = splitting.random_split(df, ["k"], 1)
        rep = reports.split_report(s, "k", "y", group="g", numbers=["x"], least=5)
        assert rep["checks"]["duplicates"]["severity"] == "OK" and rep["checks"]["groups"]["severity"] in ("LOW", "MEDIUM", "HIGH") and rep["n_checks"] == 5

    def test_split_report_finds_near_and_stereo_copies(self, spark):
        bits = [[1] * 20, [1] * 19 + [0], [0] * 10 + [1] * 10, [0, 1] * 10]
        smiles = ["C[C@H](O)CC", "C[C@@H](O)CC", "CCO", "c1ccccc1"]
        df = spark.createDataFrame([(f"m{k}", k % 2, bits[k], smiles[k], "train" if k in (0, 2) else "test") for k in range(4)], "k string, y int, v array<int>, s string, split string")
        rep = reports.split_report(df, "k", "y", least=1, vector="v", smiles="s")
        assert rep["checks"]["similarity"] == {"near": {"test-train": {"of_first": 1, "of_second": 1}}, "threshold": 0.9, "severity": "HIGH"}
        assert rep["checks"]["stereo"] == {"shared": {"test-train": 1}, "severity": "MEDIUM"} and rep["severity"] == "HIGH"


class TestQuantiles:
    PLACES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)

    @pytest.mark.parametrize("rows", [1, 7, 100_000])
    def test_any_number_of_rows_in_a_task(self, spark, rows):
        """Ties, a heavy value, nulls and infinite values; with a bound of one row every value is enclosed by counting."""
        x = [float(k * k % 97) for k in range(400)] + [5.0] * 300 + [1e300, -1e300, float("inf"), float("-inf"), 0.1]
        df = spark.createDataFrame([(v, None if k % 3 else v / 7) for k, v in enumerate(x)] + [(None, None)], "a double, b double")
        got = relational.quantiles(df, [F.col("a"), F.col("b")], self.PLACES, rows)
        finite = lambda values: df.sparkSession.createDataFrame([(v,) for v in values], "v double").select(F.percentile("v", F.array(*map(F.lit, self.PLACES)))).first()[0]
        for mine, values in zip(got, (x, [v / 7 for k, v in enumerate(x) if k % 3 == 0]), strict=True):
            assert [str(v) for v in mine] == [str(v) for v in finite(values)]

    def test_without_values(self, spark):
        df = spark.createDataFrame([(None,), (None,)], "a double")
        assert relational.quantiles(df, [F.col("a")], [0.5]) == [[None]] == relational.quantiles(df.limit(0), [F.col("a")], [0.5])


@pytest.mark.parametrize(("n", "p"), [(1, 1), (5, 2), (6, 3), (7, 7)])
def test_all_combinations_are_left_out(spark, n, p):
    from itertools import combinations

    want = list(combinations(range(n), p))
    assert [tuple(splitting.combination(k, n, p)) for k in range(len(want))] == want
    got = {}
    for r in splitting.leave_p_out(spark.range(n), "id", p).collect():
        got.setdefault(r.split_id, []).append(r.id)
    assert [tuple(sorted(got[k])) for k in range(len(want))] == want and len(got) == len(want)


def test_leave_one_out_has_no_limit(spark):
    assert splitting.leave_p_out(spark.range(1500), "id").count() == 1500
