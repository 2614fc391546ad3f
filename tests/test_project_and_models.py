import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ml, relational, splitting
from lodestone.sources.catalog import Project, check_data_dir, recorded, summarise_projects


def test_project_round_trip(spark, tmp_path):
    p = Project.create(spark, tmp_path / "p", "demo")
    with pytest.raises(FileExistsError):
        Project.create(spark, tmp_path / "p", "demo")
    (tmp_path / "in.csv").write_text("a,b\n1,x\n,y\n3.5,\n")
    name = p.import_csv(str(tmp_path / "in.csv"), "table")
    assert sorted((r.a is None, r.b) for r in p.load(name).collect() if r.b) == [(False, "x"), (True, "y")]
    text = p.import_csv_text("a,b\n1,2\n", "small")
    assert p.load(text).count() == 1
    others = {"json": {"k": [1]}, "txt": "héllo", "png": b"\x89PNG", "joblib": {"m": (1, 2)}}
    for kind, value in others.items():
        assert p.load(p.store(value, kind, kind)) == value
    with pytest.raises(ValueError):
        p.store(1, "x", "nope")
    with pytest.raises(ValueError):
        p.load("unknown.csv")
    (tmp_path / "p" / "stray.bin").write_bytes(b"1")
    assert p.untracked() == ["stray.bin"]
    p.remove(name, delete=True)
    assert not (tmp_path / "p" / name).exists() and len(p.resources()) == 5
    assert summarise_projects(tmp_path / "p")[0]["resources"]["csv"] == 1


def test_lineage(spark, tmp_path):
    p = Project.create(spark, tmp_path / "q", "demo")
    keep = recorded()(relational.keep_columns)
    keep(spark.range(3), ["id"], project=p, name="ids")
    entry = p.resources()[0]
    assert (entry["parent_function_name"], entry["parent_function_inputs"]) == ("keep_columns", {"columns": "['id']"}) and p.load(entry["filename"]).count() == 3


@pytest.fixture(scope="module")
def points(spark):
    x = F.array((F.col("id") % 10).cast("double"), (F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double"))
    df = spark.range(120).select("id", x.alias("v"))
    return df.withColumn("y", F.when(F.col("v")[0] > 4.5, 1).otherwise(0)).withColumn("z", 2 * F.col("v")[0] + F.col("v")[1]).persist()


QUICK = {"n_estimators": 3, "max_depth": 3, "ensemble_size": 2, "alpha": 0.01, "n_neighbors": 3}


@pytest.mark.parametrize("name", ml.available_models())
def test_every_model_fits_and_predicts(points, name):
    classify = ml.entry(name).kind == "classifier"
    known = {k: v for k, v in QUICK.items() if k in ml.search_space(name) or k in ("n_estimators", "max_depth") and "forest" in name}
    bundle = ml.train(points, "v", "y" if classify else "z", name, known)
    out = ml.predict(bundle, points, "v", "told")
    assert out.count() == 120 and out.where("told is null").count() == 0
    if classify:
        assert out.where("told = y").count() > 100 and out.where("told_proba between 0 and 1").count() == 120
    else:
        r2 = ml.evaluate(bundle, points, "v", "z", ["r2"]).first().r2
        assert r2 > (0.3 if "tree" in name or "forest" in name or "ada" in name else 0.8)


def test_cross_validation_and_tuning(points):
    folds = splitting.stratified_kfold(points, "y", ["id"], 3, 1)
    bundle = ml.cross_validate(folds, "v", "y", "decision_tree_classifier", {"max_depth": 3})
    s = ml.evaluate(bundle, None, "v", "y", ["accuracy", "f1_score"]).collect()
    assert {r.metric for r in s} == {"accuracy", "f1_score"} and all(r["mean"] > 0.9 for r in s)
    out = ml.predict(bundle, points, "v", "p")
    assert {"p_0", "p_1", "p_2", "p_mean", "p_std", "p_entropy"} <= set(out.columns)
    best = ml.tune(folds, "v", "z", "ridge", "rmse", {"alpha": [0.01, 100.0]})
    assert best["best"]["parameters"] == {"alpha": 0.01} and len(best["results"]) == 2
    assert len(ml.candidates({"a": [1, 2, 3], "b": [1, 2]}, "random", 4)) == 4
    with pytest.raises(ValueError):
        ml.entry("nope")


@pytest.mark.parametrize("name", ["svc", "svr", "lda_classifier", "adaboost_classifier", "knn_regressor", "random_forest_classifier_w_uncertainty", "ridge"])
def test_saved_models_predict_the_same(spark, points, tmp_path, name):
    classify = ml.entry(name).kind == "classifier"
    known = {k: v for k, v in QUICK.items() if k in ml.search_space(name) or k == "n_estimators" and "forest" in name}
    bundle = ml.train(points, "v", "y" if classify else "z", name, known, key="id")
    p = Project.create(spark, tmp_path / name, "m")
    again = p.load(p.store(bundle, "bundle", "model"))
    assert (again.algorithm, again.parameters, again.seed) == (name, known, 42)
    one, two = ({r.id: r.told for r in ml.predict(b, points, "v", "told").collect()} for b in (bundle, again))
    assert one == pytest.approx(two)


def test_folds_of_a_saved_bundle(spark, points, tmp_path):
    bundle = ml.cross_validate(splitting.kfold(points, ["id"], 3, 1), "v", "z", "ridge", {"alpha": 0.01})
    ml.save(bundle, spark, str(tmp_path / "b"))
    again = ml.load(spark, str(tmp_path / "b"))
    assert ml.evaluate(again, None, "v", "z", ["rmse"]).first()["mean"] == pytest.approx(ml.evaluate(bundle, None, "v", "z", ["rmse"]).first()["mean"])


def test_kernels_tell_rings(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(x.tolist(), int((x @ x) > 1.4), float(np.sin(x[0]) * x[1])) for x in v], "v array<double>, y int, z double")
    score = {k: ml.evaluate(ml.train(rows, "v", "y", "svc", {"C": 100.0, "kernel": k}), rows, "v", "y", ["accuracy"]).first().accuracy for k in ("rbf", "poly", "linear")}
    assert score["rbf"] > 0.95 and score["poly"] > 0.9 and score["linear"] < 0.75
    r2 = {k: ml.evaluate(ml.train(rows, "v", "z", "svr", {"C": 100.0, "kernel": k}), rows, "v", "z", ["r2"]).first().r2 for k in ("rbf", "linear")}
    assert r2["rbf"] > 0.75 > r2["linear"] + 0.3
    with pytest.raises(ValueError, match="kernel"):
        ml.train(rows, "v", "y", "svc", {"kernel": "x"})


def test_ensembles_resample_rows(spark, points):
    w = points.select(*[ml.bootstrap_weight(F.col("id"), 1, k).alias(f"w{k}") for k in range(20)]).agg(*[F.avg(f"w{k}").alias(f"m{k}") for k in range(20)], *[F.var_pop(f"w{k}").alias(f"v{k}") for k in range(20)]).first()
    assert abs(sum(w[f"m{k}"] for k in range(20)) / 20 - 1) < 0.06 and abs(sum(w[f"v{k}"] for k in range(20)) / 20 - 1) < 0.15
    rng = np.random.default_rng(3)
    noisy = spark.createDataFrame([(k, [float(x)], float(2 * x + e)) for k, (x, e) in enumerate(zip(rng.normal(size=200), rng.normal(size=200)))], "id long, v array<double>, z double")
    bundle = ml.train(noisy, "v", "z", "decision_tree_regressor_w_uncertainty", {"max_depth": 1, "ensemble_size": 12}, key="id")
    out = ml.predict(bundle, noisy, "v", "p").agg(F.avg("p_std").alias("s"), F.countDistinct("p_0").alias("n")).first()
    assert 0.02 < out.s < 1 and out.n == 2  # stumps of different samples differ by about the error of a mean


def test_strategies_by_name(points):
    assert splitting.cv_splits(points, "kfold", key=["id"], k=3).select("fold").distinct().count() == 3
    assert splitting.cv_splits(points.withColumn("g", F.col("id") % 5), "cluster", group="g", k=5).groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0

    @splitting.register_strategy("odd")
    def odd(df):
        return df.withColumn("fold", (F.col("id") % 2).cast("int"))

    assert splitting.cv_splits(points, "odd").where("fold = 1").count() == 60 and set(splitting.guidance()) <= set(splitting._STRATEGIES)
    for bad in (lambda: splitting.cv_splits(points, "none"), lambda: splitting.register_strategy("odd")(odd)):
        with pytest.raises(ValueError):
            bad()


def test_data_folders(spark, tmp_path):
    Project.create(spark, tmp_path / "one", "first")
    assert check_data_dir(tmp_path) | {"folder": ""} == {"folder": "", "exists": True, "is_folder": True, "writable": True, "projects": ["first"]}
    assert not check_data_dir(tmp_path / "none")["exists"]
