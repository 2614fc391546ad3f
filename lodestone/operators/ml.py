"""Models by name, cross-validation, prediction with uncertainty, evaluation and tuning, on Spark ML.

A data set has a key, a vector (array of doubles) and a label. Models without a Spark counterpart are composed: kNN by
block-wise top-k, AdaBoost by reweighting trees, LDA by class means and a pooled covariance from one aggregation, kernel
machines by a linear solver over Nystroem features. Models with uncertainty are bootstrap ensembles: a member weighs each
row by a Poisson variable that follows from a hash, so the weights are the same on any cluster.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import materialise
from . import metrics as M
from .relational import need, quoted

FEATURES = "_features"


@dataclass
class Entry:
    """A model: kind (classifier or regressor), make(parameters, seed) -> estimator, search space, what it stands for."""

    kind: str
    make: Callable[[dict[str, Any], int], Any]
    space: dict[str, list[Any]]
    note: str = ""
    ensemble: bool = False


def _common(p: dict[str, Any]) -> dict[str, Any]:
    names = {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "max_features": "featureSubsetStrategy"}
    return {names[k]: v for k, v in p.items() if k in names and v is not None}


def _tree(p: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in _common(p).items() if k in ("maxDepth", "minInstancesPerNode")}


def _boost(p: dict[str, Any]) -> dict[str, Any]:
    names = {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth", "subsample": "subsamplingRate", "min_samples_leaf": "minInstancesPerNode"}
    return {names[k]: v for k, v in p.items() if k in names and v is not None}


def _on(cls: Any, **extra: Any) -> Any:
    return cls(featuresCol=FEATURES, labelCol="_label", predictionCol="_prediction", **extra)


_FOREST = {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 20], "min_samples_leaf": [1, 2, 5]}
_TREE = {"max_depth": [3, 5, 10, 20], "min_samples_leaf": [1, 2, 5]}
_BOOST = {"n_estimators": [20, 50, 100], "learning_rate": [0.03, 0.1, 0.3], "max_depth": [2, 3, 5]}


#: Rows that kernel machines take as landmarks: a bounded sample, the first ones in the order of a hash.
LANDMARKS = 300


def kernel(p: dict[str, Any], gamma: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel values of the rows of a with those of b."""
    kind = p.get("kernel", "rbf")
    if kind == "rbf":
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-gamma * np.maximum(d, 0))
    if kind == "poly":
        return (gamma * (a @ b.T) + p.get("coef0", 1.0)) ** p.get("degree", 3)
    if kind == "linear":
        return a @ b.T
    raise ValueError(f"unknown kernel: {kind}")


class _Nystroem:
    """A kernel machine: rows become their kernel values with landmarks, times the inverse root of the landmarks' own
    kernel matrix, and a linear model is fitted to that. All rows are mapped, in Arrow batches; the landmarks are sent
    with the function, LANDMARKS rows of a vector's width.

    kernel: rbf (gamma: a number, or scale: one by width times variance), poly (degree, coef0) or linear."""

    def __init__(self, p: dict[str, Any], seed: int, linear: Callable[[], Any]) -> None:
        self.p, self.seed, self.linear = p, seed, linear

    def fit(self, df: DataFrame) -> _Nystroem:
        out = _Nystroem(self.p, self.seed, self.linear)
        v = vector_to_array(FEATURES)
        rows = df.select(v.alias("v")).orderBy(F.xxhash64(F.lit(self.seed), v), "v").limit(self.p.get("n_components", LANDMARKS)).collect()
        out.landmarks = np.unique(np.array([r.v for r in rows], float), axis=0)
        told = df.select(F.explode(v).alias("x")).agg(F.var_pop("x")).first()[0] or 1.0
        gamma = self.p.get("gamma", "scale")
        out.gamma = 1 / (out.landmarks.shape[1] * told) if gamma == "scale" else 1 / out.landmarks.shape[1] if gamma == "auto" else float(gamma)
        values, vectors = np.linalg.eigh(kernel(self.p, out.gamma, out.landmarks, out.landmarks))
        kept = values > max(1e-10, values.max() * 1e-12)
        out.root = vectors[:, kept] / np.sqrt(values[kept])
        out.model = self.linear().fit(out._mapped(df))
        return out

    def _mapped(self, df: DataFrame) -> DataFrame:
        """df with the features of the linear model in place of its own, which go to _raw."""
        from pyspark.sql.functions import pandas_udf

        p, gamma, landmarks, root = self.p, self.gamma, self.landmarks, self.root

        @pandas_udf("array<double>")
        def features(v: pd.Series) -> pd.Series:
            return pd.Series(list(kernel(p, gamma, np.stack(v.to_numpy()), landmarks) @ root)) if len(v) else pd.Series([], dtype=object)

        return df.withColumn("_raw", F.col(FEATURES)).withColumn(FEATURES, array_to_vector(features(vector_to_array("_raw"))))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._mapped(df)).drop(FEATURES).withColumnRenamed("_raw", FEATURES)


#: Upper ends of the values of a Poisson variable with mean 1, as shares of all.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def bootstrap_weight(key: Column, seed: int, member: int) -> Column:
    """How often a row counts for a member of an ensemble: a Poisson variable of mean 1 from md5(seed|member|key)."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(member)), key.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return sum(((u >= x).cast("double") for x in _POISSON), F.lit(0.0))


class _Nearest:
    """k nearest neighbours; the training rows stay a DataFrame."""

    def __init__(self, p: dict[str, Any], classify: bool) -> None:
        self.k, self.classify = p.get("n_neighbors", 5), classify

    def fit(self, df: DataFrame) -> _Nearest:
        out = _Nearest({"n_neighbors": self.k}, self.classify)
        out.train = materialise(df.select(F.monotonically_increasing_id().alias("_id"), vector_to_array(FEATURES).alias("_v"), quoted("_label")))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        from .similarity import nearest_neighbors

        train = self.train
        rows = materialise(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_v", vector_to_array(FEATURES)))
        near = nearest_neighbors(rows, train, "_id", "_v", self.k, "euclidean", exclude_self=False).join(train.select(F.col("_id").alias("i"), "_label"), "i")
        if self.classify:
            votes = near.groupBy("q", "_label").agg(F.count("*").alias("n"))
            found = votes.groupBy("q").agg(F.min(F.struct((-F.col("n")).alias("n"), "_label")).alias("b"), F.max(F.when(F.col("_label") == 1, F.col("n"))).alias("one"))
            found = found.select("q", F.col("b._label").alias("_prediction"), (F.coalesce("one", F.lit(0)) / self.k).alias("_proba"))
        else:
            found = near.groupBy("q").agg(F.avg("_label").alias("_prediction"))
        return rows.join(found, F.col("_id") == F.col("q"), "left").drop("_id", "_v", "q")


class _Lda:
    """Linear discriminant analysis from class sums and one Gram matrix."""

    def __init__(self, *_: Any) -> None: ...

    def fit(self, df: DataFrame) -> _Lda:
        from pyspark.ml.stat import Summarizer
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix

        by = {r._label: (r.n, np.array(r.m.toArray())) for r in df.groupBy("_label").agg(F.count("*").alias("n"), Summarizer.mean(F.col(FEATURES)).alias("m")).collect()}
        n = sum(c for c, _ in by.values())
        gram = RowMatrix(df.select(FEATURES).rdd.map(lambda r: Vectors.fromML(r[0]))).computeGramianMatrix().toArray()
        within = (gram - sum(c * np.outer(m, m) for c, m in by.values())) / max(1, n - len(by))
        inverse = np.linalg.pinv(within + 1e-9 * np.trace(within) / len(within) * np.eye(len(within)))
        out = _Lda()
        out.weights = {y: (inverse @ m, -0.5 * m @ inverse @ m + math.log(c / n)) for y, (c, m) in sorted(by.items())}
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        v = vector_to_array(FEATURES)
        score = lambda w, b: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y), F.lit(float(b)), lambda s, x: s + x)
        scores = F.array(*[F.struct(score(w, b).alias("s"), F.lit(float(-y)).alias("y")) for y, (w, b) in self.weights.items()])
        out = df.withColumn("_scores", scores)
        total = F.aggregate("_scores", F.lit(0.0), lambda a, r: a + F.exp(r["s"] - F.array_max("_scores")["s"]))
        one = F.aggregate("_scores", F.lit(0.0), lambda a, r: a + F.when(r["y"] == -1, F.exp(r["s"] - F.array_max("_scores")["s"])).otherwise(0.0))
        return out.withColumns({"_prediction": -F.array_max("_scores")["y"], "_proba": one / total}).drop("_scores")


class _AdaBoost:
    """Boosted stumps (SAMME, and AdaBoost.R2 with means for regression) over weighted Spark trees."""

    def __init__(self, p: dict[str, Any], seed: int, classify: bool) -> None:
        self.rounds, self.rate, self.depth, self.seed, self.classify = p.get("n_estimators", 10), p.get("learning_rate", 1.0), p.get("max_depth", 1 if classify else 3), seed, classify

    def fit(self, df: DataFrame) -> _AdaBoost:
        data = materialise(df.select(FEATURES, "_label", (F.col("_weight") if "_weight" in df.columns else F.lit(1.0)).alias("_w")))
        classes = data.select("_label").distinct().count() if self.classify else 2
        tree = C.DecisionTreeClassifier if self.classify else R.DecisionTreeRegressor
        out = _AdaBoost({"n_estimators": self.rounds}, self.seed, self.classify)
        out.members = []
        for _ in range(self.rounds):
            model = _on(tree, maxDepth=self.depth, weightCol="_w", seed=self.seed).fit(data)
            told = model.transform(data)
            miss = F.abs(F.col("_label") - F.col("_prediction"))
            most = told.agg(F.max(miss)).first()[0]
            loss = (miss > 0).cast("double") if self.classify else miss / (most or 1.0)
            error = told.agg(F.sum(F.col("_w") * loss) / F.sum("_w")).first()[0]
            if not error:
                out.members.append((1.0 if not out.members else 10.0, model))
                break
            if error >= 1 - 1 / classes:
                if not out.members:
                    out.members.append((1.0, model))
                break
            weight = self.rate * (math.log((1 - error) / error) + (math.log(classes - 1) if self.classify and classes > 2 else 0))
            out.members.append((weight, model))
            grown = F.col("_w") * F.exp(weight * loss if self.classify else -weight * (1 - loss))
            data = materialise(told.select(FEATURES, "_label", grown.alias("_w")))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        out, total = df, sum(w for w, _ in self.members)
        for k, (_, model) in enumerate(self.members):
            out = model.transform(out).drop("rawPrediction", "probability").withColumnRenamed("_prediction", f"_member{k}")
        names = [f"_member{k}" for k in range(len(self.members))]
        if self.classify:
            votes = F.array(*[F.struct(F.col(n).alias("y"), F.lit(w).alias("w")) for n, (w, _) in zip(names, self.members, strict=True)])
            score = lambda y: F.aggregate(votes, F.lit(0.0), lambda s, v: s + F.when(v["y"] == y, v["w"]).otherwise(0.0))
            best = F.array_max(F.transform(F.array_distinct(F.array(*names)), lambda y: F.struct(score(y).alias("s"), (-y).alias("y"))))
            out = out.withColumns({"_prediction": -best["y"], "_proba": score(F.lit(1.0)) / total})
        else:
            out = out.withColumn("_prediction", sum(F.col(n) * (w / total) for n, (w, _) in zip(names, self.members, strict=True)))
        return out.drop(*names)


def _registry() -> dict[str, Entry]:
    linear = {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0]}
    e: dict[str, Entry] = {
        "random_forest_classifier": Entry("classifier", lambda p, s: _on(C.RandomForestClassifier, seed=s, **_common(p)), _FOREST),
        "gradient_boosting_classifier": Entry("classifier", lambda p, s: _on(C.GBTClassifier, seed=s, **_boost(p)), _BOOST, "two classes"),
        "logistic_regression": Entry("classifier", lambda p, s: _on(C.LogisticRegression, regParam=1 / p.get("C", 1.0) / 100, elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0, maxIter=p.get("max_iter", 100)), {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l1", "l2"]}),
        "svc": Entry("classifier", lambda p, s: _Nystroem(p, s, lambda: _on(C.LinearSVC, regParam=1 / p.get("C", 1.0) / 1000, maxIter=p.get("max_iter", 100))), {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["rbf", "linear", "poly"], "gamma": ["scale", "auto"]}, "Nystroem features"),
        "knn_classifier": Entry("classifier", lambda p, s: _Nearest(p, True), {"n_neighbors": [3, 5, 11]}),
        "decision_tree_classifier": Entry("classifier", lambda p, s: _on(C.DecisionTreeClassifier, seed=s, **_tree(p)), _TREE),
        "adaboost_classifier": Entry("classifier", lambda p, s: _AdaBoost(p, s, True), {"n_estimators": [10, 20], "learning_rate": [0.5, 1.0]}),
        "extra_trees_classifier": Entry("classifier", lambda p, s: _on(C.RandomForestClassifier, seed=s, bootstrap=False, maxBins=8, **_common(p)), _FOREST, "a forest on whole samples with coarse thresholds"),
        "naive_bayes": Entry("classifier", lambda p, s: _on(C.NaiveBayes, modelType="gaussian"), {}),
        "lda_classifier": Entry("classifier", lambda p, s: _Lda(), {}),
        "sgd_classifier": Entry("classifier", lambda p, s: _on(C.LogisticRegression if p.get("loss") == "log_loss" else C.LinearSVC, regParam=p.get("alpha", 1e-4), maxIter=p.get("max_iter", 100)), {"loss": ["hinge", "log_loss"], "alpha": [1e-4, 1e-3, 1e-2]}, "same loss, batch solver"),
        "random_forest_regressor": Entry("regressor", lambda p, s: _on(R.RandomForestRegressor, seed=s, **_common(p)), _FOREST),
        "gradient_boosting_regressor": Entry("regressor", lambda p, s: _on(R.GBTRegressor, seed=s, **_boost(p)), _BOOST),
        "ridge": Entry("regressor", lambda p, s: _on(R.LinearRegression, regParam=p.get("alpha", 1.0), elasticNetParam=0.0), linear),
        "lasso": Entry("regressor", lambda p, s: _on(R.LinearRegression, regParam=p.get("alpha", 1.0), elasticNetParam=1.0), linear),
        "elastic_net": Entry("regressor", lambda p, s: _on(R.LinearRegression, regParam=p.get("alpha", 1.0), elasticNetParam=p.get("l1_ratio", 0.5)), linear | {"l1_ratio": [0.1, 0.5, 0.9]}),
        "svr": Entry("regressor", lambda p, s: _Nystroem(p, s, lambda: _on(R.LinearRegression, loss="huber", epsilon=max(1.01, p.get("epsilon", 1.35)), regParam=1 / p.get("C", 1.0) / 1000)), {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["rbf", "linear", "poly"], "gamma": ["scale", "auto"]}, "Nystroem features, Huber loss"),
        "knn_regressor": Entry("regressor", lambda p, s: _Nearest(p, False), {"n_neighbors": [3, 5, 11]}),
        "decision_tree_regressor": Entry("regressor", lambda p, s: _on(R.DecisionTreeRegressor, seed=s, **_tree(p)), _TREE),
        "adaboost_regressor": Entry("regressor", lambda p, s: _AdaBoost(p, s, False), {"n_estimators": [10, 20], "learning_rate": [0.5, 1.0]}),
        "extra_trees_regressor": Entry("regressor", lambda p, s: _on(R.RandomForestRegressor, seed=s, bootstrap=False, maxBins=8, **_common(p)), _FOREST, "a forest on whole samples with coarse thresholds"),
        "sgd_regressor": Entry("regressor", lambda p, s: _on(R.LinearRegression, regParam=p.get("alpha", 1e-4), maxIter=p.get("max_iter", 100)), {"alpha": [1e-4, 1e-3, 1e-2]}, "same loss, batch solver"),
    }
    for base in ("random_forest_classifier", "gradient_boosting_classifier", "logistic_regression", "decision_tree_classifier", "adaboost_classifier", "extra_trees_classifier", "random_forest_regressor", "gradient_boosting_regressor", "decision_tree_regressor", "adaboost_regressor", "extra_trees_regressor"):
        e[f"{base}_w_uncertainty"] = Entry(e[base].kind, e[base].make, e[base].space | {"ensemble_size": [5, 10]}, "a bootstrap ensemble by Poisson weights", ensemble=True)
    return e


MODELS = _registry()


def available_models() -> list[str]:
    return list(MODELS)


def search_space(name: str) -> dict[str, list[Any]]:
    return entry(name).space


def entry(name: str) -> Entry:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {list(MODELS)}")
    return MODELS[name]


def prepared(df: DataFrame, vector: str, label: str | None = None) -> DataFrame:
    """df with the columns that estimators read; rows with a null in them are out."""
    need(df, [vector, *([label] if label else [])])
    out = df.where(quoted(vector).isNotNull()).withColumn(FEATURES, array_to_vector(quoted(vector).cast("array<double>")))
    return out.where(quoted(label).isNotNull()).withColumn("_label", quoted(label).cast("double")) if label else out


@dataclass
class Bundle:
    """Fitted models with what they were fitted on."""

    algorithm: str
    models: list[Any]
    parameters: dict[str, Any]
    seed: int
    folds: DataFrame | None = None
    info: dict[str, Any] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return MODELS[self.algorithm].kind


def _fit(name: str, data: DataFrame, parameters: dict[str, Any], seed: int) -> list[Any]:
    """data: features, _label and _key. The members of an ensemble are fitted to rows weighted by bootstrap_weight;
    rows of weight 0 are left out."""
    e = entry(name)
    p = {k: v for k, v in parameters.items() if k != "ensemble_size"}
    if not e.ensemble:
        return [e.make(p, seed).fit(data.select(FEATURES, "_label"))]
    out = []
    for k in range(parameters.get("ensemble_size", 10)):
        estimator = e.make(p, seed + k)
        if hasattr(estimator, "setWeightCol"):
            estimator = estimator.setWeightCol("_weight")
        out.append(estimator.fit(data.select(FEATURES, "_label", bootstrap_weight(F.col("_key"), seed, k).alias("_weight")).where("_weight > 0")))
    return out


def _keyed(data: DataFrame, key: str | None) -> DataFrame:
    """data with _key: the key as text, or a hash of features and label, by which equal rows weigh the same."""
    own = quoted(key).cast("string") if key else F.xxhash64(vector_to_array(FEATURES), "_label").cast("string")
    return data.withColumn("_key", own)


def train(df: DataFrame, vector: str, label: str, algorithm: str = "random_forest_classifier", parameters: dict[str, Any] | None = None, seed: int = 42, key: str | None = None) -> Bundle:
    """key: what the bootstrap weights of ensembles follow from."""
    data = _keyed(prepared(df, vector, label), key).select(FEATURES, "_label", "_key").persist()
    models = _fit(algorithm, data, parameters or {}, seed)
    data.unpersist()
    return Bundle(algorithm, models, parameters or {}, seed)


def cross_validate(folds: DataFrame, vector: str, label: str, algorithm: str = "random_forest_classifier", parameters: dict[str, Any] | None = None, seed: int = 42, fold: str = "fold", key: str | None = None) -> Bundle:
    """One fit for each fold, on the rows of the others. folds: a data set with a fold column (see splitting)."""
    data = _keyed(prepared(folds, vector, label), key).persist()
    numbers = sorted(r[0] for r in data.select(quoted(fold)).distinct().collect())
    models = [_fit(algorithm, data.where(quoted(fold) != k).select(FEATURES, "_label", "_key"), parameters or {}, seed)[0] for k in numbers]
    data.unpersist()
    return Bundle(algorithm, models, parameters or {}, seed, folds, {"folds": numbers, "fold": fold})


def _one(model: Any, data: DataFrame, classify: bool) -> DataFrame:
    out = model.transform(data)
    if classify and "_proba" not in out.columns:
        if "probability" in out.columns:
            p = vector_to_array("probability")
            out = out.withColumn("_proba", F.when(F.size(p) > 1, F.get(p, 1)).otherwise(F.lit(0.0)))
        else:
            out = out.withColumn("_proba", F.col("_prediction"))
    return out.drop("rawPrediction", "probability")


def predict(bundle: Bundle, df: DataFrame, vector: str, name: str = "prediction") -> DataFrame:
    """df with name, and for classifiers name_proba. Several models add each one's prediction (name_0, ...), name_mean,
    name_std (population) and, for classifiers, name_entropy (bits) of the mean probability."""
    classify = bundle.kind == "classifier"
    out = prepared(df, vector)
    for k, model in enumerate(bundle.models):
        out = _one(model, out, classify).withColumnRenamed("_prediction", f"_y{k}")
        out = out.withColumnRenamed("_proba", f"_p{k}") if classify else out
    n = len(bundle.models)
    ys, ps = [F.col(f"_y{k}") for k in range(n)], [F.col(f"_p{k}") for k in range(n)]
    if n == 1:
        new = {name: ys[0]} | ({f"{name}_proba": ps[0]} if classify else {})
    else:
        values = ps if classify else ys
        mean = sum(values[1:], values[0]) / n
        std = F.sqrt(sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) * (values[0] - mean)) / n)
        new = {f"{name}_{k}": y for k, y in enumerate(ys)} | {f"{name}_mean": mean, f"{name}_std": std}
        if classify:
            plogp = lambda p: F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
            new |= {name: (mean >= 0.5).cast("double"), f"{name}_proba": mean, f"{name}_entropy": plogp(mean)}
        else:
            new[name] = mean
    kept: list[Column] = [quoted(c) for c in df.columns if c not in new]
    return out.select(*kept, *[v.alias(k) for k, v in new.items()])


def _written(spark: SparkSession, path: str, value: Any) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path).first()[0])


def _save_model(spark: SparkSession, model: Any, path: str) -> None:
    """A model in a folder that any Spark reader can open: what it is as JSON, with numbers, members and rows beside."""
    if isinstance(model, _Lda):
        _written(spark, f"{path}/what", {"lda": [[y, w.tolist(), b] for y, (w, b) in model.weights.items()]})
    elif isinstance(model, _AdaBoost):
        _written(spark, f"{path}/what", {"adaboost": [w for w, _ in model.members], "classify": model.classify})
        for k, (_, member) in enumerate(model.members):
            _save_model(spark, member, f"{path}/member{k}")
    elif isinstance(model, _Nearest):
        _written(spark, f"{path}/what", {"nearest": model.k, "classify": model.classify})
        model.train.write.mode("overwrite").parquet(f"{path}/rows")
    elif isinstance(model, _Nystroem):
        _written(spark, f"{path}/what", {"nystroem": model.p, "seed": model.seed, "gamma": model.gamma, "landmarks": model.landmarks.tolist(), "root": model.root.tolist()})
        _save_model(spark, model.model, f"{path}/linear")
    else:
        _written(spark, f"{path}/what", {"spark": [type(model).__module__, type(model).__name__]})
        model.write().overwrite().save(f"{path}/model")


def _load_model(spark: SparkSession, path: str) -> Any:
    what = _read(spark, f"{path}/what")
    if "lda" in what:
        out = _Lda()
        out.weights = {y: (np.array(w), b) for y, w, b in what["lda"]}
    elif "adaboost" in what:
        out = _AdaBoost({}, 0, what["classify"])
        out.members = [(w, _load_model(spark, f"{path}/member{k}")) for k, w in enumerate(what["adaboost"])]
    elif "nearest" in what:
        out = _Nearest({"n_neighbors": what["nearest"]}, what["classify"])
        out.train = spark.read.parquet(f"{path}/rows")
    elif "nystroem" in what:
        out = _Nystroem(what["nystroem"], what["seed"], lambda: None)
        out.gamma, out.landmarks, out.root = what["gamma"], np.array(what["landmarks"]), np.array(what["root"])
        out.model = _load_model(spark, f"{path}/linear")
    else:
        module, name = what["spark"]
        if module not in (C.__name__, R.__name__):
            raise ValueError(f"{module}.{name} is no model of this library")
        out = getattr(C if module == C.__name__ else R, name).load(f"{path}/model")
    return out


def save(bundle: Bundle, spark: SparkSession, path: str) -> None:
    """Write a bundle into a folder of any file system that Spark writes to; its folds go along as a table."""
    info = {k: v for k, v in bundle.info.items()}
    _written(spark, f"{path}/bundle", {"algorithm": bundle.algorithm, "parameters": bundle.parameters, "seed": bundle.seed, "info": info, "models": len(bundle.models), "folds": bundle.folds is not None})
    for k, model in enumerate(bundle.models):
        _save_model(spark, model, f"{path}/model{k}")
    if bundle.folds is not None:
        bundle.folds.write.mode("overwrite").parquet(f"{path}/folds")


def load(spark: SparkSession, path: str) -> Bundle:
    """The bundle that save wrote."""
    told = _read(spark, f"{path}/bundle")
    models = [_load_model(spark, f"{path}/model{k}") for k in range(told["models"])]
    return Bundle(told["algorithm"], models, told["parameters"], told["seed"], spark.read.parquet(f"{path}/folds") if told["folds"] else None, told["info"])


def all_search_spaces() -> dict[str, dict[str, list[Any]]]:
    return {name: e.space for name, e in MODELS.items()}


def evaluate(bundle: Bundle, df: DataFrame | None, vector: str, label: str, metrics: Sequence[str]) -> DataFrame:
    """One row of metrics on df; for a cross-validated bundle without df, (metric, mean, std, min, max) over the rows
    that each model was not fitted on."""
    if df is not None:
        told = predict(bundle, df, vector, "_told")
        return M.calculate(told, label, "_told", metrics, score="_told_proba" if bundle.kind == "classifier" else None)
    fold, parts = bundle.info["fold"], None
    for k, model in zip(bundle.info["folds"], bundle.models, strict=True):
        told = _one(model, prepared(bundle.folds.where(quoted(fold) == k), vector, label), bundle.kind == "classifier").select(F.lit(k).alias("fold"), "_label", "_prediction")
        parts = told if parts is None else parts.unionByName(told)
    return M.fold_summary(M.by_fold(parts, "fold", "_label", "_prediction", metrics), metrics)


def candidates(grid: dict[str, list[Any]], strategy: str = "grid", n: int = 10, seed: int = 42) -> list[dict[str, Any]]:
    """All combinations, or n of them by a seeded draw."""
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    if strategy == "grid":
        return every
    if strategy != "random":
        raise ValueError(f"unknown strategy: {strategy}")
    return random.Random(seed).sample(every, min(n, len(every)))


def tune(folds: DataFrame, vector: str, label: str, algorithm: str, metric: str, grid: dict[str, list[Any]] | None = None, strategy: str = "grid", n: int = 10, seed: int = 42, fold: str = "fold") -> dict[str, Any]:
    """Mean score of each combination over folds, and the best (the least for errors). Combinations that fail are
    listed with what they raised."""
    least = metric in ("mse", "rmse", "mae")
    results = []
    for p in candidates(grid or search_space(algorithm), strategy, n, seed):
        try:
            bundle = cross_validate(folds, vector, label, algorithm, p, seed, fold)
            results.append({"parameters": p, "score": evaluate(bundle, None, vector, label, [metric]).first()["mean"]})
        except Exception as e:  # a combination that a model refuses must not end the search
            results.append({"parameters": p, "error": str(e)[:500]})
    scored = [r for r in results if r.get("score") is not None]
    return {"results": results, "best": (min if least else max)(scored, key=lambda r: r["score"]) if scored else None}
