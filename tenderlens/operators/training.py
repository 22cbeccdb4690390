"""Classifiers, cross-validation, hold-out validation and parameter search."""

from __future__ import annotations

import json
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, StringType, StructField, StructType,
)

from tenderlens.operators import boosting, encode, metrics, network
from tenderlens.operators.splitting import SEED, stratified_folds
from tenderlens.settings import LABEL, ROW_ID, FeatureSpec
from tenderlens.sources.staging import discard, small_table, stage

SCORING = ("accuracy", "roc_auc", "neg_log_loss")
MAX_TREE_DEPTH = 30
#: Rows of a partition that a forest is grown on, at some 2.5 KB with the draws of 500 trees.
FOREST_ROWS = 200_000


@dataclass(frozen=True)
class Classifier:
    """A model type with its parameters, before fitting."""

    kind: str
    short_name: str
    params: dict = field(default_factory=dict)


# The finalists of the parameter search and the widest network tried.
FINALISTS = (
    Classifier("LogReg", "LogReg_lib", {"C": 2, "penalty": "l1"}),
    Classifier("LogReg", "LogReg_saga", {"C": 8, "penalty": "l1"}),
    Classifier("RandForest", "RandForest_wide",
               {"n_estimators": 500, "max_depth": 8, "max_features": 40, "criterion": "gini"}),
    Classifier("RandForest", "RandForest_deep",
               {"n_estimators": 80, "max_depth": 19, "max_features": 45,
                "criterion": "entropy"}),
    Classifier("Boosting", "Boosting-3-400",
               {"eta": 0.025, "gamma": 1.0, "max_depth": 3, "n_estimators": 400,
                "subsample": 0.85}),
    Classifier("Boosting", "Boosting-6-600",
               {"eta": 0.5, "gamma": 0.7, "max_depth": 6, "n_estimators": 600,
                "subsample": 0.9}),
)
# The networks compared, by hidden layers, activation and dropout.
NETWORKS = tuple(
    Classifier("Network", name, {"hidden": hidden, "activation": activation, "dropout": dropout,
                                 "epochs": 10, "batch": 5000, "learning_rate": 0.01})
    for name, hidden, activation, dropout in (
        ("NN-4x60-relu", [60, 60, 60, 60], "relu", 0.0),
        ("NN-4x60-tanh", [60, 60, 60, 60], "tanh", 0.0),
        ("NN-4x60-tanh-dropout", [60, 60, 60, 60], "tanh", 0.5),
        ("NN-3x150-tanh-dropout", [150, 150, 150], "tanh", 0.5),
        ("NN-4x150-tanh-dropout", [150, 150, 150, 150], "tanh", 0.5),
        ("NN-150-50-tanh-dropout", [150, 150, 100, 50], "tanh", 0.5)))


def _depth(depth: int) -> int:
    if depth > MAX_TREE_DEPTH:
        raise ValueError(f"trees may be {MAX_TREE_DEPTH} deep, not {depth}")
    return depth


def _subset(wanted: int, features: int) -> int:
    if wanted > features:
        raise ValueError(f"max_features is {wanted}, but there are {features} features")
    return wanted


def estimator(clf: Classifier, rows: int, features: int):
    """The Spark ML estimator of a classifier for training data of the given shape."""
    p = clf.params
    if clf.kind == "LogReg":
        # The penalty is weighed per row here and against the sum over rows as 1 / C there.
        return LogisticRegression(
            labelCol=LABEL, regParam=1 / (max(p.get("C", 1.0), 1e-9) * max(rows, 1)),
            elasticNetParam=1.0 if p.get("penalty", "l2") == "l1" else 0.0,
            standardization=False, maxIter=p.get("max_iter", 100))
    if clf.kind == "RandForest":
        subset = p.get("max_features", "sqrt")
        return RandomForestClassifier(
            labelCol=LABEL, seed=SEED, numTrees=p.get("n_estimators", 100),
            maxDepth=_depth(p.get("max_depth", 5)), impurity=p.get("criterion", "gini"),
            featureSubsetStrategy=subset if isinstance(subset, str)
            else str(_subset(subset, features)))
    raise ValueError(f"unknown model type {clf.kind}")


def fitted_model(clf: Classifier, data: DataFrame, rows: int, features: int):
    """The model of a classifier fitted on (label, features and, if there is one, the row id)."""
    p, key = clf.params, ROW_ID if ROW_ID in data.columns else None
    if clf.kind == "Boosting":
        wanted = boosting.Boosting(
            rounds=p.get("n_estimators", 100), eta=p.get("eta", 0.3),
            max_depth=_depth(p.get("max_depth", 6)), gamma=p.get("gamma", 0.0),
            subsample=p.get("subsample", 1.0), reg_lambda=p.get("reg_lambda", 1.0),
            least_hessian=p.get("min_child_weight", 1.0), seed=SEED)
        return boosting.fit(data, LABEL, wanted, key=key)
    if clf.kind == "Network":
        wanted = network.Network(
            hidden=tuple(p.get("hidden", (60,))), activation=p.get("activation", "relu"),
            dropout=p.get("dropout", 0.0), epochs=p.get("epochs", 10),
            batch=p.get("batch", 5000), learning_rate=p.get("learning_rate", 0.01), seed=SEED)
        return network.fit(data, LABEL, wanted, key=key)
    return estimator(clf, rows, features).fit(data)


@dataclass
class Fitted:
    """A trained classifier with the feature encoding it was trained on."""

    clf: Classifier
    encoding: dict
    model: object
    names: list[str]
    fit_time: float

    def score_rows(self, df: DataFrame) -> DataFrame:
        """``df`` with probability and prediction columns."""
        return self.model.transform(encode.vectors(encode.transform(df, self.encoding)))

    def predictions(self, df: DataFrame) -> DataFrame:
        """(row id, label, probability, prediction)"""
        return metrics.predictions_of(self.score_rows(df), LABEL,
                                      ROW_ID if ROW_ID in df.columns else None)


def encoded_rows(df: DataFrame, encoding: dict) -> tuple[DataFrame, list[str]]:
    """(row id if there is one, label, features) and the names of the features."""
    encoded = encode.transform(df, encoding)
    key = [ROW_ID] if ROW_ID in encoded.columns else []
    return encode.vectors(encoded).select(*key, LABEL, "features"), encode.feature_names(encoded)


def fit_encoded(clf: Classifier, data: DataFrame, encoding: dict, names: list[str]) -> Fitted:
    """Fits a model on encoded rows."""
    if clf.kind == "RandForest":
        # Every partition shuffles the histograms of all open nodes, hundreds of MB a pass, so
        # there are no more of them than cores, or than keep a partition's rows bounded.
        cores = data.sparkSession.sparkContext.defaultParallelism
        data = data.coalesce(max(cores, -(-data.count() // FOREST_ROWS)))
    # Trainers pass over the data many times; a lost block is recomputed from the staged input.
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = data.count()
        start = time.time()
        model = fitted_model(clf, data, rows, len(names))
        return Fitted(clf, encoding, model, names, time.time() - start)
    finally:
        data.unpersist()


def fit_classifier(clf: Classifier, train: DataFrame, spec: FeatureSpec) -> Fitted:
    """Fits encoding and model on the training rows alone."""
    encoding = encode.fit(train, spec)
    data, names = encoded_rows(train, encoding)
    return fit_encoded(clf, data, encoding, names)


def _score_parts(fitted: Fitted, train: DataFrame, test: DataFrame,
                 scoring: tuple[str, ...]) -> tuple[dict, DataFrame]:
    # Narrow, and read by every metric.
    held_out = stage(fitted.predictions(test), "held_out")
    on_train = stage(fitted.predictions(train), "fitted")
    row = {"fit_time": fitted.fit_time}
    for part, predictions in (("train", on_train), ("test", held_out)):
        for metric, value in metrics.score(predictions, scoring).items():
            row[f"{part}_{metric}"] = value
    discard(on_train)
    return row, held_out


@dataclass
class Fold:
    """The encoded training and test rows of one fold; the encoding knows the training rows only."""

    encoding: dict
    names: list[str]
    train: DataFrame
    test: DataFrame


def encoded_folds(df: DataFrame, spec: FeatureSpec, k: int) -> list[Fold]:
    """The folds of a search. They are encoded and written once, whatever the number of trials."""
    folded, out = stage(stratified_folds(df, k), "folds"), []
    for i in range(k):
        train, test = (folded.filter(f"fold {sign} {i}").drop("fold") for sign in ("<>", "="))
        encoding = encode.fit(train, spec)
        rows, names = encoded_rows(train, encoding)
        out.append(Fold(encoding, names, stage(rows, "fold_train"),
                        stage(encoded_rows(test, encoding)[0], "fold_test")))
    return out


def trial_score(clf: Classifier, folds: list[Fold]) -> float:
    """The mean negative log loss of a classifier on the test rows of all folds."""
    scores = []
    for fold in folds:
        fitted = fit_encoded(clf, fold.train, fold.encoding, fold.names)
        predictions = metrics.predictions_of(fitted.model.transform(fold.test), LABEL)
        scores.append(metrics.score(predictions, ("neg_log_loss",))["neg_log_loss"])
    return sum(scores) / len(scores)


def _score_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    numbers = [c for c in rows[0] if c not in ("model", "fold")]
    schema = StructType([StructField("model", StringType()), StructField("fold", IntegerType()),
                         *(StructField(c, DoubleType()) for c in numbers)])
    return small_table(spark, [tuple(r[f.name] for f in schema.fields) for r in rows], schema)


def cross_validate(clf: Classifier, df: DataFrame, spec: FeatureSpec, k: int = 3,
                   scoring: tuple[str, ...] = SCORING) -> tuple[DataFrame, DataFrame]:
    """(scores per fold, out-of-fold predictions of all folds).

    Encoding and model are refitted per fold on the other folds. The folds are staged; the loop
    runs over k of them and the data never leave the cluster.
    """
    folded = stage(stratified_folds(df, k), "folds")
    rows, held_out = [], None
    for i in range(k):
        train = folded.filter(F.col("fold") != i).drop("fold")
        test = folded.filter(F.col("fold") == i).drop("fold")
        fitted = fit_classifier(clf, train, spec)
        row, predictions = _score_parts(fitted, train, test, scoring)
        rows.append({"model": clf.short_name, "fold": i, **row})
        predictions = predictions.withColumn("fold", F.lit(i))
        held_out = predictions if held_out is None else held_out.unionByName(predictions)
    return _score_table(df.sparkSession, rows), held_out


def validate(clf: Classifier, train: DataFrame, valid: DataFrame, spec: FeatureSpec,
             scoring: tuple[str, ...] = SCORING) -> tuple[DataFrame, Fitted]:
    """(one row of scores, fitted classifier) for a hold-out split."""
    fitted = fit_classifier(clf, train, spec)
    row, _ = _score_parts(fitted, train, valid, scoring)
    return _score_table(train.sparkSession,
                        [{"model": clf.short_name, "fold": 0, **row}]), fitted


def feature_weights(fitted: list[Fitted], spark: SparkSession) -> DataFrame:
    """(model, rank, variable, weight): coefficients by size or importances, largest first."""
    rows = []
    for f in fitted:
        linear = f.clf.kind == "LogReg"
        weights = (f.model.coefficients if linear else f.model.featureImportances).toArray()
        pairs = sorted(zip(f.names, map(float, weights)),
                       key=lambda p: (-abs(p[1]) if linear else -p[1], p[0]))
        rows += [(f.clf.short_name, i + 1, name, w) for i, (name, w) in enumerate(pairs)]
    schema = StructType([StructField("model", StringType()), StructField("rank", IntegerType()),
                         StructField("variable", StringType()),
                         StructField("weight", DoubleType())])
    return small_table(spark, rows, schema)


def weights_by_model(weights: DataFrame, models: list[str]) -> DataFrame:
    """One column per model with 'variable: weight' in rank order."""
    text = F.format_string("%s: %.2f", "variable", "weight")
    return weights.withColumn("text", text).groupBy("rank").pivot("model", models).agg(
        F.first("text")).orderBy("rank")


# ---- parameter search ---------------------------------------------------------------------

# The searched ranges, as (first, last, step) or choices.
SPACE = {
    "LogReg": {"C": (0.0, 10.0, None), "penalty": ["l1", "l2"]},
    "RandForest": {"max_depth": (1, 10, 1), "max_features": [15, 20, 25, 30, "log2", "sqrt"],
                   "n_estimators": (100, 1000, 100), "criterion": ["gini", "entropy"]},
    "Boosting": {"n_estimators": (100, 1000, 100), "eta": (0.025, 0.5, 0.025),
                 "max_depth": (1, 10, 1), "subsample": (0.5, 1.0, 0.05),
                 "gamma": (0.5, 1.0, 0.05)},
}
SHOWN_PARAMS_EXCLUDE = ("type", "n_jobs", "random_state", "verbosity")

HISTORY = StructType([
    StructField("trial", IntegerType()), StructField("model", StringType()),
    StructField("params", StringType()), StructField("score", DoubleType())])


def draw_classifier(rng: random.Random, space: dict = SPACE) -> Classifier:
    """A random model type with random parameters from its ranges."""
    kind = rng.choice(sorted(space))
    params = {}
    for name, domain in space[kind].items():
        if isinstance(domain, list):
            params[name] = rng.choice(domain)
            continue
        low, high, step = domain
        if step is None:
            params[name] = rng.uniform(low, high)
        else:
            drawn = low + step * rng.randint(0, round((high - low) / step))
            params[name] = drawn if isinstance(step, int) else round(drawn, 6)
    return Classifier(kind, kind, params)


def shown_params(params: dict) -> dict:
    """Parameters worth logging, numbers rounded to 3 places."""
    return {k: round(v, 3) if isinstance(v, float) else v
            for k, v in params.items() if k not in SHOWN_PARAMS_EXCLUDE}


def random_search(df: DataFrame, spec: FeatureSpec, trials: int = 10, k: int = 2,
                  seed: int = SEED, space: dict = SPACE, parallelism: int = 1) -> DataFrame:
    """History (trial, model, params, score); score is the mean negative log loss, higher is
    better. Trials are independent; ``parallelism`` of them are submitted at a time."""
    rng = random.Random(seed)
    drawn = [draw_classifier(rng, space) for _ in range(trials)]

    folds = encoded_folds(df, spec, k)
    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(lambda clf: trial_score(clf, folds), drawn))
    rows = [(i, c.kind, json.dumps(shown_params(c.params)), s)
            for i, (c, s) in enumerate(zip(drawn, results))]
    return small_table(df.sparkSession, rows, HISTORY)


# ---- guided search ------------------------------------------------------------------------

#: Trials drawn at random before proposals follow the history, the share of them that counts as
#: good, and the draws among which a proposal is chosen.
FIRST_TRIALS, GOOD_SHARE, DRAWS = 4, 0.25, 24


def _near(value: float, other: float, domain: tuple) -> float:
    """How close two numbers of a range are: a bell over a fifth of the range."""
    width = (domain[1] - domain[0]) / 5 or 1.0
    return math.exp(-0.5 * ((value - other) / width) ** 2)


def _density(value, seen: list, domain) -> float:
    """How often a parameter's value, or one near it, was seen; never 0."""
    if isinstance(domain, list):
        return (1 + sum(value == s for s in seen)) / (len(domain) + len(seen))
    return (0.5 + sum(_near(value, s, domain) for s in seen)) / (1 + len(seen))


def propose(history: list[tuple[Classifier, float]], rng: random.Random,
            space: dict = SPACE) -> Classifier:
    """The next classifier to try, from what was tried and how it scored.

    The best quarter of the history is set against the rest. Of a number of random draws that is
    taken whose model type and parameters are most typical of the good trials and least of the
    others; parameters are compared with trials of their own type only.
    """
    if len(history) < FIRST_TRIALS:
        return draw_classifier(rng, space)
    ranked = sorted(history, key=lambda h: -h[1])
    cut = max(1, math.ceil(GOOD_SHARE * len(ranked)))
    good, rest = [c for c, _ in ranked[:cut]], [c for c, _ in ranked[cut:]]

    def promise(clf: Classifier) -> float:
        kinds = sorted(space)
        out = math.log(_density(clf.kind, [c.kind for c in good], kinds)
                       / _density(clf.kind, [c.kind for c in rest], kinds))
        for name, domain in space[clf.kind].items():
            sides = [[c.params[name] for c in side if c.kind == clf.kind] for side in (good, rest)]
            out += math.log(_density(clf.params[name], sides[0], domain)
                            / _density(clf.params[name], sides[1], domain))
        return out

    tried = {(c.kind, json.dumps(c.params, sort_keys=True)) for c, _ in history}
    draws = [draw_classifier(rng, space) for _ in range(DRAWS)]
    fresh = [c for c in draws if (c.kind, json.dumps(c.params, sort_keys=True)) not in tried]
    return max(fresh or draws, key=promise)


def guided_search(df: DataFrame, spec: FeatureSpec, trials: int = 10, k: int = 2,
                  seed: int = SEED, space: dict = SPACE, done: DataFrame | None = None,
                  keep=None) -> DataFrame:
    """History as of ``random_search``; every trial is proposed from those before it.

    ``done`` is the history of an earlier search with the same seed and space, which goes on behind
    its last trial; ``keep`` is called with the history after every trial, so that a search that is
    cut off loses one trial at most.
    """
    rows = [] if done is None else [tuple(r) for r in done.orderBy("trial").collect()]
    history = [(Classifier(kind, kind, json.loads(params)), score)
               for _, kind, params, score in rows]
    folds = encoded_folds(df, spec, k)
    for trial in range(len(rows), trials):
        clf = propose(history, random.Random(seed * 7919 + trial), space)
        clf = Classifier(clf.kind, clf.kind, shown_params(clf.params))
        score = trial_score(clf, folds)
        history.append((clf, score))
        rows.append((trial, clf.kind, json.dumps(clf.params), score))
        if keep is not None:
            keep(small_table(df.sparkSession, rows, HISTORY))
    return small_table(df.sparkSession, rows, HISTORY)


def best_so_far(history: DataFrame) -> DataFrame:
    """Trials that beat all earlier ones, with the line that was logged for them.

    One row per trial goes through the window, so a few thousand at most.
    """
    earlier = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    better = F.col("best").isNull() | (F.col("score") > F.col("best"))
    return (history.withColumn("best", F.max("score").over(earlier)).filter(better)
            .select("trial", "model", "params", "score",
                    F.format_string("New best: %.5f using %s", "score", "params")
                    .alias("line")))
