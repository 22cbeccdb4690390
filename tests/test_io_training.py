"""Files, tables, stored parameters, models and search."""

import random

import pytest

from tenderlens.operators import encode, metrics, training
from tenderlens.plans import experiments, preparation
from tenderlens.plans.statistics import refresh_tables
from tenderlens.operators.facts import Facts
from tenderlens.settings import INIT_DATE
from tenderlens.sources import flatfiles, modelstore, staging, warehouse as wh_mod
from tenderlens.sources.schemas import DERIVED, SOURCE

FOLDER = "/root/testdata/sf0.001"


def test_headerless_csv_with_borrowed_header(spark, tmp_path, rows):
    (tmp_path / "header.csv").write_text("cntrID;okpd\n9;9\n")
    (tmp_path / "data.csv").write_text("1;10.11;5;6\n2;20.11;;7\n")
    got = flatfiles.read_borrowed_header(spark, str(tmp_path / "data.csv"),
                                         str(tmp_path / "header.csv"))
    assert got.columns == ["cntrID", "okpd", "org_ter", "sup_ter"]
    assert rows(got) == [("1", "10.11", "5", "6"), ("2", "20.11", None, "7")]
    typed = flatfiles.read_headerless(spark, str(tmp_path / "data.csv"), got.columns,
                                      DERIVED["sample"])
    assert typed.schema["cntrID"].dataType.simpleString() == "bigint"


def test_csv_round_trip(spark, tmp_path, table, rows):
    df = table("a int, b string", [(1, "x,y"), (2, None)])
    flatfiles.write_csv(df, str(tmp_path / "out"))
    assert rows(flatfiles.read_headed(spark, str(tmp_path / "out"))) == rows(df)
    assert rows(flatfiles.read_headed(spark, str(tmp_path / "out"), df.schema)) == rows(df)
    flatfiles.write_parquet(df, str(tmp_path / "pq"), ["a"])
    (count, width), head = flatfiles.overview(spark.read.parquet(str(tmp_path / "pq")), 1)
    assert (count, width, head.count()) == (2, 2, 1)


def test_stage_reads_back_what_was_written(spark, table, rows):
    df = table("a int, b double", [(1, 0.5), (2, None)])
    assert rows(staging.stage(df, "test")) == rows(df)


def test_no_machine_local_stage_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError):
        staging.shared_folder(Session())


@pytest.mark.parametrize("folder", ["/mnt/shared", "file:///mnt/shared", "hdfs:///shared"])
def test_stage_folder_of_a_cluster_is_taken_as_set(folder):
    hadoop = type("H", (), {"get": lambda self, key, default=None: default})
    java = type("J", (), {"hadoopConfiguration": lambda self: hadoop()})

    class Session:
        conf = type("Conf", (), {"get": lambda self, key, default=None: f"{folder}/"})()
        sparkContext = type("C", (), {"master": "local-cluster[3,4,10240]", "_jsc": java()})()

    assert staging.shared_folder(Session()) == folder


def test_warehouse_folders_and_tables(spark, tmp_path, warehouse):
    made = warehouse(contracts=[(1, 3, 20170101, None, 1, "1")])
    for name in SOURCE:
        getattr(made, name).write.parquet(str(tmp_path / name))
    read = wh_mod.read_parquet(spark, str(tmp_path))
    assert read.contracts.count() == 1 and read.value.count() == 0
    for name in SOURCE:
        getattr(made, name).createOrReplaceTempView(f"t_{name}")
    tables = wh_mod.read_tables(spark, {name: f"t_{name}" for name in SOURCE})
    assert tables.contracts.first().RefStage == 3


def test_statistics_tables_are_created_and_loaded_once(spark, warehouse, settings):
    spark.sql("CREATE DATABASE IF NOT EXISTS stats_test")
    try:
        wh = warehouse(contracts=[(1, 3, INIT_DATE + 1, None, 1, "1")],
                       value=[(1, 1, 7, 9, 5, 5, 1)], suppliers=[(7, None)], org=[(9, 1, None)])
        f = Facts(wh, settings)
        refresh_tables(spark, f, "stats_test")
        refresh_tables(spark, f, "stats_test")
        assert spark.table("stats_test.sup_stats").count() == 1
        staging.add_columns(spark, "stats_test.sup_stats", {"sup_fed_ter": "INT"})
        staging.add_columns(spark, "stats_test.sup_stats", {"sup_fed_ter": "INT"})
        assert spark.table("stats_test.sup_stats").first().sup_fed_ter is None
        assert spark.table("stats_test.sample").columns == DERIVED["sample"].fieldNames()
    finally:
        spark.sql("DROP DATABASE stats_test CASCADE")


@pytest.fixture(scope="module")
def prepared(spark):
    from catalog.stages import stages

    s = stages(spark, FOLDER)
    return s.clean, s.prepared.spec


def test_params_round_trip(spark, tmp_path, prepared):
    df, spec = prepared
    params = encode.fit(df, spec)
    params["categorical"]["woe"]["nothing"] = {}
    modelstore.save_params(spark, params, str(tmp_path / "p"))
    assert modelstore.load_params(spark, str(tmp_path / "p")) == params


def test_model_round_trip_gives_equal_scores(spark, tmp_path, prepared, rows):
    df, spec = prepared
    clf = training.Classifier("RandForest", "rf", {"n_estimators": 5, "max_depth": 3})
    fitted = training.fit_classifier(clf, df, spec)
    modelstore.save_model(spark, fitted, str(tmp_path / "m"))
    again = modelstore.load_model(spark, str(tmp_path / "m"))
    assert again.clf == clf and again.names == fitted.names
    assert rows(again.predictions(df)) == rows(fitted.predictions(df))


@pytest.mark.parametrize("clf", [
    training.Classifier("LogReg", "l1", {"C": 1, "penalty": "l1", "max_iter": 20}),
    training.Classifier("LogReg", "l2", {"C": 1, "penalty": "l2", "max_iter": 20}),
    training.Classifier("RandForest", "rf", {"n_estimators": 10, "max_depth": 4,
                                             "max_features": 40, "criterion": "entropy"}),
    training.Classifier("Boosting", "gb", {"n_estimators": 5, "max_depth": 3, "gamma": 0.7}),
    training.Classifier("Network", "nn", {"hidden": [10], "epochs": 40}),
], ids=lambda c: c.short_name)
def test_models_beat_the_prior(prepared, clf):
    df, spec = prepared
    fitted = training.fit_classifier(clf, df, spec)
    got = metrics.accuracy_and_loss(fitted.predictions(df)).first().log_loss
    p = df.groupBy().avg("cntr_result").first()[0]
    prior = -(p * __import__("math").log(p) + (1 - p) * __import__("math").log(1 - p))
    assert got < prior


def test_unknown_model_type_is_an_error():
    with pytest.raises(ValueError):
        training.estimator(training.Classifier("Oracle", "x"), 1, 1)


def test_cross_validation_predicts_every_row_once(prepared):
    df, spec = prepared
    clf = training.Classifier("RandForest", "rf", {"n_estimators": 3, "max_depth": 3})
    scores, held_out = training.cross_validate(clf, df, spec, 2)
    assert scores.count() == 2 and held_out.count() == df.count()
    assert held_out.select("cntrID").distinct().count() == df.count()
    assert {"fit_time", "train_accuracy", "test_roc_auc", "test_neg_log_loss"} <= set(scores.columns)
    assert metrics.score_summary(scores).count() == 1


def test_comparison_ranks_features(prepared):
    df, spec = prepared
    clfs = [training.Classifier("LogReg", "lr", {"max_iter": 10}),
            training.Classifier("RandForest", "rf", {"n_estimators": 3, "max_depth": 3})]
    got = experiments.compare(df, spec, clfs)
    assert got.scores.count() == 2 and got.report().count() == 12
    weights = got.weights.filter("model = 'lr'").orderBy("rank").collect()
    assert [abs(r.weight) for r in weights] == sorted((abs(r.weight) for r in weights), reverse=True)
    assert {r.variable for r in weights} == set(got.fitted[0].names)
    wide = training.weights_by_model(got.weights, ["lr", "rf"])
    assert wide.columns == ["rank", "lr", "rf"] and wide.count() == len(weights)


def test_search_history(spark, tmp_path, prepared):
    df, spec = prepared
    space = {"RandForest": {"max_depth": (1, 3, 1), "n_estimators": [2],
                            "max_features": ["sqrt"], "criterion": ["gini"]}}
    history = training.random_search(df, spec, trials=2, k=2, space=space, parallelism=2)
    assert history.count() == 2
    modelstore.save_history(history, str(tmp_path / "h"))
    assert sorted(map(tuple, modelstore.load_history(spark, str(tmp_path / "h")).collect())) \
        == sorted(map(tuple, history.collect()))


def test_trials_score_as_cross_validation(prepared):
    df, spec = prepared
    clf = training.Classifier("LogReg", "lr", {"C": 1, "penalty": "l2", "max_iter": 10})
    scores, _ = training.cross_validate(clf, df, spec, 2, ("neg_log_loss",))
    assert training.trial_score(clf, training.encoded_folds(df, spec, 2)) == pytest.approx(
        scores.agg({"test_neg_log_loss": "avg"}).first()[0], rel=1e-6)


def searched(seed, trials=60):
    """Scores of a search whose best place is a boosting of depth 6 and eta near 0.3."""
    def score(clf):
        if clf.kind != "Boosting":
            return -2.0
        return -abs(clf.params["eta"] - 0.3) * 2 - abs(clf.params["max_depth"] - 6) / 10
    history = []
    for t in range(trials):
        clf = training.propose(history, random.Random(seed * 7919 + t))
        history.append((clf, score(clf)))
    return [s for _, s in history]


def test_proposals_follow_the_history():
    """Later proposals are better than random ones, and the model type that is best is found."""
    for seed in range(5):
        guided = searched(seed)
        assert sum(guided[-20:]) / 20 > sum(guided[:20]) / 20
        assert sum(s > -2 for s in guided[-20:]) >= 15
        assert max(guided) > -0.2
    assert searched(1, 12) == searched(1, 12)


def test_guided_search_goes_on(prepared, monkeypatch):
    df, spec = prepared
    space = {"LogReg": {"C": (0.1, 2.0, None), "penalty": ["l1", "l2"], "max_iter": [5]}}
    kept = []
    whole = training.guided_search(df, spec, trials=3, space=space, keep=kept.append)
    assert [h.count() for h in kept] == [1, 2, 3]
    again = training.guided_search(df, spec, trials=3, space=space, done=kept[0])
    key = lambda h: [(r.trial, r.model, r.params) for r in h.orderBy("trial").collect()]
    assert key(again) == key(whole) and key(kept[-1]) == key(whole)


def test_best_so_far_logs_improvements_only(spark, tmp_path, table):
    history = table("trial int, model string, params string, score double",
                    [(0, "a", "{}", -0.5), (1, "b", "{}", -0.6), (2, "c", "{}", -0.3)])
    best = training.best_so_far(history)
    assert [(r.trial, r.line) for r in best.orderBy("trial").collect()] == [
        (0, "New best: -0.50000 using {}"), (2, "New best: -0.30000 using {}")]
    modelstore.append_log(best, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_drawn_parameters_stay_in_range():
    rng = random.Random(0)
    for _ in range(200):
        clf = training.draw_classifier(rng)
        for name, domain in training.SPACE[clf.kind].items():
            value = clf.params[name]
            assert value in domain if isinstance(domain, list) else domain[0] <= value <= domain[1]
    assert training.shown_params({"eta": 0.123456, "n_jobs": -1}) == {"eta": 0.123}
    for params in ({"max_depth": 31}, {"max_features": 12}):
        with pytest.raises(ValueError):
            training.estimator(training.Classifier("RandForest", "x", params), 100, 11)


def test_preparation_end_to_end(spark):
    from catalog.stages import stages

    s = stages(spark, FOLDER)
    lazy, codes = preparation.flat_features(s.sample)
    assert codes == s.prepared.codes
    assert lazy.columns == s.prepared.features.columns
    assert lazy.columns[0] == "cntrID" and lazy.columns[-1] == "cntr_result"
    assert lazy.count() == s.prepared.features.count() == s.sample.select("cntrID").distinct().count()
