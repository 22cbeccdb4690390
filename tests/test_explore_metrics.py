"""Exploratory statistics and metrics against values computed by hand or by numpy."""

import math

import numpy as np
import pytest

from tenderlens.operators import explore, metrics


@pytest.fixture(scope="module")
def two_class(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    a = rng.normal(size=300) + y
    b = np.abs(rng.normal(size=300)) * 10
    data = [(float(p), float(q) if i % 10 else None, int(r))
            for i, (p, q, r) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(data, "a double, b double, cntr_result int"), a, b, y


def test_anova_f(two_class):
    df, a, _, y = two_class
    groups = [a[y == k] for k in (0, 1)]
    between = sum(len(g) * (g.mean() - a.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    got = {r.variable: r.score for r in explore.anova_f(df, ["a"]).collect()}
    assert got["a"] == pytest.approx(between / (within / (len(a) - 2)))


def test_chi2_is_the_class_sum_score(two_class):
    df, _, b, y = two_class
    known = np.where(np.arange(300) % 10 == 0, 0, b)
    observed = np.array([known[y == k].sum() for k in (0, 1)])
    expected = np.array([(y == k).mean() for k in (0, 1)]) * known.sum()
    got = explore.chi2_score(df, ["b"]).first().score
    assert got == pytest.approx((((observed - expected) ** 2) / expected).sum())


def test_rating_is_sorted_within_each_criterion(two_class):
    df = two_class[0]
    got = [tuple(r) for r in explore.rate_features(df, ["a", "b"], ["f_classif"]).collect()]
    assert [r[1] for r in got] == ["a", "b"] and got[0][2] > got[1][2]


def test_correlations_skip_missing_pairs(two_class):
    df, a, b, y = two_class
    keep = np.arange(300) % 10 != 0
    got = {(r.variable_a, r.variable_b): r["corr"]
           for r in explore.correlation_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef(a[keep], b[keep])[0, 1])
    assert got["a", "b"] == got["b", "a"] and got["a", "a"] == pytest.approx(1)
    label = {r.variable: r["corr"] for r in explore.correlation_with_label(df, ["a"]).collect()}
    assert label["a"] == pytest.approx(np.corrcoef(a, y)[0, 1])


def test_describe(two_class):
    df, a, _, _ = two_class
    got = {r.variable: r for r in explore.describe(df, ["a", "b"]).collect()}
    assert got["a"]["count"] == 300 and got["b"]["count"] == 270
    assert got["a"].std == pytest.approx(a.std(ddof=1))
    assert [got["a"].p25, got["a"].p50, got["a"].p75] == pytest.approx(
        list(np.percentile(a, [25, 50, 75])))


def test_histogram_counts_every_row_once(two_class):
    df, a, _, _ = two_class
    got = explore.clipped_histogram(df, ["a"]).orderBy("bin").collect()
    low, high = np.percentile(a, [1, 99])
    want, edges = np.histogram(np.clip(a, low, high), bins=10)
    assert [r["count"] for r in got] == list(want[want > 0])
    assert got[0].low == pytest.approx(edges[0]) and got[-1].high == pytest.approx(edges[-1])


def test_constant_column_has_one_bin(table):
    df = table("x double, cntr_result int", [(2.0, 0)] * 5)
    assert [(r.bin, r["count"]) for r in explore.clipped_histogram(df, ["x"]).collect()] == [(0, 5)]


def test_quantile_grid(two_class):
    df, a, _, _ = two_class
    got = {r.p: r for r in explore.quantile_grid(df, ["a"]).collect()}
    assert len(got) == 101
    assert got[0.0].initial == pytest.approx(a.min())
    assert got[0.0].clipped == pytest.approx(np.percentile(a, 1))


def test_frequencies(table, rows):
    df = table("k int, d int, cntr_result int", [(1, 0, 0), (1, 2, 1), (None, 1, 1), (2, 0, 0)])
    assert rows(explore.category_frequency(df, ["k"])) == [
        ("k", None, 1), ("k", "1", 2), ("k", "2", 1)]
    assert rows(explore.dummy_frequency(df, ["d"])) == [("d", 2)]
    assert rows(explore.distinct_counts(df, ["k"])) == [("k", 2)]
    assert rows(explore.missing_share(df, ["k", "d"])) == [("d", 0, 0.0), ("k", 1, 0.25)]
    assert rows(explore.label_by_category(df, "k")) == [
        (None, 1, 0, 1, 1.0, 0.0), (1, 1, 1, 2, 0.5, 0.5), (2, 0, 1, 1, 0.0, 1.0)]


# Ten rows with ties, 0 and 1.
SCORED = [(1, 1.0), (1, 0.9), (0, 0.9), (1, 0.6), (0, 0.5), (1, 0.5), (0, 0.4), (0, 0.2),
          (0, 0.0), (1, 0.2)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(y, p, int(p >= 0.5)) for y, p in SCORED],
                                 "label int, probability double, prediction int")


def test_accuracy_and_loss(scored):
    row = metrics.accuracy_and_loss(scored).first()
    assert row.accuracy == pytest.approx(0.7)
    clipped = [(y, min(max(p, 1e-15), 1 - 1e-15)) for y, p in SCORED]
    assert row.log_loss == pytest.approx(
        -sum(math.log(p if y else 1 - p) for y, p in clipped) / 10)


@pytest.mark.parametrize("slices", [2, 64])
def test_auc_counts_ties_half(scored, slices):
    pos, neg = [p for y, p in SCORED if y], [p for y, p in SCORED if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(scored, slices).first().roc_auc == pytest.approx(want)


def test_auc_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(5000).selectExpr("CAST(id % 7 < 2 AS INT) AS label",
                                      "(id * 37 % 991) / 991D AS probability")
    ml = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label",
                                       numBins=0).evaluate(df)
    assert metrics.roc_auc(df, 16).first().roc_auc == pytest.approx(ml)


def test_one_class_has_no_auc(table):
    df = table("label int, probability double", [(1, 0.5), (1, 0.7)])
    assert metrics.roc_auc(df).first().roc_auc is None


def test_roc_points(scored, rows):
    got = rows(metrics.roc_points(scored))
    assert got[:2] == [(None, 0.0, 0.0), (0.0, 1.0, 1.0)] and got[-1] == (1.0, 0.0, 0.2)
    assert len(got) == len({p for _, p in SCORED}) + 1


def test_confusion_and_report(scored, rows):
    assert rows(metrics.confusion_matrix(scored)) == [
        (0, 0, 3, 0.6), (0, 1, 2, 0.4), (1, 0, 1, 0.2), (1, 1, 4, 0.8)]
    got = dict(rows(metrics.classification_report(scored)))
    assert got == {"precision_0": 0.75, "precision_1": 0.667, "recall_0": 0.6, "recall_1": 0.8,
                   "f_score": 0.727, "accuracy": 0.7}


def test_report_of_a_class_never_predicted(table):
    df = table("label int, probability double, prediction int", [(0, 0.1, 0), (1, 0.2, 0)])
    got = {r.metric: r.value for r in metrics.classification_report(df).collect()}
    assert got["precision_1"] == 0.0 and got["f_score"] == 0.0


def test_bins(scored, rows):
    assert rows(metrics.probability_histogram(scored)) == [
        (0, 1), (2, 2), (4, 1), (5, 2), (6, 1), (9, 3)]
    curve = {r.bin: r for r in metrics.calibration_curve(scored).collect()}
    # A probability on an inner edge belongs to the lower bin.
    assert set(curve) == {0, 1, 3, 4, 5, 8, 9}
    assert curve[8].positive_share == pytest.approx(1 / 2) and curve[9].positive_share == 1.0
    assert rows(metrics.label_by_probability(scored))[-1] == (1.0, 0, 1)


def test_score_summary_uses_population_deviation(table):
    df = table("model string, fold int, fit_time double, test_accuracy double",
               [("m", 0, 1.0, 0.5), ("m", 1, 3.0, 0.9)])
    row = metrics.score_summary(df).first()
    assert (row.time, row.tst_acc, row.tst_acc_std) == (2.0, pytest.approx(0.7),
                                                        pytest.approx(0.2))


def test_sorted_series_counts_every_value(table, rows):
    values = [5.0, 1.0, 1.0, None, float("nan"), 3.0, 100.0]
    df = table("a double, b double", [(v, None) for v in values])
    got = rows(explore.sorted_series(df, ["a", "b"], {"a": (1.0, 5.0), "b": (0.0, 1.0)}))
    assert got == [("a", 1.0, 1.0, 2, 0), ("a", 3.0, 3.0, 1, 2), ("a", 5.0, 5.0, 1, 3),
                   ("a", 100.0, 5.0, 1, 4)]
