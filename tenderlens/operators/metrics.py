"""Metrics of a prediction table (row id, label, probability, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.functions.scalars import ratio
from tenderlens.operators.running import totals_before

EPSILON = 1e-15
LABEL, PROBABILITY, PREDICTION = "label", "probability", "prediction"


def accuracy() -> Column:
    hit = (F.col(LABEL) == F.col(PREDICTION)).cast("double")
    return F.avg(hit).alias("accuracy")


def log_loss(epsilon: float = EPSILON) -> Column:
    p = F.least(F.greatest(F.col(PROBABILITY), F.lit(epsilon)), F.lit(1 - epsilon))
    term = F.when(F.col(LABEL) == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return (-F.avg(term)).alias("log_loss")


def accuracy_and_loss(predictions: DataFrame) -> DataFrame:
    """One row: accuracy and log loss."""
    return predictions.agg(accuracy(), log_loss())


def score_groups(predictions: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per distinct probability with its class counts and the counts above it."""
    groups = predictions.groupBy((-F.col(PROBABILITY)).alias("order")).agg(
        F.count(F.when(F.col(LABEL) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(LABEL) == 0, 1)).alias("neg"))
    return totals_before(groups, "order", ["pos", "neg"], ranges)


def roc_auc(predictions: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row: exact area under the ROC curve, ties counted half."""
    groups = score_groups(predictions, ranges)
    wins = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return groups.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def roc_points(predictions: DataFrame, ranges: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr): the start (0, 0) without threshold, then one row per distinct
    probability. The groups are staged, so the class totals need no second look at the input."""
    groups = score_groups(predictions, ranges)
    classes = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = groups.select(
        (-F.col("order")).alias("threshold"),
        ratio(F.col("neg_before") + F.col("neg"), classes.select("n").scalar()).alias("fpr"),
        ratio(F.col("pos_before") + F.col("pos"), classes.select("p").scalar()).alias("tpr"))
    start = classes.selectExpr("cast(null as double) threshold", "0D fpr", "0D tpr")
    return start.unionByName(points)


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """(label, prediction, count, share of the label's rows)"""
    counts = predictions.groupBy(LABEL, PREDICTION).agg(F.count("*").alias("count"))
    per_label = counts.groupBy(LABEL).agg(F.sum("count").alias("n"))
    return counts.join(per_label, LABEL).select(
        LABEL, PREDICTION, "count", ratio("count", "n").alias("share"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """(metric, value) rounded to 3 places; a ratio with an empty denominator is 0."""
    def n(label: int | None, predicted: int | None) -> Column:
        test = F.lit(True)
        if label is not None:
            test = test & (F.col(LABEL) == label)
        if predicted is not None:
            test = test & (F.col(PREDICTION) == predicted)
        return F.count(F.when(test, 1))

    values = {
        "precision_0": ratio(n(0, 0), n(None, 0)),
        "precision_1": ratio(n(1, 1), n(None, 1)),
        "recall_0": ratio(n(0, 0), n(0, None)),
        "recall_1": ratio(n(1, 1), n(1, None)),
        "f_score": ratio(2 * n(1, 1), n(1, None) + n(None, 1)),
        "accuracy": ratio(n(0, 0) + n(1, 1), n(None, None)),
    }
    cells = F.array(*(
        F.struct(F.lit(k).alias("metric"),
                 F.round(F.coalesce(v, F.lit(0.0)), 3).alias("value"))
        for k, v in values.items()))
    return predictions.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def _bin(bins: int) -> Column:
    return (F.least(F.width_bucket(PROBABILITY, F.lit(0.0), F.lit(1.0), F.lit(bins)),
                    F.lit(bins)) - 1).cast("int")


def calibration_curve(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, mean probability, share of positives); empty bins have no row. A probability on an
    inner edge belongs to the lower bin, unlike in the histogram."""
    lower = sum(((F.col(PROBABILITY) > i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    return predictions.groupBy(lower.alias("bin")).agg(
        F.avg(PROBABILITY).alias("mean_probability"),
        F.avg(F.col(LABEL).cast("double")).alias("positive_share"))


def probability_histogram(predictions: DataFrame, bins: int = 10) -> DataFrame:
    return predictions.groupBy(_bin(bins).alias("bin")).agg(F.count("*").alias("count"))


def label_by_probability(predictions: DataFrame) -> DataFrame:
    """Good and bad rows by probability rounded to 2 places."""
    return predictions.groupBy(F.bround(PROBABILITY, 2).alias("proba")).agg(
        F.count(F.when(F.col(LABEL) == 0, 1)).alias("good"),
        F.count(F.when(F.col(LABEL) == 1, 1)).alias("bad"))


def predictions_of(scored: DataFrame, label: str, row_id: str | None = None) -> DataFrame:
    """Truth, positive-class probability and prediction of a scored table, side by side."""
    from pyspark.ml.functions import vector_to_array

    keys = [F.col(row_id)] if row_id else []
    return scored.select(
        *keys, F.col(label).cast("int").alias(LABEL),
        vector_to_array("probability")[1].alias(PROBABILITY),
        F.col("prediction").cast("int").alias(PREDICTION))


def score(predictions: DataFrame, scoring: tuple[str, ...]) -> dict[str, float]:
    """The asked metrics as numbers; log loss negated so that more is better."""
    out: dict[str, float] = {}
    if "accuracy" in scoring or "neg_log_loss" in scoring:
        row = accuracy_and_loss(predictions).first()
        out["accuracy"], out["neg_log_loss"] = row["accuracy"], -row["log_loss"]
    if "roc_auc" in scoring:
        out["roc_auc"] = roc_auc(predictions).first()["roc_auc"]
    return {m: out[m] for m in scoring}


def score_summary(scores: DataFrame) -> DataFrame:
    """Per model: mean fit time, and mean and population deviation of each fold score.

    ``scores`` has one row per (model, fold): fit_time and any of {train,test}_{accuracy,
    roc_auc,neg_log_loss}.
    """
    short = {"accuracy": "acc", "roc_auc": "auc", "neg_log_loss": "ll"}
    measures = [F.avg("fit_time").alias("time")]
    for part, p in (("test", "tst"), ("train", "tr")):
        for metric, m in short.items():
            if f"{part}_{metric}" in scores.columns:
                measures += [F.avg(f"{part}_{metric}").alias(f"{p}_{m}"),
                             F.stddev_pop(f"{part}_{metric}").alias(f"{p}_{m}_std")]
    return scores.groupBy("model").agg(*measures)
