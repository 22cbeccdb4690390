"""Clean features to compared classifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tenderlens.operators import metrics, training
from tenderlens.operators.splitting import train_valid_split
from tenderlens.settings import FeatureSpec


@dataclass
class Comparison:
    scores: DataFrame
    fitted: list[training.Fitted]
    predictions: dict[str, DataFrame]
    weights: DataFrame

    def report(self) -> DataFrame:
        """(model, metric, value) of the hold-out predictions."""
        return _union([metrics.classification_report(p).selectExpr(f"'{name}' AS model", "*")
                       for name, p in self.predictions.items()])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def compare(df: DataFrame, spec: FeatureSpec, classifiers=training.FINALISTS,
            valid_percent: int = 20) -> Comparison:
    """Hold-out validation of several classifiers on one split. ``df`` has the contract key."""
    train, valid = train_valid_split(df, valid_percent)
    scores, fitted, predictions = [], [], {}
    for clf in classifiers:
        table, model = training.validate(clf, train, valid, spec)
        scores.append(table)
        fitted.append(model)
        predictions[clf.short_name] = model.predictions(valid)
    weighted = [f for f in fitted if f.clf.kind != "Network"]
    weights = training.feature_weights(weighted, df.sparkSession)
    return Comparison(_union(scores), fitted, predictions, weights)
