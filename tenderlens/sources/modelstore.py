"""Fitted parameters, trained models and search history on shared storage."""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tenderlens.operators.boosting import Boosted
from tenderlens.operators.network import Trained
from tenderlens.operators.training import Classifier, Fitted
from tenderlens.sources.staging import small_table

PARAMS = StructType([
    StructField("part", StringType()), StructField("variable", StringType()),
    StructField("key", StringType()), StructField("value", DoubleType())])
META = StructType([StructField("meta", StringType())])
#: Models that are stored as one line of JSON, the others by Spark ML.
OWN_MODELS = {"Boosting": Boosted, "Network": Trained}


def params_table(spark: SparkSession, encoding: dict) -> DataFrame:
    """Fitted parameters as rows (part, variable, key, value).

    A variable without any code has one row with a NULL key.
    """
    rows: list[tuple] = []
    quantitative = encoding["quantitative"]
    for c, (low, high) in quantitative["percentile"].items():
        rows += [("percentile", c, "low", low), ("percentile", c, "high", high)]
    for c, (mean, std) in quantitative["scale"].items():
        rows += [("scale", c, "mean", mean), ("scale", c, "std", std)]
    for c, codes in encoding["categorical"]["woe"].items():
        rows += [("woe", c, k, v) for k, v in codes.items()] or [("woe", c, None, None)]
    return small_table(spark, rows, PARAMS)


def params_of(table: DataFrame) -> dict:
    """The inverse of ``params_table``; the table is small by construction."""
    quantitative: dict = {"percentile": {}, "scale": {}}
    woe: dict = {}
    for r in table.collect():
        part, c = r["part"], r["variable"]
        if part == "woe":
            codes = woe.setdefault(c, {})
            if r["key"] is not None:
                codes[r["key"]] = r["value"]
        else:
            pair = quantitative[part].setdefault(c, [None, None])
            pair[0 if r["key"] in ("low", "mean") else 1] = r["value"]
    return {"quantitative": quantitative, "categorical": {"woe": woe}}


def save_params(spark: SparkSession, encoding: dict, path: str) -> None:
    params_table(spark, encoding).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> dict:
    return params_of(spark.read.schema(PARAMS).parquet(path))


def save_model(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """Model, encoding and description under one folder."""
    if fitted.clf.kind in OWN_MODELS:
        small_table(spark, [(fitted.model.to_json(),)], META).coalesce(1) \
            .write.mode("overwrite").text(f"{path}/model")
    else:
        fitted.model.write().overwrite().save(f"{path}/model")
    save_params(spark, fitted.encoding, f"{path}/params")
    meta = json.dumps({"kind": fitted.clf.kind, "short_name": fitted.clf.short_name,
                       "params": fitted.clf.params, "names": fitted.names,
                       "fit_time": fitted.fit_time})
    small_table(spark, [(meta,)], META).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Fitted:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["kind"] in OWN_MODELS:
        model = OWN_MODELS[meta["kind"]].from_json(spark.read.text(f"{path}/model").first()[0])
    else:
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return Fitted(Classifier(meta["kind"], meta["short_name"], meta["params"]),
                  load_params(spark, f"{path}/params"), model, meta["names"], meta["fit_time"])


def save_history(history: DataFrame, path: str) -> None:
    """One JSON object per trial."""
    history.coalesce(1).write.mode("overwrite").json(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trial int, model string, params string, score double").json(path)


def append_log(best: DataFrame, path: str) -> None:
    """Best-so-far lines as text."""
    best.select(F.col("line")).coalesce(1).write.mode("append").text(path)
