"""Labelled sample to model-ready features, one staged table per step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tenderlens.operators import cleaning, features, flatten
from tenderlens.operators.skew import hot_keys
from tenderlens.settings import FeatureSpec
from tenderlens.sources.staging import stage


@dataclass(frozen=True)
class Prepared:
    rolled_up: DataFrame
    flat: DataFrame
    features: DataFrame
    clean: DataFrame
    codes: list[str]
    spec: FeatureSpec


def flat_features(sample: DataFrame, length: int = flatten.PREFIX_LENGTH,
                  codes: list[str] | None = None, first_only: bool = False,
                  hot: dict[str, list] | None = None) -> tuple[DataFrame, list[str]]:
    """One engineered row per contract, and the codes its dummy columns stand for."""
    column = flatten.prefix_column(length)
    hot = hot_keys(sample, ["supID"]) if hot is None else hot
    rolled = flatten.roll_up_codes(sample, length, hot)
    codes = flatten.prefix_codes(rolled, column) if codes is None else codes
    flat = flatten.flatten(rolled, codes, length, first_only, hot)
    return features.engineer(flat, column), codes


def prepare(sample: DataFrame, length: int = flatten.PREFIX_LENGTH,
            codes: list[str] | None = None, first_only: bool = False,
            hot: dict[str, list] | None = None, keep_id: bool = False) -> Prepared:
    """All steps. Steps that are read more than once are staged as tables.

    Suppliers that hold a large share of the sample are looked up unless ``hot`` names them.
    """
    column = flatten.prefix_column(length)
    hot = hot_keys(sample, ["supID"]) if hot is None else hot
    rolled = stage(flatten.roll_up_codes(sample, length, hot), "rolled_up")
    codes = flatten.prefix_codes(rolled, column) if codes is None else codes
    flat = stage(flatten.flatten(rolled, codes, length, first_only, hot), "flat")
    engineered = stage(features.engineer(flat, column), "features")
    cleaned, spec = cleaning.clean(engineered, keep_id=keep_id)
    return Prepared(rolled, flat, engineered, cleaned, codes, spec)
