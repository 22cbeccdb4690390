"""Cleaning that follows from the exploratory analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenderlens.functions.scalars import clip, log_floor_one, ratio
from tenderlens.settings import COLLINEAR, ROW_ID, USELESS, FeatureSpec

UNDEFINED = -1
MODE_COLUMNS = ("purch_type", "cntr_lvl", "org_ter")


def fit_modes(df: DataFrame, columns: tuple[str, ...] = MODE_COLUMNS,
              compat: bool = False) -> dict[str, int]:
    """Most frequent known value per column, the smallest on ties.

    One value per column reaches the driver. ``compat`` lets the undefined marker -1 win, too.
    """
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("long").alias("value"))
        for c in columns)))
    counts = (df.select(pairs.alias("x")).select("x.*").filter("value is not null")
              .groupBy("variable", "value").agg(F.count("*").alias("n")))
    if not compat:
        counts = counts.filter(F.col("value") != UNDEFINED)
    modes = counts.groupBy("variable").agg(
        F.max_by("value", F.struct("n", -F.col("value"))).alias("mode"))
    return {r["variable"]: r["mode"] for r in modes.collect()}


def impute_modes(df: DataFrame, modes: dict[str, int]) -> DataFrame:
    """-1 in purchase type and level, and a missing customer territory, become the mode."""
    out = {}
    for c in ("purch_type", "cntr_lvl"):
        if c in modes:
            out[c] = F.when(F.col(c) == UNDEFINED, F.lit(modes[c])).otherwise(F.col(c))
    if "org_ter" in modes:
        out["org_ter"] = F.coalesce(F.col("org_ter"), F.lit(modes["org_ter"]))
    return df.withColumns({c: e.cast(df.schema[c].dataType) for c, e in out.items()})


def impute_constant(df: DataFrame, column: str = "sup_ter", value: int = 1) -> DataFrame:
    return df.fillna({column: value})


def drop_useless(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, FeatureSpec]:
    return df.drop(*USELESS, ROW_ID), spec.without(USELESS)


def drop_collinear(df: DataFrame, spec: FeatureSpec,
                   columns: tuple[str, ...] = COLLINEAR) -> tuple[DataFrame, FeatureSpec]:
    return df.drop(*columns), spec.without(columns)


def drop_zero_price(df: DataFrame) -> DataFrame:
    """Drops rows of price 0; a missing price stays."""
    return df.filter(~F.col("price").eqNullSafe(0))


def fix_day_price(df: DataFrame) -> DataFrame:
    """Planned length of at least one day, and the price per day that follows from it."""
    df = drop_zero_price(df)
    df = df.withColumn("plan_cntr_len", clip("plan_cntr_len", low=1))
    return df.withColumn("day_price", ratio("price", "plan_cntr_len"))


def log_transform(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: log_floor_one(c) for c in columns})


def clean(df: DataFrame, modes: dict[str, int] | None = None,
          keep_id: bool = False) -> tuple[DataFrame, FeatureSpec]:
    """Impute, drop, fix and log-transform; returns the data and its variable groups.

    ``keep_id`` retains the contract key, which splits and folds are drawn from.
    """
    spec = FeatureSpec.of(df.columns)
    modes = fit_modes(df) if modes is None else modes
    out = impute_modes(df, modes)
    spec = spec.without(USELESS)
    out = fix_day_price(out.drop(*USELESS))
    out, spec = drop_collinear(out, spec)
    out = log_transform(out, spec.numeric)
    return (out if keep_id else out.drop(ROW_ID)), spec
