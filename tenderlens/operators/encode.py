"""Fit / apply pairs for quantitative and categorical features.

Fitting is one or two aggregations; what it returns is small by construction (two limits and two
moments per column, at most 1 / rare_share codes per categorical variable), so parameters are
plain dictionaries that can be stored as JSON and applied to any later data.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tenderlens.functions.scalars import clip, flag, ratio
from tenderlens.operators.running import exact_percentiles
from tenderlens.settings import LABEL, ROW_ID, WINSORISED_SHARES, FeatureSpec
from tenderlens.sources.staging import small_table

RARE_SHARE = 0.005
RARE = "NEW"
LOW, HIGH = 0.01, 0.99


# ---- quantitative -------------------------------------------------------------------------

def quantitative_columns(spec: FeatureSpec,
                         shares: tuple[str, ...] = WINSORISED_SHARES) -> list[str]:
    return [*spec.numeric, *(c for c in shares if c in spec.shares)]


def percentile_limits(df: DataFrame, columns: list[str], low: float = LOW, high: float = HIGH,
                      accuracy: int | None = None) -> DataFrame:
    """(variable, low, high): exact percentile limits per column."""
    extra = {} if accuracy is None else {"accuracy": accuracy}
    found = exact_percentiles(df, columns, [low, high], **extra)
    return found.groupBy("variable").agg(
        F.max(F.when(F.col("p") == low, F.col("value"))).alias("low"),
        F.max(F.when(F.col("p") == high, F.col("value"))).alias("high"))


def approximate_limits(df: DataFrame, columns: list[str], low: float = LOW, high: float = HIGH,
                       accuracy: int = 10_000) -> DataFrame:
    """The same from a mergeable sketch: one pass, rank error of rows / accuracy."""
    sketch = F.array(*(
        F.struct(F.lit(c).alias("variable"),
                 F.percentile_approx(F.col(c).cast("double"), [low, high], accuracy).alias("q"))
        for c in columns))
    return (df.agg(sketch.alias("x")).select(F.explode("x").alias("x"))
            .select("x.variable", F.col("x.q")[0].alias("low"), F.col("x.q")[1].alias("high")))


def winsorised(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c).cast("double"), float(lo), float(hi))
                           for c, (lo, hi) in limits.items()})


def outlier_flags(df: DataFrame, limits: dict[str, tuple[float, float]],
                  compat: bool = False) -> DataFrame:
    """``<column>_out``: 1 outside the limits.

    ``compat`` flags val < high or val > low, which holds for nearly every row.
    """
    def outside(c: str, lo: float, hi: float) -> Column:
        v = F.col(c)
        return (v < hi) | (v > lo) if compat else (v < lo) | (v > hi)

    return df.withColumns({f"{c}_out": flag(outside(c, float(lo), float(hi)))
                           for c, (lo, hi) in limits.items()})


def fit_limits(df: DataFrame, columns: list[str], exact: bool = True,
               accuracy: int | None = None) -> dict[str, tuple[float, float]]:
    found = (percentile_limits(df, columns, accuracy=accuracy) if exact
             else approximate_limits(df, columns))
    return {r["variable"]: (r["low"], r["high"]) for r in found.collect()}


def fit_quantitative(df: DataFrame, spec: FeatureSpec,
                     shares: tuple[str, ...] = WINSORISED_SHARES, exact: bool = True) -> dict:
    """Percentile limits of numeric and selected share columns; mean and population standard
    deviation of the winsorised numeric columns."""
    limits = fit_limits(df, quantitative_columns(spec, shares), exact)
    bounded = winsorised(df, {c: limits[c] for c in spec.numeric if c in limits})
    moments = bounded.agg(*(F.avg(c).alias(f"{c}_mean") for c in spec.numeric),
                          *(F.stddev_pop(c).alias(f"{c}_std") for c in spec.numeric)).first()
    return {
        "percentile": {c: list(v) for c, v in limits.items()},
        "scale": {c: [moments[f"{c}_mean"], moments[f"{c}_std"]] for c in spec.numeric
                  if c in limits},
    }


def standardised(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """(value - mean) / population standard deviation; a constant column is only centred."""
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(float(mean))) / F.lit(float(std) or 1.0)
        for c, (mean, std) in scale.items()})


def apply_quantitative(df: DataFrame, params: dict, compat: bool = False) -> DataFrame:
    """Outlier flags, winsorising and standardising with fitted parameters."""
    limits = params["percentile"]
    df = winsorised(outlier_flags(df, limits, compat), limits)
    return standardised(df, params["scale"])


# ---- categorical --------------------------------------------------------------------------

def category_counts(df: DataFrame, columns, label: str = LABEL) -> DataFrame:
    """(variable, category, n, good, bad) in one pass over all columns; categories as text."""
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category"))
        for c in columns)))
    return (df.select(label, pairs.alias("x")).select(label, "x.*")
            .groupBy("variable", "category")
            .agg(F.count("*").alias("n"),
                 F.count(F.when(F.col(label) == 0, 1)).alias("good"),
                 F.count(F.when(F.col(label) == 1, 1)).alias("bad")))


def group_rare(counts: DataFrame, rare_share: float = RARE_SHARE) -> DataFrame:
    """Categories at or below ``rare_share`` of the rows become one category; adds totals.

    At most 1 / rare_share categories per variable are above it, so the result is small however
    many categories there are.
    """
    # One row per variable.
    totals = counts.groupBy("variable").agg(
        F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    rare = F.col("n") / F.col("all_n") <= rare_share
    return (counts.filter("category is not null").join(F.broadcast(totals), "variable")
            .withColumn("category", F.when(rare, RARE).otherwise(F.col("category")))
            .groupBy("variable", "category", "all_n", "all_good", "all_bad")
            .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")))


def grouped_categories(df: DataFrame, columns, rare_share: float = RARE_SHARE) -> DataFrame:
    """``df`` with rare categories replaced; every column becomes text.

    Kept categories come to the driver: at most 1 / rare_share per column.
    """
    kept = _kept(group_rare(category_counts(df, columns), rare_share))
    return df.withColumns({
        c: F.when(F.col(c).isNull() | F.col(c).cast("string").isin(*kept.get(c, [])),
                  F.col(c).cast("string")).otherwise(RARE) for c in columns})


def _kept(grouped: DataFrame) -> dict[str, list[str]]:
    kept: dict[str, list[str]] = {}
    for r in grouped.select("variable", "category").collect():
        if r["category"] != RARE:
            kept.setdefault(r["variable"], []).append(r["category"])
    return kept


def woe_table(df: DataFrame, columns, label: str = LABEL, rare_share: float = RARE_SHARE,
              smoothing: float = 0.0) -> DataFrame:
    """(variable, category, n, good, bad, woe): ln of good share over bad share, 3 places.

    NULL where a class is empty, unless ``smoothing`` is added to every count.
    """
    grouped = group_rare(category_counts(df, columns, label), rare_share)
    p = ratio(F.col("good") + smoothing, F.col("all_good"))
    q = ratio(F.col("bad") + smoothing, F.col("all_bad"))
    odds = F.try_divide(p, q)
    return grouped.select("variable", "category", "n", "good", "bad",
                          F.bround(F.ln(F.when(odds > 0, odds)), 3).alias("woe"))


def fit_categorical(df: DataFrame, spec: FeatureSpec, label: str = LABEL,
                    rare_share: float = RARE_SHARE, smoothing: float = 0.0) -> dict:
    """{'woe': {variable: {category: code}}}, at most 1 / rare_share + 1 codes per variable."""
    woe: dict[str, dict[str, float]] = {c: {} for c in spec.categorical}
    if not spec.categorical:
        return {"woe": woe}
    for r in woe_table(df, spec.categorical, label, rare_share, smoothing).collect():
        if r["woe"] is not None:
            woe[r["variable"]][r["category"]] = r["woe"]
    return {"woe": woe}


def apply_categorical(df: DataFrame, params: dict) -> DataFrame:
    """Categories replaced by their weight of evidence.

    Rare, unseen and missing categories get the code of the rare group, or 0 without one.
    """
    order = df.columns
    for c, codes in params["woe"].items():
        schema = StructType([StructField("_category", StringType()),
                             StructField("_woe", DoubleType())])
        # Bounded by the rare share at fit time.
        lookup = F.broadcast(small_table(df.sparkSession, list(codes.items()), schema))
        df = (df.join(lookup, F.col(c).cast("string") == F.col("_category"), "left")
              .withColumn(c, F.coalesce("_woe", F.lit(float(codes.get(RARE, 0.0)))))
              .drop("_category", "_woe"))
    return df.select(*(F.col(f"`{c}`") for c in order))


# ---- both ---------------------------------------------------------------------------------

def fit(df: DataFrame, spec: FeatureSpec, shares: tuple[str, ...] = WINSORISED_SHARES,
        exact: bool = True) -> dict:
    return {"quantitative": fit_quantitative(df, spec, shares, exact),
            "categorical": fit_categorical(df, spec)}


def transform(df: DataFrame, params: dict, compat: bool = False) -> DataFrame:
    return apply_categorical(apply_quantitative(df, params["quantitative"], compat),
                             params["categorical"])


def feature_names(df: DataFrame, label: str = LABEL) -> list[str]:
    return [c for c in df.columns if c not in (label, ROW_ID)]


def vectors(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Adds ``features``; missing numbers are 0, the mean of a standardised column.

    Feature names travel in the metadata of the vector column.
    """
    names = feature_names(df, label)
    return VectorAssembler(inputCols=names, outputCol="features").transform(
        df.fillna(0, subset=names))
