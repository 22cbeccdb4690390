"""Exploratory statistics, as long tables with one row per variable (and criterion)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tenderlens.functions.scalars import clip, ratio
from tenderlens.operators.encode import category_counts, fit_limits, group_rare
from tenderlens.operators.running import exact_percentiles, totals_before
from tenderlens.settings import LABEL

# Pairs of columns correlated in one aggregation; keeps generated code within JVM limits.
PAIRS_PER_PASS = 120


def _long(df: DataFrame, columns, *keep: str) -> DataFrame:
    """(keep..., variable, value): one row per column and row."""
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns)))
    return df.select(*keep, pairs.alias("x")).select(*keep, "x.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample standard deviation, extremes and exact quartiles."""
    moments = _long(df, columns).groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75]).groupBy("variable").agg(*(
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))))
    return moments.join(quartiles, "variable", "left").select(
        "variable", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable_a, variable_b, corr) for all ordered pairs; each pair skips its own NULLs.

    One pass per chunk of unordered pairs; the mirror image is added afterwards.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        cells = F.array(*(
            F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"),
                     F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double"))
                     .alias("corr"))
            for a, b in pairs[start:start + PAIRS_PER_PASS]))
        parts.append(df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    upper = parts[0]
    for part in parts[1:]:
        upper = upper.unionByName(part)
    sides = F.array(F.struct(F.col("variable_a").alias("a"), F.col("variable_b").alias("b")),
                    F.struct(F.col("variable_b").alias("a"), F.col("variable_a").alias("b")))
    mirrored = F.when(F.col("variable_a") == F.col("variable_b"), F.slice(sides, 1, 1))
    return (upper.withColumn("s", F.explode(mirrored.otherwise(sides)))
            .select(F.col("s.a").alias("variable_a"), F.col("s.b").alias("variable_b"), "corr"))


def correlation_with_label(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """(variable, corr)"""
    cells = F.array(*(
        F.struct(F.lit(c).alias("variable"),
                 F.corr(F.col(f"`{c}`").cast("double"), F.col(label).cast("double"))
                 .alias("corr")) for c in columns))
    return df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def anova_f(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """(variable, score): one-way ANOVA F of each feature between the classes.

    Per class only count, mean and variance are needed, so one grouped pass suffices. Rows
    without a value are left out.
    """
    classes = _long(df, columns, label).filter("value is not null").groupBy(
        "variable", label).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    # One row per variable.
    totals = classes.groupBy("variable").agg(
        F.sum("n").alias("all_n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    gap = F.col("mean") - F.col("all_mean")
    sums = classes.join(F.broadcast(totals), "variable").groupBy("variable", "all_n").agg(
        F.count("*").alias("k"), F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"))
    score = F.try_divide(F.try_divide(F.col("between"), F.col("k") - 1),
                         F.try_divide(F.col("within"), F.col("all_n") - F.col("k")))
    return sums.select("variable", score.alias("score"))


def chi2_score(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """(variable, score): class sums of a non-negative feature against their expectation.

    The expected sum of a class is its share of the rows times the total of the feature.
    """
    per_class = _long(df, columns, label).groupBy("variable", label).agg(
        F.count("*").alias("n"), F.sum("value").alias("observed"))
    totals = per_class.groupBy("variable").agg(
        F.sum("n").alias("all_n"), F.sum("observed").alias("total"))
    # One row per variable.
    expected = F.col("n") / F.col("all_n") * F.col("total")
    gap = F.col("observed") - F.col("expected")
    return (per_class.join(F.broadcast(totals), "variable")
            .withColumn("expected", expected).groupBy("variable")
            .agg(F.sum(F.try_divide(gap * gap, F.col("expected"))).alias("score")))


CRITERIA = {"f_classif": anova_f, "chi2": chi2_score}


def rate_features(df: DataFrame, columns: list[str], criteria: list[str],
                  label: str = LABEL) -> DataFrame:
    """(criterion, variable, score), best first within each criterion."""
    parts = [CRITERIA[c](df, columns, label).select(F.lit(c).alias("criterion"), "variable",
                                                    "score") for c in criteria]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("criterion", F.desc("score"), "variable")


def information_value(df: DataFrame, columns, label: str = LABEL,
                      at_least: float | None = None) -> DataFrame:
    """(variable, iv): sum over grouped categories of (p - q) ln(p / q).

    Categories without one of the classes have no finite term and are skipped.
    """
    grouped = group_rare(category_counts(df, columns, label))
    p = F.col("good") / F.col("all_good")
    q = F.col("bad") / F.col("all_bad")
    term = F.when((F.col("good") > 0) & (F.col("bad") > 0), (p - q) * F.ln(p / q))
    out = grouped.groupBy("variable").agg(F.sum(term).alias("iv"))
    return out if at_least is None else out.filter(F.col("iv") >= at_least)


def label_by_category(df: DataFrame, column: str, label: str = LABEL) -> DataFrame:
    """Bad, good and total rows per category, and their shares."""
    counts = df.groupBy(column).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("bad"), F.count("*").alias("total"))
    return counts.select(
        column, "bad", (F.col("total") - F.col("bad")).alias("good"), "total",
        ratio("bad", "total").alias("bad_share"),
        ratio(F.col("total") - F.col("bad"), "total").alias("good_share"))


def clipped_histogram(df: DataFrame, columns: list[str], bins: int = 10,
                      limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(variable, bin, low, high, count): equal-width bins between the 1st and 99th percentile.

    Values beyond the limits count in the edge bins; a constant column has a single bin.
    """
    limits = fit_limits(df, columns) if limits is None else limits
    cells = F.array(*(
        F.struct(F.lit(c).alias("variable"), F.lit(float(lo)).alias("low"),
                 F.lit(float(hi)).alias("high"),
                 clip(F.col(f"`{c}`").cast("double"), float(lo), float(hi)).alias("value"))
        for c, (lo, hi) in limits.items()))
    width = (F.col("high") - F.col("low")) / bins
    position = F.when(width > 0, F.least(
        F.floor(F.try_divide(F.col("value") - F.col("low"), width)), F.lit(bins - 1)))
    return (df.select(F.explode(cells).alias("x")).select("x.*").filter("value is not null")
            .withColumn("bin", F.coalesce(position, F.lit(0)).cast("int"))
            .groupBy("variable", "bin", "low", "high").agg(F.count("*").alias("count"))
            .select("variable", "bin", (F.col("low") + F.col("bin") * width).alias("low"),
                    (F.col("low") + (F.col("bin") + 1) * width).alias("high"), "count"))


def quantile_grid(df: DataFrame, columns: list[str], steps: int = 100, low: float = 0.01,
                  high: float = 0.99) -> DataFrame:
    """(variable, p, initial, clipped): sorted values before and after clipping, on a grid."""
    grid = sorted({i / steps for i in range(steps + 1)} | {low, high})
    values = exact_percentiles(df, columns, grid)
    limits = values.groupBy("variable").agg(
        F.max(F.when(F.col("p") == low, F.col("value"))).alias("lo"),
        F.max(F.when(F.col("p") == high, F.col("value"))).alias("hi"))
    # One row per variable and grid point on both sides.
    return values.join(F.broadcast(limits), "variable").select(
        "variable", "p", F.col("value").alias("initial"),
        F.greatest(F.least("value", "hi"), F.col("lo")).alias("clipped"))


def sorted_series(df: DataFrame, columns: list[str],
                  limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(variable, initial, clipped, count, rows_before): every variable's values in order, before
    and after clipping, one row per distinct value with the number of rows that precede it.

    NULL and NaN are left out. Each variable is folded and cut into slices of its own, so no
    task orders a whole variable; making the table writes the folded values.
    """
    limits = fit_limits(df, columns) if limits is None else limits
    parts = []
    for c, (low, high) in limits.items():
        value = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        folded = (df.select(value.alias("initial")).filter("initial is not null")
                  .groupBy("initial").agg(F.count("*").alias("count")))
        parts.append(totals_before(folded, "initial", ["count"]).select(
            F.lit(c).alias("variable"), "initial",
            clip(F.col("initial"), float(low), float(high)).alias("clipped"), "count",
            F.col("count_before").alias("rows_before")))
    return reduce(DataFrame.unionByName, parts)


def category_frequency(df: DataFrame, columns) -> DataFrame:
    """(variable, category, count), NULL included."""
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category"))
        for c in columns)))
    return (df.select(pairs.alias("x")).select("x.*").groupBy("variable", "category")
            .agg(F.count("*").alias("count")))


def dummy_frequency(df: DataFrame, columns) -> DataFrame:
    """(variable, count) of rows with a non-zero dummy, most frequent first."""
    cells = F.array(*(
        F.struct(F.lit(c).alias("variable"),
                 F.count(F.when(F.col(f"`{c}`") != 0, 1)).alias("count")) for c in columns))
    return (df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")
            .orderBy(F.desc("count"), "variable"))


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    """(variable, count) of distinct known values: one unpivoted distinct, then one count."""
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"))
        for c in columns)))
    return (df.select(pairs.alias("x")).select("x.*").distinct().groupBy("variable")
            .agg(F.count("value").alias("count")))


def missing_share(df: DataFrame, columns) -> DataFrame:
    """(variable, missing, share)"""
    cells = F.array(*(
        F.struct(F.lit(c).alias("variable"),
                 F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("missing"),
                 F.count("*").alias("n")) for c in columns))
    return (df.agg(cells.alias("x")).select(F.explode("x").alias("x"))
            .select("x.variable", "x.missing", ratio("x.missing", "x.n").alias("share")))


def codes_per_contract_percentiles(rows: DataFrame, low: float = 0.01,
                                   high: float = 0.99) -> DataFrame:
    """(p, value, several_share): percentiles of the row count of contracts with several rows,
    and the share of such contracts."""
    counts = rows.groupBy("cntrID").agg(F.count("okpd").alias("n"))
    # Distinct counts are few, so the share comes from a tiny table.
    share = counts.agg(ratio(F.count(F.when(F.col("n") > 1, 1)), F.count("*")).alias("share"))
    found = exact_percentiles(counts.filter("n > 1"), ["n"], [low, high])
    return found.select("p", "value", share.scalar().alias("several_share"))


def codes_per_contract_distribution(rows: DataFrame) -> DataFrame:
    """(cntrID, okpd): code rows per contract, most first."""
    return (rows.groupBy("cntrID").agg(F.count("okpd").alias("okpd"))
            .orderBy(F.desc("okpd"), "cntrID"))
