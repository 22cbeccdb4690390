"""Global running totals and exact percentiles without a single-task window.

A window over a whole column would sort it in one task. For running totals the rows are dealt over
ranges of the column, so many that each holds a bounded number of rows; totals of the ranges are
accumulated, in ranges again where there are many, and added to the running totals inside each
range. For percentiles every wanted rank is enclosed between two values, round by round, until few
enough values are left to order. Results are exact: samples and sketches decide only where to cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tenderlens.sources.staging import small_table, stage

WANTED = StructType([
    StructField("variable", StringType()), StructField("cell", DoubleType()),
    StructField("p", DoubleType()), StructField("low", LongType()),
    StructField("high", LongType()), StructField("weight", DoubleType())])
#: Rows that one task orders, on average over the ranges.
RANGE_ROWS = 1 << 17
ACCURACY = 10_000


def _sliced(df: DataFrame, cuts: dict[str, list[float]], out: str) -> DataFrame:
    """Adds, per column, the number of cut points at or below the value.

    ``out`` is the name of the new column with ``{}`` for the column it belongs to. The search is
    binary and runs inside the JVM.
    """
    cut = [c for c, points in cuts.items() if points]
    whole = {out.format(c): F.lit(0.0) for c, points in cuts.items() if not points}
    df = df.withColumns(whole) if whole else df
    if not cut:
        return df
    return Bucketizer(
        inputCols=cut, outputCols=[out.format(c) for c in cut], handleInvalid="keep",
        splitsArray=[[-math.inf, *cuts[c], math.inf] for c in cut]).transform(df)


def totals_before(df: DataFrame, order: str, measures: list[str],
                  ranges: int | None = None) -> DataFrame:
    """Adds ``<measure>_before``: the sum over all rows with a smaller ``order`` value.

    ``df`` has one row per distinct value of ``order`` (equal values are folded beforehand, so
    a value shared by a third of all rows is one row here). It is staged, as counting, totals
    and running totals each read it. The number of ranges follows the rows unless it is given.
    """
    df = stage(df, "folded")
    ranges = -(-df.count() // RANGE_ROWS) if ranges is None else ranges
    if ranges > 1:
        # Written, so that every reader sees the same ranges.
        df = stage(df.repartitionByRange(ranges, order).withColumn(
            "_range", F.spark_partition_id()), "ranges")
    else:
        df = df.withColumn("_range", F.lit(0))
    preceding = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_range").agg(*(F.sum(m).alias(m) for m in measures))
    if ranges > RANGE_ROWS:
        offsets = totals_before(totals.withColumnRenamed("_range", "_place"), "_place", measures) \
            .withColumnRenamed("_place", "_range")
    else:
        offsets = totals.select("_range", *(
            F.coalesce(F.sum(m).over(preceding.orderBy("_range")), F.lit(0)).alias(f"{m}_before")
            for m in measures))
    offsets = offsets.select("_range", *(F.col(f"{m}_before").alias(f"_{m}_offset")
                                         for m in measures))
    # A row per range; so few that one task may order them, they may also be broadcast.
    out = df.join(F.broadcast(offsets) if ranges <= RANGE_ROWS else offsets, "_range")
    inside = (Window.partitionBy("_range").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_{m}_offset")
                             + F.coalesce(F.sum(m).over(inside), F.lit(0)))
    return out.drop("_range", *(f"_{m}_offset" for m in measures))


@dataclass(frozen=True)
class Bracket:
    """A closed interval of a column's values that holds the ranks of some percentiles."""

    low: float
    high: float
    below: int  # values under it
    inside: int
    wanted: tuple[float, ...]

    def around(self, n: int, margin: float) -> list[tuple[float, float, float]]:
        """(p, from, to): where each wanted percentile lies among the values inside."""
        out = []
        for p in self.wanted:
            at = [(rank - self.below) / max(self.inside - 1, 1)
                  for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]
            out.append((p, max(at[0] - margin, 0.0), min(at[1] + margin, 1.0)))
        return out


def _merged(spans: list[tuple[float, float, float]]) -> list[tuple[float, float, tuple]]:
    """Disjoint intervals with the percentiles of the (p, low, high) they cover."""
    out: list[tuple[float, float, tuple]] = []
    for p, low, high in sorted(spans, key=lambda s: s[1:]):
        if out and low <= out[-1][1]:
            last = out.pop()
            out.append((last[0], max(last[1], high), (*last[2], p)))
        else:
            out.append((low, high, (p,)))
    return out


def _narrowed(values: DataFrame, brackets: dict[str, list[Bracket]], counts: dict[str, int],
              most: int, accuracy: int) -> dict[str, list[Bracket]]:
    """One round: brackets of more than ``most`` values are replaced by narrower ones.

    A first pass finds, among the values of each such bracket, two between which a wanted rank
    surely lies; a second one counts the values below and inside exactly.
    """
    large = [(c, i, b) for c, own in brackets.items() for i, b in enumerate(own)
             if b.inside > most and b.low < b.high]
    if not large:
        return brackets
    margin = 5 / accuracy
    around = {(c, i): b.around(counts[c], margin) for c, i, b in large}
    found = values.agg(*(
        F.percentile_approx(F.when(F.col(c).between(b.low, b.high), F.col(c)),
                            [x for _, lo, hi in around[c, i] for x in (lo, hi)], accuracy)
        .alias(f"b{k}") for k, (c, i, b) in enumerate(large))).first()
    spans = []
    for k, (c, i, b) in enumerate(large):
        ends = found[f"b{k}"]
        own = [(p, b.low if lo == 0 else ends[2 * j], b.high if hi == 1 else ends[2 * j + 1])
               for j, (p, lo, hi) in enumerate(around[c, i])]
        spans += [(c, i, *span) for span in _merged(own)]
    row = values.agg(*(
        F.struct(F.count(F.when(F.col(c) < low, 1)).alias("below"),
                 F.count(F.when(F.col(c).between(low, high), 1)).alias("inside")).alias(f"s{k}")
        for k, (c, _, low, high, _) in enumerate(spans))).first()
    out = {c: [b for i, b in enumerate(own) if (c, i) not in around]
           for c, own in brackets.items()}
    for k, (c, _, low, high, wanted) in enumerate(spans):
        out[c].append(Bracket(low, high, row[f"s{k}"].below, row[f"s{k}"].inside, wanted))
    return {c: sorted(own, key=lambda b: b.low) for c, own in out.items()}


def exact_percentiles(df: DataFrame, columns: list[str], probabilities: list[float],
                      accuracy: int = ACCURACY) -> DataFrame:
    """(variable, p, value): linearly interpolated exact percentiles of many columns.

    Every wanted rank starts in a bracket of all values. Rounds narrow brackets about a thousandfold
    until they hold at most 10 * accuracy values, or one value only, or can get no narrower because
    of a value that many rows share. Then the values inside are folded and ordered, one window per
    bracket. NULL and NaN values are left out; a column without values gives no rows.
    """
    doubles = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    values = df.select(*(v.alias(c) for c, v in doubles.items()))
    row = values.agg(*(F.count(c).alias(c) for c in columns)).first()
    counts = {c: row[c] for c in columns if row[c]}
    # A wanted rank is asked for once, however often it is listed.
    wanted = tuple(dict.fromkeys(float(p) for p in probabilities))
    found = {c: [Bracket(-math.inf, math.inf, 0, n, wanted)] for c, n in counts.items()}
    while True:
        narrower = _narrowed(values, found, counts, 10 * accuracy, accuracy)
        if narrower == found:
            break
        found = narrower

    targets, cells, cuts = [], [], {}
    for c, brackets in found.items():
        n = counts[c]
        # Bracket j covers slice j + 1 when its low end cuts, slice j when it starts at -inf.
        cuts[c] = [b.low for b in brackets if b.low != -math.inf]
        first = 0 if brackets[0].low == -math.inf else 1
        cell = F.col(f"_{c}_cell")
        position = (cell - first).cast("int")
        tops = F.array(*(F.lit(b.high) for b in brackets))
        inside = (position >= 0) & (F.col(c) <= F.get(tops, position))
        cells.append(F.struct(
            F.lit(c).alias("variable"), cell.alias("cell"), F.when(inside, F.col(c)).alias("value"),
            F.col(c).isNotNull().alias("known")))
        for j, b in enumerate(brackets):
            for p in b.wanted:
                h = p * (n - 1)
                targets.append((c, float(j + first), float(p), math.floor(h), math.ceil(h),
                                h - math.floor(h)))
    values = _sliced(values, cuts, "_{}_cell")
    spark = df.sparkSession
    wanted = small_table(spark, targets, WANTED)
    if not targets:
        return wanted.select("variable", "p", F.lit(None).cast("double").alias("value"))

    counts = (values.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("known")
              .groupBy("variable", "cell", "value").agg(F.count("*").alias("n")))
    by_cell = Window.partitionBy("variable").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (counts.groupBy("variable", "cell").agg(F.sum("n").alias("n"))
               .select("variable", "cell",
                       F.coalesce(F.sum("n").over(by_cell), F.lit(0)).alias("offset")))
    by_value = Window.partitionBy("variable", "cell").orderBy("value").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = (counts.filter("value is not null")
              .withColumn("start", F.coalesce(F.sum("n").over(by_value), F.lit(0)))
              .join(F.broadcast(offsets), ["variable", "cell"])
              .withColumn("start", F.col("start") + F.col("offset"))
              .withColumn("end", F.col("start") + F.col("n")))
    # One row per wanted percentile on the broadcast side.
    hits = ranked.join(F.broadcast(wanted), ["variable", "cell"]).filter(
        "(low >= start and low < end) or (high >= start and high < end)")
    at_low = F.max(F.when(F.expr("low >= start and low < end"), F.col("value")))
    at_high = F.max(F.when(F.expr("high >= start and high < end"), F.col("value")))
    found = hits.groupBy("variable", "p", "weight").agg(at_low.alias("lo"), at_high.alias("hi"))
    missed = F.raise_error(F.lit("a wanted rank lies outside its bracket; lower the accuracy"))
    return found.select(
        "variable", "p",
        F.when(F.col("lo").isNull() | F.col("hi").isNull(), missed.cast("double"))
        .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("weight")).alias("value"))
