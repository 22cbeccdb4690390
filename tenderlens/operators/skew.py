"""Joins of a large fact with a one-row-per-key lookup when a few keys hold most of the fact.

AQE splits skewed joins only where both inputs come straight from a shuffle. A lookup that was
just aggregated by the join key does not, so the few hot keys are spread explicitly: their fact
rows are dealt over slices and their lookup rows repeated once per slice. All other keys join as
usual, and no row is lost or added.

Where a key may have many rows on both sides (``join_grid``), its rows on either side are measured
and laid out as a grid: a cell gets one slice of the left rows and one of the right.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlens.sources.staging import stage

# Slices of a key that a caller names without its share.
SLICES = 64
# Bound of the hot keys per column, which reach the plan as literals.
MOST_KEYS = 4096


def hot_share(spark: SparkSession) -> float:
    """A key is hot from a quarter of an even partition on."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1 / (4 * partitions), 1 / MOST_KEYS)


def hot_keys(fact: DataFrame, columns: list[str],
             least: float | None = None) -> dict[str, dict]:
    """Values of each column that hold at least ``least`` of the rows, with a number of slices
    that grows with their share: a power of two, so that few numbers occur.

    One mergeable sketch per column in one pass: the driver receives at most 1 / least values.
    The answer steers the layout of joins only, never their result.
    """
    least = hot_share(fact.sparkSession) if least is None else least
    k = math.ceil(1 / least)
    sketches = [F.expr(f"approx_top_k({c}, {k}, {max(8192, 16 * k)})").alias(c) for c in columns]
    row = fact.agg(F.count("*").alias("rows"), *sketches).first()
    return {
        c: {top["item"]: 1 << math.ceil(math.log2(max(2, top["count"] / (least * row["rows"]))))
            for top in (row[c] or [])
            if top["item"] is not None and top["count"] >= least * row["rows"]}
        for c in columns
    }


def _slices(column: str, hot, slices: int) -> Column:
    """The number of slices of a value, 1 unless it is hot."""
    numbers = hot if isinstance(hot, dict) else dict.fromkeys(hot, slices)
    out = F.lit(1)
    for n in sorted(set(numbers.values())):
        out = F.when(F.col(column).isin(*(v for v, m in numbers.items() if m == n)),
                     F.lit(n)).otherwise(out)
    return out


def join_lookup(fact: DataFrame, lookup: DataFrame, keys: list[str], hot: dict,
                how: str = "inner", deal_by: str = "valID", slices: int = SLICES,
                any_value: tuple[str, ...] = ()) -> DataFrame:
    """``fact.join(lookup, keys, how)`` with the rows of hot keys dealt over slices.

    ``hot`` holds hot values per column: as ``hot_keys`` gives them, or a list, dealt over
    ``slices``. Rows are spread where every key column is hot, because a combination can only be
    hot when each of its parts is; of the columns in ``any_value`` every value counts as hot.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(how)
    listed = [k for k in keys if k not in any_value]
    if not listed or not all(hot.get(k) for k in listed):
        return fact.join(lookup, keys, how)
    numbers = [_slices(k, hot[k], slices) for k in listed]
    number = F.least(*numbers) if len(numbers) > 1 else numbers[0]
    dealt = F.pmod(F.xxhash64(deal_by), number).cast("int")
    return (fact.withColumn("_slice", dealt)
            .join(lookup.withColumn("_slice", F.explode(F.sequence(F.lit(0), number - 1))),
                  [*keys, "_slice"], how)
            .drop("_slice"))


# ---- many rows on both sides --------------------------------------------------------------

# A key's cells are to hold no more than this part of an even partition each.
CELL = 1 / 4


def key_work(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l, r, work) of the keys on both sides: rows read on either side and rows joined.

    Counts combine before the shuffle, so a hot key is one row per task here.
    """
    counts = [df.groupBy(*keys).agg(F.count("*").cast("double").alias(n))
              for df, n in ((left, "l"), (right, "r"))]
    return counts[0].join(counts[1], keys).withColumn("work", F.expr("l + r + l * r"))


def grids(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _rows, _columns): the grid of every hot key, by the measured sizes of its sides.

    A key is hot if its work is more than ``CELL`` of an even partition, so there are at most
    partitions / ``CELL`` of them. Its grid has so many cells that one holds about that much;
    slices are long on the longer side, which repeats the fewest rows.
    """
    work = stage(key_work(left, right, keys), "key_work")
    total = work.agg(F.sum("work")).first()[0] or 0.0
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = max(total * CELL / partitions, 1.0)
    # rows / columns as l / r, neither beyond the rows there are to deal.
    return (work.filter(F.col("work") > cell)
            .withColumn("cells", F.ceil(F.col("work") / cell).cast("double"))
            .withColumn("_rows", F.expr("least(l, cells, ceil(sqrt(cells * l / r)))").cast("int"))
            .withColumn("_columns", F.expr("least(r, ceil(cells / _rows))").cast("int"))
            .select(*keys, "_rows", "_columns"))


def _dealt(df: DataFrame, hot: DataFrame, keys: list[str], deal_by: list[str], own: str,
           other: str) -> DataFrame:
    """Rows with their slice ``_<own>``, once for every slice ``_<other>``."""
    slices, repeated = (F.coalesce(f"_{side}s", F.lit(1)) for side in (own, other))
    return (df.join(F.broadcast(hot), keys, "left")
            .withColumn(f"_{own}", F.pmod(F.xxhash64(*deal_by), slices).cast("int"))
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), repeated - 1)))
            .drop("_rows", "_columns"))


def join_grid(left: DataFrame, right: DataFrame, keys: list[str], deal_left: list[str],
              deal_right: list[str], hot: DataFrame | None = None) -> DataFrame:
    """``left.join(right, keys)`` where a key may have many rows on both sides.

    Rows of hot keys are dealt by the hash of ``deal_left`` and ``deal_right``, which should tell
    the rows of a key apart. The table of grids is small by its definition, so it is broadcast;
    where it is empty the join is the plain one. A caller that knows the counts of either side
    from narrower tables passes ``hot``, else both sides are read twice and should be staged.
    """
    hot = grids(left, right, keys) if hot is None else hot
    if hot.isEmpty():
        return left.join(right, keys)
    return _dealt(left, hot, keys, deal_left, "row", "column").join(
        _dealt(right, hot, keys, deal_right, "column", "row"),
        [*keys, "_row", "_column"]).drop("_row", "_column")
