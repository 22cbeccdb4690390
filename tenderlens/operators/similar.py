"""Share of an entity's finished contracts priced within 20 % of a given price.

Counting pairs of one entity would be quadratic in its contracts, and a running count over all
prices of one entity would put that entity into one task. Prices are therefore cut into blocks
of fixed relative width. A count up to a bound is the total of the blocks before it plus a
running count inside its block, so a task sees one block of one entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlens.functions.scalars import share

# Blocks per doubling of the price, as a power of two; an entity has at most 2**12 * 52 blocks.
BLOCK_BITS = 12


def price_block(v: str) -> Column:
    """Order-preserving block number of a non-negative integer.

    Numbers below 2**13 are their own block; above, a block holds the numbers that share their
    leading 13 binary digits.
    """
    shift = f"greatest(length(bin({v})) - 1 - {BLOCK_BITS}, 0)"
    return F.expr(f"{shift} * {1 << BLOCK_BITS} + shiftright({v}, {shift})")


def similar_price_counts(facts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, price, similar): facts of the same key with a price in 0.8 .. 1.2 of ``price``.

    ``facts`` and ``wanted`` have the columns ``key`` and ``price`` (integers). Bounds are exact
    because everything is scaled by 5: a fact counts at 5p, the band runs from 4q to 6q.
    Negative wanted prices have an empty band.
    """
    points = (facts.filter("price >= 0").groupBy(key, "price").agg(F.count("*").alias("n"))
              .select(key, (F.col("price") * 5).alias("v"), F.lit(1).alias("kind"), "n"))
    prices = wanted.filter("price >= 0").select(key, "price").distinct()
    # Kind orders equal values: the lower bound before the facts, the upper bound after them.
    bounds = prices.select(key, "price", F.explode(F.array(
        F.struct((F.col("price") * 4).alias("v"), F.lit(0).alias("kind"), F.lit(-1).alias("sign")),
        F.struct((F.col("price") * 6).alias("v"), F.lit(2).alias("kind"), F.lit(1).alias("sign")),
    )).alias("b")).select(key, "price", "b.*")

    rows = points.withColumn("price", F.lit(None).cast("long")).withColumn(
        "sign", F.lit(None).cast("int")).unionByName(
        bounds.withColumn("n", F.lit(0).cast("long"))).withColumn("block", price_block("v"))
    inside = Window.partitionBy(key, "block").orderBy("v", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("inside", F.sum("n").over(inside)).filter("sign is not null")

    blocks = rows.groupBy(key, "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(key, "block",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (ranked.join(offsets, [key, "block"])
            .groupBy(key, "price")
            .agg(F.sum(F.col("sign") * (F.col("inside") + F.col("offset"))).alias("similar")))


def similar_price_share(facts: DataFrame, wanted: DataFrame, key: str, total: str,
                        out: str) -> DataFrame:
    """(key, price, out) for every (key, price, total) of ``wanted``: similar / total.

    The share is 0 when the entity has no finished contract.
    """
    counts = similar_price_counts(facts, wanted, key)
    return (wanted.select(key, "price", total).distinct()
            .join(counts, [key, "price"], "left")
            .select(key, "price", share(F.coalesce("similar", F.lit(0)), total).alias(out)))
