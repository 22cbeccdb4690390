"""Repeatable train / validation splits and balanced folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlens.settings import LABEL, ROW_ID

SEED = 42
BUCKETS = 4096


def _draw(key: str, seed: int, mode: str, modulus: int) -> Column:
    """0 .. modulus - 1 from the key, by hash or by plain modulo."""
    drawn = F.xxhash64(F.col(key), F.lit(seed)) if mode == "hash" else F.col(key)
    return F.pmod(drawn, F.lit(modulus))


def train_valid_split(df: DataFrame, valid_percent: int = 20, key: str = ROW_ID,
                      seed: int = SEED, mode: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(train, valid); a row's side depends on its key alone, whatever the partitioning."""
    if mode == "modulo":
        # Other rules draw by the last digits of the key, so take digits that the seed mixes.
        is_valid = F.expr(f"pmod((`{key}` * 7919 + {seed}) div 100, 100) < {valid_percent}")
    else:
        is_valid = _draw(key, seed, mode, 100) < valid_percent
    return df.filter(~is_valid), df.filter(is_valid)


def random_split(df: DataFrame, valid_percent: int = 20,
                 seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The same without a key; repeatable only while the partitioning is."""
    train, valid = df.randomSplit([100.0 - valid_percent, float(valid_percent)], seed)
    return train, valid


def shuffled(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows in random order. Row order carries no meaning in later stages."""
    return df.orderBy(F.rand(seed))


def stratified_folds(df: DataFrame, k: int, label: str = LABEL, key: str = ROW_ID,
                     seed: int = SEED, mode: str = "hash", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``fold`` 0 .. k-1 so that each label's rows differ by at most one between folds.

    A row number over a whole label would sort half the data in one task. Rows are numbered
    inside key buckets instead, and the numbers continue from the totals of earlier buckets.
    ``key`` is unique, so buckets are even.
    """
    df = df.withColumn("_bucket", _draw(key, seed, mode, buckets))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    # At most ``buckets`` rows per label.
    offsets = df.groupBy(label, "_bucket").agg(F.count("*").alias("_n")).select(
        label, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    position = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy(key)) - 1
    return (df.withColumn("_position", position)
            .join(F.broadcast(offsets), [label, "_bucket"])
            .withColumn("fold", ((F.col("_offset") + F.col("_position")) % k).cast("int"))
            .drop("_bucket", "_position", "_offset"))
