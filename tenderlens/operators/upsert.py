"""Keyed inserts and updates expressed as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def new_rows(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is neither stored yet nor a repetition within the batch."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The table after an insert that ignores duplicate keys."""
    return existing.unionByName(new_rows(existing, incoming, key).select(*existing.columns))


def update_from(base: DataFrame, updates: DataFrame, key: list[str],
                columns: list[str]) -> DataFrame:
    """Rows of ``base`` with ``columns`` taken from the matching row of ``updates``.

    A match overwrites even with NULL; rows without a match stay as they are.
    """
    fresh = updates.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns),
                           F.lit(True).alias("_matched"))
    joined = base.join(fresh, key, "left")
    return joined.select(*(
        F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c) for c in base.columns))


def refresh_missing(df: DataFrame, columns: list[str],
                    compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Recompute only rows in which any of ``columns`` is NULL; keep the others."""
    missing: Column = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.filter(~missing).unionByName(compute(df.filter(missing)).select(*df.columns))
