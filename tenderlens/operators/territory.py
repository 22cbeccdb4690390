"""Nearest federal subject above (or at) each territory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenderlens.sources.staging import stage
from tenderlens.sources.warehouse import Warehouse


def federal_subjects(wh: Warehouse) -> DataFrame:
    """(territory, subject) for every territory that has a subject at or above it.

    By pointer doubling: every territory points to its parent and a subject to itself, and each
    round replaces a pointer by the pointer of where it leads, which doubles the steps it stands
    for; at the nearest subject it stays. So the rounds are a logarithm of the depth, whatever that
    is. A territory whose walk ends at an unknown parent has no row, nor has one whose walk comes
    to a circle: its pointer still moves when it stands for more steps than there are territories.
    """
    subjects = wh.fed_subject.select("ID").distinct()
    inner = wh.territory.join(subjects, "ID", "left_anti").filter("ParentID is not null")
    pointers = stage(
        subjects.selectExpr("ID AS territory", "ID AS at", "true AS arrived").unionByName(
            inner.selectExpr("ID AS territory", "ParentID AS at", "false AS arrived")), "pointers")
    territories, steps = pointers.count(), 1
    while steps <= territories and not pointers.filter("not arrived").isEmpty():
        # Only pointers on their way are joined; those at a subject would be very many of one key.
        ahead = pointers.select(F.col("territory").alias("at"), F.col("at").alias("further"),
                                F.col("arrived").alias("there"))
        moved = pointers.filter("not arrived").join(ahead, "at").selectExpr(
            "territory", "further AS at", "there AS arrived")
        pointers = stage(pointers.filter("arrived").unionByName(moved), "pointers")
        steps *= 2
    return pointers.filter("arrived").selectExpr("territory", "at AS subject")


def with_subject(df: DataFrame, subjects: DataFrame, territory: str, out: str) -> DataFrame:
    """Adds the federal subject of a territory column; NULL where there is none."""
    lookup = subjects.withColumnRenamed("territory", territory).withColumnRenamed("subject", out)
    return df.join(lookup, territory, "left")


def supplier_territory(wh: Warehouse, subjects: DataFrame) -> DataFrame:
    """(SupID, sup_fed_ter)"""
    parties = wh.suppliers.selectExpr("ID AS SupID", "RefTerritory")
    return with_subject(parties, subjects, "RefTerritory", "sup_fed_ter").select(
        "SupID", "sup_fed_ter")


def customer_territory(wh: Warehouse, subjects: DataFrame) -> DataFrame:
    """(OrgID, org_fed_ter)"""
    parties = wh.org.selectExpr("ID AS OrgID", "RefTerritory")
    return with_subject(parties, subjects, "RefTerritory", "org_fed_ter").select(
        "OrgID", "org_fed_ter")
