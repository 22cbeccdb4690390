"""Statistics of product codes and of supplier pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenderlens.operators.facts import Facts
from tenderlens.sources.warehouse import Warehouse


def code_lines(f: Facts) -> DataFrame:
    """(cntrID, okpdID, lines, good): product lines of finished contracts, and those of contracts
    with a good ending, NULL for others.

    Lines are already folded per (contract, supplier, product); they are summed per code before
    anything joins.
    """
    labels = f.endings.select("cntrID", "label").join(
        f.recent_values.select("cntrID").distinct(), "cntrID", "left_semi")
    return (f.finished_products.groupBy("cntrID", "okpdID").agg(F.sum("lines").alias("lines"))
            .join(labels, "cntrID", "left")
            .select("cntrID", "okpdID", "lines",
                    F.when(F.col("label") == 0, F.col("lines")).alias("good")))


def code_stats(f: Facts) -> DataFrame:
    """Product-line count and good-line count per code; the latter is NULL without good lines."""
    return named_codes(f.wh, code_lines(f).groupBy("okpdID").agg(
        F.sum("lines").alias("cntr_num"), F.sum("good").alias("good_cntr_num")))


def named_codes(wh: Warehouse, stats: DataFrame) -> DataFrame:
    codes = wh.okpd2.select(F.col("ID").alias("OkpdID"), F.col("Code").alias("code"))
    return stats.withColumnRenamed("okpdID", "OkpdID").join(codes, "OkpdID").select(
        "OkpdID", "code", "cntr_num", "good_cntr_num")


def supplier_codes(f: Facts) -> DataFrame:
    """Distinct (cntrID, supID, okpdID) of finished contracts."""
    return f.finished_products.select("cntrID", "supID", "okpdID").distinct()


def supplier_code_contracts(f: Facts) -> DataFrame:
    """Distinct finished contracts per (supplier, code)."""
    return known_suppliers(f.wh, supplier_codes(f).groupBy("supID", "okpdID").agg(
        F.count("*").alias("cntr_num")))


def known_suppliers(wh: Warehouse, stats: DataFrame) -> DataFrame:
    suppliers = wh.suppliers.select(F.col("ID").alias("SupID"))
    return stats.select(F.col("supID").alias("SupID"), F.col("okpdID").alias("OkpdID"),
                        "cntr_num").join(suppliers, "SupID", "left_semi")


def supplier_customer_contracts(f: Facts) -> DataFrame:
    """Finished value rows per (supplier, customer)."""
    return known_parties(f.wh, f.finished_values.groupBy("supID", "orgID").agg(
        F.count("*").alias("cntr_num")))


def known_parties(wh: Warehouse, stats: DataFrame) -> DataFrame:
    suppliers = wh.suppliers.select(F.col("ID").alias("SupID"))
    customers = wh.org.select(F.col("ID").alias("OrgID"))
    return (stats.select(F.col("supID").alias("SupID"), F.col("orgID").alias("OrgID"), "cntr_num")
            .join(suppliers, "SupID", "left_semi").join(customers, "OrgID", "left_semi")
            .select("SupID", "OrgID", "cntr_num"))


def contract_codes(f: Facts) -> DataFrame:
    """Distinct (contract, code) pairs of finished contracts, with the code text."""
    codes = f.wh.okpd2.select(F.col("ID").alias("okpdID"), F.col("Code").alias("okpd"))
    return f.finished_products.select("cntrID", "okpdID").distinct().join(codes, "okpdID")
