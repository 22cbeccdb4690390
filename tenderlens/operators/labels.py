"""Contract outcome labels and the amount paid per closure reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenderlens.operators.facts import Facts
from tenderlens.sources.warehouse import Warehouse


def contract_labels(f: Facts) -> DataFrame:
    """(CntrID, result) for every finished, recent contract.

    A contract is good (0) when its highest closure code is 0 and bad (1) otherwise; it has no
    label without a closure or without a value row.
    """
    # Distinct first: a contract with very many value rows is one key in the shuffle.
    valued = f.recent_values.select("cntrID").distinct()
    endings = f.endings.join(valued, "cntrID", "left_semi")
    return (f.contracts.select("cntrID").distinct()
            .join(endings, "cntrID", "left")
            .select(F.col("cntrID").alias("CntrID"), F.col("label").alias("result")))


def paid_by_reason(wh: Warehouse) -> DataFrame:
    """Amount paid per (contract, reason code, price), summed over closures and value rows.

    Closures are summed per (contract, code) and value rows counted per (contract, price)
    before the two meet, so a contract with many of both is not multiplied out.
    """
    contracts = wh.contracts.select(F.col("ID").alias("cntrID"))
    reasons = wh.termin_reason.select(F.col("ID").alias("RefTerminReason"),
                                      F.col("Code").alias("code"))
    paid = (wh.closures.join(reasons, "RefTerminReason")
            .groupBy(F.col("RefContract").alias("cntrID"), "code")
            .agg(F.sum("FactPaid").alias("paid")))
    prices = (wh.value.groupBy(F.col("RefContract").alias("cntrID"), F.col("Price").alias("price"))
              .agg(F.count("*").alias("n")))
    return (prices.join(contracts, "cntrID").join(paid, "cntrID")
            .select("cntrID", "code", "price", (F.col("paid") * F.col("n")).alias("paid")))
