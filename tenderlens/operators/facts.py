"""Shared pre-joined facts: who bought what from whom, when, and how the contract ended."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tenderlens.settings import Settings
from tenderlens.sources.staging import stage_all
from tenderlens.sources.warehouse import Condition, Warehouse


def recent(s: Settings) -> Condition:
    return Condition("RefSignDate", after=s.init_date)


def finished(s: Settings) -> Condition:
    return Condition("RefStage", among=tuple(s.finished_stages))


def finished_contracts(wh: Warehouse, s: Settings) -> DataFrame:
    return wh.where("contracts", finished(s), recent(s))


class Facts:
    """The facts every statistic is grouped from, each built when first asked for.

    As lazy plans they let a single statistic scan only the columns it needs. A job that
    computes many statistics takes ``staged()``: each fact is then joined and written once.
    """

    def __init__(self, wh: Warehouse, s: Settings):
        self.wh, self.s = wh, s

    @cached_property
    def recent_values(self) -> DataFrame:
        return _recent_values(self.wh, self.s)

    @cached_property
    def contracts(self) -> DataFrame:
        """Finished, recent contracts with the columns that the sample takes from them."""
        return finished_contracts(self.wh, self.s).select(
            F.col("ID").alias("cntrID"), F.col("RegNum").alias("cntr_reg_num"),
            F.col("RefSignDate").alias("sign_date"), F.col("RefExecution").alias("exec_date"),
            F.col("RefTypePurch").alias("purch_type"))

    @cached_property
    def finished_products(self) -> DataFrame:
        return _finished_products(self.wh, self.s)

    @cached_property
    def endings(self) -> DataFrame:
        return _contract_endings(self.wh, self.s)

    @property
    def finished_values(self) -> DataFrame:
        """Value rows of finished, recent contracts."""
        return self.recent_values.filter("finished").drop("finished")

    def staged(self) -> "Facts":
        out = Facts(self.wh, self.s)
        names = ("recent_values", "contracts", "finished_products", "endings")
        out.__dict__.update(stage_all({n: getattr(self, n) for n in names}))
        return out


def _recent_values(wh: Warehouse, s: Settings) -> DataFrame:
    """Value rows of recent contracts of any stage, with a ``finished`` flag.

    The filters reach the scan of the contracts, so only recent ones are shuffled.
    """
    contracts = wh.where("contracts", recent(s)).select(
        F.col("ID").alias("cntrID"), finished(s).holds().alias("finished"))
    value = wh.value.select(
        F.col("ID").alias("valID"), F.col("RefContract").alias("cntrID"),
        F.col("RefSupplier").alias("supID"), F.col("RefOrg").alias("orgID"),
        F.col("Price").alias("price"), F.col("PMP").alias("pmp"),
        F.col("RefLevelOrder").alias("cntr_lvl"))
    return value.join(contracts, "cntrID")


def _finished_products(wh: Warehouse, s: Settings) -> DataFrame:
    """Product lines of finished, recent contracts, counted per (contract, supplier, product).

    Lines are filtered and folded first; the product dictionary only meets what is left.
    """
    contracts = finished_contracts(wh, s).select(F.col("ID").alias("cntrID"))
    lines = (wh.product.select(F.col("RefContract").alias("cntrID"),
                               F.col("RefProduct").alias("productID"),
                               F.col("RefSupplier").alias("supID"))
             .join(contracts, "cntrID")
             .groupBy("cntrID", "supID", "productID").agg(F.count("*").alias("lines")))
    products = wh.products.select(F.col("ID").alias("productID"),
                                  F.col("RefOKPD2").alias("okpdID"))
    return lines.join(products, "productID")


def _contract_endings(wh: Warehouse, s: Settings) -> DataFrame:
    """One row per contract with a closure: its label and who severed it.

    The label is 0 when the highest reason code is 0 and 1 for any other or unknown code.
    """
    reasons = wh.termin_reason.select(F.col("ID").alias("RefTerminReason"), "Code")
    closed = wh.closures.select("RefContract", "RefTerminReason").join(reasons, "RefTerminReason")
    by_supplier = F.col("Code").isin(*s.supplier_decided)
    by_customer = F.col("Code").isin(*s.customer_decided)
    return closed.groupBy(F.col("RefContract").alias("cntrID")).agg(
        F.when(F.max("Code") == 0, 0).otherwise(1).alias("label"),
        F.max(F.when(by_supplier, 1).otherwise(0)).alias("supplier_severed"),
        F.max(F.when(by_customer, 1).otherwise(0)).alias("customer_severed"))
