"""Statistics that follow changes of the warehouse without being counted anew.

Every statistic is a sum over contracts: a contract contributes to the keys it touches (a supplier,
a customer, a code, a pair of them, a ratio), and its contribution follows from its own rows alone.
What a load stores is the sums per key (the state) and the contributions themselves (the log). When
contracts change, their stored contributions are taken back and their new ones added; keys that
nothing touches any more go. Sets, such as the distinct ratios of a supplier, are kept as keys with
the number of contracts that have them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tenderlens.operators import codes, entities
from tenderlens.operators.entities import CUSTOMER, SUPPLIER
from tenderlens.operators.facts import Facts
from tenderlens.settings import Settings
from tenderlens.sources.warehouse import Warehouse

#: Contract column of the tables that belong to contracts.
OWNED = {"contracts": "ID", "value": "RefContract", "product": "RefContract",
         "closures": "RefContract", "penalties": "RefContract"}


@dataclass(frozen=True)
class Measured:
    """A statistic by what it is keyed by and what is summed."""

    keys: tuple[str, ...]
    measures: tuple[str, ...]


#: ``times`` counts contributions, so that a key without any can be told from one that sums to 0.
KINDS = {
    "suppliers": Measured(("supID",), (*entities.summed(SUPPLIER), "times")),
    "customers": Measured(("orgID",), (*entities.summed(CUSTOMER), "times")),
    "ratios": Measured(("supID", "ratio"), ("times",)),
    "codes": Measured(("okpdID",), ("lines", "good", "good_times", "times")),
    "supplier_codes": Measured(("supID", "okpdID"), ("times",)),
    "pairs": Measured(("supID", "orgID"), ("n", "times")),
}


def contributions(f: Facts) -> dict[str, DataFrame]:
    """(cntrID, keys, measures) of every contract, one row per contract and key."""
    pairs = f.finished_values.groupBy("cntrID", "supID", "orgID").agg(F.count("*").alias("n"))
    lines = codes.code_lines(f).withColumn("good_times", F.col("good").isNotNull().cast("long"))
    found = {
        "suppliers": entities.entity_grain(f, SUPPLIER),
        "customers": entities.entity_grain(f, CUSTOMER),
        "ratios": entities.penalty_ratios(f).distinct(),
        "codes": lines, "supplier_codes": codes.supplier_codes(f), "pairs": pairs}
    out = {}
    for name, df in found.items():
        kind = KINDS[name]
        df = df.withColumn("times", F.lit(1))
        out[name] = df.select("cntrID", *kind.keys, *(
            F.coalesce(F.col(m).cast("long"), F.lit(0).cast("long")).alias(m)
            for m in kind.measures))
    return out


def merged(name: str, *parts: DataFrame) -> DataFrame:
    """Sums per key over states and contributions; keys without contributions are gone."""
    kind = KINDS[name]
    rows = [p.select(*kind.keys, *kind.measures) for p in parts]
    out = rows[0]
    for p in rows[1:]:
        out = out.unionByName(p)
    return (out.groupBy(*kind.keys).agg(*(F.sum(m).alias(m) for m in kind.measures))
            .filter("times <> 0"))


def taken_back(name: str, log: DataFrame) -> DataFrame:
    """Contributions with the opposite sign, folded per contract and key."""
    kind = KINDS[name]
    return (log.groupBy("cntrID", *kind.keys).agg(*(F.sum(m).alias(m) for m in kind.measures))
            .filter("times <> 0")
            .select("cntrID", *kind.keys, *((-F.col(m)).alias(m) for m in kind.measures)))


# --- which contracts changed

def digests(wh: Warehouse) -> DataFrame:
    """(cntrID, digest): a sum of hashes of all rows of a contract, whatever their order.

    Sums combine before the shuffle, so a contract with very many rows is no bottleneck.
    """
    rows = None
    for table, key in OWNED.items():
        df = getattr(wh, table)
        part = df.filter(F.col(key).isNotNull()).select(
            F.col(key).alias("cntrID"), F.xxhash64(F.lit(table), *df.columns).alias("h"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("cntrID").agg(F.sum(F.col("h").cast("decimal(20,0)")).alias("digest"))


def changed_contracts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Contracts whose digest is new, another one, or gone."""
    old = before.select("cntrID", F.col("digest").alias("old"))
    return old.join(after, "cntrID", "full").filter(~F.col("old").eqNullSafe(F.col("digest"))) \
        .select("cntrID")


def restricted(wh: Warehouse, contracts: DataFrame) -> Warehouse:
    """The warehouse with the rows of some contracts only; dictionaries stay whole."""
    def table(name: str) -> DataFrame:
        df = getattr(wh, name)
        if name not in OWNED:
            return df
        wanted = contracts.select(F.col("cntrID").alias(OWNED[name]))
        return df.join(wanted, OWNED[name], "left_semi").select(*df.columns)

    return Warehouse(wh.spark, table)


# --- the statistics tables from sums

def tables(wh: Warehouse, s: Settings, states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five statistics tables that are sums, as they would be counted from scratch."""
    suppliers = entities.from_sums(wh, SUPPLIER, states["suppliers"])
    ratios = entities.mean_ratio(wh, states["ratios"])
    good = F.when(F.col("good_times") > 0, F.col("good"))
    return {
        "sup_stats": entities.supplier_columns(suppliers.join(ratios, "SupID"), s),
        "org_stats": entities.customer_columns(
            entities.from_sums(wh, CUSTOMER, states["customers"]), s),
        "okpd_stats": codes.named_codes(wh, states["codes"].select(
            "okpdID", F.col("lines").alias("cntr_num"), good.alias("good_cntr_num"))),
        "okpd_sup_stats": codes.known_suppliers(
            wh, states["supplier_codes"].withColumnRenamed("times", "cntr_num")),
        "sup_org_stats": codes.known_parties(wh, states["pairs"].withColumnRenamed("n", "cntr_num")),
    }
