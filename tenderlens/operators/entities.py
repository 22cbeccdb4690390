"""Per-supplier and per-customer history statistics.

Every figure is a grouped aggregation over a shared fact, left-joined to the whole dimension, so
entities without contracts keep a row with their default.

Distinct contracts are counted in two steps, first per (contract, entity) and then per entity.
The first step groups by the key the fact was just joined on, so it needs no shuffle of its own,
and the second combines partial sums, so an entity with a third of all rows is no bottleneck.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.functions.scalars import ratio, share
from tenderlens.operators.facts import Facts
from tenderlens.settings import FEDERAL_LEVEL, REGIONAL_LEVEL, Settings
from tenderlens.sources.warehouse import Warehouse


@dataclass(frozen=True)
class Side:
    """Which party of a contract the statistics describe."""

    prefix: str
    fact_key: str
    stats_key: str
    dimension: str


SUPPLIER = Side("sup", "supID", "SupID", "suppliers")
CUSTOMER = Side("org", "orgID", "OrgID", "org")


def everyone(wh: Warehouse, side: Side) -> DataFrame:
    return getattr(wh, side.dimension).select(F.col("ID").alias(side.stats_key))


def _onto_everyone(f: Facts, side: Side, stats: DataFrame, zero: tuple[str, ...]) -> DataFrame:
    return _onto_everyone_of(f.wh, side, stats, zero)


def _onto_everyone_of(wh: Warehouse, side: Side, stats: DataFrame,
                      zero: tuple[str, ...]) -> DataFrame:
    joined = everyone(wh, side).join(
        stats.withColumnRenamed(side.fact_key, side.stats_key), side.stats_key, "left")
    return joined.fillna(0, subset=list(zero)) if zero else joined


def contract_counts(f: Facts, side: Side) -> DataFrame:
    """Finished-contract count: value rows, not distinct contracts."""
    name = f"{side.prefix}_cntr_num"
    counts = f.finished_values.groupBy(side.fact_key).agg(F.count("*").alias(name))
    return _onto_everyone(f, side, counts, (name,))


def average_price(f: Facts, side: Side) -> DataFrame:
    """Average price of finished contracts, truncated to a whole number; NULL without any."""
    name = f"{side.prefix}_cntr_avg_price"
    prices = f.finished_values.groupBy(side.fact_key).agg(_whole_average().alias(name))
    return _onto_everyone(f, side, prices, ())


def _whole_average() -> Column:
    return F.expr("cast(sum(price) div count(price) as bigint)")


def running_good_level_counts(f: Facts, side: Side) -> DataFrame:
    """Running, good, federal, regional and municipal contract counts."""
    p = side.prefix
    grain = _contract_grain(f, side, endings=True)
    sums = grain.groupBy(side.fact_key).agg(
        F.sum("n").alias("n"), *(F.sum(c).alias(f"{p}_{c}_cntr_num")
                                 for c in ("running", "good", "fed", "sub")))
    sums = sums.withColumn(
        f"{p}_mun_cntr_num",
        F.col("n") - F.col(f"{p}_fed_cntr_num") - F.col(f"{p}_sub_cntr_num")).drop("n")
    return _onto_everyone(f, side, sums, tuple(sums.columns[1:]))


def _contract_grain(f: Facts, side: Side, endings: bool = False,
                    penalties: bool = False) -> DataFrame:
    """One row per (contract, entity) over recent contracts of any stage."""
    done = F.col("finished")
    level = F.col("cntr_lvl")
    grain = f.recent_values.groupBy("cntrID", side.fact_key).agg(
        F.max(done.cast("int")).alias("finished"),
        F.count(F.when(done, 1)).alias("n"),
        F.count(F.when(~done, 1)).alias("running"),
        F.count(F.when(done & (level == FEDERAL_LEVEL), 1)).alias("fed"),
        F.count(F.when(done & (level == REGIONAL_LEVEL), 1)).alias("sub"),
        F.sum(F.when(done, F.col("price"))).alias("price"),
        F.count(F.when(done, F.col("price"))).alias("priced"))
    if endings:
        grain = (grain.join(f.endings, "cntrID", "left")
                 .withColumn("good", F.when(F.col("label") == 0, F.col("n")).otherwise(0)))
    if penalties:
        clean = f.wh.penalties.groupBy(F.col("RefContract").alias("cntrID")).agg(
            F.max(F.col("Accrual").isNull().cast("int")).alias("clean"))
        grain = (grain.join(clean, "cntrID", "left")
                 .withColumn("clean", F.coalesce("clean", F.lit(1)) * F.col("finished")))
    return grain


def average_penalty_share(f: Facts, distinct: bool = True) -> DataFrame:
    """Mean of the distinct accrual / price ratios of a supplier's finished contracts.

    The ratio set, which is all the mean depends on, stays whole.
    """
    ratios = penalty_ratios(f, distinct).select("supID", "ratio")
    return mean_ratio(f.wh, ratios.distinct() if distinct else ratios)


def no_penalty_share(f: Facts) -> DataFrame:
    """Distinct contracts with no penalty row, or one of unknown amount, over the count."""
    sums = (_contract_grain(f, SUPPLIER, penalties=True).groupBy("supID")
            .agg(F.sum("clean").alias("clean"), F.sum("n").alias("n")))
    out = _onto_everyone(f, SUPPLIER, sums, ("clean", "n"))
    return out.select("SupID", share("clean", "n", f.s.int_division).alias("sup_no_pnl_share"))


# Name of the severance share by (side of the entity, party that decided).
SEVERANCE_NAMES = {
    ("sup", "supplier"): "sup_1s_sev",
    ("sup", "customer"): "sup_1s_org_sev",
    ("org", "customer"): "org_1s_sev",
    ("org", "supplier"): "org_1s_sup_sev",
}


def severance_share(f: Facts, side: Side, decided_by: str) -> DataFrame:
    """Distinct recent contracts, of any stage, severed by one party over finished count."""
    sums = (_contract_grain(f, side, endings=True).groupBy(side.fact_key)
            .agg(F.sum(f"{decided_by}_severed").alias("severed"), F.sum("n").alias("n")))
    out = _onto_everyone(f, side, sums, ("severed", "n"))
    return out.select(side.stats_key, share("severed", "n", f.s.int_division)
                      .alias(SEVERANCE_NAMES[side.prefix, decided_by]))


def entity_grain(f: Facts, side: Side) -> DataFrame:
    """One row per (contract, entity) with all that the entity's statistics are summed from."""
    return _contract_grain(f, side, endings=True, penalties=side is SUPPLIER)


def summed(side: Side) -> tuple[str, ...]:
    """The columns of the grain that are summed per entity."""
    names = ("n", "running", "good", "fed", "sub", "price", "priced", "supplier_severed",
             "customer_severed")
    return (*names, "clean") if side is SUPPLIER else names


def from_sums(wh: Warehouse, side: Side, sums: DataFrame) -> DataFrame:
    """Sums per entity onto the whole dimension, under the names of the statistics."""
    p = side.prefix
    counted = {"n": f"{p}_cntr_num"}
    counted |= {c: f"{p}_{c}_cntr_num" for c in ("running", "good", "fed", "sub")}
    price = F.expr("cast(price div nullif(priced, 0) as bigint)").alias(f"{p}_cntr_avg_price")
    rest = [c for c in summed(side) if c not in (*counted, "price", "priced")]
    sums = sums.select(side.fact_key, *(F.col(c).alias(name) for c, name in counted.items()),
                       price, *rest)
    return _onto_everyone_of(wh, side, sums, (*counted.values(), *rest))


def _entity_sums(f: Facts, side: Side) -> DataFrame:
    sums = entity_grain(f, side).groupBy(side.fact_key).agg(
        *(F.sum(c).alias(c) for c in summed(side)))
    return from_sums(f.wh, side, sums)


def penalty_ratios(f: Facts, distinct: bool = True) -> DataFrame:
    """(cntrID, supID, ratio) of accruals to prices of finished contracts.

    Equal accruals of a contract and equal (supplier, price) rows are folded before they meet.
    """
    values = f.finished_values.filter("price > 0").select("cntrID", "supID", "price")
    accruals = f.wh.penalties.filter("Accrual is not null").select(
        F.col("RefContract").alias("cntrID"), "Accrual")
    if distinct:
        values, accruals = values.distinct(), accruals.distinct()
    return values.join(accruals, "cntrID").select(
        "cntrID", "supID", ratio("Accrual", "price").alias("ratio"))


def mean_ratio(wh: Warehouse, ratios: DataFrame) -> DataFrame:
    """Rounded mean of the (supID, ratio) rows onto all suppliers."""
    name = "sup_cntr_avg_penalty"
    means = ratios.groupBy("supID").agg(F.round(F.avg("ratio"), 3).alias(name))
    return _onto_everyone_of(wh, SUPPLIER, means, (name,))


def supplier_columns(sums: DataFrame, s: Settings) -> DataFrame:
    n = F.col("sup_cntr_num")
    return sums.select(
        "SupID", "sup_cntr_num", "sup_running_cntr_num", "sup_good_cntr_num",
        "sup_fed_cntr_num", "sup_sub_cntr_num",
        (n - F.col("sup_fed_cntr_num") - F.col("sup_sub_cntr_num")).alias("sup_mun_cntr_num"),
        "sup_cntr_avg_price", "sup_cntr_avg_penalty",
        share("clean", n, s.int_division).alias("sup_no_pnl_share"),
        share("supplier_severed", n, s.int_division).alias("sup_1s_sev"),
        share("customer_severed", n, s.int_division).alias("sup_1s_org_sev"))


def customer_columns(sums: DataFrame, s: Settings) -> DataFrame:
    n = F.col("org_cntr_num")
    return sums.select(
        "OrgID", "org_cntr_num", "org_running_cntr_num", "org_good_cntr_num",
        "org_fed_cntr_num", "org_sub_cntr_num",
        (n - F.col("org_fed_cntr_num") - F.col("org_sub_cntr_num")).alias("org_mun_cntr_num"),
        "org_cntr_avg_price",
        share("customer_severed", n, s.int_division).alias("org_1s_sev"),
        share("supplier_severed", n, s.int_division).alias("org_1s_sup_sev"))


def supplier_stats(f: Facts) -> DataFrame:
    """All supplier statistics from one pass over the fact plus the penalty ratios."""
    return supplier_columns(
        _entity_sums(f, SUPPLIER).join(average_penalty_share(f), "SupID"), f.s)


def customer_stats(f: Facts) -> DataFrame:
    """All customer statistics from one pass over the fact."""
    return customer_columns(_entity_sums(f, CUSTOMER), f.s)
