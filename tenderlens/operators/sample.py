"""The labelled sample: one row per (value, contract, supplier, customer, product code)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tenderlens.functions.scalars import flag, hash_percent, share
from tenderlens.operators import codes as code_ops
from tenderlens.operators.facts import Facts
from tenderlens.operators.similar import similar_price_counts
from tenderlens.operators.skew import grids, hot_keys, join_grid, join_lookup
from tenderlens.operators.territory import (
    customer_territory, federal_subjects, supplier_territory,
)
from tenderlens.operators.upsert import refresh_missing
from tenderlens.settings import Settings
from tenderlens.sources.schemas import DERIVED
from tenderlens.sources.staging import discard, stage


@dataclass(frozen=True)
class Statistics:
    """The six derived tables the sample is assembled from."""

    cntr_stats: DataFrame
    sup_stats: DataFrame
    org_stats: DataFrame
    okpd_stats: DataFrame
    okpd_sup_stats: DataFrame
    sup_org_stats: DataFrame


def price_flags(df: DataFrame, s: Settings) -> DataFrame:
    """1/0 flags: price above a known maximum price; price at or below 60 % of it."""
    higher = (F.col("pmp") > 0) & (F.col("price") > F.col("pmp"))
    too_low = F.col("price") <= F.col("pmp") * s.low_price_ratio
    return df.withColumns({"price_higher_pmp": flag(higher), "price_too_low": flag(too_low)})


def sampled_good(labels: DataFrame, s: Settings, mode: str = "hash") -> DataFrame:
    """A fixed share of the good contracts, drawn by their key, so repeatable."""
    return labels.filter("result = 0").filter(hash_percent("CntrID", mode) < s.good_percent)


def chosen_values(f: Facts, labels: DataFrame, mode: str = "hash",
                  existing: DataFrame | None = None, hot: dict | None = None) -> DataFrame:
    """Value rows of the contracts in the sample, with the contract columns and the label.

    Bad contracts give their priced rows. Sampled good contracts that have a priced row, and
    are not in ``existing`` yet, give all their rows.
    """
    bad = labels.filter("result = 1")
    good = sampled_good(labels, f.s, mode)
    if existing is not None:
        taken = existing.filter("cntr_result = 0").select(F.col("cntrID").alias("CntrID"))
        good = good.join(taken, "CntrID", "left_anti")
    picked = bad.unionByName(good).select(
        F.col("CntrID").alias("cntrID"), F.col("result").alias("cntr_result"))
    contracts = f.contracts.join(picked, "cntrID")
    priced = f.finished_values.filter("price > 0").select("cntrID").distinct()
    contracts = contracts.join(priced, "cntrID", "left_semi")
    return join_lookup(f.finished_values, contracts, ["cntrID"], hot or {}) \
        .filter("cntr_result = 0 or price > 0")


def sample_codes(f: Facts, stats: Statistics, values: DataFrame,
                 hot: dict[str, list]) -> DataFrame:
    """Codes of each chosen (contract, supplier), with the code and (supplier, code) counts.

    Works on narrow distinct keys, so product lines are folded before anything is multiplied. A
    contract may have very many suppliers and very many codes, so the two are dealt as a grid.
    """
    # Staged, as they are measured before they are joined.
    pairs = stage(values.select("cntrID", "supID").distinct(), "pairs")
    contract_codes = code_ops.contract_codes(f).select("cntrID", "okpdID", "okpd")
    supplier_codes = stats.okpd_sup_stats.select(
        F.col("SupID").alias("supID"), F.col("OkpdID").alias("okpdID"),
        F.col("cntr_num").alias("sup_okpd_cntr_num"))
    code_counts = stats.okpd_stats.select(
        F.col("OkpdID").alias("okpdID"), F.col("cntr_num").alias("okpd_cntr_num"),
        F.col("good_cntr_num").alias("okpd_good_cntr_num"))
    contract_codes = stage(contract_codes.join(pairs.select("cntrID").distinct(), "cntrID",
                                               "left_semi"), "contract_codes")
    exploded = join_grid(pairs, contract_codes, ["cntrID"], ["supID"], ["okpdID"])
    exploded = join_lookup(exploded, code_counts, ["okpdID"], hot, deal_by="cntrID")
    return join_lookup(exploded, supplier_codes, ["supID", "okpdID"], hot, deal_by="cntrID")


def supplier_profile(f: Facts, stats: Statistics, subjects: DataFrame) -> DataFrame:
    """One row per supplier: its statistics and federal subject."""
    territory = supplier_territory(f.wh, subjects).withColumnRenamed("sup_fed_ter", "sup_ter")
    return stats.sup_stats.join(territory, "SupID", "left").withColumnsRenamed(
        {"SupID": "supID", "sup_cntr_avg_penalty": "sup_cntr_avg_penalty_share"})


def customer_profile(f: Facts, stats: Statistics, subjects: DataFrame) -> DataFrame:
    """One row per customer: its statistics, type and federal subject."""
    types = f.wh.org.select(F.col("ID").alias("OrgID"), F.col("RefTypeOrg").alias("org_type"))
    territory = customer_territory(f.wh, subjects).withColumnRenamed("org_fed_ter", "org_ter")
    return (stats.org_stats.join(types, "OrgID").join(territory, "OrgID", "left")
            .withColumnRenamed("OrgID", "orgID"))


def hot_parties(f: Facts) -> dict[str, list]:
    """Contracts, suppliers, customers, prices and codes that hold a large share of the rows."""
    return {**hot_keys(f.finished_values, ["cntrID", "supID", "orgID", "price"]),
            **hot_keys(f.finished_products, ["okpdID"])}


#: Key of a party, its contract count, its share, and the rows counted for the share.
SIMILAR = (("supID", "sup_cntr_num", "sup_sim_price_share", "_sup_similar"),
           ("orgID", "org_cntr_num", "org_sim_price_share", "_org_similar"))


def with_similar_counts(df: DataFrame, f: Facts, asked: DataFrame, hot: dict[str, list],
                        key: str, found: str) -> DataFrame:
    """Adds the number of finished contracts of the party ``key`` with a similar price.

    ``asked`` holds (key, price) of the rows.
    """
    counts = similar_price_counts(f.finished_values, asked, key)
    df = join_lookup(df, counts, [key, "price"], hot, how="left")
    return df.withColumn(found, F.coalesce("similar", F.lit(0))).drop("similar")


def similar_shares(df: DataFrame) -> DataFrame:
    """The counted rows as shares of the parties' contracts."""
    for _, total, out, found in SIMILAR:
        df = df.withColumn(out, share(F.col(found), total)).drop(found)
    return df


def with_similar_shares(df: DataFrame, f: Facts, asked: DataFrame,
                        hot: dict[str, list]) -> DataFrame:
    """Adds the similar-price shares of both parties.

    ``asked`` holds (supID, orgID, price) of the rows, ``df`` also the contract counts.
    """
    for key, _, _, found in SIMILAR:
        df = with_similar_counts(df, f, asked, hot, key, found)
    return similar_shares(df)


def build_sample(f: Facts, stats: Statistics, mode: str = "hash",
                 existing: DataFrame | None = None,
                 hot: dict[str, list] | None = None) -> DataFrame:
    """The labelled sample.

    The chosen value rows are staged, as four parts of the plan read them. What adds one column is
    joined to them first and the wide profiles last, and a step is staged before the next shuffles
    its rows, so the disk holds the shuffles of one step. Profiles are joined to value rows and code
    counts to (contract, supplier, code) keys; only the last join multiplies rows by the codes of
    their contract. The key is unique because value IDs are and because codes are distinct per
    contract.
    """
    hot = hot_parties(f) if hot is None else hot
    subjects = federal_subjects(f.wh)
    values = stage(price_flags(chosen_values(f, stats.cntr_stats, mode, existing, hot), f.s),
                   "chosen_values")
    together = stats.sup_org_stats.select(
        F.col("SupID").alias("supID"), F.col("OrgID").alias("orgID"),
        F.col("cntr_num").alias("cntr_num_together"))
    rows = stage(join_lookup(values, together, ["supID", "orgID"], hot), "with_pairs")
    for key, _, _, found in SIMILAR:
        before = rows
        rows = stage(with_similar_counts(before, f, values, hot, key, found), f"with{found}")
        discard(before)
    before = rows
    rows = join_lookup(before, supplier_profile(f, stats, subjects), ["supID"], hot)
    rows = join_lookup(rows, customer_profile(f, stats, subjects), ["orgID"], hot)
    rows = stage(similar_shares(rows), "with_profiles")
    discard(before)
    # A (contract, supplier) may have many value rows and many codes. Lookups keep the number of
    # its rows, so the chosen values tell it.
    both = ["cntrID", "supID"]
    codes = stage(sample_codes(f, stats, values, hot), "codes")
    rows = join_grid(rows, codes, both, ["valID"], ["okpdID"], grids(values, codes, both))
    return rows.select(*(F.col(c.name).cast(c.dataType).alias(c.name)
                         for c in DERIVED["sample"].fields))


def refresh_similar_shares(sample: DataFrame, f: Facts,
                           hot: dict[str, list] | None = None) -> DataFrame:
    """Fills the similar-price shares of rows that lack one; other rows are left alone."""
    hot = hot_parties(f) if hot is None else hot
    names = ["sup_sim_price_share", "org_sim_price_share"]

    def compute(part: DataFrame) -> DataFrame:
        return with_similar_shares(part.drop(*names), f, part, hot)

    return refresh_missing(sample, names, compute)
