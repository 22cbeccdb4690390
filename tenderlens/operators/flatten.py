"""From one row per product code to one row per contract.

Where file order decided which row of a contract was kept, the order here is okpdID, valID,
supID, orgID. "Keep the first row" is a minimum over (order, row), which combines partially
before the shuffle, so a contract with very many rows is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenderlens.functions.scalars import flag, prefix, ratio
from tenderlens.operators.skew import join_lookup
from tenderlens.sources.staging import stage

ROW_ORDER = ("okpdID", "valID", "supID", "orgID")
# Suppliers, and counts of them by prefix, up to which a task holds the lookup: some 100 MB.
MOST_SUPPLIERS, MOST_COUNTS = 500_000, 3_000_000
PREFIX_LENGTH = 2


def prefix_column(length: int = PREFIX_LENGTH) -> str:
    return f"okpd{length}"


def add_prefix(rows: DataFrame, length: int = PREFIX_LENGTH) -> DataFrame:
    return rows.withColumn(prefix_column(length), prefix("okpd", length))


def prefix_codes(rows: DataFrame, column: str) -> list[str]:
    """Sorted distinct codes: a fitted parameter that fixes the one-hot columns.

    The column count of the flat table grows with it, so more codes than
    ``spark.sql.pivotMaxValues`` are an error, as in any pivot.
    """
    limit = int(rows.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = rows.select(column).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} codes in {column}; shorten the prefix")
    return sorted(r[0] for r in found if r[0] is not None)


def keep_first(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ROW_ORDER) -> DataFrame:
    """The first row per key; grouping combines partially, unlike a window."""
    order = tuple(c for c in order if c not in keys)
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*rows.columns)




def code_totals(rows: DataFrame, column: str) -> DataFrame:
    """(prefix, okpd_cntr_num, okpd_good_cntr_num): each full code counted once."""
    counts = F.struct(*ROW_ORDER, "okpd_cntr_num", "okpd_good_cntr_num")
    per_code = rows.groupBy("okpd", column).agg(F.min(counts).alias("c"))
    return per_code.groupBy(column).agg(
        F.coalesce(F.sum("c.okpd_cntr_num"), F.lit(0)).alias("okpd_cntr_num"),
        F.coalesce(F.sum("c.okpd_good_cntr_num"), F.lit(0)).alias("okpd_good_cntr_num"))


def supplier_code_totals(rows: DataFrame, column: str) -> DataFrame:
    """(supID, prefix, sup_okpd_cntr_num): each (supplier, full code) counted once."""
    counts = F.struct("okpdID", "valID", "orgID", "sup_okpd_cntr_num")
    per_code = rows.groupBy("supID", "okpd", column).agg(F.min(counts).alias("c"))
    return per_code.groupBy("supID", column).agg(
        F.coalesce(F.sum("c.sup_okpd_cntr_num"), F.lit(0)).alias("sup_okpd_cntr_num"))


def roll_up_codes(rows: DataFrame, length: int = PREFIX_LENGTH,
                  hot: dict | None = None,
                  most_suppliers: int = MOST_SUPPLIERS) -> DataFrame:
    """Code counts replaced by those of the code's prefix; adds the prefix column.

    The rows are the widest there are. Counts of suppliers are measured, and up to a fixed size a
    task looks them up, so that the rows stay where they lie, those of a contract together; beyond
    it rows and counts are shuffled. Hot suppliers may be hot under any of the few prefixes.
    """
    column = prefix_column(length)
    rows = add_prefix(rows, length)
    order = rows.columns
    # One row per prefix. Staged, so that the planner sees its size and need not shuffle the
    # rows by prefix when it fits a broadcast.
    out = rows.drop("okpd_cntr_num", "okpd_good_cntr_num").join(
        stage(code_totals(rows, column), "code_totals"), column)
    out = out.drop("sup_okpd_cntr_num")
    totals = stage(supplier_code_totals(rows, column), "supplier_code_totals").filter(
        F.col("supID").isNotNull() & F.col(column).isNotNull())
    found = totals.agg(F.count("*").alias("n"), F.countDistinct("supID").alias("keys")).first()
    if found["keys"] <= most_suppliers and found["n"] <= MOST_COUNTS:
        # A row per supplier takes a fraction of a row per supplier and prefix.
        by_code = totals.groupBy("supID").agg(F.map_from_entries(F.collect_list(
            F.struct(column, "sup_okpd_cntr_num"))).alias("_counts"))
        out = out.join(F.broadcast(by_code), "supID") \
            .withColumn("sup_okpd_cntr_num", F.element_at("_counts", F.col(column))) \
            .filter("sup_okpd_cntr_num is not null")
    else:
        out = join_lookup(out, totals, ["supID", column], hot or {}, any_value=(column,))
    return out.select(*order)


def code_shares(rows: DataFrame) -> DataFrame:
    """Adds the good share of the code and the supplier's share of contracts under it."""
    return (rows.withColumn("okpd_good_cntr_share", ratio("okpd_good_cntr_num", "okpd_cntr_num"))
            .withColumn("sup_okpd_cntr_share", ratio("sup_okpd_cntr_num", "sup_cntr_num")))


def codes_per_contract(rows: DataFrame) -> DataFrame:
    """(cntrID, okpd_num): rows of the contract, before codes are shortened and folded."""
    return rows.groupBy("cntrID").agg(F.count("*").alias("okpd_num"))


def multi_hot_columns(found: Column, column: str, codes: list[str]) -> list[Column]:
    """One 0/1 column per code: is it among the found ones."""
    return [flag(F.array_contains(found, c)).alias(f"{column}_{c}") for c in codes]


def multi_hot(rows: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """(cntrID, <prefix>_<code>...): union of the codes of the contract.

    The codes of a contract are one set, which combines before the shuffle and holds no more
    than the distinct codes.
    """
    found = rows.groupBy("cntrID").agg(F.collect_set(column).alias("_codes"))
    return found.select("cntrID", *multi_hot_columns(F.col("_codes"), column, codes))


def good_share_range(rows: DataFrame, column: str) -> DataFrame:
    """Min, mean and max good share over the distinct prefixes of a contract."""
    share = rows.groupBy("cntrID", column).agg(F.min("okpd_good_cntr_share").alias("share"))
    return share.groupBy("cntrID").agg(
        F.min("share").alias("okpd_good_share_min"),
        F.avg("share").alias("okpd_good_share_mean"),
        F.max("share").alias("okpd_good_share_max"))


def supplier_specialisation(rows: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """(supID, socs_<code>...): share of the supplier's contracts per prefix, 0 if none.

    ``rows`` are all rows of a supplier, or one kept row per contract to reproduce a vector
    that knows only the first prefix of each contract.
    """
    per_code = rows.groupBy("supID", column).agg(F.max("sup_okpd_cntr_share").alias("share"))
    wide = per_code.groupBy("supID").pivot(column, codes).agg(F.first("share"))
    return wide.select("supID", *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"socs_{c}")
                                  for c in codes))


def flatten(rows: DataFrame, codes: list[str], length: int = PREFIX_LENGTH,
            first_only: bool = False, hot: dict[str, list] | None = None) -> DataFrame:
    """One row per contract from rolled-up rows.

    One grouped pass yields the kept row, the row count and the set of (code, good share), from
    which the multi-hot columns and the range of the share follow: one aggregate, however many
    codes there are. The supplier's vector joins the folded rows, not the exploded ones.
    """
    column = prefix_column(length)
    rows = code_shares(rows)
    rest = [c for c in rows.columns if c not in ("cntrID", *ROW_ORDER)]
    pair = F.struct(F.col(column).alias("code"), F.col("okpd_good_cntr_share").alias("share"))
    grouped = rows.groupBy("cntrID").agg(
        F.min(F.struct(*ROW_ORDER, *rest)).alias("first"), F.count("*").alias("okpd_num"),
        F.collect_set(pair).alias("pairs"))
    listed = F.array(*(F.lit(c) for c in codes)).cast("array<string>")
    shares = F.transform(listed, lambda c: F.array_max(F.transform(
        F.filter("pairs", lambda x: x["code"] == c), lambda x: x["share"])))
    grouped = grouped.select("cntrID", "first", "okpd_num", shares.alias("shares"),
                             *multi_hot_columns(F.col("pairs.code"), column, codes))
    known = F.filter("shares", lambda s: s.isNotNull())
    flat = grouped.withColumns({
        "okpd_good_share_min": F.array_min("shares"),
        "okpd_good_share_mean": F.try_divide(
            F.aggregate(known, F.lit(0.0), lambda a, s: a + s), F.size(known)),
        "okpd_good_share_max": F.array_max("shares")})
    kept = [c for c in rows.columns if c not in ("cntrID", "okpd_good_cntr_share")]
    flat = flat.select(
        "cntrID", *(F.col(f"first.{c}").alias(c) for c in kept), "okpd_num",
        "okpd_good_share_min", "okpd_good_share_mean", "okpd_good_share_max",
        *(f"`{column}_{c}`" for c in codes))
    vector = supplier_specialisation(flat if first_only else rows, column, codes)
    return join_lookup(flat, vector, ["supID"], hot or {}, deal_by="cntrID")


def multi_code_contracts(rows: DataFrame, hot: dict | None = None) -> DataFrame:
    """Rows of contracts with more than one row; those of hot contracts are dealt by code."""
    several = rows.groupBy("cntrID").agg(F.count("*").alias("n")).filter("n > 1")
    return join_lookup(rows, several.select("cntrID"), ["cntrID"], hot or {}, "left_semi",
                       deal_by="okpdID")


def multi_code_label_split(rows: DataFrame) -> DataFrame:
    """(cntr_result, count) over contracts with more than one row."""
    per_contract = rows.groupBy("cntrID").agg(
        F.count("*").alias("n"), F.min("cntr_result").alias("cntr_result")).filter("n > 1")
    return per_contract.groupBy("cntr_result").agg(F.count("*").alias("count"))


def unique_codes_by_length(rows: DataFrame) -> DataFrame:
    """(okpd_sym, count): distinct prefixes for every length up to the longest code."""
    longest = rows.agg(F.max(F.length("okpd"))).first()[0] or 0
    # Shorter codes count as themselves at greater lengths.
    lengths = F.explode(F.array(*(F.lit(i) for i in range(1, longest + 1))))
    prefixes = (rows.select("okpd").distinct().withColumn("okpd_sym", lengths)
                .select("okpd_sym", F.expr("substring(okpd, 1, okpd_sym)").alias("p")).distinct())
    return prefixes.groupBy("okpd_sym").agg(F.count("*").alias("count"))
