"""Presents the order / line / part star schema of the test data as a procurement warehouse.

Orders act as contracts, (order, supplier) pairs as contract values, lines as product lines and
closures, late taxes as penalties, nations and regions as the territory tree. Money goes through
integer cents so that results do not depend on summation order.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlens.settings import Settings
from tenderlens.sources.schemas import SOURCE
from tenderlens.sources.staging import small_table
from tenderlens.sources.warehouse import Condition, Warehouse

# Order dates start in 1995, so "recent" starts in 1997 here.
SETTINGS = Settings(init_date=19970000)

# Reason codes dealt over severed lines, customer segments, part types.
SEVERANCE_CODES = (8326974, 8326975, 8361022, 8361023, 8724082, 8724083)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

# The stage of a contract by the status of its order.
STAGES, OTHER_STAGE = {"F": 3, "P": 4}, 2

# Declared, so that opening a table reads no file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _yyyymmdd(column: str) -> Column:
    return F.date_format(F.col(column), "yyyyMMdd").cast("int")


def _position(column: str, values: tuple[str, ...]) -> Column:
    """1-based position of the value in a fixed list."""
    return F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int")


def _okpd_id() -> Column:
    return (100 * _position("p_type", PART_TYPES)
            + F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")).cast("int")


def first_day_after(yyyymmdd: int) -> date:
    """The first day whose number is greater; the number need not be that of a day."""
    year, month, day = yyyymmdd // 10000, yyyymmdd // 100 % 100, yyyymmdd % 100
    if month > 12:
        return date(year + 1, 1, 1)
    if month < 1:
        return date(year, 1, 1)
    return date(year, month, 1) + timedelta(days=min(day, monthrange(year, month)[1]))


def orders_where(orders: DataFrame, conditions: tuple[Condition, ...]) -> DataFrame:
    """Orders whose contracts may fulfil the conditions, by the columns as they are stored."""
    for c in conditions:
        if c.column == "RefSignDate" and c.after is not None:
            orders = orders.filter(
                f"o_orderdate >= TIMESTAMP_NTZ'{first_day_after(c.after)} 00:00:00'")
        elif c.column == "RefStage" and c.among is not None and OTHER_STAGE not in c.among:
            orders = orders.filter(F.col("o_orderstatus").isin(
                *(status for status, stage in STAGES.items() if stage in c.among)))
    return orders


def contracts(orders: DataFrame, lines: DataFrame, execution: bool) -> DataFrame:
    stage = F.lit(OTHER_STAGE)
    for status, number in STAGES.items():
        stage = F.when(F.col("o_orderstatus") == status, number).otherwise(stage)
    purchase = F.substring("o_orderpriority", 1, 1).cast("int")
    if execution:
        last_ship = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.max("l_shipdate").alias("last_ship"))
        orders = orders.join(last_ship, "o_orderkey", "left")
        exec_date = _yyyymmdd("last_ship")
    else:
        exec_date = F.lit(None).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("ID"),
        stage.alias("RefStage"),
        _yyyymmdd("o_orderdate").alias("RefSignDate"),
        exec_date.alias("RefExecution"),
        F.when(purchase == 4, -1).otherwise(purchase).alias("RefTypePurch"),
        F.lpad(F.col("o_orderkey").cast("string"), 19, "0").alias("RegNum"),
    )


def value(orders: DataFrame, lines: DataFrame, customer: DataFrame, part: DataFrame,
          pmp: bool) -> DataFrame:
    measures = [(F.expr("sum(cents) div 100")).alias("Price")]
    lines = lines.withColumn("cents", _cents("l_extendedprice"))
    if pmp:
        lines = lines.join(
            part.select(F.col("p_partkey").alias("l_partkey"),
                        _cents("p_retailprice").alias("retail_cents")), "l_partkey")
        lines = lines.withColumn("pmp_cents",
                                 F.col("retail_cents") * F.col("l_quantity").cast("long"))
        measures.append(F.expr("sum(pmp_cents) div 100").alias("PMP"))
    pairs = lines.groupBy("l_orderkey", "l_suppkey").agg(*measures)
    if not pmp:
        pairs = pairs.withColumn("PMP", F.lit(None).cast("long"))
    segment = F.col("c_mktsegment")
    level = F.when(segment == "AUTOMOBILE", 1).when(segment == "BUILDING", 2).otherwise(3)
    buyers = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(
        customer.select(F.col("c_custkey").alias("o_custkey"), level.alias("RefLevelOrder")),
        "o_custkey")
    return pairs.join(buyers, "l_orderkey").select(
        (F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey")).alias("ID"),
        F.col("l_orderkey").alias("RefContract"),
        F.col("l_suppkey").alias("RefSupplier"),
        F.col("o_custkey").alias("RefOrg"),
        "Price", "PMP", "RefLevelOrder",
    )


def closures(lines: DataFrame) -> DataFrame:
    severed = ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
               & (F.round(F.col("l_discount") * 100) >= 8))
    dealt = F.element_at(F.array(*map(F.lit, SEVERANCE_CODES)),
                         ((F.col("l_orderkey") + F.col("l_linenumber")) % 6 + 1).cast("int"))
    return lines.filter("l_linenumber <= 5").select(
        F.col("l_orderkey").alias("RefContract"),
        F.when(severed, dealt).otherwise(0).cast("int").alias("RefTerminReason"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("FactPaid"),
    )


def penalties(lines: DataFrame) -> DataFrame:
    tax = F.round(F.col("l_tax") * 100).cast("long")
    accrual = F.expr("(cents * tax) div 10000")
    return (lines.withColumn("tax", tax).filter("tax >= 7")
            .withColumn("cents", _cents("l_extendedprice"))
            .select(F.col("l_orderkey").alias("RefContract"),
                    F.when(F.col("l_linenumber") != 7, accrual).alias("Accrual")))


def okpd2(part: DataFrame) -> DataFrame:
    code = F.concat(F.upper(F.substring("p_type", 1, 2)), F.lit("."),
                    F.lpad(F.regexp_extract("p_brand", r"(\d+)$", 1), 2, "0"))
    return part.select("p_type", "p_brand").distinct().select(
        _okpd_id().alias("ID"), code.alias("Code")).distinct()


def territory(region: DataFrame, nation: DataFrame) -> DataFrame:
    regions = region.select((1000 + F.col("r_regionkey")).alias("ID"),
                            F.lit(None).cast("int").alias("ParentID"))
    nations = nation.select((100 + F.col("n_nationkey")).alias("ID"),
                            (1000 + F.col("n_regionkey")).alias("ParentID"))
    leaves = nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    leaves = leaves.select(
        (10000 + 10 * F.col("n_nationkey") + F.col("k")).alias("ID"),
        F.when(F.col("n_nationkey") != 24, 100 + F.col("n_nationkey")).alias("ParentID"))
    return regions.unionByName(nations).unionByName(leaves)


def load(spark: SparkSession, root: str, execution: bool = True, pmp: bool = True) -> Warehouse:
    """Adapter over ``<root>/<table>.parquet``.

    ``execution`` and ``pmp`` say whether the planned end date and the maximum price are wanted;
    both cost an extra join here that column pruning cannot remove.
    """
    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")

    builders = {
        "contracts": lambda: contracts(table("orders"), table("lineitem"), execution),
        "value": lambda: value(table("orders"), table("lineitem"), table("customer"),
                               table("part"), pmp),
        "product": lambda: table("lineitem").selectExpr(
            "l_orderkey AS RefContract", "l_partkey AS RefProduct", "l_suppkey AS RefSupplier"),
        "products": lambda: table("part").select(F.col("p_partkey").alias("ID"),
                                                 _okpd_id().alias("RefOKPD2")),
        "okpd2": lambda: okpd2(table("part")),
        "suppliers": lambda: table("supplier").selectExpr(
            "s_suppkey AS ID",
            "CAST(IF(s_suppkey % 5 <> 0, 10000 + 10 * s_nationkey + s_suppkey % 3, NULL) AS INT) "
            "AS RefTerritory"),
        "org": lambda: table("customer").select(
            F.col("c_custkey").alias("ID"),
            _position("c_mktsegment", SEGMENTS).alias("RefTypeOrg"),
            F.when(F.col("c_custkey") % 100 != 0, 100 + F.col("c_nationkey"))
            .cast("int").alias("RefTerritory")),
        "closures": lambda: closures(table("lineitem")),
        "termin_reason": lambda: small_table(
            spark, [(c, c) for c in (0, *SEVERANCE_CODES)], SOURCE["termin_reason"]),
        "penalties": lambda: penalties(table("lineitem")),
        "territory": lambda: territory(table("region"), table("nation")),
        "fed_subject": lambda: table("region").selectExpr("1000 + r_regionkey AS ID",
                                                          "r_name AS Name"),
    }
    def where(name: str, conditions: tuple[Condition, ...]) -> DataFrame | None:
        if name != "contracts":
            return None
        return contracts(orders_where(table("orders"), conditions), table("lineitem"), execution)

    return Warehouse(spark, lambda name: builders[name](), where)
