"""The source warehouse: twelve tables read from Parquet, catalog tables or JDBC."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlens.sources.schemas import SOURCE

# Table names of the source warehouse.
WAREHOUSE_NAMES = {
    "contracts": "DV.d_OOS_Contracts",
    "value": "DV.f_OOS_Value",
    "product": "DV.f_OOS_Product",
    "products": "DV.d_OOS_Products",
    "okpd2": "DV.d_OOS_OKPD2",
    "suppliers": "DV.d_OOS_Suppliers",
    "org": "DV.d_OOS_Org",
    "closures": "DV.d_OOS_ClosContracts",
    "termin_reason": "DV.d_OOS_TerminReason",
    "penalties": "DV.d_OOS_Penalties",
    "territory": "DV.d_Territory_RF",
    "fed_subject": "guest.fed_subject_rf",
}


@dataclass(frozen=True)
class Condition:
    """A condition on one column of a warehouse table: ``after`` (greater than) or ``among``."""

    column: str
    after: int | None = None
    among: tuple[int, ...] | None = None

    def holds(self) -> Column:
        column = F.col(self.column)
        return column > self.after if self.among is None else column.isin(*self.among)


class Warehouse:
    """The twelve tables as attributes; each is opened when it is first asked for."""

    contracts: DataFrame
    value: DataFrame
    product: DataFrame
    products: DataFrame
    okpd2: DataFrame
    suppliers: DataFrame
    org: DataFrame
    closures: DataFrame
    termin_reason: DataFrame
    penalties: DataFrame
    territory: DataFrame
    fed_subject: DataFrame

    def __init__(self, spark: SparkSession, open_table: Callable[[str], DataFrame],
                 open_where: Callable[[str, tuple], DataFrame | None] | None = None):
        self.spark = spark
        self._open, self._open_where = open_table, open_where

    def where(self, name: str, *conditions: Condition) -> DataFrame:
        """A table's rows under all conditions.

        A source whose columns are not stored as they are read here may open the table with the
        conditions in its own terms (``open_where``), so that they reach its scan; for the others
        they are filters, which do so by themselves.
        """
        table = self._open_where(name, conditions) if self._open_where else None
        table = getattr(self, name) if table is None else table
        for condition in conditions:
            table = table.filter(condition.holds())
        return table

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SOURCE:
            raise AttributeError(name)
        table = self._open(name)
        setattr(self, name, table)
        return table


def read_parquet(spark: SparkSession, root: str) -> Warehouse:
    """``<root>/<table>`` Parquet folders with the declared schemas (no inference)."""
    return Warehouse(
        spark, lambda name: spark.read.schema(SOURCE[name]).parquet(f"{root}/{name}"))


def read_tables(spark: SparkSession, names: dict[str, str] | None = None) -> Warehouse:
    """Catalog tables, by default under the names the warehouse uses."""
    names = {**WAREHOUSE_NAMES, **(names or {})}
    return Warehouse(
        spark, lambda name: spark.table(names[name]).select(*SOURCE[name].fieldNames()))


def of_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> Warehouse:
    """A warehouse over DataFrames that exist already."""
    return Warehouse(spark, tables.__getitem__)


def read_jdbc(spark: SparkSession, url: str, options: dict[str, str] | None = None,
              split_bounds: dict[str, tuple[str, int, int, int]] | None = None) -> Warehouse:
    """A live warehouse over JDBC.

    ``split_bounds`` maps a table to (numeric column, lower, upper, partitions) so that large
    facts are read by many tasks rather than through one connection.
    """
    split_bounds = split_bounds or {}

    def load(name: str) -> DataFrame:
        reader = (spark.read.format("jdbc").option("url", url)
                  .option("dbtable", WAREHOUSE_NAMES[name]).options(**(options or {})))
        if name in split_bounds:
            column, low, high, parts = split_bounds[name]
            reader = (reader.option("partitionColumn", column).option("lowerBound", low)
                      .option("upperBound", high).option("numPartitions", parts))
        return reader.load().select(*SOURCE[name].fieldNames())

    return Warehouse(spark, load)
