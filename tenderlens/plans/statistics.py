"""Warehouse to statistics tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tenderlens.operators import codes, entities
from tenderlens.operators.facts import Facts
from tenderlens.operators.labels import contract_labels
from tenderlens.operators.sample import Statistics, build_sample
from tenderlens.operators.upsert import new_rows
from tenderlens.sources.schemas import DERIVED
from tenderlens.sources.staging import append, create_table, stage, stage_all


def statistics(f: Facts) -> Statistics:
    """The six statistics tables as lazy plans."""
    return Statistics(
        cntr_stats=contract_labels(f),
        sup_stats=entities.supplier_stats(f),
        org_stats=entities.customer_stats(f),
        okpd_stats=codes.code_stats(f),
        okpd_sup_stats=codes.supplier_code_contracts(f),
        sup_org_stats=codes.supplier_customer_contracts(f),
    )


def staged_statistics(f: Facts) -> Statistics:
    """The same tables written once; each is read several times by later stages."""
    return Statistics(**stage_all(vars(statistics(f))))


def refresh_tables(spark: SparkSession, f: Facts, database: str) -> None:
    """Creates the statistics and sample tables in ``database`` if absent and loads all of them.

    Every table takes only rows whose key (its columns that may not be null) it does not hold yet,
    so a second load adds what is new and repeats nothing.
    """
    for name, schema in DERIVED.items():
        create_table(spark, f"{database}.{name}", schema)
    f = f.staged()
    stats = staged_statistics(f)
    sample = build_sample(f, stats, existing=spark.table(f"{database}.sample"))
    for name, df in {**vars(stats), "sample": sample}.items():
        key = [field.name for field in DERIVED[name] if not field.nullable]
        # Staged, as the plan reads the table that it is appended to.
        append(stage(new_rows(spark.table(f"{database}.{name}"), df, key), name),
               f"{database}.{name}")
