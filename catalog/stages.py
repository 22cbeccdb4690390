"""Stage tables the queries read, derived by Spark from the tables of one folder.

As with the versioned stage files of the original workflow, a stage is written once per session
and read by all later steps. Statistics of single operators do not use them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlens.operators.facts import Facts
from tenderlens.operators.labels import contract_labels
from tenderlens.operators.sample import Statistics, build_sample
from tenderlens.plans.maintenance import StatisticsStore
from tenderlens.plans.preparation import Prepared, prepare
from tenderlens.plans.statistics import staged_statistics
from tenderlens.session import configure
from tenderlens.sources import star
from tenderlens.sources.schemas import SOURCE
from tenderlens.sources.staging import passing, shared_folder, stage
from tenderlens.sources.warehouse import of_tables

# Sampling by modulo, so that another engine can draw the same contracts.
SAMPLE_MODE = "modulo"


def lazy_facts(spark: SparkSession, folder: str) -> Facts:
    """Facts straight over the given tables; nothing is staged."""
    configure(spark)
    return Facts(star.load(spark, folder, execution=False, pmp=False), star.SETTINGS)


def full_facts(spark: SparkSession, folder: str) -> Facts:
    """The same with planned end dates and maximum prices."""
    configure(spark)
    return Facts(star.load(spark, folder), star.SETTINGS)


@dataclass
class Stages:
    """Stages of one folder in one session, each built on first use."""

    spark: SparkSession
    folder: str

    def __post_init__(self):
        self._built: dict[str, object] = {}

    def _once(self, name: str, build):
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    @property
    def facts(self) -> Facts:
        return self._once("facts", lambda: full_facts(self.spark, self.folder).staged())

    @property
    def statistics(self) -> Statistics:
        return self._once("statistics", lambda: staged_statistics(self.facts))

    @property
    def refreshed(self) -> Statistics:
        """Statistics loaded from an earlier warehouse, with fewer contracts and without their
        severances, and then refreshed by the contracts that have changed since."""
        def build() -> Statistics:
            now = star.load(self.spark, self.folder, execution=False, pmp=False)
            earlier = {"contracts": now.contracts.filter("RefSignDate < 20000000"),
                       "closures": now.closures.filter("RefTerminReason = 0")}
            before = of_tables(self.spark, {n: earlier.get(n, getattr(now, n)) for n in SOURCE})
            store = StatisticsStore.create(
                self.spark, f"{shared_folder(self.spark)}/tenderlens/store-{uuid.uuid4().hex}")
            store.refresh(before, star.SETTINGS)
            store.refresh(now, star.SETTINGS)
            return store.statistics(now, star.SETTINGS)

        return self._once("refreshed", build)

    @property
    def sample(self) -> DataFrame:
        def build() -> DataFrame:
            facts, statistics = self.facts, self.statistics
            with passing(self.spark):
                return stage(build_sample(facts, statistics, SAMPLE_MODE), "sample", lasting=True)

        return self._once("sample", build)

    @property
    def prepared(self) -> Prepared:
        return self._once("prepared", lambda: prepare(self.sample, keep_id=True))

    @property
    def clean(self) -> DataFrame:
        return self._once("clean", lambda: stage(self.prepared.clean, "clean"))


@lru_cache(maxsize=8)
def _stages(application: str, folder: str, spark: SparkSession) -> Stages:
    return Stages(spark, folder)


def stages(spark: SparkSession, folder: str) -> Stages:
    configure(spark)
    return _stages(spark.sparkContext.applicationId, folder, spark)


def scored_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed prediction table over all labelled contracts.

    The probability is a formula of the contract key and the label, with ties, 0 and 1, so that
    metrics can be checked by another engine without a trained model.
    """
    labels = contract_labels(lazy_facts(spark, folder)).filter("result is not null")
    probability = (F.pmod(F.col("CntrID") * 7919, F.lit(1001)) * 3 + 1000 * F.col("result")) / 4000
    return (labels.select(F.col("CntrID").alias("cntrID"), F.col("result").alias("label"),
                          probability.alias("probability"))
            .withColumn("prediction", (F.col("probability") >= 0.5).cast("int")))
