"""Stored statistics that are refreshed by the contracts that changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tenderlens.operators import maintenance
from tenderlens.operators.facts import Facts
from tenderlens.operators.labels import contract_labels
from tenderlens.operators.maintenance import KINDS
from tenderlens.operators.sample import Statistics
from tenderlens.settings import Settings
from tenderlens.sources.staging import passing, small_table, stage
from tenderlens.sources.warehouse import Warehouse

COMMIT = StructType([StructField("number", LongType()), StructField("batch", StringType())])
LABELS, DIGESTS = "labels", "digests"


class StatisticsStore:
    """States and logs under one folder of shared storage.

    A refresh writes folders of its own and is in force once its line stands in ``commits``, which
    is written last; what a refresh that did not get so far has left is never read. So a reader
    sees one load or the next, and a refresh that failed can simply be run again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> "StatisticsStore":
        store = cls(spark, folder)
        store._commit(0, "")
        return store

    def _commit(self, number: int, batch: str) -> None:
        small_table(self.spark, [(number, batch)], COMMIT).coalesce(1).write.mode("append") \
            .parquet(f"{self.folder}/commits")

    def _batches(self) -> list[str]:
        """Batches in force, one line for each load."""
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").orderBy("number")
        return [r.batch for r in rows.collect() if r.batch]

    def _log(self, name: str) -> DataFrame | None:
        """All stored rows of a kind with the number of their load."""
        out = None
        for i, batch in enumerate(self._batches()):
            part = self.spark.read.parquet(f"{self.folder}/log/{name}/{batch}") \
                .withColumn("load", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out

    def state(self, name: str) -> DataFrame | None:
        batches = self._batches()
        return self.spark.read.parquet(f"{self.folder}/state/{name}/{batches[-1]}") \
            if batches else None

    def _latest(self, name: str, value: str) -> DataFrame | None:
        """The last stored value of every contract; contracts that are gone have none."""
        log = self._log(name)
        return log and log.groupBy("cntrID").agg(F.max_by(
            F.struct(value, "gone"), "load").alias("x")).filter("not x.gone") \
            .select("cntrID", f"x.{value}")

    def refresh(self, wh: Warehouse, s: Settings, changed: DataFrame | None = None) -> int:
        """Brings the states up to date and returns how many contracts it touched.

        ``changed`` (cntrID) names contracts that are new, gone or have other rows; without it
        they are found by comparing digests of the whole warehouse with the stored ones. What it
        stages on the way goes when it has ended.
        """
        with passing(self.spark):
            return self._refresh(wh, s, changed)

    def _refresh(self, wh: Warehouse, s: Settings, changed: DataFrame | None) -> int:
        batch, number = uuid.uuid4().hex, len(self._batches())
        digests = stage(maintenance.digests(wh), "digests")
        if changed is None:
            before = self._latest(DIGESTS, "digest")
            changed = digests.select("cntrID") if before is None else \
                maintenance.changed_contracts(before, digests)
        changed = stage(changed.select("cntrID").distinct(), "changed")
        touched = changed.count()
        f = Facts(maintenance.restricted(wh, changed), s).staged()

        self._write_values(DIGESTS, batch, changed, digests, "digest")
        labels = contract_labels(f).select(F.col("CntrID").alias("cntrID"), "result")
        self._write_values(LABELS, batch, changed, labels, "result")
        for name, new in maintenance.contributions(f).items():
            log, state = self._log(name), self.state(name)
            delta = new
            if log is not None:
                own = log.join(changed, "cntrID", "left_semi")
                delta = new.unionByName(maintenance.taken_back(name, own))
            path = f"{self.folder}/log/{name}/{batch}"
            delta.write.parquet(path)
            parts = [self.spark.read.parquet(path)] + ([] if state is None else [state])
            maintenance.merged(name, *parts).write.parquet(f"{self.folder}/state/{name}/{batch}")
        self._commit(number + 1, batch)
        return touched

    def _write_values(self, name: str, batch: str, changed: DataFrame, values: DataFrame,
                      value: str) -> None:
        """The value of every changed contract, or that it is gone."""
        known = values.withColumn("known", F.lit(True))
        changed.join(known, "cntrID", "left").select(
            "cntrID", value, F.col("known").isNull().alias("gone")) \
            .write.parquet(f"{self.folder}/log/{name}/{batch}")

    def statistics(self, wh: Warehouse, s: Settings) -> Statistics:
        """The six statistics tables of the last load."""
        labels = self._latest(LABELS, "result")
        if labels is None:
            raise ValueError(f"nothing is loaded in {self.folder}")
        states = {name: self.state(name) for name in KINDS}
        return Statistics(cntr_stats=labels.withColumnRenamed("cntrID", "CntrID"),
                          **maintenance.tables(wh, s, states))
