"""Stage tables: written once to the cluster's shared folder, read back by every consumer."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="tenderlens-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, on the default file system unless it names one.

    Only a local session without that setting gets a folder of its own, one per application; on a
    cluster a folder of one machine would not survive the loss of that machine, so there the
    setting must be given. That it is shared by the cluster, be it by a mount, is for the caller.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        return _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


#: Folders of the stages that go when the innermost ``passing`` block ends.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of the shared file system; those that are gone are left alone."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the stages that are written in the block when it ends, but for lasting ones.

    What leaves the block must not read them any more: a lasting stage, or rows on the driver.
    """
    token = _passing.set(folders := [])
    try:
        yield
    finally:
        _passing.reset(token)
        delete_folders(spark, folders)


def discard(staged: DataFrame) -> None:
    """Deletes the files of a table as ``stage`` returned it, which nothing reads any more."""
    delete_folders(staged.sparkSession,
                   sorted({file.rsplit("/", 1)[0] for file in staged.inputFiles()}))


def stage(df: DataFrame, name: str = "stage", lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    Cuts the lineage, so a lost executor re-reads files instead of recomputing the plan, and
    gives the planner true sizes: sides that fit are broadcast, others are shuffled. All stages
    of an application lie in one folder, which may be deleted when it has ended. In a ``passing``
    block a stage goes with the block unless it is ``lasting``.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/tenderlens/{application}/{name}-{uuid.uuid4().hex}"
    folders = _passing.get()
    if folders is not None and not lasting:
        folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_all(frames: dict[str, DataFrame], at_a_time: int = 2) -> dict[str, DataFrame]:
    """Stages tables that do not depend on each other; a few jobs share the cluster at a time, and
    the disk holds the shuffles of as many."""
    with ThreadPoolExecutor(at_a_time) as pool:
        # Threads know the block they were started in by their context.
        staged = {name: pool.submit(copy_context().run, stage, df, name)
                  for name, df in frames.items()}
    return {name: future.result() for name, future in staged.items()}


def small_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A handful of literal rows as a local relation, whose size the planner knows."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(
        pa.table([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow))


def create_table(spark: SparkSession, name: str, schema: StructType,
                 partition_by: list[str] | None = None) -> None:
    """Create an empty Parquet table unless it exists."""
    if spark.catalog.tableExists(name):
        return
    writer = small_table(spark, [], schema).write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def append(df: DataFrame, name: str) -> None:
    """Append by column name, never by position."""
    target = df.sparkSession.table(name)
    df.select(*(df[c].cast(target.schema[c].dataType).alias(c) for c in target.columns)) \
        .write.mode("append").format("parquet").saveAsTable(name)


def add_columns(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    """Add columns (name -> SQL type) that the table does not have yet; old rows read NULL."""
    present = set(spark.table(name).columns)
    missing = {c: t for c, t in columns.items() if c not in present}
    if missing:
        listed = ", ".join(f"{c} {t}" for c, t in missing.items())
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({listed})")
