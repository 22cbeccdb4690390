"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime-changeable settings: AQE sizes partitions, splits skewed joins and turns a join into a
# broadcast only after it has seen the real size of a side.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even if the aggregation behind it then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A stage sorts and aggregates several tables of a partition at once, in some 30 bytes for a
    # byte read. Without a bound a task gets an even share of the input, however large that is.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
    # Shuffle files go with the action that wrote them; else they stay until the driver's JVM
    # happens to collect its garbage, and the disk holds the shuffles of all steps at once.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Partitions a shuffle is written in at least; AQE joins small ones up to the advisory size, so
# tasks keep that size up to 6 GB a shuffle. For more, raise spark.sql.shuffle.partitions.
LEAST_PARTITIONS = 800
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    wanted = (spark.conf.get(INITIAL, None), spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL, str(max(LEAST_PARTITIONS, *(int(n) for n in wanted if n))))
    return spark


def local_session(cores: int | str = "*", app: str = "tenderlens") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
