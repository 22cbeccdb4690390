"""CSV stage files: headerless or headed input, headed output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from tenderlens.sources.schemas import DERIVED

# Stage files of the data preparation, in order.
STAGES = ("v2.1", "v2.2", "v2.3", "v2.4", "v2.5")


def sample_columns() -> list[str]:
    return DERIVED["sample"].fieldNames()


def read_header(spark: SparkSession, path: str, sep: str = ";") -> list[str]:
    """Column names of a headed CSV file (only the header row is read)."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].split(sep) if first else []


def read_headerless(spark: SparkSession, path: str, names: list[str],
                    types: StructType | None = None, sep: str = ";") -> DataFrame:
    """Headerless CSV; ``names`` come from elsewhere, ``types`` gives known column types."""
    known = {f.name: f.dataType for f in types.fields} if types else {}
    schema = StructType([StructField(n, known.get(n, StringType())) for n in names])
    return spark.read.csv(path, sep=sep, header=False, schema=schema)


def read_borrowed_header(spark: SparkSession, path: str, header_path: str,
                         extra: tuple[str, ...] = ("org_ter", "sup_ter"),
                         sep: str = ";") -> DataFrame:
    """Headerless CSV named by the header of another file plus the columns added since."""
    names = read_header(spark, header_path, sep) + list(extra)
    return read_headerless(spark, path, names, sep=sep)


def read_headed(spark: SparkSession, path: str, schema: StructType | None = None,
                sep: str = ",") -> DataFrame:
    """Headed CSV; with no schema the types are inferred (one more pass over the file)."""
    if schema is None:
        return spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    return spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def overview(df: DataFrame, rows: int = 5) -> tuple[tuple[int, int], DataFrame]:
    """(row count, column count) and the first rows, as looked at after each stage."""
    return (df.count(), len(df.columns)), df.limit(rows)
