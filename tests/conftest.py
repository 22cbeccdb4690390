import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tenderlens.session import local_session  # noqa: E402
from tenderlens.settings import Settings  # noqa: E402
from tenderlens.sources.schemas import SOURCE  # noqa: E402
from tenderlens.sources.staging import small_table  # noqa: E402
from tenderlens.sources.warehouse import of_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tenderlens-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def settings():
    return Settings()


@pytest.fixture(scope="session")
def table(spark):
    """table('a int, b string', [(1, 'x')]) -> DataFrame"""
    def make(schema, rows):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def warehouse(spark):
    """A warehouse from the rows of a few tables; all others are empty."""
    def make(**rows):
        return of_tables(spark, {name: small_table(spark, rows.get(name, []), schema)
                                 for name, schema in SOURCE.items()})

    return make


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""
    def collect(df, *columns):
        got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(got, key=lambda t: tuple((x is not None, x) for x in t))

    return collect
