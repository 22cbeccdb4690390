"""Every query against its SQL counterpart on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from catalog.oracle import ORACLE
from catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if math.isnan(value) else float(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, "" if x is None else x) for x in t))


def test_registry():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLE) <= 11


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cursor.fetchall())


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    keys = ["valID", "cntrID", "supID", "orgID", "okpdID"]
    assert df.count() > 0 and df.count() == df.select(*keys).distinct().count()


def test_split_holds_both_classes_on_both_sides(spark):
    from catalog.stages import stages

    keys = stages(spark, FOLDER).clean.select("cntrID", "cntr_result")
    sides = QUERIES["train_valid_split"](spark, FOLDER).join(keys, "cntrID")
    side = next(c for c in sides.columns if c not in ("cntrID", "cntr_result"))
    counts = {(r[side], r.cntr_result): r["count"]
              for r in sides.groupBy(side, "cntr_result").count().collect()}
    assert len(counts) == 4
    valid = sum(n for (s, _), n in counts.items() if s == 1)
    assert 0.1 < valid / sum(counts.values()) < 0.3
