"""Conditions on warehouse tables reach the scan, whatever form the source stores them in."""

import re
from datetime import date

import pytest

from tenderlens.operators.facts import finished_contracts, recent
from tenderlens.sources import star
from tenderlens.sources.warehouse import Condition

FOLDER = "/root/testdata/sf0.001"


def scan_of(df, column):
    plan = df._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "FileScan" in x and column in x)
    return re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line)[1]


@pytest.mark.parametrize("number, want", [
    (19970000, date(1997, 1, 1)), (19970101, date(1997, 1, 2)), (19970228, date(1997, 3, 1)),
    (19960228, date(1996, 2, 29)), (19971231, date(1998, 1, 1)), (19971299, date(1998, 1, 1)),
    (19971300, date(1998, 1, 1)), (19970100, date(1997, 1, 1)), (19970231, date(1997, 3, 1))])
def test_first_day_after(number, want):
    assert star.first_day_after(number) == want


def test_date_and_stage_reach_the_scan(spark):
    wh = star.load(spark, FOLDER, execution=False, pmp=False)
    pushed = scan_of(finished_contracts(wh, star.SETTINGS), "o_orderdate")
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01" in pushed
    assert "In(o_orderstatus, [F,P])" in pushed
    assert "GreaterThanOrEqual(o_orderdate" in scan_of(
        wh.where("contracts", recent(star.SETTINGS)), "o_orderdate")


@pytest.mark.parametrize("conditions", [
    (Condition("RefSignDate", after=19970315),), (Condition("RefStage", among=(3,)),),
    (Condition("RefStage", among=(2,)),), (Condition("RefStage", among=(2, 4)),),
    (Condition("RefStage", among=(3, 4)), Condition("RefSignDate", after=19980000)),
    (Condition("RefTypePurch", among=(1, -1)), Condition("ID", after=500)), ()])
@pytest.mark.parametrize("execution", [False, True])
def test_translated_conditions_keep_the_same_rows(spark, rows, conditions, execution):
    wh = star.load(spark, FOLDER, execution=execution, pmp=False)
    plain = wh.contracts
    for c in conditions:
        plain = plain.filter(c.holds())
    assert rows(wh.where("contracts", *conditions)) == rows(plain)


def test_other_tables_and_sources_take_plain_filters(spark, warehouse, rows):
    wh = star.load(spark, FOLDER)
    assert wh.where("org", Condition("ID", after=140)).count() == wh.org.filter("ID > 140").count()
    plain = warehouse(contracts=[(1, 3, 20170101, None, 1, "a"), (2, 3, 20100101, None, 1, "b")])
    assert rows(plain.where("contracts", Condition("RefSignDate", after=20120000)), "ID") == [(1,)]
