"""Refreshed statistics against statistics counted from scratch."""

import random

import pytest

from tenderlens.operators import maintenance
from tenderlens.operators.facts import Facts
from tenderlens.plans.maintenance import StatisticsStore
from tenderlens.plans.statistics import statistics

SUPPLIERS, CUSTOMERS = range(1, 7), range(1, 5)


def make_tables(seed, contracts=60):
    rnd = random.Random(seed)
    out = {"contracts": [], "value": [], "product": [], "closures": [], "penalties": []}
    for c in range(contracts):
        out["contracts"].append((c, rnd.choice([2, 3, 4]), rnd.choice([20100101, 20170101]),
                                 20180101, 1, str(c)))
        for v in range(rnd.randint(0, 4)):
            out["value"].append((c * 10 + v, c, rnd.choice([*SUPPLIERS, 99]), rnd.choice(CUSTOMERS),
                                 rnd.choice([0, 50, 100]), 80, rnd.randint(1, 3)))
        for _ in range(rnd.randint(0, 5)):
            out["product"].append((c, rnd.choice([100, 101, 102]), rnd.choice(SUPPLIERS)))
        for _ in range(rnd.randint(0, 2)):
            out["closures"].append((c, rnd.choice([1, 1, 2, 3]), 1.0))
        for _ in range(rnd.randint(0, 2)):
            out["penalties"].append((c, rnd.choice([None, 5, 10])))
    return out


FIXED = dict(products=[(100, 1), (101, 1), (102, 2)], okpd2=[(1, "10.11"), (2, "20.22")],
             suppliers=[(i, None) for i in SUPPLIERS], org=[(i, 1, None) for i in CUSTOMERS],
             termin_reason=[(1, 0), (2, 8326974), (3, 8361022)])


def of_contracts(tables, keep):
    owner = {"contracts": 0, "value": 1, "product": 0, "closures": 0, "penalties": 0}
    return {t: [r for r in rows if keep(r[owner[t]])] for t, rows in tables.items()}


def same(rows, store, wh, settings):
    want = statistics(Facts(wh, settings))
    got = store.statistics(wh, settings)
    for name, df in vars(want).items():
        assert rows(getattr(got, name), *df.columns) == rows(df), name


def test_loads_equal_one_from_scratch(spark, warehouse, settings, rows, tmp_path):
    tables = make_tables(1)
    store = StatisticsStore.create(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.statistics(warehouse(**FIXED), settings)
    first = warehouse(**of_contracts(tables, lambda c: c < 30), **FIXED)
    assert store.refresh(first, settings) == 30
    # New contracts, other rows of old ones, one that is gone, a new supplier without contracts.
    other = make_tables(2)
    later = {t: [*r1, *r2] for (t, r1), r2 in zip(
        of_contracts(tables, lambda c: 5 <= c or c == 0).items(),
        of_contracts(other, lambda c: 1 <= c < 4).values())}
    second = warehouse(**later, **{**FIXED, "suppliers": [*FIXED["suppliers"], (99, None)]})
    assert store.refresh(second, settings) == 30 + 3 + 1
    same(rows, store, second, settings)


def test_named_contracts_and_an_unfinished_refresh(spark, warehouse, settings, rows, tmp_path,
                                                   monkeypatch, table):
    tables = make_tables(3, 20)
    store = StatisticsStore.create(spark, str(tmp_path / "store"))
    first = warehouse(**of_contracts(tables, lambda c: c < 15), **FIXED)
    store.refresh(first, settings)
    whole = warehouse(**tables, **FIXED)
    with monkeypatch.context() as m:
        m.setattr(StatisticsStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.refresh(whole, settings)
    same(rows, store, first, settings)
    changed = table("cntrID long", [(i,) for i in range(15, 20)] + [(15,), (3,)])
    assert store.refresh(whole, settings, changed) == 6
    same(rows, store, whole, settings)


def test_digest_tells_repeated_rows(warehouse, rows):
    one = warehouse(product=[(1, 100, 1)] * 2 + [(2, 100, 1), (2, 101, 1)])
    two = warehouse(product=[(1, 100, 1)] * 4 + [(2, 101, 1), (2, 100, 1)])
    changed = maintenance.changed_contracts(maintenance.digests(one), maintenance.digests(two))
    assert rows(changed) == [(1,)]
