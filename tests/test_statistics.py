"""Labels and entity statistics on micro tables, one case per semantic edge."""

import pytest

from tenderlens.operators import codes, entities, labels
from tenderlens.operators.entities import CUSTOMER, SUPPLIER
from tenderlens.operators.facts import Facts
from tenderlens.settings import Settings

SUP, ORG = 7, 9
BY_CUSTOMER, BY_SUPPLIER = 8326974, 8326975


def contract(i, stage=3, signed=20170101):
    return (i, stage, signed, 20180101, 1, str(i).zfill(19))


def value(i, contract_id, sup=SUP, org=ORG, price=100, pmp=100, level=3):
    return (i, contract_id, sup, org, price, pmp, level)


REASONS = [(1, 0), (2, BY_CUSTOMER), (3, BY_SUPPLIER), (4, None)]
PARTIES = dict(suppliers=[(SUP, None), (8, None)], org=[(ORG, 1, None), (10, 2, None)],
               termin_reason=REASONS)


def test_label_edges(warehouse, settings, rows):
    wh = warehouse(
        contracts=[contract(i) for i in range(1, 7)] + [contract(7, stage=2),
                                                        contract(8, signed=20150101)],
        value=[value(i, i) for i in (1, 2, 3, 4, 6, 7, 8)],
        closures=[(1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 4, 1.0), (5, 1, 1.0), (6, 99, 1.0),
                  (7, 1, 1.0), (8, 1, 1.0)], **PARTIES)
    got = rows(labels.contract_labels(Facts(wh, settings)))
    # 1 only code 0; 2 a higher code, too; 3 unknown code; 4 no closure; 5 no value row;
    # 6 a reason that does not exist; 7 is running and 8 too old, so neither has a row.
    assert got == [(1, 0), (2, 1), (3, 1), (4, None), (5, None), (6, None)]


def test_init_date_is_exclusive_and_a_parameter(warehouse, rows):
    wh = warehouse(contracts=[contract(1, signed=20160000), contract(2, signed=20160001)],
                   value=[value(1, 1), value(2, 2)], **PARTIES)
    assert rows(labels.contract_labels(Facts(wh, Settings()))) == [(2, None)]
    assert len(rows(labels.contract_labels(Facts(wh, Settings(init_date=20150000))))) == 2


def test_paid_by_reason_counts_closures_times_value_rows(warehouse, rows):
    wh = warehouse(contracts=[contract(1)],
                   value=[value(1, 1, price=5), value(2, 1, price=5), value(3, 1, price=6)],
                   closures=[(1, 1, 1.5), (1, 1, 2.0), (1, 2, 4.0)], **PARTIES)
    assert rows(labels.paid_by_reason(wh)) == [
        (1, 0, 5, 7.0), (1, 0, 6, 3.5), (1, BY_CUSTOMER, 5, 8.0), (1, BY_CUSTOMER, 6, 4.0)]


def test_counts_are_value_rows_and_keep_idle_entities(warehouse, settings, rows):
    wh = warehouse(contracts=[contract(1), contract(2, stage=2)],
                   value=[value(1, 1), value(2, 1), value(3, 2)], **PARTIES)
    f = Facts(wh, settings)
    assert rows(entities.contract_counts(f, SUPPLIER)) == [(SUP, 2), (8, 0)]
    assert rows(entities.contract_counts(f, CUSTOMER)) == [(ORG, 2), (10, 0)]


def test_average_price_truncates_and_is_null_without_contracts(warehouse, settings, rows):
    wh = warehouse(contracts=[contract(1), contract(2)],
                   value=[value(1, 1, price=10), value(2, 2, price=15), value(3, 2, price=15)],
                   **PARTIES)
    assert rows(entities.average_price(Facts(wh, settings), SUPPLIER)) == [(SUP, 13), (8, None)]


def test_shares_divide_properly_or_as_integers(warehouse, settings, rows):
    wh = warehouse(contracts=[contract(i) for i in (1, 2, 3)], value=[value(i, i) for i in (1, 2, 3)],
                   closures=[(1, 3, 1.0), (2, 1, 1.0)], **PARTIES)
    share = entities.severance_share(Facts(wh, settings), SUPPLIER, "supplier")
    assert rows(share) == [(SUP, 0.333), (8, 0.0)]
    whole = entities.severance_share(Facts(wh, Settings(int_division=True)), SUPPLIER, "supplier")
    assert rows(whole) == [(SUP, 0.0), (8, 0.0)]


def test_severance_counts_running_contracts_too(warehouse, settings, rows):
    wh = warehouse(contracts=[contract(1), contract(2, stage=2), contract(3, signed=20150101)],
                   value=[value(i, i) for i in (1, 2, 3)],
                   closures=[(1, 2, 1.0), (2, 2, 1.0), (3, 2, 1.0)], **PARTIES)
    f = Facts(wh, settings)
    assert rows(entities.severance_share(f, CUSTOMER, "customer")) == [(ORG, 2.0), (10, 0.0)]
    assert rows(entities.severance_share(f, CUSTOMER, "supplier")) == [(ORG, 0.0), (10, 0.0)]
    assert rows(entities.severance_share(f, SUPPLIER, "customer")) == [(SUP, 2.0), (8, 0.0)]


def test_penalty_share_averages_distinct_ratios(warehouse, settings, rows):
    wh = warehouse(contracts=[contract(i) for i in (1, 2, 3, 4)],
                   value=[value(1, 1), value(2, 2), value(3, 3), value(4, 4, price=0)],
                   penalties=[(1, 10), (2, 10), (3, 40), (4, 5), (1, None)], **PARTIES)
    f = Facts(wh, settings)
    assert rows(entities.average_penalty_share(f)) == [(SUP, 0.25), (8, 0.0)]
    assert rows(entities.average_penalty_share(f, distinct=False)) == [(SUP, 0.2), (8, 0.0)]


def test_no_penalty_share_admits_unknown_amounts(warehouse, settings, rows):
    wh = warehouse(contracts=[contract(i) for i in (1, 2, 3, 4)],
                   value=[value(i, i) for i in (1, 2, 3, 4)],
                   penalties=[(2, None), (3, None), (3, 5), (4, 5)], **PARTIES)
    # 1 has no penalty, 2 and 3 one of unknown amount, 4 only a known one.
    assert rows(entities.no_penalty_share(Facts(wh, settings))) == [(SUP, 0.75), (8, 0.0)]


def test_full_stats_agree_with_single_statistics(warehouse, settings, rows):
    wh = warehouse(
        contracts=[contract(1), contract(2), contract(3, stage=2), contract(4)],
        value=[value(1, 1, level=1), value(2, 2, level=2), value(3, 3), value(4, 4, price=50),
               value(5, 1, org=10)],
        closures=[(1, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], penalties=[(2, 10)], **PARTIES)
    f = Facts(wh, settings)
    sup, org = entities.supplier_stats(f), entities.customer_stats(f)
    for stats, side in ((sup, SUPPLIER), (org, CUSTOMER)):
        for single in (entities.contract_counts(f, side), entities.average_price(f, side),
                       entities.running_good_level_counts(f, side),
                       entities.severance_share(f, side, "supplier"),
                       entities.severance_share(f, side, "customer")):
            assert rows(stats, *single.columns) == rows(single)
    for single in (entities.average_penalty_share(f), entities.no_penalty_share(f)):
        assert rows(sup, *single.columns) == rows(single)
    counts = sup.filter(f"SupID = {SUP}").first()
    assert (counts.sup_cntr_num, counts.sup_running_cntr_num, counts.sup_good_cntr_num) == (4, 1, 2)
    assert (counts.sup_fed_cntr_num, counts.sup_sub_cntr_num, counts.sup_mun_cntr_num) == (1, 1, 2)


def test_code_stats_count_lines_and_leave_no_good_null(warehouse, settings, rows):
    wh = warehouse(contracts=[contract(1), contract(2)], value=[value(1, 1), value(2, 2)],
                   closures=[(1, 1, 1.0), (2, 3, 1.0)],
                   product=[(1, 100, SUP)] * 3 + [(1, 101, SUP), (2, 102, SUP)],
                   products=[(100, 1), (101, 1), (102, 2)], okpd2=[(1, "10.11"), (2, "20.11")],
                   **PARTIES)
    f = Facts(wh, settings)
    assert rows(codes.code_stats(f)) == [(1, "10.11", 4, 4), (2, "20.11", 1, None)]
    # Distinct contracts, not lines.
    assert rows(codes.supplier_code_contracts(f)) == [(SUP, 1, 1), (SUP, 2, 1)]
    assert rows(codes.contract_codes(f), "cntrID", "okpdID") == [(1, 1), (2, 2)]


def test_pairs_drop_unknown_parties(warehouse, settings, rows):
    wh = warehouse(contracts=[contract(1)],
                   value=[value(1, 1), value(2, 1), value(3, 1, sup=999), value(4, 1, org=999)],
                   **PARTIES)
    assert rows(codes.supplier_customer_contracts(Facts(wh, settings))) == [(SUP, ORG, 2)]


@pytest.mark.parametrize("side", [SUPPLIER, CUSTOMER], ids=lambda s: s.prefix)
def test_counts_add_up_to_the_fact(spark, side):
    from catalog.stages import lazy_facts

    f = lazy_facts(spark, "/root/testdata/sf0.001")
    name = f"{side.prefix}_cntr_num"
    total = entities.contract_counts(f, side).groupBy().sum(name).first()[0]
    assert total == f.finished_values.count()
