"""Sampling, flags, keyed inserts and updates, and the assembled sample."""

from pyspark.sql import functions as F

from tenderlens.operators import sample, upsert
from tenderlens.operators.facts import Facts
from tenderlens.plans.statistics import statistics
from tenderlens.sources.schemas import DERIVED, SAMPLE_KEY

SUP, ORG = 7, 9


def small_warehouse(warehouse):
    contracts = [(i, 3, 20170101, 20180101, 1, str(i).zfill(19)) for i in (1, 2, 3, 50)]
    contracts.append((4, 2, 20170101, 20180101, 1, "4"))
    return warehouse(
        contracts=contracts,
        value=[(10, 1, SUP, ORG, 100, 90, 1), (11, 1, SUP, ORG, 0, 0, 1),
               (20, 2, SUP, ORG, 50, 100, 2), (21, 2, SUP, ORG, 0, 100, 2),
               (30, 3, SUP, ORG, 0, 0, 3), (40, 4, SUP, ORG, 70, 0, 3),
               (500, 50, SUP, ORG, 10, 0, 3), (600, 1, 999, ORG, 10, 0, 3)],
        product=[(i, 100, SUP) for i in (1, 1, 2, 3, 50)] + [(2, 101, SUP)],
        products=[(100, 1), (101, 2)], okpd2=[(1, "10.11"), (2, "20.22")],
        suppliers=[(SUP, 15)], org=[(ORG, 5, None)],
        closures=[(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0), (50, 1, 1.0)],
        termin_reason=[(1, 0), (2, 8326975)],
        territory=[(1, None), (15, 1)], fed_subject=[(1, "one")])


def test_sample_rows_and_columns(warehouse, settings, rows):
    f = Facts(small_warehouse(warehouse), settings)
    got = sample.build_sample(f, statistics(f), "modulo")
    assert got.schema.names == DERIVED["sample"].fieldNames()
    assert [x.dataType for x in got.schema] == [x.dataType for x in DERIVED["sample"].fields]
    # Bad 1 gives its priced row only; good 2 is drawn and gives both rows, once per code; good
    # 3 has no priced row, good 50 is not drawn, 4 is running, supplier 999 is unknown.
    assert rows(got, *SAMPLE_KEY, "cntr_result") == [
        (10, 1, SUP, ORG, 1, 1), (20, 2, SUP, ORG, 1, 0), (20, 2, SUP, ORG, 2, 0),
        (21, 2, SUP, ORG, 1, 0), (21, 2, SUP, ORG, 2, 0)]
    row = got.filter("valID = 10").first()
    assert (row.sup_ter, row.org_ter, row.org_type, row.okpd) == (1, None, 5, "10.11")
    assert (row.price_higher_pmp, row.price_too_low) == (1, 0)
    assert (row.sup_cntr_num, row.cntr_num_together, row.sup_okpd_cntr_num) == (6, 6, 4)
    # Of six finished prices 100, 0, 50, 0, 0, 10 only itself is within 20 % of 100.
    assert row.sup_sim_price_share == 0.167


def test_hot_parties_do_not_change_the_sample(warehouse, settings, rows):
    f = Facts(small_warehouse(warehouse), settings)
    stats = statistics(f)
    plain = sample.build_sample(f, stats, "modulo", hot={})
    hot = {"cntrID": [1, 2], "supID": [SUP], "orgID": [ORG], "price": [0, 100], "okpdID": [1]}
    assert rows(sample.build_sample(f, stats, "modulo", hot=hot)) == rows(plain)


def test_contracts_sampled_before_are_not_loaded_again(warehouse, settings, rows):
    f = Facts(small_warehouse(warehouse), settings)
    stats = statistics(f)
    first = sample.build_sample(f, stats, "modulo", hot={})
    again = sample.build_sample(f, stats, "modulo", existing=first, hot={})
    assert rows(again, "valID") == [(10,)]
    assert rows(upsert.insert_ignore(first, again, list(SAMPLE_KEY))) == rows(first)


def test_hash_sample_is_repeatable_and_near_its_share(spark, settings):
    labels = spark.range(20_000).selectExpr("id AS CntrID", "0 AS result")
    first = sample.sampled_good(labels, settings).count()
    assert first == sample.sampled_good(labels.repartition(7), settings).count()
    assert 3600 < first < 4400


def test_price_flags_treat_unknown_as_zero(table, settings, rows):
    df = table("price long, pmp long", [(10, 5), (10, 0), (None, 5), (6, 10), (7, 10), (5, None)])
    got = rows(sample.price_flags(df, settings))
    assert got == [(None, 5, 0, 0), (5, None, 0, 0), (6, 10, 0, 1), (7, 10, 0, 0), (10, 0, 0, 0),
                   (10, 5, 1, 0)]


def test_insert_ignores_stored_and_repeated_keys(table, rows):
    stored = table("k int, v string", [(1, "old")])
    batch = table("k int, v string", [(1, "new"), (2, "x"), (2, "x")])
    assert rows(upsert.insert_ignore(stored, batch, ["k"])) == [(1, "old"), (2, "x")]


def test_update_overwrites_matches_even_with_null(table, rows):
    base = table("k int, a int, b int", [(1, 1, 1), (2, 2, 2), (3, 3, 3)])
    fresh = table("k int, a int", [(1, 10), (2, None)])
    assert rows(upsert.update_from(base, fresh, ["k"], ["a"])) == [(1, 10, 1), (2, None, 2),
                                                                   (3, 3, 3)]


def test_refresh_computes_only_missing_rows(table, rows):
    df = table("k int, a int", [(1, 5), (2, None)])
    got = upsert.refresh_missing(df, ["a"], lambda part: part.withColumn("a", F.col("k") * 100))
    assert rows(got) == [(1, 5), (2, 200)]
