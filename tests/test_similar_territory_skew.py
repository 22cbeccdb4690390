"""Similar prices, territory walk, running totals, percentiles and skewed joins."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from tenderlens.operators import flatten, running, similar, skew, territory


def brute(facts, wanted):
    return sorted((k, q, sum(1 for k2, p in facts if k2 == k and abs(p - q) * 5 <= q))
                  for k, q in set(wanted))


def counted(table, rows, facts, wanted):
    got = similar.similar_price_share(
        table("supID long, price long", facts),
        table("supID long, price long, n long", [(k, q, 1) for k, q in wanted]),
        "supID", "n", "share")
    return [(k, q, int(s)) for k, q, s in rows(got)]


def test_band_edges_are_inclusive(table, rows):
    facts = [(1, p) for p in (79, 80, 80, 100, 120, 121)] + [(2, 100)]
    assert counted(table, rows, facts, [(1, 100), (2, 100), (3, 100)]) == [
        (1, 100, 4), (2, 100, 1), (3, 100, 0)]


def test_zero_and_negative_prices(table, rows):
    facts = [(1, 0), (1, 0), (1, -5), (1, 3)]
    assert counted(table, rows, facts, [(1, 0), (1, -5)]) == [(1, -5, 0), (1, 0, 2)]


def test_share_of_idle_entity_is_zero(table, rows):
    got = similar.similar_price_share(
        table("supID long, price long", [(1, 5)]),
        table("supID long, price long, n long", [(1, 5, 0)]), "supID", "n", "share")
    assert rows(got) == [(1, 5, 0.0)]


def test_sweep_equals_range_join_over_many_magnitudes(table, rows):
    rng = random.Random(5)
    facts = [(rng.randint(1, 3), int(10 ** rng.uniform(0, 13))) for _ in range(600)]
    # A hot entity with close prices around block borders.
    facts += [(1, 2 ** e + d) for e in (12, 13, 14, 30, 40) for d in range(-3, 4)]
    wanted = rng.sample(facts, 200) + facts[-35:]
    assert counted(table, rows, facts, wanted) == brute(facts, wanted)


def test_blocks_keep_the_order(spark):
    values = sorted({max(0, 2 ** e + d) for e in range(62) for d in (-1, 0, 1)})
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r[0] for r in df.select(similar.price_block("v"), "v").orderBy("v").collect()]
    assert got == sorted(got)


def test_territory_edges(warehouse, rows):
    wh = warehouse(
        territory=[(1, None), (10, 1), (100, 10), (50, 999), (60, None), (70, 71), (71, 70),
                   (2, 1), (20, 2)],
        fed_subject=[(1, "one"), (2, "two")])
    got = rows(territory.federal_subjects(wh))
    # Itself, one and two levels up, a subject below a subject; orphans and cycles have no row.
    assert got == [(1, 1), (2, 2), (10, 1), (20, 2), (100, 1)]


def test_deep_chains_and_circles(warehouse, rows, monkeypatch):
    """A chain of 1,000 in 11 rounds; circles of 1 and 300, and a chain that leads to one, have no
    row."""
    rounds = []
    staged = territory.stage
    monkeypatch.setattr(territory, "stage", lambda df, name: rounds.append(name) or staged(df, name))
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 1001)]
    wh = warehouse(territory=chain, fed_subject=[(1, "one"), (600, "six hundred")])
    assert rows(territory.federal_subjects(wh)) == \
        [(i, 1 if i < 600 else 600) for i in range(1, 1001)]
    assert len(rounds) <= 12
    circle = [(2000 + i, 2000 + (i + 1) % 300) for i in range(300)]
    wh = warehouse(territory=[(1, None), (2, 1), (3, 3), (5000, 2000), *circle],
                   fed_subject=[(1, "one")])
    assert rows(territory.federal_subjects(wh)) == [(1, 1), (2, 1)]


def test_parties_without_territory_get_null(warehouse, rows):
    wh = warehouse(territory=[(1, None), (10, 1)], fed_subject=[(1, "one")],
                   suppliers=[(5, 10), (6, None), (7, 404)], org=[(8, 1, 1)])
    subjects = territory.federal_subjects(wh)
    assert rows(territory.supplier_territory(wh, subjects)) == [(5, 1), (6, None), (7, None)]
    assert rows(territory.customer_territory(wh, subjects)) == [(8, 1)]


def test_hot_keys_finds_a_third_and_nothing_else(spark):
    df = spark.range(9000).selectExpr("IF(id % 3 = 0, 7, id + 100) AS k", "id AS other")
    # A third of the rows is 13.3 times a share of 1 / 40.
    assert skew.hot_keys(df, ["k", "other"], 1 / 40) == {"k": {7: 16}, "other": {}}


def test_hot_from_a_quarter_of_an_even_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    # 2 % of the rows are less than a quarter of one partition in 8, more than that of one in 200.
    df = spark.range(5000).selectExpr("IF(id % 50 = 0, 7, id + 100) AS k")
    try:
        for partitions, hot in ((8, {}), (200, {7: 16}), (10 ** 6, {7: 128})):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            assert {k: n for k, n in skew.hot_keys(df, ["k"])["k"].items() if k == 7} == hot
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_dealt_join_equals_plain_join(spark, rows, how):
    fact = spark.range(3000).selectExpr(
        "id AS valID", "IF(id % 3 = 0, 7, id % 50) AS supID", "id % 4 AS orgID")
    lookup = spark.range(40).selectExpr("id AS supID", "id * 10 AS x")
    plain = fact.join(lookup, "supID", how)
    dealt = skew.join_lookup(fact, lookup, ["supID"], {"supID": [7, 8]}, how)
    assert rows(dealt, *plain.columns) == rows(plain)
    dealt = skew.join_lookup(fact, lookup, ["supID"], {"supID": {7: 8, 8: 2, 9: 2}}, how)
    assert rows(dealt, *plain.columns) == rows(plain)
    pairs = fact.select("supID", "orgID").distinct().selectExpr("*", "supID + orgID AS y")
    plain = fact.join(pairs, ["supID", "orgID"], how)
    hot = {"supID": [7], "orgID": [0, 3]}
    dealt = skew.join_lookup(fact, pairs, ["supID", "orgID"], hot, how)
    assert rows(dealt, *plain.columns) == rows(plain)


def test_dealt_join_spreads_the_hot_key(spark):
    fact = spark.range(6000).selectExpr("id AS valID", "IF(id % 3 = 0, 7, id) AS supID")
    lookup = spark.range(40).selectExpr("id AS supID", "id * 10 AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.join_lookup(fact, lookup, ["supID"], {"supID": [7]}, slices=16)
        sizes = [n for n in joined.filter("supID = 7").rdd.mapPartitions(
            lambda it: [sum(1 for _ in it)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 2001 and max(sizes) < 1500 and len(sizes) > 1


def test_hot_contract_is_spread_over_tasks(spark):
    """A contract with a third of all rows: no task of the semi-join holds most of it."""
    fact = spark.range(6000).selectExpr("id AS okpdID", "IF(id % 3 = 0, 7, id) AS cntrID")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        several = flatten.multi_code_contracts(fact, skew.hot_keys(fact, ["cntrID"]))
        sizes = [n for n in several.rdd.mapPartitions(
            lambda it: [sum(1 for _ in it)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 2001 and max(sizes) < 1000


def hot_pairs(spark, n=400):
    """Key 7 has a third of the rows of either side, key None and 9 stand on one side only."""
    left = spark.range(3 * n).selectExpr(
        "id AS valID", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS k")
    right = spark.range(3 * n).selectExpr(
        "id AS okpdID", "CASE WHEN id % 3 = 0 THEN 7 WHEN id = 1 THEN 9 ELSE id END AS k")
    return left, right


@pytest.mark.parametrize("partitions", [2, 16, 64])
def test_grid_join_equals_plain_join(spark, rows, partitions):
    left, right = hot_pairs(spark, 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        hot = skew.grids(left, right, ["k"]).collect()
        assert [r.k for r in hot] == [7] and hot[0]._rows * hot[0]._columns >= partitions
        dealt = skew.join_grid(left, right, ["k"], ["valID"], ["okpdID"])
        plain = left.join(right, "k")
        assert dealt.columns == plain.columns and rows(dealt) == rows(plain)
        assert rows(dealt)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_grid_follows_the_longer_side(spark):
    left = spark.range(900).selectExpr("1 AS k", "id AS a")
    right = spark.range(4).selectExpr("1 AS k", "id AS b")
    row = skew.grids(left, right, ["k"]).first()
    assert row._rows > row._columns and row._columns <= 4
    one = skew.grids(left, right.limit(1), ["k"]).first()
    assert (one._columns, one._rows > 1) == (1, True)
    assert skew.join_grid(left, right, ["k"], ["a"], ["b"]).count() == 3600
    assert skew.join_grid(left.limit(0), right, ["k"], ["a"], ["b"]).count() == 0


def test_hot_contract_on_both_sides_leaves_no_large_task(spark):
    """A contract with a third of the rows of both sides: tasks hold about equal parts of what
    it joins to, where the plain join puts all of it into one."""
    left, right = hot_pairs(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
                "spark.sql.shuffle.partitions": "16"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        per_task = lambda df: sorted(
            r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        plain = per_task(left.join(right, "k"))
        dealt = per_task(skew.join_grid(left, right, ["k"], ["valID"], ["okpdID"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(plain) == sum(dealt) and plain[-1] > 0.9 * sum(plain)
    assert len(dealt) == 16 and dealt[-1] < 3 * dealt[len(dealt) // 2]


@pytest.mark.parametrize("ranges", [None, 1, 16])
def test_totals_before_in_ranges(spark, rows, ranges, monkeypatch):
    monkeypatch.setattr(running, "RANGE_ROWS", 64)
    df = spark.range(1000).selectExpr("CAST(id * id % 1009 AS DOUBLE) AS o", "id AS n")
    df = df.groupBy("o").sum("n").withColumnRenamed("sum(n)", "n")
    got = rows(running.totals_before(df, "o", ["n"], ranges), "o", "n", "n_before")
    before = 0
    for _, n, b in got:
        assert b == before
        before += n


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_percentiles_equal_numpy(spark, accuracy):
    """Short columns are one bracket; at accuracy 100 the brackets are narrow."""
    rng = np.random.default_rng(3)
    columns = {
        "normal": rng.normal(size=5000), "skewed": np.exp(rng.normal(0, 4, 5000)),
        "few": rng.integers(0, 4, 5000).astype(float),
        "hot": np.where(rng.random(5000) < 0.4, 7.0, rng.random(5000) * 100),
        "constant": np.full(5000, 3.0),
    }
    df = spark.createDataFrame(list(zip(*(c.tolist() for c in columns.values()))),
                               ", ".join(f"{c} double" for c in columns))
    grid = [0.0, 0.01, 0.25, 0.5, 0.505, 0.99, 1.0]
    got = {(r.variable, r.p): r.value for r in running.exact_percentiles(
        df, list(columns), grid, accuracy).collect()}
    assert len(got) == len(columns) * len(grid)
    for c, values in columns.items():
        for p in grid:
            assert got[c, p] == pytest.approx(np.percentile(values, p * 100), rel=1e-12), (c, p)


def test_ranges_follow_the_rows(spark, rows, monkeypatch):
    """With more ranges than one task may order, their totals are ranged in turn."""
    monkeypatch.setattr(running, "RANGE_ROWS", 5)
    asked = []
    frame = type(spark.range(1))
    ranged = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange",
                        lambda df, n, *c: asked.append(n) or ranged(df, n, *c))
    df = spark.range(90).selectExpr("CAST(id AS DOUBLE) AS o", "1 AS n")
    assert rows(running.totals_before(df, "o", ["n"]), "o", "n_before") == \
        [(float(i), i) for i in range(90)]
    assert asked[0] == 18 and len(asked) >= 2


def test_brackets_are_narrowed_to_a_fixed_number(spark, monkeypatch):
    """However many rows there are, no bracket that can be narrowed stays larger."""
    left = {}
    narrow = running._narrowed

    def watched(values, brackets, counts, most, accuracy):
        out = narrow(values, brackets, counts, most, accuracy)
        left.update({c: [b for b in own] for c, own in out.items()})
        return out

    monkeypatch.setattr(running, "_narrowed", watched)
    df = spark.range(40_000).selectExpr(
        "CAST(id * 7919 % 40009 AS DOUBLE) AS a", "IF(id % 3 = 0, 5D, id * 1D) AS hot")
    grid = [0.0, 0.2, 0.25, 0.9, 1.0]
    got = {(r.variable, r.p): r.value for r in running.exact_percentiles(
        df, ["a", "hot"], grid, 40).collect()}
    pdf = df.toPandas()
    for c in ("a", "hot"):
        for p in grid:
            assert got[c, p] == pytest.approx(np.percentile(pdf[c], p * 100), rel=1e-12), (c, p)
        # What is left to order is few values, of which one may be that of very many rows.
        assert all(pdf[c][pdf[c].between(b.low, b.high)].nunique() <= 400 for b in left[c])
    assert any(b.inside > 13_000 for b in left["hot"])


def test_percentiles_skip_missing_values(table, rows):
    df = table("a double, b double", [(1.0, None), (None, None), (3.0, None), (float("nan"), None)])
    assert rows(running.exact_percentiles(df, ["a", "b"], [0.5])) == [("a", 0.5, 2.0)]


@hyp(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(facts=st.lists(st.tuples(st.integers(1, 2), st.integers(0, 40_000)), min_size=1, max_size=40),
       wanted=st.lists(st.tuples(st.integers(1, 3), st.integers(0, 40_000)), min_size=1, max_size=10))
def test_sweep_property(table, rows, facts, wanted):
    assert counted(table, rows, facts, wanted) == brute(facts, wanted)
