"""Reshaping, features, cleaning and encoding."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.functions import scalars
from tenderlens.operators import cleaning, encode, explore, features, flatten, splitting
from tenderlens.settings import CATEGORICAL, NUMERIC, SHARES, FeatureSpec

ROW = ("valID long, cntrID long, supID long, orgID long, okpdID int, okpd string, "
       "okpd_cntr_num long, okpd_good_cntr_num long, sup_okpd_cntr_num long, sup_cntr_num long, "
       "cntr_result int")
ROWS = [
    # contract 1: codes 10.11, 10.12, 20.11; contract 2: 10.11; contract 3: 20.11, 30.11
    (1, 1, 7, 9, 1, "10.11", 10, 6, 2, 4, 0), (1, 1, 7, 9, 2, "10.12", 20, None, 3, 4, 0),
    (1, 1, 7, 9, 3, "20.11", 5, 5, 1, 4, 0), (2, 2, 7, 9, 1, "10.11", 10, 6, 2, 4, 1),
    (3, 3, 8, 9, 3, "20.11", 5, 5, 1, 2, 1), (3, 3, 8, 9, 4, "30.11", 8, 0, 2, 2, 1),
]


def test_prefix_totals_count_each_code_once(table, rows):
    df = flatten.add_prefix(table(ROW, ROWS))
    assert rows(flatten.code_totals(df, "okpd2")) == [("10", 30, 6), ("20", 5, 5), ("30", 8, 0)]
    assert rows(flatten.supplier_code_totals(df, "okpd2")) == [
        (7, "10", 5), (7, "20", 1), (8, "20", 1), (8, "30", 2)]


def test_roll_up_writes_totals_back(table, rows):
    df = table(ROW, ROWS)
    got = rows(flatten.roll_up_codes(df), "cntrID", "okpdID", "okpd2", "okpd_cntr_num",
               "okpd_good_cntr_num", "sup_okpd_cntr_num")
    assert got[:3] == [(1, 1, "10", 30, 6, 5), (1, 2, "10", 30, 6, 5), (1, 3, "20", 5, 5, 1)]
    hot = flatten.roll_up_codes(df, hot={"supID": [7]})
    assert rows(hot) == rows(flatten.roll_up_codes(df))


def flat(table, **options):
    rolled = flatten.roll_up_codes(table(ROW, ROWS))
    return flatten.flatten(rolled, ["10", "20", "30"], **options)


def test_flatten_keeps_the_first_row_and_unites_codes(table, rows):
    got = flat(table)
    assert rows(got, "cntrID", "okpdID", "okpd_num", "okpd2_10", "okpd2_20", "okpd2_30") == [
        (1, 1, 3, 1, 1, 0), (2, 1, 1, 1, 0, 0), (3, 3, 2, 0, 1, 1)]
    assert rows(got, "cntrID", "okpd_good_share_min", "okpd_good_share_mean",
                "okpd_good_share_max") == [(1, 0.2, 0.6, 1.0), (2, 0.2, 0.2, 0.2),
                                           (3, 0.0, 0.5, 1.0)]


def test_single_steps_agree_with_flatten(table, rows):
    rolled = flatten.code_shares(flatten.roll_up_codes(table(ROW, ROWS)))
    got, codes = flat(table), ["10", "20", "30"]
    for step in (flatten.multi_hot(rolled, "okpd2", codes),
                 flatten.good_share_range(rolled, "okpd2"), flatten.codes_per_contract(rolled)):
        assert rows(got, *(f"`{c}`" for c in step.columns)) == rows(step)


def test_specialisation_knows_all_or_only_first_prefixes(table, rows):
    columns = ("cntrID", "socs_10", "socs_20", "socs_30")
    assert rows(flat(table), *columns) == [(1, 1.25, 0.25, 0.0), (2, 1.25, 0.25, 0.0),
                                           (3, 0.0, 0.5, 1.0)]
    assert rows(flat(table, first_only=True), *columns) == [
        (1, 1.25, 0.0, 0.0), (2, 1.25, 0.0, 0.0), (3, 0.0, 0.5, 0.0)]


def test_multi_code_reports(table, rows):
    df = table(ROW, ROWS)
    assert rows(flatten.multi_code_contracts(df).groupBy("cntrID").count()) == [(1, 3), (3, 2)]
    assert rows(flatten.multi_code_label_split(df)) == [(0, 1), (1, 1)]
    assert rows(flatten.unique_codes_by_length(df)) == [(1, 3), (2, 3), (3, 3), (4, 3), (5, 4)]
    # Counts 3 and 2 of contracts with several rows; two of three contracts have several.
    assert rows(explore.codes_per_contract_percentiles(df)) == [
        (0.01, pytest.approx(2.01), pytest.approx(2 / 3)),
        (0.99, pytest.approx(2.99), pytest.approx(2 / 3))]


def test_too_many_codes_are_an_error(spark, table):
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError):
            flatten.prefix_codes(flatten.add_prefix(table(ROW, ROWS)), "okpd2")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_time_features(table, rows):
    df = table("i int, price long, sign_date int, exec_date int", [
        (1, 100, 20170315, 20170325), (2, 100, 20170315, 20170315), (3, 100, 20171231, 20171221),
        (4, 100, 20160000, 20170101), (5, 100, 20170101, None)])
    got = rows(features.time_features(df), "i", "plan_cntr_len", "day_price", "sign_month",
               "sign_quarter")
    assert got == [(1, 10, 10.0, 3, 1), (2, 0, None, 3, 1), (3, -10, -10.0, 12, 4),
                   (4, None, None, 0, 0), (5, None, None, 1, 1)]


def test_decimal_comma(table, rows):
    df = table("t string", [("0,125",), ("1",), (None,), ("x",)])
    assert rows(df.select(scalars.decimal_comma("t"))) == [(None,), (None,), (0.125,), (1.0,)]


def test_clip_and_log_keep_null(table, rows):
    df = table("i int, x double", [(1, None), (2, 0.0), (3, math.e), (4, -5.0), (5, 99.0)])
    assert rows(df.select("i", scalars.clip("x", 0.0, 10.0))) == [
        (1, None), (2, 0.0), (3, math.e), (4, 0.0), (5, 10.0)]
    assert rows(df.select("i", scalars.log_floor_one("x")))[:4] == [
        (1, None), (2, 0.0), (3, 1.0), (4, 0.0)]


def test_modes_break_ties_low_and_skip_the_marker(table):
    df = table("purch_type int, cntr_lvl int, org_ter int",
               [(-1, 3, None), (-1, 2, 5), (-1, 3, 5), (4, 2, None), (1, -1, None)])
    assert cleaning.fit_modes(df) == {"purch_type": 1, "cntr_lvl": 2, "org_ter": 5}
    assert cleaning.fit_modes(df, compat=True)["purch_type"] == -1
    filled = cleaning.impute_modes(df, cleaning.fit_modes(df))
    assert {tuple(r) for r in filled.collect()} == {(1, 3, 5), (1, 2, 5), (4, 2, 5)}


def test_zero_price_goes_and_length_is_at_least_one(table, rows):
    df = table("price long, plan_cntr_len int, day_price double",
               [(0, 5, 1.0), (10, 0, None), (10, -4, -2.5), (10, 5, 2.0), (None, 5, None)])
    assert rows(cleaning.fix_day_price(df)) == [
        (None, 5, None), (10, 1, 10.0), (10, 1, 10.0), (10, 5, 2.0)]


def test_feature_groups():
    spec = FeatureSpec.of([*SHARES, *NUMERIC, *CATEGORICAL, "price_too_low", "okpd2_10",
                           "socs_10", "cntrID"])
    assert (len(spec.shares), len(spec.numeric), len(spec.categorical)) == (19, 13, 7)
    assert spec.binary == ("price_too_low", "okpd2_10", "socs_10")
    less = spec.without(["pmp", "sup_ter"])
    assert "pmp" in spec.numeric and "pmp" not in less.numeric
    assert "sup_ter" not in less.categorical


SPEC = FeatureSpec(shares=("s",), numeric=("x", "c"), binary=(), categorical=("k",))


def training_rows(n=400):
    rng = np.random.default_rng(1)
    return [(i, float(rng.normal(10, 3)) if i % 50 else 1000.0, 5.0, float(rng.random()),
             "a" if i % 3 else "b", int(i % 4 == 0)) for i in range(n)]


def frame(table, data):
    return table("cntrID long, x double, c double, s double, k string, cntr_result int", data)


def test_quantitative_fit_and_apply(table):
    data = training_rows()
    df = frame(table, data)
    params = encode.fit_quantitative(df, SPEC, shares=("s",))
    x = np.array([r[1] for r in data])
    low, high = np.percentile(x, [1, 99])
    assert params["percentile"]["x"] == pytest.approx([low, high])
    bounded = np.clip(x, low, high)
    assert params["scale"]["x"] == pytest.approx([bounded.mean(), bounded.std()])
    assert params["scale"]["c"] == [5.0, 0.0] and "s" not in params["scale"]
    got = {r.cntrID: r for r in encode.apply_quantitative(df, params).collect()}
    for i, v in enumerate(x):
        assert got[i].x == pytest.approx((np.clip(v, low, high) - bounded.mean()) / bounded.std())
        assert got[i].x_out == int(v < low or v > high)
        assert got[i].c == 0.0 and got[i].c_out == 0


def test_compat_flag_marks_nearly_everything(table):
    df = frame(table, training_rows())
    out = encode.outlier_flags(df, {"x": (0.0, 500.0)}, compat=True)
    assert out.agg(F.sum("x_out")).first()[0] == df.count()


def test_woe_edges(table, rows):
    # 1000 rows: category e is exactly 0.5 %, f below, g only good, h unknown to training.
    data = ([("a", 0)] * 600 + [("a", 1)] * 200 + [("b", 0)] * 50 + [("b", 1)] * 92
            + [("e", 0)] * 4 + [("e", 1)] + [("f", 0)] * 2 + [("f", 1)] + [("g", 0)] * 50)
    df = table("k string, cntr_result int", data)
    got = {r.category: r for r in encode.woe_table(df, ["k"]).collect()}
    assert set(got) == {"a", "b", "g", "NEW"}
    assert (got["NEW"].n, got["NEW"].good, got["NEW"].bad) == (8, 6, 2)
    assert got["a"].woe == pytest.approx(round(math.log((600 / 706) / (200 / 294)), 3))
    assert got["g"].woe is None
    spec = FeatureSpec((), (), (), ("k",))
    params = encode.fit_categorical(df, spec)
    new = params["woe"]["k"]["NEW"]
    probe = table("k string", [("a",), ("e",), ("g",), ("h",), (None,)])
    coded = [r.k for r in encode.apply_categorical(probe, params).collect()]
    assert sorted(coded) == sorted([got["a"].woe, new, new, new, new])
    smooth = {r.category: r.woe for r in encode.woe_table(df, ["k"], smoothing=0.5).collect()}
    assert smooth["g"] is not None


def test_no_rare_group_codes_unseen_as_zero(table):
    df = table("k string, cntr_result int", [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 1)])
    params = encode.fit_categorical(df, FeatureSpec((), (), (), ("k",)))
    assert "NEW" not in params["woe"]["k"]
    probe = table("k string", [("zzz",)])
    assert encode.apply_categorical(probe, params).first().k == 0.0


def test_information_value(table):
    data = [("a", 0)] * 60 + [("a", 1)] * 20 + [("b", 0)] * 40 + [("b", 1)] * 80
    df = table("k string, cntr_result int", data)
    want = (.6 - .2) * math.log(.6 / .2) + (.4 - .8) * math.log(.4 / .8)
    got = explore.information_value(df, ["k"]).first()
    assert got.iv == pytest.approx(want)
    assert explore.information_value(df, ["k"], at_least=want + 0.1).count() == 0


def test_encoding_of_train_does_not_see_other_rows(table):
    data = training_rows()
    train, valid = splitting.train_valid_split(frame(table, data))
    params = encode.fit(train, SPEC, shares=("s",))
    shifted = [(i, x + 500, c, s, "zzz", y) for i, x, c, s, _, y in data]
    again, _ = splitting.train_valid_split(frame(table, data))
    assert encode.fit(again, SPEC, shares=("s",)) == params
    _, other = splitting.train_valid_split(frame(table, shifted))
    # Parameters stay those of the training rows whatever the validation rows hold.
    assert encode.transform(other, params).count() == valid.count()
    assert {r.k for r in encode.transform(other, params).collect()} == {0.0}


def test_folds_are_balanced_per_label(table):
    df = frame(table, [(i * 13, 0.0, 0.0, 0.0, "a", int(i >= 7)) for i in range(10)])
    folded = splitting.stratified_folds(df, 3, buckets=4)
    counts = {(r.cntr_result, r.fold): r["count"]
              for r in folded.groupBy("cntr_result", "fold").count().collect()}
    assert sorted(v for (y, _), v in counts.items() if y == 0) == [2, 2, 3]
    assert sorted(v for (y, _), v in counts.items() if y == 1) == [1, 1, 1]


def test_split_depends_on_the_key_alone(spark):
    df = spark.range(5000).withColumnRenamed("id", "cntrID")
    train, valid = splitting.train_valid_split(df)
    again = splitting.train_valid_split(df.repartition(13))[1]
    assert {r[0] for r in valid.collect()} == {r[0] for r in again.collect()}
    assert train.count() + valid.count() == 5000 and 850 < valid.count() < 1150
    assert splitting.shuffled(df).count() == 5000
    assert sum(part.count() for part in splitting.random_split(df)) == 5000
