"""One query per operator (or tight group of operators)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from catalog.stages import SAMPLE_MODE, full_facts, lazy_facts, scored_contracts, stages
from tenderlens.functions.scalars import decimal_comma
from tenderlens.operators import (
    boosting, cleaning, codes, encode, entities, explore, features, flatten, labels, metrics, sample,
    similar, skew, splitting, territory, training, upsert,
)
from tenderlens.operators.entities import CUSTOMER, SUPPLIER
from tenderlens.operators.sample import build_sample
from tenderlens.settings import CATEGORICAL, NUMERIC, SHARES
from tenderlens.sources import modelstore
from tenderlens.sources.schemas import SAMPLE_KEY
from tenderlens.sources.staging import shared_folder, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

COLUMN = flatten.prefix_column()


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to fixed places, as sums of doubles depend on their order in the last digits."""
    return df.select(*(
        F.round(F.col(f"`{f.name}`"), places).alias(f.name)
        if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- labels and entity statistics ---------------------------------------------------------

@query
def contract_label(spark, folder):
    return labels.contract_labels(lazy_facts(spark, folder))


@query
def paid_by_reason(spark, folder):
    return rounded(labels.paid_by_reason(lazy_facts(spark, folder).wh), 4)


@query
def sup_contract_count(spark, folder):
    return entities.contract_counts(lazy_facts(spark, folder), SUPPLIER)


@query
def org_contract_count(spark, folder):
    return entities.contract_counts(lazy_facts(spark, folder), CUSTOMER)


@query
def sup_avg_price(spark, folder):
    return entities.average_price(lazy_facts(spark, folder), SUPPLIER)


@query
def org_avg_price(spark, folder):
    return entities.average_price(lazy_facts(spark, folder), CUSTOMER)


@query
def sup_avg_penalty_share(spark, folder):
    return entities.average_penalty_share(lazy_facts(spark, folder))


@query
def sup_no_penalty_share(spark, folder):
    return entities.no_penalty_share(lazy_facts(spark, folder))


@query
def sup_severance_by_supplier(spark, folder):
    return entities.severance_share(lazy_facts(spark, folder), SUPPLIER, "supplier")


@query
def sup_severance_by_customer(spark, folder):
    return entities.severance_share(lazy_facts(spark, folder), SUPPLIER, "customer")


@query
def org_severance_by_customer(spark, folder):
    return entities.severance_share(lazy_facts(spark, folder), CUSTOMER, "customer")


@query
def org_severance_by_supplier(spark, folder):
    return entities.severance_share(lazy_facts(spark, folder), CUSTOMER, "supplier")


@query
def sup_running_good_level_counts(spark, folder):
    return entities.running_good_level_counts(lazy_facts(spark, folder), SUPPLIER)


@query
def org_running_good_level_counts(spark, folder):
    return entities.running_good_level_counts(lazy_facts(spark, folder), CUSTOMER)


@query
def sup_stats(spark, folder):
    return entities.supplier_stats(lazy_facts(spark, folder))


@query
def org_stats(spark, folder):
    return entities.customer_stats(lazy_facts(spark, folder))


# ---- codes, pairs, territory, similar prices ----------------------------------------------

@query
def okpd_stats(spark, folder):
    return codes.code_stats(lazy_facts(spark, folder))


@query
def sup_okpd_contracts(spark, folder):
    return codes.supplier_code_contracts(lazy_facts(spark, folder))


@query
def sup_org_contracts(spark, folder):
    return codes.supplier_customer_contracts(lazy_facts(spark, folder))


# Statistics that were loaded once, and refreshed after contracts were added and severed.

@query
def refreshed_labels(spark, folder):
    return stages(spark, folder).refreshed.cntr_stats


@query
def refreshed_sup_stats(spark, folder):
    return stages(spark, folder).refreshed.sup_stats


@query
def refreshed_org_stats(spark, folder):
    return stages(spark, folder).refreshed.org_stats


@query
def refreshed_okpd_stats(spark, folder):
    return stages(spark, folder).refreshed.okpd_stats


@query
def refreshed_sup_okpd_contracts(spark, folder):
    return stages(spark, folder).refreshed.okpd_sup_stats


@query
def refreshed_sup_org_contracts(spark, folder):
    return stages(spark, folder).refreshed.sup_org_stats


@query
def federal_subject(spark, folder):
    wh = lazy_facts(spark, folder).wh
    every = wh.territory.select(F.col("ID").alias("territory"))
    return every.join(territory.federal_subjects(wh), "territory", "left")


@query
def stats_with_territory(spark, folder):
    """Keyed update of the customer statistics by the territory walk."""
    f = lazy_facts(spark, folder)
    base = entities.contract_counts(f, CUSTOMER).withColumn("org_fed_ter",
                                                            F.lit(None).cast("int"))
    found = territory.customer_territory(f.wh, territory.federal_subjects(f.wh))
    return upsert.update_from(base, found, ["OrgID"], ["org_fed_ter"])


def _similar(spark, folder, key, total, out, side):
    f = stages(spark, folder).facts
    counts = entities.contract_counts(f, side).withColumnRenamed(side.stats_key, key)
    asked = f.finished_values.select(key, "price").distinct().join(counts, key)
    return similar.similar_price_share(f.finished_values, asked, key, total, out)


@query
def sup_similar_price_share(spark, folder):
    return _similar(spark, folder, "supID", "sup_cntr_num", "sup_sim_price_share", SUPPLIER)


@query
def org_similar_price_share(spark, folder):
    return _similar(spark, folder, "orgID", "org_cntr_num", "org_sim_price_share", CUSTOMER)


# ---- sample -------------------------------------------------------------------------------

@query
def hash_sample_good(spark, folder):
    f = lazy_facts(spark, folder)
    return sample.sampled_good(labels.contract_labels(f), f.s, SAMPLE_MODE)


@query
def price_flags(spark, folder):
    f = full_facts(spark, folder)
    return sample.price_flags(f.finished_values, f.s).select(
        "valID", "price", "pmp", "price_higher_pmp", "price_too_low")


@query
def sample_full(spark, folder):
    s = stages(spark, folder)
    return build_sample(s.facts, s.statistics, SAMPLE_MODE)


@query
def sample_keys(spark, folder):
    return stages(spark, folder).sample.select(*SAMPLE_KEY, "cntr_result")


@query
def incremental_append(spark, folder):
    """A second load that repeats the first, and itself, adds only the new keys."""
    rows = stages(spark, folder).sample.select(*SAMPLE_KEY, "cntr_result")
    return upsert.insert_ignore(rows.filter("cntr_result = 1"), rows.unionByName(rows),
                                list(SAMPLE_KEY))


@query
def refresh_null_only(spark, folder):
    """Similar-price shares of newly loaded good rows are still NULL and get filled."""
    s = stages(spark, folder)
    new = F.col("cntr_result") == 0
    loaded = s.sample.withColumns({
        c: F.when(~new, F.col(c)) for c in ("sup_sim_price_share", "org_sim_price_share")})
    return sample.refresh_similar_shares(loaded, s.facts).select(
        *SAMPLE_KEY, "sup_sim_price_share", "org_sim_price_share")


# ---- one row per contract -----------------------------------------------------------------

@query
def okpd_prefix_rollup(spark, folder):
    rows = flatten.add_prefix(stages(spark, folder).sample)
    return flatten.code_totals(rows, COLUMN)


@query
def sup_prefix_rollup(spark, folder):
    rows = flatten.add_prefix(stages(spark, folder).sample)
    return flatten.supplier_code_totals(rows, COLUMN)


@query
def rolled_up_rows(spark, folder):
    sample_rows = stages(spark, folder).sample
    rows = flatten.roll_up_codes(sample_rows, hot=skew.hot_keys(sample_rows, ["supID"]))
    return rows.select(*SAMPLE_KEY, COLUMN, "okpd_cntr_num", "okpd_good_cntr_num",
                       "sup_okpd_cntr_num")


@query
def code_shares(spark, folder):
    rows = flatten.code_shares(stages(spark, folder).prepared.rolled_up)
    return rounded(rows.select(*SAMPLE_KEY, "okpd_good_cntr_share", "sup_okpd_cntr_share"))


@query
def codes_per_contract(spark, folder):
    return flatten.codes_per_contract(stages(spark, folder).sample)


@query
def okpd_distribution(spark, folder):
    return explore.codes_per_contract_distribution(stages(spark, folder).sample)


@query
def okpd_count_percentiles(spark, folder):
    return rounded(explore.codes_per_contract_percentiles(stages(spark, folder).sample))


@query
def multi_code_contracts(spark, folder):
    rows = stages(spark, folder).sample
    return flatten.multi_code_contracts(rows, skew.hot_keys(rows, ["cntrID"])).select(*SAMPLE_KEY)


@query
def multi_code_label_split(spark, folder):
    return flatten.multi_code_label_split(stages(spark, folder).sample)


@query
def unique_codes_by_length(spark, folder):
    return flatten.unique_codes_by_length(stages(spark, folder).sample)


@query
def first_row_per_code(spark, folder):
    rows = flatten.add_prefix(stages(spark, folder).sample)
    return flatten.keep_first(rows, ["cntrID", COLUMN]).select("cntrID", COLUMN, "okpdID",
                                                               "valID", "supID", "price")


@query
def okpd_multi_hot(spark, folder):
    p = stages(spark, folder).prepared
    return flatten.multi_hot(p.rolled_up, COLUMN, p.codes)


@query
def good_share_min_mean_max(spark, folder):
    rows = flatten.code_shares(stages(spark, folder).prepared.rolled_up)
    return rounded(flatten.good_share_range(rows, COLUMN))


@query
def supplier_specialisation(spark, folder):
    p = stages(spark, folder).prepared
    rows = flatten.code_shares(p.rolled_up)
    return rounded(flatten.supplier_specialisation(rows, COLUMN, p.codes))


@query
def flatten_contracts(spark, folder):
    """All steps from the sample to one row per contract."""
    rows = stages(spark, folder).sample
    hot = skew.hot_keys(rows, ["supID"])
    codes = flatten.prefix_codes(flatten.add_prefix(rows), COLUMN)
    return rounded(flatten.flatten(flatten.roll_up_codes(rows, hot=hot), codes, hot=hot))


# ---- features and cleaning ----------------------------------------------------------------

@query
def time_features(spark, folder):
    flat = features.time_features(stages(spark, folder).prepared.flat)
    return rounded(flat.select("cntrID", "plan_cntr_len", "day_price", "sign_month",
                               "sign_quarter"))


@query
def share_features(spark, folder):
    flat = features.share_features(stages(spark, folder).prepared.flat)
    return rounded(flat.select("cntrID", *(
        f"{side}_{kind}_cntr_share" for side in ("sup", "org")
        for kind in ("good", "fed", "sub", "mun"))))


@query
def decimal_comma_parse(spark, folder):
    """Shares written with a decimal comma, as in the exported files, and parsed again."""
    rows = stages(spark, folder).sample
    text = rows.select(*SAMPLE_KEY, *(
        F.regexp_replace(F.col(c).cast("string"), r"\.", ",").alias(c)
        for c in features.COMMA_COLUMNS))
    return text.select(*SAMPLE_KEY, *(decimal_comma(c).alias(c) for c in features.COMMA_COLUMNS))


@query
def engineered_features(spark, folder):
    return rounded(features.engineer(stages(spark, folder).prepared.flat, COLUMN))


@query
def mode_impute(spark, folder):
    df = stages(spark, folder).prepared.features
    filled = cleaning.impute_constant(cleaning.impute_modes(df, cleaning.fit_modes(df)))
    return filled.select("cntrID", "purch_type", "cntr_lvl", "org_ter", "sup_ter")


@query
def day_price_fixed(spark, folder):
    fixed = cleaning.fix_day_price(stages(spark, folder).prepared.features)
    return rounded(fixed.select("cntrID", "plan_cntr_len", "day_price", "price"))


@query
def log_transform(spark, folder):
    s = stages(spark, folder).prepared
    return rounded(cleaning.log_transform(s.features, NUMERIC).select("cntrID", *NUMERIC))


@query
def clean_after_eda(spark, folder):
    return rounded(cleaning.clean(stages(spark, folder).prepared.features, keep_id=True)[0])


# ---- encoding -----------------------------------------------------------------------------

def _clean(spark, folder):
    s = stages(spark, folder)
    return s.clean, s.prepared.spec


@query
def percentile_limits(spark, folder):
    df, spec = _clean(spark, folder)
    return rounded(encode.percentile_limits(df, encode.quantitative_columns(spec)))


@query
def percentile_limits_sketch(spark, folder):
    df, spec = _clean(spark, folder)
    return encode.approximate_limits(df, encode.quantitative_columns(spec))


@query
def winsorise_and_flag(spark, folder):
    df, spec = _clean(spark, folder)
    columns = encode.quantitative_columns(spec)
    limits = encode.fit_limits(df, columns)
    out = encode.winsorised(encode.outlier_flags(df, limits), limits)
    return rounded(out.select("cntrID", *columns, *(f"{c}_out" for c in columns)))


@query
def standardise(spark, folder):
    df, spec = _clean(spark, folder)
    params = encode.fit_quantitative(df, spec)
    return rounded(encode.apply_quantitative(df, params).select("cntrID", *spec.numeric))


@query
def rare_grouping(spark, folder):
    df, spec = _clean(spark, folder)
    return encode.grouped_categories(df, spec.categorical).select("cntrID", *spec.categorical)


@query
def woe_table(spark, folder):
    df, spec = _clean(spark, folder)
    return encode.woe_table(df, spec.categorical)


@query
def woe_encode(spark, folder):
    df, spec = _clean(spark, folder)
    params = encode.fit_categorical(df, spec)
    return encode.apply_categorical(df, params).select("cntrID", *spec.categorical)


@query
def train_valid_split(spark, folder):
    df, _ = _clean(spark, folder)
    train, valid = splitting.train_valid_split(df, mode="modulo")
    return train.select("cntrID", F.lit(0).alias("valid")).unionByName(
        valid.select("cntrID", F.lit(1).alias("valid")))


@query
def stratified_folds(spark, folder):
    df, _ = _clean(spark, folder)
    return splitting.stratified_folds(df, 3, mode="modulo").select(
        "cntrID", "cntr_result", "fold")


@query
def encode_fit_apply(spark, folder):
    """Parameters fitted on the training rows, applied to the validation rows."""
    df, spec = _clean(spark, folder)
    train, valid = splitting.train_valid_split(df, mode="modulo")
    return rounded(encode.transform(valid, encode.fit(train, spec)), 5)


@query
def params_round_trip(spark, folder):
    """Fitted parameters written to the shared folder and read back."""
    df, spec = _clean(spark, folder)
    path = f"{shared_folder(spark)}/tenderlens/params-{spark.sparkContext.applicationId}"
    modelstore.save_params(spark, encode.fit(df, spec), path)
    return rounded(modelstore.params_table(spark, modelstore.load_params(spark, path)))


# ---- exploration --------------------------------------------------------------------------

@query
def describe_numeric(spark, folder):
    return rounded(explore.describe(stages(spark, folder).prepared.features, list(NUMERIC)), 4)


@query
def describe_shares(spark, folder):
    return rounded(explore.describe(stages(spark, folder).prepared.features, list(SHARES)), 4)


@query
def corr_matrix(spark, folder):
    df, spec = _clean(spark, folder)
    return rounded(explore.correlation_matrix(df, list(spec.numeric)))


@query
def corr_with_label(spark, folder):
    df, spec = _clean(spark, folder)
    return rounded(explore.correlation_with_label(df, [*spec.numeric, *spec.shares]))


@query
def anova_f(spark, folder):
    df, spec = _clean(spark, folder)
    return rounded(explore.anova_f(df, [*spec.numeric, *spec.shares]), 4)


@query
def chi2_score(spark, folder):
    df = cleaning.impute_constant(stages(spark, folder).prepared.features)
    df = cleaning.impute_modes(df, cleaning.fit_modes(df))
    return rounded(explore.chi2_score(df, list(CATEGORICAL)), 4)


@query
def rate_features(spark, folder):
    df, spec = _clean(spark, folder)
    return rounded(explore.rate_features(df, list(spec.numeric), ["f_classif", "chi2"]), 4)


@query
def information_value(spark, folder):
    df, spec = _clean(spark, folder)
    return rounded(explore.information_value(df, [*spec.categorical, *spec.binary]))


@query
def label_by_category(spark, folder):
    return rounded(explore.label_by_category(stages(spark, folder).prepared.features,
                                             "sign_month"))


@query
def histogram_clipped(spark, folder):
    return rounded(explore.clipped_histogram(stages(spark, folder).prepared.features,
                                             list(NUMERIC)), 4)


@query
def quantile_grid(spark, folder):
    return rounded(explore.quantile_grid(stages(spark, folder).prepared.features,
                                         list(NUMERIC)), 4)


@query
def sorted_series(spark, folder):
    return rounded(explore.sorted_series(stages(spark, folder).prepared.features,
                                         list(NUMERIC)), 10)


@query
def category_frequency(spark, folder):
    return explore.category_frequency(stages(spark, folder).prepared.features, CATEGORICAL)


@query
def dummy_frequency(spark, folder):
    df, spec = _clean(spark, folder)
    return explore.dummy_frequency(df, spec.binary)


@query
def distinct_counts(spark, folder):
    return explore.distinct_counts(stages(spark, folder).prepared.features, CATEGORICAL)


@query
def missing_share(spark, folder):
    df = stages(spark, folder).prepared.features
    return rounded(explore.missing_share(df, [c for c in df.columns if c != "cntrID"]))


# ---- metrics ------------------------------------------------------------------------------

@query
def accuracy_and_log_loss(spark, folder):
    return rounded(metrics.accuracy_and_loss(scored_contracts(spark, folder)))


@query
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(scored_contracts(spark, folder)))


@query
def roc_points(spark, folder):
    return rounded(metrics.roc_points(scored_contracts(spark, folder)))


@query
def confusion_matrix(spark, folder):
    return rounded(metrics.confusion_matrix(scored_contracts(spark, folder)))


@query
def classification_report(spark, folder):
    return metrics.classification_report(scored_contracts(spark, folder))


@query
def calibration_curve(spark, folder):
    return rounded(metrics.calibration_curve(scored_contracts(spark, folder)))


@query
def probability_histogram(spark, folder):
    return metrics.probability_histogram(scored_contracts(spark, folder))


@query
def probability_dependency(spark, folder):
    return metrics.label_by_probability(scored_contracts(spark, folder))


@query
def cv_score_summary(spark, folder):
    """Scores of three folds per purchase type, summarised per type."""
    wh = lazy_facts(spark, folder).wh
    kinds = wh.contracts.select(F.col("ID").alias("cntrID"),
                                F.col("RefTypePurch").cast("string").alias("model"))
    scores = (scored_contracts(spark, folder).join(kinds, "cntrID")
              .groupBy("model", (F.col("cntrID") % 3).alias("fold"))
              .agg(F.count("*").cast("double").alias("fit_time"),
                   metrics.accuracy().alias("test_accuracy"),
                   (-metrics.log_loss()).alias("test_neg_log_loss")))
    return rounded(metrics.score_summary(scores))


# ---- models -------------------------------------------------------------------------------

LOGISTIC, _, FOREST, DEEP_FOREST, BOOSTING, DEEP_BOOSTING = training.FINALISTS
SMALL_FOREST = training.Classifier("RandForest", "RandForest",
                                   {"n_estimators": 20, "max_depth": 8, "max_features": 40})
# Rounds follow each other, a job for every level: the registered query stops after these.
ROUNDS = 10


def _held_out(spark, folder, clf):
    """Contracts held out with their label, and whether the model is sound: probabilities lie in
    [0, 1], predictions follow from them, and on its training rows the model loses less than the
    share of bad contracts would."""
    df, spec = _clean(spark, folder)
    train, valid = splitting.train_valid_split(df, mode="modulo")
    fitted = training.fit_classifier(clf, train, spec)
    loss = metrics.accuracy_and_loss(fitted.predictions(train)).first().log_loss
    bad = train.agg(F.avg("cntr_result")).first()[0]
    prior = -(bad * math.log(bad) + (1 - bad) * math.log(1 - bad))
    return fitted.predictions(valid).select(
        "cntrID", "label", F.col("probability").between(0, 1).cast("int").alias("valid_probability"),
        # A forest votes for the first class at one half.
        ((F.col("prediction") == (F.col("probability") >= 0.5).cast("int"))
         | (F.abs(F.col("probability") - 0.5) < 1e-9)).cast("int").alias("prediction_follows"), F.lit(int(loss < prior)).alias("better_than_share"))


@query
def train_logistic(spark, folder):
    return _held_out(spark, folder, LOGISTIC)


@query
def train_forest(spark, folder):
    return _held_out(spark, folder, FOREST)


@query
def train_deep_forest(spark, folder):
    return _held_out(spark, folder, DEEP_FOREST)


@query
def train_gbt(spark, folder):
    return _held_out(spark, folder, replace(
        BOOSTING, params={**BOOSTING.params, "n_estimators": ROUNDS, "eta": 0.3}))


@query
def train_deep_gbt(spark, folder):
    return _held_out(spark, folder, replace(
        DEEP_BOOSTING, params={**DEEP_BOOSTING.params, "n_estimators": ROUNDS}))


@query
def train_mlp(spark, folder):
    return _held_out(spark, folder, training.NETWORKS[0])


@query
def train_tanh_network(spark, folder):
    return _held_out(spark, folder, training.NETWORKS[1])


def _first_splits(spark, folder):
    """Sums and gain of every split of the root at fixed cuts of the shares, and their names."""
    df, spec = _clean(spark, folder)
    x = F.array(*(F.coalesce(c, F.lit(0.0)) for c in spec.shares))
    cuts = [[i / 20 for i in range(1, 20)]] * len(spec.shares)
    rows = boosting.binned(df.select("cntr_result", x.alias("x")), cuts).select(
        F.lit(0).alias("node"), (0.5 - F.col("cntr_result")).alias("g"), F.lit(0.25).alias("h"),
        "bins")
    name = F.array(*map(F.lit, spec.shares))[F.col("feature")].alias("variable")
    return boosting.split_gains(boosting.histogram(rows), boosting.Boosting()), name


@query
def boosting_split_gains(spark, folder):
    gains, name = _first_splits(spark, folder)
    return rounded(gains.select(name, "bin", "gl", "hl", "gr", "hr", "gain"))


@query
def boosting_first_split(spark, folder):
    gains, name = _first_splits(spark, folder)
    return rounded(boosting.best_splits(gains).select(name, "bin", "gain"))


@query
def cross_validate(spark, folder):
    df, spec = _clean(spark, folder)
    return training.cross_validate(LOGISTIC, df, spec, 2)[0]


@query
def holdout_validate(spark, folder):
    df, spec = _clean(spark, folder)
    train, valid = splitting.train_valid_split(df)
    return training.validate(LOGISTIC, train, valid, spec)[0]


@query
def feature_weights(spark, folder):
    df, spec = _clean(spark, folder)
    fitted = [training.fit_classifier(c, df, spec) for c in (LOGISTIC, SMALL_FOREST)]
    return training.feature_weights(fitted, spark)


# The searched ranges with fewer trees and rounds, as a trial of a thousand takes an hour here.
SMALL_SPACE = {
    **training.SPACE,
    "RandForest": {**training.SPACE["RandForest"], "n_estimators": (10, 30, 10)},
    "Boosting": {**training.SPACE["Boosting"], "n_estimators": (2, 4, 1), "max_depth": (1, 3, 1)},
}


def _in_range(space: dict):
    """Whether the parameters of a trial lie in the space."""
    tests = []
    for kind, params in space.items():
        test = F.col("model") == kind
        for name, domain in params.items():
            value = F.get_json_object("params", f"$.{name}")
            test = test & (value.isin(*map(str, domain)) if isinstance(domain, list)
                           else value.cast("double").between(*domain[:2]))
        tests.append(test)
    return reduce(lambda a, b: a | b, tests)


def _search(spark, folder, search, trials):
    """Trials with whether each is in the space and, of the best, whether it beats the share of
    bad contracts on the rows held out."""
    df, spec = _clean(spark, folder)
    history = stage(search(df, spec, trials=trials, space=SMALL_SPACE), "history")
    bad = df.agg(F.avg("cntr_result")).first()[0]
    prior = bad * math.log(bad) + (1 - bad) * math.log(1 - bad)
    best = history.agg(F.max("score")).first()[0]
    return history.select("trial", _in_range(SMALL_SPACE).cast("int").alias("in_space"),
                          F.lit(int(best > prior)).alias("best_beats_share"))


@query
def random_search(spark, folder):
    return _search(spark, folder, training.random_search, 2)


@query
def guided_search(spark, folder):
    return _search(spark, folder, training.guided_search, 10)


@query
def best_so_far(spark, folder):
    """The log of a search: each line beats all before it. The history is a formula of the
    contracts per purchase type, so that another engine can write the same."""
    wh = lazy_facts(spark, folder).wh
    counts = wh.contracts.groupBy("RefTypePurch").agg(F.count("*").alias("n"))
    history = counts.select(
        (F.col("RefTypePurch") + 1).alias("trial"), F.lit("LogReg").alias("model"),
        F.format_string('{"C": %d}', "RefTypePurch").alias("params"),
        (-(F.col("n") * 7919 % 1000) / 1000).alias("score"))
    return rounded(training.best_so_far(history))


@query
def batch_score(spark, folder):
    """A saved model with its encoding, loaded and applied to all contracts."""
    df, spec = _clean(spark, folder)
    path = f"{shared_folder(spark)}/tenderlens/model-{spark.sparkContext.applicationId}"
    train, _ = splitting.train_valid_split(df)
    modelstore.save_model(spark, training.fit_classifier(SMALL_FOREST, train, spec), path)
    return modelstore.load_model(spark, path).predictions(df)
