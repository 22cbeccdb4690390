"""Feature engineering on the flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from tenderlens.functions.scalars import (
    days_between, decimal_comma, month_of, quarter_of, ratio,
)

# Columns that later columns replace, and the order of the contract columns.
REPLACED = (
    "valID", "supID", "orgID", "okpdID", "cntr_reg_num", "okpd",
    "sup_good_cntr_num", "sup_fed_cntr_num", "sup_sub_cntr_num", "sup_mun_cntr_num",
    "sup_okpd_cntr_num", "sup_okpd_cntr_share",
    "org_good_cntr_num", "org_fed_cntr_num", "org_sub_cntr_num", "org_mun_cntr_num",
    "okpd_good_cntr_num", "sign_date", "exec_date",
)
CONTRACT_COLUMNS = (
    "sign_month", "sign_quarter", "cntr_okpd_num", "plan_cntr_len", "day_price", "purch_type",
    "cntr_lvl", "price_higher_pmp", "price_too_low", "pmp", "price",
)
COMMA_COLUMNS = ("sup_cntr_avg_penalty_share", "sup_sim_price_share", "org_sim_price_share")


def time_features(df: DataFrame) -> DataFrame:
    """Planned length, price per day, signing month and quarter."""
    return df.withColumns({
        "plan_cntr_len": days_between("sign_date", "exec_date"),
        "sign_month": month_of("sign_date"),
    }).withColumns({
        "day_price": ratio("price", "plan_cntr_len"),
        "sign_quarter": quarter_of("sign_month"),
    })


def share_features(df: DataFrame) -> DataFrame:
    """Good, federal, regional and municipal shares of both parties."""
    return df.withColumns({
        f"{side}_{kind}_cntr_share": ratio(f"{side}_{kind}_cntr_num", f"{side}_cntr_num")
        for side in ("sup", "org") for kind in ("good", "fed", "sub", "mun")
    })


def parse_commas(df: DataFrame, columns: tuple[str, ...] = COMMA_COLUMNS) -> DataFrame:
    """Text columns with a decimal comma to double; numeric ones are left alone."""
    text = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
    return df.withColumns({c: decimal_comma(c) for c in text}) if text else df


def drop_replaced(df: DataFrame, column: str) -> DataFrame:
    return df.drop(*REPLACED, column)


def reorder(df: DataFrame, column: str) -> DataFrame:
    """Contract key, supplier, customer, code and contract columns, dummies, label last."""
    df = df.withColumnRenamed("okpd_num", "cntr_okpd_num")

    def starting(p: str) -> list[str]:
        return [c for c in df.columns if c.startswith(p)]

    names = ["cntrID", *starting("sup"), *starting("org"), "cntr_num_together",
             *starting("okpd_"), *CONTRACT_COLUMNS, *starting(column), *starting("socs"),
             "cntr_result"]
    return df.select(*(F.col(f"`{c}`") for c in names))


def engineer(flat: DataFrame, column: str) -> DataFrame:
    """All of the above, in order."""
    df = share_features(time_features(flat))
    return reorder(parse_commas(drop_replaced(df, column)), column)
