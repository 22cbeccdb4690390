"""Business constants and variable groups shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Closure reason codes, contract stages and levels of the source warehouse.
CLOSED_NORMALLY = 0
CUSTOMER_DECIDED = (8326974, 8361022, 8724082)
SUPPLIER_DECIDED = (8326975, 8361023, 8724083)
FINISHED_STAGES = (3, 4)
FEDERAL_LEVEL, REGIONAL_LEVEL = 1, 2
INIT_DATE = 20160000


@dataclass(frozen=True)
class Settings:
    """Knobs of the statistics and sampling stages.

    ``init_date`` is the yyyymmdd integer after which a contract counts as recent;
    ``int_division`` reproduces truncated shares (quotients of two integers).
    """

    init_date: int = INIT_DATE
    finished_stages: tuple[int, ...] = FINISHED_STAGES
    customer_decided: tuple[int, ...] = CUSTOMER_DECIDED
    supplier_decided: tuple[int, ...] = SUPPLIER_DECIDED
    int_division: bool = False
    good_percent: int = 20
    low_price_ratio: float = 0.6


# Variable groups of the flat one-row-per-contract table.
NUMERIC = (
    "sup_cntr_num", "sup_running_cntr_num", "sup_cntr_avg_price",
    "org_cntr_num", "org_running_cntr_num", "org_cntr_avg_price",
    "cntr_num_together", "okpd_cntr_num", "cntr_okpd_num",
    "plan_cntr_len", "day_price", "pmp", "price",
)
SHARES = (
    "sup_cntr_avg_penalty_share", "sup_no_pnl_share", "sup_1s_sev", "sup_1s_org_sev",
    "sup_sim_price_share", "sup_good_cntr_share", "sup_fed_cntr_share",
    "sup_sub_cntr_share", "sup_mun_cntr_share",
    "org_1s_sev", "org_1s_sup_sev", "org_sim_price_share", "org_good_cntr_share",
    "org_fed_cntr_share", "org_sub_cntr_share", "org_mun_cntr_share",
    "okpd_good_share_min", "okpd_good_share_mean", "okpd_good_share_max",
)
CATEGORICAL = (
    "sup_ter", "org_type", "org_ter", "sign_month", "sign_quarter", "purch_type", "cntr_lvl",
)
BINARY = ("price_higher_pmp", "price_too_low")
DUMMY_PREFIXES = ("okpd2_", "socs")

# Columns found useless or collinear in the exploratory analysis.
USELESS = (
    "sup_1s_sev", "sup_1s_org_sev", "org_1s_sev", "org_1s_sup_sev",
    "org_fed_cntr_share", "org_sub_cntr_share", "org_mun_cntr_share",
    "price_higher_pmp", "price_too_low", "sup_ter", "pmp",
)
COLLINEAR = (
    "okpd_good_share_mean", "okpd_good_share_max", "price",
    "org_running_cntr_num", "sup_cntr_num", "sign_quarter",
)
# Share columns winsorised before training.
WINSORISED_SHARES = ("okpd_good_share_min", "sup_cntr_avg_penalty_share", "org_sim_price_share")

LABEL = "cntr_result"
ROW_ID = "cntrID"


@dataclass(frozen=True)
class FeatureSpec:
    """The four variable groups of a feature table. Immutable: dropping returns a new spec."""

    shares: tuple[str, ...]
    numeric: tuple[str, ...]
    binary: tuple[str, ...]
    categorical: tuple[str, ...]

    @classmethod
    def of(cls, columns) -> "FeatureSpec":
        """Group the given column names; dummies are recognised by their prefix."""
        columns = list(columns)
        dummies = tuple(c for c in columns if c.startswith(DUMMY_PREFIXES))
        return cls(SHARES, NUMERIC, BINARY + dummies, CATEGORICAL).only(columns)

    def only(self, columns) -> "FeatureSpec":
        kept = set(columns)
        return replace(self, **{
            group: tuple(c for c in getattr(self, group) if c in kept)
            for group in ("shares", "numeric", "binary", "categorical")
        })

    def without(self, columns) -> "FeatureSpec":
        return self.only(set(self.all) - set(columns))

    @property
    def all(self) -> tuple[str, ...]:
        return self.shares + self.numeric + self.binary + self.categorical
