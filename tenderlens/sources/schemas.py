"""Declared schemas of the warehouse tables and of the tables derived from them."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

_TYPES = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType()}


def _struct(spec: str) -> StructType:
    """'name type[!], ...' -> StructType; '!' marks a column that is never NULL."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return StructType(fields)


SOURCE = {
    "contracts": _struct("ID long!, RefStage int, RefSignDate int, RefExecution int, "
                         "RefTypePurch int, RegNum string"),
    "value": _struct("ID long!, RefContract long, RefSupplier long, RefOrg long, "
                     "Price long, PMP long, RefLevelOrder int"),
    "product": _struct("RefContract long, RefProduct long, RefSupplier long"),
    "products": _struct("ID long!, RefOKPD2 int"),
    "okpd2": _struct("ID int!, Code string"),
    "suppliers": _struct("ID long!, RefTerritory int"),
    "org": _struct("ID long!, RefTypeOrg int, RefTerritory int"),
    "closures": _struct("RefContract long, RefTerminReason int, FactPaid double"),
    "termin_reason": _struct("ID int!, Code int"),
    "penalties": _struct("RefContract long, Accrual long"),
    "territory": _struct("ID int!, ParentID int"),
    "fed_subject": _struct("ID int!, Name string"),
}

SAMPLE_KEY = ("valID", "cntrID", "supID", "orgID", "okpdID")

DERIVED = {
    "cntr_stats": _struct("CntrID long!, result int"),
    "sup_stats": _struct(
        "SupID long!, sup_cntr_num long, sup_running_cntr_num long, sup_good_cntr_num long, "
        "sup_fed_cntr_num long, sup_sub_cntr_num long, sup_mun_cntr_num long, "
        "sup_cntr_avg_price long, sup_cntr_avg_penalty double, sup_no_pnl_share double, "
        "sup_1s_sev double, sup_1s_org_sev double"),
    "org_stats": _struct(
        "OrgID long!, org_cntr_num long, org_running_cntr_num long, org_good_cntr_num long, "
        "org_fed_cntr_num long, org_sub_cntr_num long, org_mun_cntr_num long, "
        "org_cntr_avg_price long, org_1s_sev double, org_1s_sup_sev double"),
    "okpd_stats": _struct("OkpdID int!, code string, cntr_num long, good_cntr_num long"),
    "okpd_sup_stats": _struct("SupID long!, OkpdID int!, cntr_num long"),
    "sup_org_stats": _struct("SupID long!, OrgID long!, cntr_num long"),
    "sample": _struct(
        "valID long!, cntrID long!, supID long!, orgID long!, okpdID int!, cntr_reg_num string, "
        "sup_cntr_num long, sup_running_cntr_num long, sup_good_cntr_num long, "
        "sup_fed_cntr_num long, sup_sub_cntr_num long, sup_mun_cntr_num long, "
        "sup_cntr_avg_price long, sup_cntr_avg_penalty_share double, sup_no_pnl_share double, "
        "sup_1s_sev double, sup_1s_org_sev double, sup_okpd_cntr_num long, "
        "sup_sim_price_share double, "
        "org_cntr_num long, org_running_cntr_num long, org_good_cntr_num long, "
        "org_fed_cntr_num long, org_sub_cntr_num long, org_mun_cntr_num long, "
        "org_cntr_avg_price long, org_1s_sev double, org_1s_sup_sev double, "
        "org_sim_price_share double, cntr_num_together long, org_type int, "
        "okpd_cntr_num long, okpd_good_cntr_num long, okpd string, "
        "price long, pmp long, cntr_lvl int, sign_date int, exec_date int, purch_type int, "
        "price_higher_pmp int, price_too_low int, cntr_result int, org_ter int, sup_ter int"),
    "fed_subject": SOURCE["fed_subject"],
}
