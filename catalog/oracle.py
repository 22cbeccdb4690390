"""The same results in plain SQL, for DuckDB over the given tables.

Every statement is written from the definition of its result, mostly row by row or as a direct
range join, and shares no code or plan with the Spark queries.
"""

from __future__ import annotations

from tenderlens.settings import (
    BINARY, CATEGORICAL, COLLINEAR, NUMERIC, SHARES, USELESS, WINSORISED_SHARES,
)
from tenderlens.sources.schemas import DERIVED, SAMPLE_KEY

INIT = 19970000
CUSTOMER = "(8326974, 8361022, 8724082)"
SUPPLIER = "(8326975, 8361023, 8724083)"
# Code prefixes of the test data, and so its dummy columns.
CODES = ("EC", "LA", "ME", "PR", "SM", "ST")
DUMMIES = tuple(f"okpd2_{c}" for c in CODES) + tuple(f"socs_{c}" for c in CODES)
SAMPLE_COLUMNS = DERIVED["sample"].fieldNames()
KEY = ", ".join(SAMPLE_KEY)

# name -> (SQL, names it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (sql, needs)


def statement(sql: str, *needs: str) -> str:
    """``sql`` behind a WITH clause that holds what it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for n in VIEWS[name][1]:
            visit(n)
        ordered.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(
        f"{n} AS {'' if VIEWS[n][0].lstrip().startswith('--recursive') else 'MATERIALIZED '}"
        f"({VIEWS[n][0].replace('--recursive', '')})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{sql}"


def listed(columns, template: str = "{c}") -> str:
    return ", ".join(template.format(c=c) for c in columns)


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) AS {name}"


def rounded(columns, places: int = 6) -> str:
    return ", ".join(r(c, c, places) for c in columns)


def long(columns, relation: str, keep: str = "", cast: str = "DOUBLE") -> str:
    keep = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS variable, CAST({c} AS {cast}) AS v FROM {relation}"
        for c in columns)


# ---- source tables ------------------------------------------------------------------------

view("contracts", """
    SELECT o_orderkey AS ID,
           CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 4 ELSE 2 END AS RefStage,
           CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS RefSignDate,
           CAST(strftime(s.last_ship, '%Y%m%d') AS INTEGER) AS RefExecution,
           CASE WHEN left(o_orderpriority, 1) = '4' THEN -1
                ELSE CAST(left(o_orderpriority, 1) AS INTEGER) END AS RefTypePurch,
           lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS RegNum
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship
                           FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey""")
view("vals", """
    SELECT l_orderkey * 1000000 + l_suppkey AS ID, l_orderkey AS RefContract,
           l_suppkey AS RefSupplier, any_value(o_custkey) AS RefOrg,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // 100 AS BIGINT) AS Price,
           CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT))
                // 100 AS BIGINT) AS PMP,
           any_value(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END)
               AS RefLevelOrder
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
    GROUP BY l_orderkey, l_suppkey""")
view("product", "SELECT l_orderkey AS RefContract, l_partkey AS RefProduct, "
     "l_suppkey AS RefSupplier FROM lineitem")
_OKPD_ID = ("100 * list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], "
            "p_type) + CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER)")
view("products", f"SELECT p_partkey AS ID, CAST({_OKPD_ID} AS INTEGER) AS RefOKPD2 FROM part")
view("okpd2", f"""
    SELECT DISTINCT CAST({_OKPD_ID} AS INTEGER) AS ID,
           upper(left(p_type, 2)) || '.'
           || lpad(regexp_extract(p_brand, '([0-9]+)$', 1), 2, '0') AS Code FROM part""")
view("closures", """
    SELECT l_orderkey AS RefContract,
           CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND round(l_discount * 100) >= 8
                THEN list_extract([8326974, 8326975, 8361022, 8361023, 8724082, 8724083],
                                  CAST((l_orderkey + l_linenumber) % 6 + 1 AS INTEGER))
                ELSE 0 END AS Code,
           l_extendedprice * (1 - l_discount) AS FactPaid
    FROM lineitem WHERE l_linenumber <= 5""")
view("penalties", """
    SELECT l_orderkey AS RefContract,
           CASE WHEN l_linenumber <> 7
                THEN CAST(round(l_extendedprice * 100) AS BIGINT)
                     * CAST(round(l_tax * 100) AS BIGINT) // 10000 END AS Accrual
    FROM lineitem WHERE round(l_tax * 100) >= 7""")
view("suppliers", """
    SELECT s_suppkey AS ID, CASE WHEN s_suppkey % 5 <> 0
           THEN 10000 + 10 * s_nationkey + s_suppkey % 3 END AS RefTerritory FROM supplier""")
view("org", """
    SELECT c_custkey AS ID,
           CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'],
                              c_mktsegment) AS INTEGER) AS RefTypeOrg,
           CASE WHEN c_custkey % 100 <> 0 THEN 100 + c_nationkey END AS RefTerritory
    FROM customer""")
view("territory", """
    SELECT 1000 + r_regionkey AS ID, CAST(NULL AS INTEGER) AS ParentID FROM region
    UNION ALL SELECT 100 + n_nationkey, 1000 + n_regionkey FROM nation
    UNION ALL SELECT 10000 + 10 * n_nationkey + k,
                     CASE WHEN n_nationkey <> 24 THEN 100 + n_nationkey END
    FROM nation, (VALUES (0), (1), (2)) t(k)""")

# ---- statistics ---------------------------------------------------------------------------

view("rec", f"""
    SELECT v.ID AS valID, v.RefContract AS cntrID, v.RefSupplier AS supID, v.RefOrg AS orgID,
           v.Price AS price, v.PMP AS pmp, v.RefLevelOrder AS lvl, c.RefStage IN (3, 4) AS fin
    FROM vals v JOIN contracts c ON c.ID = v.RefContract WHERE c.RefSignDate > {INIT}""",
     "vals", "contracts")
view("fin", "SELECT * FROM rec WHERE fin", "rec")
view("labels_", f"""
    SELECT c.ID AS CntrID, CASE WHEN l.n IS NULL THEN NULL WHEN l.top = 0 THEN 0 ELSE 1 END
           AS result
    FROM contracts c LEFT JOIN (
        SELECT cl.RefContract, max(cl.Code) AS top, count(*) AS n
        FROM vals v JOIN closures cl ON cl.RefContract = v.RefContract GROUP BY 1) l
        ON l.RefContract = c.ID
    WHERE c.RefStage IN (3, 4) AND c.RefSignDate > {INIT}""", "contracts", "vals", "closures")


def _severed(key: str, codes: str) -> str:
    return (f"SELECT {key} AS k, count(DISTINCT cntrID) AS n FROM rec "
            f"JOIN closures ON RefContract = cntrID WHERE Code IN {codes} GROUP BY 1")


def _share(n: str, total: str) -> str:
    return (f"CASE WHEN coalesce({total}, 0) = 0 THEN 0.0 "
            f"ELSE round(coalesce({n}, 0) / {total}, 3) END")


view("sup_stats_", f"""
    SELECT s.ID AS SupID, coalesce(f.n, 0) AS sup_cntr_num,
           coalesce(f.running, 0) AS sup_running_cntr_num, coalesce(f.good, 0) AS sup_good_cntr_num,
           coalesce(f.fed, 0) AS sup_fed_cntr_num, coalesce(f.sub, 0) AS sup_sub_cntr_num,
           coalesce(f.n - f.fed - f.sub, 0) AS sup_mun_cntr_num,
           f.price AS sup_cntr_avg_price, coalesce(p.share, 0) AS sup_cntr_avg_penalty,
           {_share('np.n', 'f.n')} AS sup_no_pnl_share,
           {_share('a.n', 'f.n')} AS sup_1s_sev, {_share('b.n', 'f.n')} AS sup_1s_org_sev
    FROM suppliers s
    LEFT JOIN (SELECT supID, count(*) FILTER (fin) AS n, count(*) FILTER (NOT fin) AS running,
                      count(*) FILTER (fin AND result = 0) AS good,
                      count(*) FILTER (fin AND lvl = 1) AS fed,
                      count(*) FILTER (fin AND lvl = 2) AS sub,
                      CAST(trunc(avg(price) FILTER (fin)) AS BIGINT) AS price
               FROM rec LEFT JOIN labels_ l ON l.CntrID = rec.cntrID GROUP BY 1) f ON f.supID = s.ID
    LEFT JOIN (SELECT supID, round(avg(DISTINCT CAST(Accrual AS DOUBLE) / price), 3) AS share
               FROM fin JOIN penalties ON RefContract = cntrID WHERE price > 0 GROUP BY 1) p
              ON p.supID = s.ID
    LEFT JOIN (SELECT supID, count(DISTINCT cntrID) AS n
               FROM fin LEFT JOIN penalties ON RefContract = cntrID WHERE Accrual IS NULL
               GROUP BY 1) np ON np.supID = s.ID
    LEFT JOIN ({_severed('supID', SUPPLIER)}) a ON a.k = s.ID
    LEFT JOIN ({_severed('supID', CUSTOMER)}) b ON b.k = s.ID""",
     "suppliers", "rec", "fin", "labels_", "penalties", "closures")
view("org_stats_", f"""
    SELECT s.ID AS OrgID, coalesce(f.n, 0) AS org_cntr_num,
           coalesce(f.running, 0) AS org_running_cntr_num, coalesce(f.good, 0) AS org_good_cntr_num,
           coalesce(f.fed, 0) AS org_fed_cntr_num, coalesce(f.sub, 0) AS org_sub_cntr_num,
           coalesce(f.n - f.fed - f.sub, 0) AS org_mun_cntr_num,
           f.price AS org_cntr_avg_price,
           {_share('a.n', 'f.n')} AS org_1s_sev, {_share('b.n', 'f.n')} AS org_1s_sup_sev
    FROM org s
    LEFT JOIN (SELECT orgID, count(*) FILTER (fin) AS n, count(*) FILTER (NOT fin) AS running,
                      count(*) FILTER (fin AND result = 0) AS good,
                      count(*) FILTER (fin AND lvl = 1) AS fed,
                      count(*) FILTER (fin AND lvl = 2) AS sub,
                      CAST(trunc(avg(price) FILTER (fin)) AS BIGINT) AS price
               FROM rec LEFT JOIN labels_ l ON l.CntrID = rec.cntrID GROUP BY 1) f ON f.orgID = s.ID
    LEFT JOIN ({_severed('orgID', CUSTOMER)}) a ON a.k = s.ID
    LEFT JOIN ({_severed('orgID', SUPPLIER)}) b ON b.k = s.ID""",
     "org", "rec", "labels_", "closures")
view("finprod", f"""
    SELECT p.RefContract AS cntrID, p.RefSupplier AS supID, d.RefOKPD2 AS okpdID
    FROM product p JOIN contracts c ON c.ID = p.RefContract JOIN products d ON d.ID = p.RefProduct
    WHERE c.RefStage IN (3, 4) AND c.RefSignDate > {INIT}""", "product", "contracts", "products")
view("okpd_stats_", """
    SELECT o.ID AS OkpdID, o.Code AS code, count(*) AS cntr_num,
           nullif(count(*) FILTER (result = 0), 0) AS good_cntr_num
    FROM finprod JOIN okpd2 o ON o.ID = okpdID LEFT JOIN labels_ l ON l.CntrID = finprod.cntrID
    GROUP BY 1, 2""", "finprod", "okpd2", "labels_")
view("okpd_sup_", """
    SELECT supID AS SupID, okpdID AS OkpdID, count(DISTINCT cntrID) AS cntr_num
    FROM finprod JOIN suppliers s ON s.ID = supID GROUP BY 1, 2""", "finprod", "suppliers")
view("sup_org_", """
    SELECT supID AS SupID, orgID AS OrgID, count(*) AS cntr_num
    FROM fin JOIN suppliers s ON s.ID = supID JOIN org o ON o.ID = orgID GROUP BY 1, 2""",
     "fin", "suppliers", "org")
view("climb", """--recursive
    SELECT ID AS start, ID AS cur FROM territory
    UNION ALL
    SELECT start, t.ParentID FROM climb JOIN territory t ON t.ID = cur
    WHERE cur NOT IN (SELECT 1000 + r_regionkey FROM region)""", "territory")
view("subject", """
    SELECT t.ID AS territory, s.cur AS subject FROM territory t
    LEFT JOIN (SELECT * FROM climb WHERE cur IN (SELECT 1000 + r_regionkey FROM region)) s
    ON s.start = t.ID""", "climb", "territory")


def _similar(key: str, name: str) -> str:
    return f"""
    SELECT q.{key}, q.price, round(count(f.valID) / q.total, 3) AS {name}
    FROM (SELECT {key}, price, sum(count(*)) OVER (PARTITION BY {key}) AS total
          FROM fin GROUP BY 1, 2) q
    JOIN fin f ON f.{key} = q.{key} AND abs(f.price - q.price) * 5 <= q.price
    GROUP BY q.{key}, q.price, q.total"""


view("sup_sim", _similar("supID", "sup_sim_price_share"), "fin")
view("org_sim", _similar("orgID", "org_sim_price_share"), "fin")

# ---- sample -------------------------------------------------------------------------------

_FROM_STATS = {
    "sup_cntr_avg_penalty_share": "ss.sup_cntr_avg_penalty",
    "sup_okpd_cntr_num": "os2.cntr_num", "sup_sim_price_share": "x.sup_sim_price_share",
    "org_sim_price_share": "y.org_sim_price_share", "cntr_num_together": "so.cntr_num",
    "org_type": "o.RefTypeOrg", "okpd_cntr_num": "ks.cntr_num",
    "okpd_good_cntr_num": "ks.good_cntr_num", "okpd": "ks.code", "price": "v.price",
    "pmp": "v.pmp", "cntr_lvl": "v.lvl", "sign_date": "c.RefSignDate",
    "exec_date": "c.RefExecution", "purch_type": "c.RefTypePurch", "cntr_result": "l.result",
    "price_higher_pmp": "CASE WHEN v.pmp > 0 AND v.price > v.pmp THEN 1 ELSE 0 END",
    "price_too_low": "CASE WHEN v.price <= v.pmp * 0.6 THEN 1 ELSE 0 END",
    "org_ter": "ot.subject", "sup_ter": "st.subject", "valID": "v.valID", "cntrID": "v.cntrID",
    "supID": "v.supID", "orgID": "v.orgID", "okpdID": "k.okpdID", "cntr_reg_num": "c.RegNum",
}


def _sample_column(c: str) -> str:
    if c in _FROM_STATS:
        return f"{_FROM_STATS[c]} AS {c}"
    return f"{'ss' if c.startswith('sup') else 'gs'}.{c} AS {c}"


view("sample_", f"""
    SELECT {', '.join(map(_sample_column, SAMPLE_COLUMNS))}
    FROM fin v JOIN contracts c ON c.ID = v.cntrID JOIN labels_ l ON l.CntrID = v.cntrID
    JOIN org o ON o.ID = v.orgID JOIN suppliers s ON s.ID = v.supID
    JOIN (SELECT DISTINCT cntrID, okpdID FROM finprod) k ON k.cntrID = v.cntrID
    JOIN sup_stats_ ss ON ss.SupID = v.supID JOIN org_stats_ gs ON gs.OrgID = v.orgID
    JOIN okpd_stats_ ks ON ks.OkpdID = k.okpdID
    JOIN okpd_sup_ os2 ON os2.SupID = v.supID AND os2.OkpdID = k.okpdID
    JOIN sup_org_ so ON so.SupID = v.supID AND so.OrgID = v.orgID
    LEFT JOIN sup_sim x ON x.supID = v.supID AND x.price = v.price
    LEFT JOIN org_sim y ON y.orgID = v.orgID AND y.price = v.price
    LEFT JOIN subject st ON st.territory = s.RefTerritory
    LEFT JOIN subject ot ON ot.territory = o.RefTerritory
    WHERE (l.result = 1 AND v.price > 0)
       OR (l.result = 0 AND v.cntrID % 100 < 20
           AND v.cntrID IN (SELECT cntrID FROM fin WHERE price > 0))""",
     "fin", "contracts", "labels_", "org", "suppliers", "finprod", "sup_stats_", "org_stats_",
     "okpd_stats_", "okpd_sup_", "sup_org_", "sup_sim", "org_sim", "subject")

# ---- one row per contract -----------------------------------------------------------------

view("code_totals", """
    SELECT left(okpd, 2) AS okpd2, CAST(coalesce(sum(okpd_cntr_num), 0) AS BIGINT) AS okpd_cntr_num,
           CAST(coalesce(sum(okpd_good_cntr_num), 0) AS BIGINT) AS okpd_good_cntr_num
    FROM (SELECT *, row_number() OVER (PARTITION BY okpd ORDER BY okpdID, valID, supID, orgID) AS i
          FROM sample_) WHERE i = 1 GROUP BY 1""", "sample_")
view("sup_totals", """
    SELECT supID, left(okpd, 2) AS okpd2,
           CAST(coalesce(sum(sup_okpd_cntr_num), 0) AS BIGINT) AS sup_okpd_cntr_num
    FROM (SELECT *, row_number() OVER (PARTITION BY supID, okpd ORDER BY okpdID, valID, orgID) AS i
          FROM sample_) WHERE i = 1 GROUP BY 1, 2""", "sample_")
view("rolled", f"""
    SELECT {listed([c for c in SAMPLE_COLUMNS if c not in ('okpd_cntr_num', 'okpd_good_cntr_num',
                                                           'sup_okpd_cntr_num')], 's.{c}')},
           left(s.okpd, 2) AS okpd2, a.okpd_cntr_num, a.okpd_good_cntr_num, b.sup_okpd_cntr_num,
           CAST(a.okpd_good_cntr_num AS DOUBLE) / nullif(a.okpd_cntr_num, 0)
               AS okpd_good_cntr_share,
           CAST(b.sup_okpd_cntr_num AS DOUBLE) / nullif(s.sup_cntr_num, 0) AS sup_okpd_cntr_share
    FROM sample_ s JOIN code_totals a ON a.okpd2 = left(s.okpd, 2)
    JOIN sup_totals b ON b.supID = s.supID AND b.okpd2 = left(s.okpd, 2)""",
     "sample_", "code_totals", "sup_totals")
view("hot", "SELECT cntrID, " + ", ".join(
    f"CAST(max(CASE WHEN okpd2 = '{c}' THEN 1 ELSE 0 END) AS INTEGER) AS okpd2_{c}"
    for c in CODES) + " FROM rolled GROUP BY 1", "rolled")
view("good_range", """
    SELECT cntrID, min(s) AS okpd_good_share_min, avg(s) AS okpd_good_share_mean,
           max(s) AS okpd_good_share_max
    FROM (SELECT DISTINCT cntrID, okpd2, okpd_good_cntr_share AS s FROM rolled) GROUP BY 1""",
     "rolled")
view("socs", "SELECT supID, " + ", ".join(
    f"coalesce(max(CASE WHEN okpd2 = '{c}' THEN sup_okpd_cntr_share END), 0.0) AS socs_{c}"
    for c in CODES) + " FROM rolled GROUP BY 1", "rolled")
view("flat_", f"""
    SELECT f.* EXCLUDE (i, okpd_good_cntr_share), n.okpd_num, g.okpd_good_share_min,
           g.okpd_good_share_mean, g.okpd_good_share_max,
           {listed([f'okpd2_{c}' for c in CODES], 'h.{c}')},
           {listed([f'socs_{c}' for c in CODES], 'z.{c}')}
    FROM (SELECT *, row_number() OVER (PARTITION BY cntrID ORDER BY okpdID, valID, supID, orgID)
          AS i FROM rolled) f
    JOIN (SELECT cntrID, count(*) AS okpd_num FROM rolled GROUP BY 1) n USING (cntrID)
    JOIN good_range g USING (cntrID) JOIN hot h USING (cntrID)
    JOIN socs z ON z.supID = f.supID
    WHERE f.i = 1""", "rolled", "good_range", "hot", "socs")
_MONTH = "CAST(sign_date // 100 % 100 AS INTEGER)"
_SHARES = [(side, kind) for side in ("sup", "org") for kind in ("good", "fed", "sub", "mun")]
_SHARE_SQL = ", ".join(
    f"CAST({s}_{k}_cntr_num AS DOUBLE) / nullif({s}_cntr_num, 0) AS {s}_{k}_cntr_share"
    for s, k in _SHARES)
view("timed", f"""
    SELECT *, price / nullif(plan_cntr_len, 0) AS day_price,
           CAST((sign_month - 1) // 3 + 1 AS INTEGER) AS sign_quarter, {_SHARE_SQL}
    FROM (SELECT *, CAST(date_diff('day', strptime(CAST(sign_date AS VARCHAR), '%Y%m%d'),
                             strptime(CAST(exec_date AS VARCHAR), '%Y%m%d')) AS INTEGER)
                        AS plan_cntr_len, {_MONTH} AS sign_month FROM flat_)""", "flat_")
FEATURES = (("cntrID",) + SHARES
            + tuple(c for c in NUMERIC if c != "cntr_okpd_num") + CATEGORICAL + BINARY + DUMMIES
            + ("cntr_result",))
view("feat", f"SELECT {listed(FEATURES)}, okpd_num AS cntr_okpd_num FROM timed", "timed")


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM feat WHERE {c} IS NOT NULL AND {c} <> -1 GROUP BY 1 "
            f"ORDER BY count(*) DESC, 1 LIMIT 1)")


view("filled", f"""
    SELECT * REPLACE (
        CASE WHEN purch_type = -1 THEN {_mode('purch_type')} ELSE purch_type END AS purch_type,
        CASE WHEN cntr_lvl = -1 THEN {_mode('cntr_lvl')} ELSE cntr_lvl END AS cntr_lvl,
        coalesce(org_ter, {_mode('org_ter')}) AS org_ter)
    FROM feat""", "feat")
view("fixed", """
    SELECT * REPLACE (price / plan_cntr_len AS day_price) FROM (
        SELECT * REPLACE (CASE WHEN plan_cntr_len < 1 THEN 1 ELSE plan_cntr_len END
                          AS plan_cntr_len)
        FROM filled WHERE price IS DISTINCT FROM 0)""", "filled")


def _log(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN ln(greatest(CAST({c} AS DOUBLE), 1.0)) END"


DROPPED = set(USELESS) | set(COLLINEAR)
CLEAN_NUMERIC = tuple(c for c in NUMERIC if c not in DROPPED)
CLEAN_SHARES = tuple(c for c in SHARES if c not in DROPPED)
CLEAN_CATEGORICAL = tuple(c for c in CATEGORICAL if c not in DROPPED)
view("clean_", f"""
    SELECT cntrID, {listed(CLEAN_SHARES + CLEAN_CATEGORICAL + DUMMIES)}, cntr_result,
           {', '.join(f'{_log(c)} AS {c}' for c in CLEAN_NUMERIC)} FROM fixed""", "fixed")

# ---- encoding -----------------------------------------------------------------------------

QUANTITATIVE = CLEAN_NUMERIC + WINSORISED_SHARES


def limits_of(relation: str) -> str:
    return f"""
    SELECT variable, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high
    FROM ({long(QUANTITATIVE, relation)}) GROUP BY 1"""


def limits_wide(relation: str) -> str:
    return "SELECT " + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS {c}_lo, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.99) AS {c}_hi" for c in QUANTITATIVE
    ) + f" FROM {relation}"


def clipped(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_hi), {c}_lo) END"


def woe_of(relation: str, columns=CLEAN_CATEGORICAL) -> str:
    return f"""
    SELECT variable, category, sum(n) AS n, sum(good) AS good, sum(bad) AS bad,
           any_value(all_good) AS all_good, any_value(all_bad) AS all_bad
    FROM (SELECT variable, CASE WHEN n / all_n <= 0.005 THEN 'NEW' ELSE v END AS category,
                 n, good, bad, all_good, all_bad
          FROM (SELECT variable, v, count(*) AS n, count(*) FILTER (cntr_result = 0) AS good,
                       count(*) FILTER (cntr_result = 1) AS bad,
                       sum(count(*)) OVER w AS all_n,
                       sum(count(*) FILTER (cntr_result = 0)) OVER w AS all_good,
                       sum(count(*) FILTER (cntr_result = 1)) OVER w AS all_bad
                FROM ({long(columns, relation, 'cntr_result', 'VARCHAR')})
                GROUP BY 1, 2 WINDOW w AS (PARTITION BY variable))
          WHERE v IS NOT NULL) GROUP BY 1, 2"""


_WOE = ("CASE WHEN good > 0 AND bad > 0 "
        "THEN round_even(ln((good / all_good) / (bad / all_bad)), 3) END")
_VALID = "(cntrID * 7919 + 42) // 100 % 100"
view("train_", f"SELECT * FROM clean_ WHERE {_VALID} >= 20", "clean_")
view("valid_", f"SELECT * FROM clean_ WHERE {_VALID} < 20", "clean_")
for suffix, source in (("", "clean_"), ("_t", "train_")):
    view(f"lim{suffix}", limits_wide(source), source)
    view(f"bounded{suffix}", "SELECT " + ", ".join(
        f"{clipped(c)} AS {c}" for c in CLEAN_NUMERIC) + f" FROM {source}, lim{suffix}",
        source, f"lim{suffix}")
    view(f"moments{suffix}", "SELECT " + ", ".join(
        f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in CLEAN_NUMERIC)
        + f" FROM bounded{suffix}", f"bounded{suffix}")
    view(f"woes{suffix}", f"SELECT variable, category, n, good, bad, {_WOE} AS woe "
         f"FROM ({woe_of(source)})", source)


def _z(c: str, suffix: str = "") -> str:
    return (f"({clipped(c)} - {c}_mean) / CASE WHEN {c}_std = 0 THEN 1.0 ELSE {c}_std END")


def _coded(c: str, woes: str) -> str:
    one = f"(SELECT max(woe) FROM {woes} w WHERE w.variable = '{c}' AND w.category = "
    return f"coalesce({one}CAST(t.{c} AS VARCHAR)), {one}'NEW'), 0.0) AS {c}"


# ---- predictions --------------------------------------------------------------------------

view("scored", """
    SELECT CntrID AS cntrID, result AS label,
           (CntrID * 7919 % 1001 * 3 + 1000 * result) / 4000 AS probability,
           CASE WHEN (CntrID * 7919 % 1001 * 3 + 1000 * result) / 4000 >= 0.5 THEN 1 ELSE 0 END
               AS prediction
    FROM labels_ WHERE result IS NOT NULL""", "labels_")
_LOSS = ("CASE WHEN label = 1 THEN ln(greatest(least(probability, 1 - 1e-15), 1e-15)) "
         "ELSE ln(1 - greatest(least(probability, 1 - 1e-15), 1e-15)) END")


def _build() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(name: str, sql: str, *needs: str) -> None:
        q[name] = statement(sql, *needs)

    add("contract_label", "SELECT * FROM labels_", "labels_")
    add("paid_by_reason", """
        SELECT v.RefContract AS cntrID, cl.Code AS code, v.Price AS price,
               round(sum(cl.FactPaid), 4) AS paid
        FROM vals v JOIN closures cl ON cl.RefContract = v.RefContract GROUP BY 1, 2, 3""",
        "vals", "closures")
    for side, key, table in (("sup", "SupID", "sup_stats_"), ("org", "OrgID", "org_stats_")):
        add(f"{side}_contract_count", f"SELECT {key}, {side}_cntr_num FROM {table}", table)
        add(f"{side}_avg_price", f"SELECT {key}, {side}_cntr_avg_price FROM {table}", table)
        add(f"{side}_running_good_level_counts", f"SELECT {key}, " + listed(
            ("running", "good", "fed", "sub", "mun"), side + "_{c}_cntr_num") + f" FROM {table}",
            table)
        add(f"{side}_stats", f"SELECT * FROM {table}", table)
    add("sup_avg_penalty_share", "SELECT SupID, sup_cntr_avg_penalty FROM sup_stats_",
        "sup_stats_")
    add("sup_no_penalty_share", "SELECT SupID, sup_no_pnl_share FROM sup_stats_", "sup_stats_")
    add("sup_severance_by_supplier", "SELECT SupID, sup_1s_sev FROM sup_stats_", "sup_stats_")
    add("sup_severance_by_customer", "SELECT SupID, sup_1s_org_sev FROM sup_stats_",
        "sup_stats_")
    add("org_severance_by_customer", "SELECT OrgID, org_1s_sev FROM org_stats_", "org_stats_")
    add("org_severance_by_supplier", "SELECT OrgID, org_1s_sup_sev FROM org_stats_",
        "org_stats_")
    add("okpd_stats", "SELECT * FROM okpd_stats_", "okpd_stats_")
    add("sup_okpd_contracts", "SELECT * FROM okpd_sup_", "okpd_sup_")
    add("sup_org_contracts", "SELECT * FROM sup_org_", "sup_org_")
    add("federal_subject", "SELECT * FROM subject", "subject")
    add("stats_with_territory", """
        SELECT OrgID, org_cntr_num, subject AS org_fed_ter FROM org_stats_
        JOIN org ON org.ID = OrgID LEFT JOIN subject ON territory = RefTerritory""",
        "org_stats_", "org", "subject")
    add("sup_similar_price_share", "SELECT * FROM sup_sim", "sup_sim")
    add("org_similar_price_share", "SELECT * FROM org_sim", "org_sim")

    add("hash_sample_good", "SELECT * FROM labels_ WHERE result = 0 AND CntrID % 100 < 20",
        "labels_")
    add("price_flags", f"""
        SELECT valID, price, pmp, {_FROM_STATS['price_higher_pmp']} AS price_higher_pmp,
               {_FROM_STATS['price_too_low']} AS price_too_low FROM fin v""", "fin")
    add("sample_full", "SELECT * FROM sample_", "sample_")
    add("sample_keys", f"SELECT {KEY}, cntr_result FROM sample_", "sample_")
    add("incremental_append", f"SELECT {KEY}, cntr_result FROM sample_", "sample_")
    add("refresh_null_only", f"""
        SELECT {KEY}, sup_sim_price_share, org_sim_price_share FROM sample_""", "sample_")

    add("okpd_prefix_rollup", "SELECT * FROM code_totals", "code_totals")
    add("sup_prefix_rollup", "SELECT * FROM sup_totals", "sup_totals")
    add("rolled_up_rows", f"SELECT {KEY}, okpd2, okpd_cntr_num, okpd_good_cntr_num, "
        "sup_okpd_cntr_num FROM rolled", "rolled")
    add("code_shares", f"SELECT {KEY}, "
        f"{rounded(('okpd_good_cntr_share', 'sup_okpd_cntr_share'))} FROM rolled", "rolled")
    add("codes_per_contract", "SELECT cntrID, count(*) AS okpd_num FROM sample_ GROUP BY 1",
        "sample_")
    add("okpd_distribution", "SELECT cntrID, count(okpd) AS okpd FROM sample_ GROUP BY 1",
        "sample_")
    add("okpd_count_percentiles", """
        SELECT p, round(quantile_cont(CASE WHEN n > 1 THEN CAST(n AS DOUBLE) END, 0.01), 6)
                   AS value,
               round(count(*) FILTER (n > 1) / count(*), 6) AS several_share
        FROM (SELECT cntrID, count(okpd) AS n FROM sample_ GROUP BY 1), (SELECT 0.01::DOUBLE AS p)
        GROUP BY p
        UNION ALL
        SELECT 0.99, round(quantile_cont(CASE WHEN n > 1 THEN CAST(n AS DOUBLE) END, 0.99), 6),
               round(count(*) FILTER (n > 1) / count(*), 6)
        FROM (SELECT cntrID, count(okpd) AS n FROM sample_ GROUP BY 1)""", "sample_")
    several = "(SELECT cntrID FROM sample_ GROUP BY 1 HAVING count(*) > 1)"
    add("multi_code_contracts", f"SELECT {KEY} FROM sample_ WHERE cntrID IN {several}",
        "sample_")
    add("multi_code_label_split", f"""
        SELECT cntr_result, count(DISTINCT cntrID) AS count FROM sample_
        WHERE cntrID IN {several} GROUP BY 1""", "sample_")
    add("unique_codes_by_length", """
        SELECT CAST(i AS INTEGER) AS okpd_sym, count(DISTINCT left(okpd, CAST(i AS INTEGER)))
                   AS count
        FROM sample_, range(1, 6) t(i) GROUP BY 1""", "sample_")
    add("first_row_per_code", """
        SELECT cntrID, okpd2, okpdID, valID, supID, price FROM (
            SELECT *, row_number() OVER (PARTITION BY cntrID, okpd2
                                         ORDER BY okpdID, valID, supID, orgID) AS i FROM rolled)
        WHERE i = 1""", "rolled")
    add("okpd_multi_hot", "SELECT * FROM hot", "hot")
    add("good_share_min_mean_max", "SELECT cntrID, " + rounded(
        [f"okpd_good_share_{k}" for k in ("min", "mean", "max")]) + " FROM good_range",
        "good_range")
    add("supplier_specialisation", "SELECT supID, " + rounded([f"socs_{c}" for c in CODES])
        + " FROM socs", "socs")
    doubles = ([c for c in DUMMIES if c.startswith("socs")] + ["sup_okpd_cntr_share"]
               + [f"okpd_good_share_{k}" for k in ("min", "mean", "max")])
    add("flatten_contracts", "SELECT * REPLACE (" + rounded(doubles) + ") FROM flat_", "flat_")

    add("time_features", f"SELECT cntrID, plan_cntr_len, {r('day_price', 'day_price')}, "
        "sign_month, sign_quarter FROM timed", "timed")
    add("share_features", "SELECT cntrID, " + rounded(
        [f"{s}_{k}_cntr_share" for s, k in _SHARES]) + " FROM timed", "timed")
    add("decimal_comma_parse", f"""
        SELECT {KEY}, sup_cntr_avg_penalty_share, sup_sim_price_share, org_sim_price_share
        FROM sample_""", "sample_")
    add("engineered_features", "SELECT * REPLACE (" + rounded(
        [*SHARES, "day_price", *(c for c in DUMMIES if c.startswith("socs"))])
        + ") FROM feat", "feat")
    add("mode_impute", "SELECT cntrID, purch_type, cntr_lvl, org_ter, "
        "coalesce(sup_ter, 1) AS sup_ter FROM filled", "filled")
    add("day_price_fixed", f"SELECT cntrID, plan_cntr_len, {r('day_price', 'day_price')}, price "
        "FROM fixed", "fixed")
    add("log_transform", "SELECT cntrID, " + ", ".join(r(_log(c), c) for c in NUMERIC)
        + " FROM feat", "feat")
    socs = [c for c in DUMMIES if c.startswith("socs")]
    add("clean_after_eda", "SELECT * REPLACE (" + rounded([*CLEAN_SHARES, *CLEAN_NUMERIC, *socs])
        + ") FROM clean_", "clean_")

    add("percentile_limits", f"SELECT variable, {rounded(('low', 'high'))} "
        f"FROM ({limits_of('clean_')})", "clean_")
    add("winsorise_and_flag", "SELECT cntrID, " + ", ".join(
        f"{r(clipped(c), c)}, CASE WHEN {c} < {c}_lo OR {c} > {c}_hi THEN 1 ELSE 0 END AS {c}_out"
        for c in QUANTITATIVE) + " FROM clean_, lim", "clean_", "lim")
    add("standardise", "SELECT cntrID, " + ", ".join(r(_z(c), c) for c in CLEAN_NUMERIC)
        + " FROM clean_, lim, moments", "clean_", "lim", "moments")
    add("rare_grouping", "SELECT cntrID, " + ", ".join(
        f"""CASE WHEN {c} IS NULL THEN NULL
             WHEN count(*) OVER (PARTITION BY {c}) / count(*) OVER () <= 0.005 THEN 'NEW'
             ELSE CAST({c} AS VARCHAR) END AS {c}""" for c in CLEAN_CATEGORICAL)
        + " FROM clean_", "clean_")
    add("woe_table", "SELECT variable, category, CAST(n AS BIGINT) AS n, "
        "CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, woe FROM woes", "woes")
    add("woe_encode", "SELECT cntrID, " + ", ".join(_coded(c, "woes") for c in CLEAN_CATEGORICAL)
        + " FROM clean_ t", "clean_", "woes")
    add("train_valid_split", f"SELECT cntrID, CASE WHEN {_VALID} < 20 THEN 1 ELSE 0 END "
        "AS valid FROM clean_", "clean_")
    add("stratified_folds", """
        SELECT cntrID, cntr_result, CAST((row_number() OVER (
            PARTITION BY cntr_result ORDER BY cntrID % 4096, cntrID) - 1) % 3 AS INTEGER) AS fold
        FROM clean_""", "clean_")
    other = [c for c in CLEAN_SHARES if c not in WINSORISED_SHARES] + socs
    add("encode_fit_apply", "SELECT cntrID, cntr_result, " + ", ".join(
        [r(_z(c), c, 5) for c in CLEAN_NUMERIC]
        + [r(clipped(c), c, 5) for c in WINSORISED_SHARES]
        + [f"CASE WHEN {c} < {c}_lo OR {c} > {c}_hi THEN 1 ELSE 0 END AS {c}_out"
           for c in QUANTITATIVE]
        + [r(c, c, 5) for c in other] + [f"okpd2_{c}" for c in CODES]
        + [_coded(c, "woes_t") for c in CLEAN_CATEGORICAL])
        + " FROM valid_ t, lim_t, moments_t", "valid_", "lim_t", "moments_t", "woes_t")
    add("params_round_trip", " UNION ALL ".join(
        f"SELECT '{part}' AS part, '{c}' AS variable, '{key}' AS key, {r(column, 'value')} "
        f"FROM {table}"
        for columns, table, part, keys in (
            (QUANTITATIVE, "lim", "percentile", (("low", "_lo"), ("high", "_hi"))),
            (CLEAN_NUMERIC, "moments", "scale", (("mean", "_mean"), ("std", "_std"))))
        for c in columns for key, column in ((k, c + tail) for k, tail in keys))
        + " UNION ALL SELECT 'woe', variable, category, woe FROM woes WHERE woe IS NOT NULL",
        "lim", "moments", "woes")

    def describe(columns) -> str:
        return ("SELECT variable, count(v) AS count, " + ", ".join((
            r("avg(v)", "mean", 4), r("stddev_samp(v)", "std", 4), r("min(v)", "min", 4),
            r("quantile_cont(v, 0.25)", "p25", 4), r("quantile_cont(v, 0.5)", "p50", 4),
            r("quantile_cont(v, 0.75)", "p75", 4), r("max(v)", "max", 4)))
            + f" FROM ({long(columns, 'feat')}) GROUP BY 1")

    add("describe_numeric", describe(NUMERIC), "feat")
    add("describe_shares", describe(SHARES), "feat")
    add("corr_matrix", " UNION ALL ".join(
        f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, {r(f'corr({a}, {b})', 'corr')} "
        "FROM clean_" for a in CLEAN_NUMERIC for b in CLEAN_NUMERIC), "clean_")
    add("corr_with_label", " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {r(f'corr({c}, cntr_result)', 'corr')} FROM clean_"
        for c in CLEAN_NUMERIC + CLEAN_SHARES), "clean_")

    def anova(columns, relation: str) -> str:
        return f"""
        SELECT variable, (sum(n * (m - am) * (m - am)) / (count(*) - 1))
                         / nullif(sum(n * s2) / (any_value(an) - count(*)), 0) AS score
        FROM (SELECT *, sum(n) OVER w AS an, sum(n * m) OVER w / sum(n) OVER w AS am
              FROM (SELECT variable, cntr_result, count(v) AS n, avg(v) AS m, var_pop(v) AS s2
                    FROM ({long(columns, relation, 'cntr_result')}) GROUP BY 1, 2)
              WINDOW w AS (PARTITION BY variable)) GROUP BY 1"""

    def chi2(columns, relation: str) -> str:
        return f"""
        SELECT variable, sum((o - e) * (o - e) / nullif(e, 0)) AS score
        FROM (SELECT variable, o, n / sum(n) OVER w * sum(o) OVER w AS e
              FROM (SELECT variable, cntr_result, count(*) AS n, sum(v) AS o
                    FROM ({long(columns, relation, 'cntr_result')}) GROUP BY 1, 2)
              WINDOW w AS (PARTITION BY variable)) GROUP BY 1"""

    add("anova_f", f"SELECT variable, {r('score', 'score', 4)} "
        f"FROM ({anova(CLEAN_NUMERIC + CLEAN_SHARES, 'clean_')})", "clean_")
    add("chi2_score", f"SELECT variable, {r('score', 'score', 4)} FROM "
        f"({chi2(CATEGORICAL, '(SELECT * REPLACE (coalesce(sup_ter, 1) AS sup_ter) FROM filled)')})",
        "filled")
    add("rate_features", f"""
        SELECT 'f_classif' AS criterion, variable, {r('score', 'score', 4)}
        FROM ({anova(CLEAN_NUMERIC, 'clean_')})
        UNION ALL SELECT 'chi2', variable, round(score, 4) FROM ({chi2(CLEAN_NUMERIC, 'clean_')})
        """, "clean_")
    add("information_value", f"""
        SELECT variable, round(sum(CASE WHEN good > 0 AND bad > 0 THEN
            (good / all_good - bad / all_bad) * ln((good / all_good) / (bad / all_bad)) END), 6)
            AS iv
        FROM ({woe_of('clean_', CLEAN_CATEGORICAL + DUMMIES)}) GROUP BY 1""", "clean_")
    add("label_by_category", """
        SELECT sign_month, count(*) FILTER (cntr_result = 1) AS bad,
               count(*) FILTER (cntr_result IS DISTINCT FROM 1) AS good, count(*) AS total,
               round(count(*) FILTER (cntr_result = 1) / count(*), 6) AS bad_share,
               round(count(*) FILTER (cntr_result IS DISTINCT FROM 1) / count(*), 6) AS good_share
        FROM feat GROUP BY 1""", "feat")
    add("histogram_clipped", f"""
        SELECT variable, bin, round(lo + bin * (hi - lo) / 10, 4) AS low,
               round(lo + (bin + 1) * (hi - lo) / 10, 4) AS high, count(*) AS count
        FROM (SELECT variable, lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE
                  least(floor((greatest(least(v, hi), lo) - lo) / ((hi - lo) / 10)), 9) END
                  AS INTEGER) AS bin
              FROM ({long(NUMERIC, 'feat')}) JOIN (
                  SELECT variable, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
                  FROM ({long(NUMERIC, 'feat')}) GROUP BY 1) USING (variable)
              WHERE v IS NOT NULL)
        GROUP BY 1, 2, lo, hi""", "feat")
    grid = [i / 100 for i in range(101)]
    add("quantile_grid", f"""
        SELECT variable, p, round(q, 4) AS initial, round(greatest(least(q, hi), lo), 4) AS clipped
        FROM (SELECT variable, CAST(unnest({grid}) AS DOUBLE) AS p, unnest(quantile_cont(v, {grid})) AS q,
                     quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
              FROM ({long(NUMERIC, 'feat')}) GROUP BY variable)""", "feat")
    add("sorted_series", f"""
        SELECT variable, round(v, 10) AS initial,
               round(greatest(least(v, hi), lo), 10) AS clipped, count,
               CAST(sum(count) OVER (PARTITION BY variable ORDER BY v) - count AS BIGINT)
                   AS rows_before
        FROM (SELECT variable, v, count(*) AS count FROM ({long(NUMERIC, 'feat')})
              WHERE v IS NOT NULL GROUP BY 1, 2) JOIN (
                  SELECT variable, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
                  FROM ({long(NUMERIC, 'feat')}) GROUP BY 1) USING (variable)""", "feat")
    add("category_frequency", f"SELECT variable, v AS category, count(*) AS count FROM "
        f"({long(CATEGORICAL, 'feat', '', 'VARCHAR')}) GROUP BY 1, 2", "feat")
    add("dummy_frequency", f"SELECT variable, count(*) FILTER (v <> 0) AS count FROM "
        f"({long(DUMMIES, 'clean_')}) GROUP BY 1", "clean_")
    add("distinct_counts", f"SELECT variable, count(DISTINCT v) AS count FROM "
        f"({long(CATEGORICAL, 'feat')}) GROUP BY 1", "feat")
    every = [c for c in FEATURES if c != "cntrID"] + ["cntr_okpd_num"]
    add("missing_share", f"SELECT variable, count(*) - count(v) AS missing, "
        f"round((count(*) - count(v)) / count(*), 6) AS share FROM ({long(every, 'feat')}) "
        "GROUP BY 1", "feat")

    add("accuracy_and_log_loss", f"""
        SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
               round(-avg({_LOSS}), 6) AS log_loss FROM scored""", "scored")
    add("roc_auc", """
        SELECT round((sum(rk) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2)
                     / (any_value(p) * any_value(n)), 6) AS roc_auc
        FROM (SELECT label, rank() OVER (ORDER BY probability)
                     + (count(*) OVER (PARTITION BY probability) - 1) / 2 AS rk,
                     count(*) FILTER (label = 1) OVER () AS p,
                     count(*) FILTER (label = 0) OVER () AS n FROM scored)""", "scored")
    add("roc_points", """
        SELECT NULL AS threshold, 0.0 AS fpr, 0.0 AS tpr
        UNION ALL SELECT round(probability, 6) AS threshold,
               round(sum(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)) OVER w
                     / (SELECT count(*) FROM scored WHERE label = 0), 6) AS fpr,
               round(sum(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)) OVER w
                     / (SELECT count(*) FROM scored WHERE label = 1), 6) AS tpr
        FROM scored GROUP BY probability WINDOW w AS (ORDER BY probability DESC)""", "scored")
    add("confusion_matrix", """
        SELECT label, prediction, count(*) AS count,
               round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share
        FROM scored GROUP BY 1, 2""", "scored")
    def hits(a: str, b: str) -> str:
        return f"coalesce(round(count(*) FILTER ({a}) / nullif(count(*) FILTER ({b}), 0), 3), 0)"

    add("classification_report", f"""
        SELECT 'precision_0' AS metric, {hits('label = 0 AND prediction = 0', 'prediction = 0')}
                   AS value FROM scored
        UNION ALL SELECT 'precision_1', {hits('label = 1 AND prediction = 1', 'prediction = 1')}
                   FROM scored
        UNION ALL SELECT 'recall_0', {hits('label = 0 AND prediction = 0', 'label = 0')} FROM scored
        UNION ALL SELECT 'recall_1', {hits('label = 1 AND prediction = 1', 'label = 1')} FROM scored
        UNION ALL SELECT 'accuracy', {hits('label = prediction', 'true')} FROM scored
        UNION ALL SELECT 'f_score', round(2 * count(*) FILTER (label = 1 AND prediction = 1)
                   / (count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1)), 3)
                   FROM scored""", "scored")
    bins = "CAST(least(floor(probability * 10), 9) AS INTEGER)"
    # The inner edges below a probability; one on an edge belongs to the lower bin.
    lower = " + ".join(f"CAST(probability > {i} / 10.0::DOUBLE AS INTEGER)" for i in range(1, 10))
    add("calibration_curve", f"SELECT {lower} AS bin, "
        f"{r('avg(probability)', 'mean_probability')}, {r('avg(label)', 'positive_share')} "
        "FROM scored GROUP BY 1", "scored")
    add("probability_histogram", f"SELECT {bins} AS bin, count(*) AS count FROM scored GROUP BY 1",
        "scored")
    add("probability_dependency", """
        SELECT round_even(probability, 2) AS proba, count(*) FILTER (label = 0) AS good,
               count(*) FILTER (label = 1) AS bad FROM scored GROUP BY 1""", "scored")
    add("cv_score_summary", f"""
        SELECT model, round(avg(t), 6) AS time, round(avg(acc), 6) AS tst_acc,
               round(stddev_pop(acc), 6) AS tst_acc_std, round(avg(ll), 6) AS tst_ll,
               round(stddev_pop(ll), 6) AS tst_ll_std
        FROM (SELECT CAST(RefTypePurch AS VARCHAR) AS model, cntrID % 3 AS fold,
                     CAST(count(*) AS DOUBLE) AS t,
                     avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc,
                     avg({_LOSS}) AS ll
              FROM scored JOIN contracts ON ID = cntrID GROUP BY 1, 2) GROUP BY 1""",
        "scored", "contracts")

    for name in ("logistic", "forest", "deep_forest", "gbt", "deep_gbt", "mlp", "tanh_network"):
        add(f"train_{name}", "SELECT cntrID, cntr_result AS label, 1 AS valid_probability, "
            "1 AS prediction_follows, 1 AS better_than_share FROM valid_", "valid_")
    cuts = " + ".join(f"CAST(coalesce(v, 0) >= {i} / 20.0::DOUBLE AS INTEGER)"
                      for i in range(1, 20))
    gains = f"""
        SELECT variable, bin, gl, hl, g - gl AS gr, h - hl AS hr,
               gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain
        FROM (SELECT variable, bin, sum(g) OVER up_to AS gl, sum(h) OVER up_to AS hl,
                     sum(g) OVER (PARTITION BY variable) AS g,
                     sum(h) OVER (PARTITION BY variable) AS h
              FROM (SELECT variable, {cuts} AS bin, sum(0.5 - cntr_result)::DOUBLE AS g,
                           count(*) * 0.25::DOUBLE AS h
                    FROM ({long(CLEAN_SHARES, 'clean_', 'cntr_result')}) GROUP BY 1, 2)
              WINDOW up_to AS (PARTITION BY variable ORDER BY bin))
        WHERE hl >= 1 AND h - hl >= 1"""
    add("boosting_split_gains", "SELECT variable, bin, "
        + rounded(("gl", "hl", "gr", "hr", "gain")) + f" FROM ({gains})", "clean_")
    add("boosting_first_split", f"SELECT variable, bin, {r('gain', 'gain')} FROM ({gains}) "
        f"ORDER BY round(gain, 9) DESC, list_position({list(CLEAN_SHARES)}, variable), bin LIMIT 1",
        "clean_")
    for name, trials in (("random_search", 2), ("guided_search", 10)):
        add(name, "SELECT CAST(i AS INTEGER) AS trial, 1 AS in_space, 1 AS best_beats_share "
            f"FROM range({trials}) t(i) WHERE EXISTS (FROM clean_)", "clean_")
    add("best_so_far", """
        SELECT trial, model, params, round(score, 6) AS score,
               printf('New best: %.5f using %s', score, params) AS line
        FROM (SELECT *, max(score) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING
                                         AND 1 PRECEDING) AS best
              FROM (SELECT RefTypePurch + 1 AS trial, 'LogReg' AS model,
                           printf('{"C": %d}', RefTypePurch) AS params,
                           -(count(*) * 7919 % 1000) / 1000 AS score
                    FROM contracts GROUP BY RefTypePurch))
        WHERE best IS NULL OR score > best""", "contracts")
    # A refreshed table is what counting from scratch gives.
    for name in ("sup_stats", "org_stats", "okpd_stats", "sup_okpd_contracts",
                 "sup_org_contracts"):
        q[f"refreshed_{name}"] = q[name]
    q["refreshed_labels"] = q["contract_label"]
    return q


ORACLE = _build()
