"""Independent SQL statements (DuckDB dialect) for the registered queries.

Each statement recomputes the query from the base tables with plain SQL -- window ranks, CASE
maps, GROUP BY -- and never calls this library, so it can serve as a cross-check.  Numbers are
rounded to 6 places on both sides; counts are BIGINT.
"""

from __future__ import annotations

from panelspark import schema as S
from panelspark.sources import responses as R

ROUND = 6


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v if not isinstance(v, str) else q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def pick(labels: list[str], idx_expr: str) -> str:
    return "([" + ", ".join(q(x) for x in labels) + f"])[CAST(({idx_expr}) AS BIGINT) + 1]"


def r(expr: str, digits: int = ROUND) -> str:
    scale = float(10 ** digits)
    return f"(round(CAST({expr} AS DOUBLE) * CAST({scale!r} AS DOUBLE)) / CAST({scale!r} AS DOUBLE))"


def _joined(expr: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list({expr}))), ';')"


_QA, _QB, _QC = R.QTY_CUTS
_SA, _SB, _SC = R.SUPPLIER_CUTS

RESPONSES_CTE = f"""
li_items AS (
  SELECT l.l_orderkey AS id,
         max(l.l_shipdate) AS end_time,
         sum(l.l_quantity) AS qty,
         count(DISTINCT l.l_suppkey) AS n_supp,
         count(*) AS n_items,
         sum(CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END) AS n_flag_n,
         sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_flag_r,
         sum(CAST(round(l.l_discount * 100) AS INTEGER)) AS disc_pct,
         sum(CAST(round(l.l_tax * 100) AS INTEGER)) AS tax_pct,
         max(CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END) AS any_open,
         {_joined(case_map('p.p_type', R.PART_TYPE_TO_PLATFORM))} AS platforms,
         {_joined(case_map('l.l_returnflag || l.l_linestatus', R.FLAGS_TO_MOTIVATION))} AS purchase_motivation,
         {_joined(pick(S.CONTENT_TYPES, '(p.p_size - 1) // 8'))} AS content_type
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey
),
item_answers AS (
  SELECT id, end_time, platforms, purchase_motivation, content_type,
         {pick(S.DAILY_TIME_LEVELS, f'CASE WHEN qty < {_QA} THEN 0 WHEN qty < {_QB} THEN 1 WHEN qty < {_QC} THEN 2 ELSE 3 END')} AS daily_time,
         {pick(S.ENGAGEMENT_LEVELS, f'CASE WHEN n_supp <= {_SA} THEN 0 WHEN n_supp <= {_SB} THEN 1 WHEN n_supp <= {_SC} THEN 2 ELSE 3 END')} AS engagement_freq,
         {pick(S.PURCHASE_LEVELS, 'least(n_flag_n, 4)')} AS purchase_freq,
         {pick(S.AD_CLICK_LEVELS, 'least(n_flag_r, 3)')} AS ad_click_freq,
         CAST(least(5, 1 + disc_pct // (2 * n_items)) AS INTEGER) AS satisfaction_score,
         CAST(least(5, 1 + (10 * tax_pct) // (16 * n_items)) AS INTEGER) AS retargeting_score,
         CASE WHEN any_open = 1 THEN 'Yes' ELSE 'No' END AS searched_product
  FROM li_items
),
responses AS (
  SELECT o.o_orderkey AS id,
         o.o_orderdate AS start_time,
         i.end_time,
         {pick(S.AGE_GROUPS, 'r.r_regionkey')} AS age_group,
         {case_map('o.o_orderstatus', R.STATUS_TO_GENDER)} AS gender,
         {pick(S.SPENDING_LEVELS, f'CAST(least(floor(o.o_totalprice / {R.PRICE_BAND_WIDTH}), 3) AS INTEGER)')} AS spending,
         i.platforms,
         i.daily_time,
         CASE WHEN c.c_acctbal >= 0 THEN 'Yes' ELSE 'No' END AS follows_influencers,
         i.content_type,
         {case_map('c.c_mktsegment', R.SEGMENT_TO_TRUST)} AS trust_factor,
         i.engagement_freq,
         CAST(6 - CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS product_interest_score,
         i.searched_product,
         i.purchase_freq,
         i.purchase_motivation,
         i.satisfaction_score,
         i.ad_click_freq,
         {pick(S.AD_INFLUENCED_LEVELS, 'CAST(o.o_orderkey % 3 AS INTEGER)')} AS ad_influenced,
         i.retargeting_score,
         {pick(S.AD_FORMATS, 'CAST(c.c_custkey % 5 AS INTEGER)')} AS preferred_ad_format
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN item_answers i ON i.id = o.o_orderkey
)"""


def _flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def _contains(col: str, label: str) -> str:
    return _flag(f"contains({col}, {q(label)})")


ENCODED_CTE = RESPONSES_CTE + f""",
enc0 AS (
  SELECT *,
         {case_map('spending', S.SPENDING_MAP)} AS spending_ord,
         {case_map('daily_time', S.DAILY_TIME_MAP)} AS daily_time_ord,
         {case_map('engagement_freq', S.ENGAGEMENT_MAP)} AS engagement_ord,
         {case_map('purchase_freq', S.PURCHASE_MAP)} AS purchase_ord,
         {case_map('ad_click_freq', S.AD_CLICK_MAP)} AS ad_click_ord,
         {case_map('age_group', S.AGE_MAP, '2')} AS age_ord,
         {_flag("searched_product = 'Yes'")} AS searched_binary,
         CAST({case_map('ad_influenced', S.AD_INFLUENCED_MAP, '0.5')} AS DOUBLE) AS ad_influenced_binary
  FROM responses
),
enc AS (
  SELECT *,
         {_flag('ad_click_ord >= 2')} AS high_ad_responsive,
         {_flag('purchase_ord > 0')} AS made_purchase,
         {", ".join(_contains('platforms', p) + ' AS platform_' + p.lower().replace(' ', '') for p in S.PLATFORMS_DASHBOARD)},
         {", ".join(_contains('purchase_motivation', lab) + ' AS ' + f for f, lab in S.MOTIVATION_FLAGS_DASHBOARD.items())}
  FROM enc0
)"""


def with_enc(body: str) -> str:
    return "WITH " + ENCODED_CTE + "\n" + body


def with_responses(body: str) -> str:
    return "WITH " + RESPONSES_CTE + "\n" + body
