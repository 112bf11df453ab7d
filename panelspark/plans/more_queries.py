"""Registered queries: association rules, time trends, term frequency, campaign scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.encode import clip
from panelspark.operators import aggregate as A
from panelspark.operators import campaigns as B
from panelspark.operators import rules as R
from panelspark.operators import text as D
from panelspark.operators import trends as W
from panelspark.plans.common import encoded, values_sql
from panelspark.plans.oracle import q, r, with_enc
from panelspark.plans.registry import register, rounded
from panelspark.sources.tables import read_table

def _dist_tail(src: str, bins: int) -> str:
    return f"""base AS ({src}),
st AS (SELECT min(v) AS lo, max(v) AS hi, avg(v) AS mean, median(v) AS median FROM base),
mom AS (SELECT (SELECT avg(power(v - st.mean, 3)) FROM base, st) AS c3,
               (SELECT avg(power(v - st.mean, 2)) FROM base, st) AS c2),
b AS (SELECT CASE WHEN st.hi = st.lo THEN 0 ELSE least(CAST(floor((v - st.lo) / ((st.hi - st.lo) / {bins})) AS INTEGER), {bins - 1}) END AS bin
      FROM base, st),
h AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
grid AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT grid.bin, {r(f'st.lo + grid.bin * ((st.hi - st.lo) / {bins})')} AS lower,
       {r(f'st.lo + (grid.bin + 1) * ((st.hi - st.lo) / {bins})')} AS upper,
       coalesce(h.n, 0) AS n, {r('st.mean')} AS mean, {r('st.median')} AS median,
       {r('CASE WHEN mom.c2 = 0 THEN NULL ELSE mom.c3 / power(mom.c2, 1.5) END')} AS skewness
FROM grid CROSS JOIN st CROSS JOIN mom LEFT JOIN h ON grid.bin = h.bin"""


# -- R1-R5 ---------------------------------------------------------------------------------------
# SQL spellings of the item definitions (an independent restatement for the cross-check).
_DASH_ITEMS_SQL = {
    "High_Engagement": "engagement_ord >= 2",
    "ContentQuality_Trust": "trust_factor = 'Content quality'",
    "Transparency_Trust": "trust_factor = 'Transparency in reviews'",
    "Authenticity_Trust": "trust_factor = 'Authenticity'",
    "High_Interest": "product_interest_score >= 4",
    "High_Satisfaction": "satisfaction_score >= 4",
    "Made_Purchase": "purchase_ord > 0",
    "High_Purchase": "purchase_ord >= 2",
    "High_AdClick": "ad_click_ord >= 2",
    "Motiv_Reviews": "motiv_positive_reviews = 1",
    "Motiv_Coupon": "motiv_coupon = 1",
    "Uses_Instagram": "platform_instagram = 1",
    "Uses_YouTube": "platform_youtube = 1",
    "High_TimeSpent": "daily_time_ord >= 3",
    "High_Retargeting": "retargeting_score >= 4",
}


def _rules_sql(items: dict[str, str], consequent: str, min_sup: float, min_conf: float, exclude=(), top=None, singles=False) -> str:
    ants = [a for a in items if a != consequent and a not in exclude]
    flags = ", ".join(f"CAST(coalesce({e}, false) AS INTEGER) AS {n}" for n, e in items.items())
    long = " UNION ALL ".join(f"SELECT rid, {q(a)} AS item, {i} AS pos, {consequent} AS c FROM t WHERE {a} = 1"
                              for i, a in enumerate(ants))
    order = "ORDER BY lift DESC, antecedent LIMIT " + str(top) if top else ""
    pairs = "" if singles else """
  UNION ALL
  SELECT a.item || ' + ' || b.item, count(*), sum(a.c) FROM lng a JOIN lng b ON a.rid = b.rid AND a.pos < b.pos
  GROUP BY 1"""
    return with_enc(f""",
t AS (SELECT row_number() OVER () AS rid, {flags} FROM enc),
tot AS (SELECT count(*) AS n, sum({consequent}) AS n_c FROM t),
lng AS ({long}),
ants AS (
  SELECT item AS antecedent, count(*) AS n_a, sum(c) AS n_ac FROM lng GROUP BY item{pairs}),
m AS (SELECT antecedent, n_ac * 1.0 / n AS sup, n_ac * 1.0 / n_a AS conf, n_c * 1.0 / n AS cr, n_a FROM ants, tot)
SELECT antecedent, {q(consequent)} AS consequent, round_even(sup * 1000.0, 0) / 1000.0 AS support,
       round_even(conf * 1000.0, 0) / 1000.0 AS confidence,
       round_even(CASE WHEN cr > 0 THEN conf / cr ELSE 0.0 END * 1000.0, 0) / 1000.0 AS lift,
       CAST(len(string_split(antecedent, ' + ')) AS INTEGER) AS length
FROM m WHERE sup >= {min_sup} AND n_a > 0 AND conf >= {min_conf} {order}""")


def _dash_rules(spark, sf_dir, consequent="Made_Purchase", min_sup=0.08, min_conf=0.5):
    items = R.transaction_items(encoded(spark, sf_dir), R.dashboard_items())
    return R.association_rules(items, list(R.dashboard_items()), consequent, min_sup, min_conf)


@register("rules_made_purchase", _rules_sql(_DASH_ITEMS_SQL, "Made_Purchase", 0.08, 0.5))
def q_rules_made_purchase(spark, sf_dir):
    return _dash_rules(spark, sf_dir)


@register("rules_high_adclick", _rules_sql(_DASH_ITEMS_SQL, "High_AdClick", 0.05, 0.3))
def q_rules_high_adclick(spark, sf_dir):
    return _dash_rules(spark, sf_dir, "High_AdClick", 0.05, 0.3)


_REPORT_ITEMS = ("High_Engagement", "ContentQuality_Trust", "High_Interest", "High_Satisfaction", "Made_Purchase", "High_TimeSpent")


@register("rules_report_top6", _rules_sql({k: _DASH_ITEMS_SQL[k] for k in _REPORT_ITEMS}, "Made_Purchase", 0.06, 0.45, top=6, singles=True))
def q_rules_report_top6(spark, sf_dir):
    """R1/R4, report variant: single items, support 0.06, confidence 0.45, the six of highest lift."""
    items = R.transaction_items(encoded(spark, sf_dir), R.report_items())
    rules = R.association_rules(items, list(R.report_items()), "Made_Purchase", 0.06, 0.45, max_len=1)
    return rules.orderBy(F.desc("lift"), "antecedent").limit(6)


_NB_ITEMS_SQL = {
    "High_Engagement": "engagement_ord >= 2",
    "Low_Engagement": "engagement_ord = 1",
    "Trust_ContentQuality": "trust_factor = 'Content quality'",
    "Trust_Transparency": "trust_factor = 'Transparency in reviews'",
    "Trust_Authenticity": "trust_factor = 'Authenticity'",
    "Made_Purchase": "purchase_ord > 0",
    "High_Purchase": "purchase_ord >= 2",
    "High_AdClick": "ad_click_ord >= 2",
    "Low_AdClick": "ad_click_ord <= 1",
    "Motiv_PosReviews": "motiv_positive_reviews = 1",
    "Motiv_Coupon": "motiv_coupon = 1",
    "Motiv_Trust": "motiv_trust = 1",
    "Uses_Instagram": "platform_instagram = 1",
    "Uses_YouTube": "platform_youtube = 1",
    "High_Interest": "product_interest_score >= 4",
    "High_Satisfaction": "satisfaction_score >= 4",
}


@register("rules_notebook_top", _rules_sql(_NB_ITEMS_SQL, "Made_Purchase", 0.08, 0.6, exclude=("High_Purchase",), top=15))
def q_rules_notebook_top(spark, sf_dir):
    """Notebook variant: 16 items, both purchase items barred as antecedents, top 15 by lift."""
    enc = encoded(spark, sf_dir, profile="notebook")
    items = R.notebook_items()
    t = R.transaction_items(enc, items)
    rules = R.association_rules(t, list(items), "Made_Purchase", 0.08, 0.6, exclude=["High_Purchase"])
    return R.top_rules(rules, 15)


_RULES_MP_SQL = _rules_sql(_DASH_ITEMS_SQL, "Made_Purchase", 0.08, 0.5)


@register("rules_summary", f"""SELECT count(*) AS n_rules, max(lift) AS best_lift, max(confidence) AS best_confidence,
       (SELECT antecedent FROM ({_RULES_MP_SQL}) x ORDER BY lift DESC, antecedent LIMIT 1) AS best_rule
FROM ({_RULES_MP_SQL}) r""")
def q_rules_summary(spark, sf_dir):
    return R.rules_summary(_dash_rules(spark, sf_dir))


# -- W1-W4 ---------------------------------------------------------------------------------------
@register("daily_trend_responses", with_enc(f"""
SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, count(*) AS responses,
       {r('avg(purchase_ord)')} AS avg_purchase, {r('avg(product_interest_score)')} AS avg_interest
FROM enc WHERE start_time IS NOT NULL GROUP BY 1"""))
def q_daily_trend_responses(spark, sf_dir):
    t = W.daily_trend(encoded(spark, sf_dir), "start_time",
                      {"avg_purchase": "purchase_ord", "avg_interest": "product_interest_score"})
    return rounded(t.withColumn("day", F.col("day").cast("string")))


@register("daily_trend_events", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, {r('avg(value)')} AS avg_value
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def q_daily_trend_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["ts", "value"])
    t = W.daily_trend(ev, "ts", {"avg_value": "value"}, count_name="events")
    return rounded(t.withColumn("day", F.col("day").cast("string")))


@register("hourly_events", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def q_hourly_events(spark, sf_dir):
    return W.hourly_counts(read_table(spark, sf_dir, "events", ["ts"]), "ts")


def _completion_days(spark, sf_dir):
    from panelspark.functions.encode import minutes_between
    enc = encoded(spark, sf_dir)
    days = minutes_between("start_time", "end_time", unit_seconds=86400.0)
    return enc.select(clip(days, 0, 30).alias("completion_days"))


@register("completion_distribution", with_enc(""",
base0 AS (SELECT CASE WHEN d IS NULL THEN NULL ELSE least(greatest(d, 0.0), 30.0) END AS v FROM (
  SELECT date_diff('microsecond', start_time, end_time) / 86400000000.0 AS d FROM enc)),
""" + _dist_tail("SELECT v FROM base0 WHERE v IS NOT NULL", 20)))
def q_completion_distribution(spark, sf_dir):
    """Completion time (days here) clipped to [0, 30], 20 bins, with median."""
    return rounded(A.distribution(_completion_days(spark, sf_dir), "completion_days", bins=20))


@register("rolling_value_by_user", f"""
SELECT event_id, user_id, {r('CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END')} AS rolling
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def q_rolling_value_by_user(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    out = W.rolling_mean(ev, "ts", "value", 20, 5, by=["user_id"], order_tiebreak="event_id")
    return rounded(out.select("event_id", "user_id", "rolling"))


@register("rolling_purchase_global", with_enc(f"""
SELECT id, {r('CASE WHEN count(purchase_ord) OVER w >= 5 THEN avg(purchase_ord) OVER w END')} AS rolling
FROM enc WHERE start_time IS NOT NULL AND purchase_ord IS NOT NULL
WINDOW w AS (ORDER BY start_time, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def q_rolling_purchase_global(spark, sf_dir):
    """W4 without a group: range partitions with a 19-row halo (no single-task sort)."""
    enc = encoded(spark, sf_dir).select("id", "start_time", "purchase_ord")
    out = W.rolling_mean(enc, "start_time", "purchase_ord", 20, 5)
    return rounded(out.select("id", "rolling"))


# -- D1 --------------------------------------------------------------------------------------------
def _tf_sql(src: str, col: str, top: int, sep: str | None = None) -> str:
    text = f"lower({col})"
    if sep:
        text = f"regexp_replace({text}, {q(sep)}, ' ', 'g')"
    stop = values_sql("stop", ["term"], [(w,) for w in sorted(set(S.STOPWORDS))])
    return f"""{stop},
toks AS (SELECT regexp_replace(unnest(regexp_extract_all({text}, {q(D.TOKEN_PATTERN)})), '''s$', '') AS term
         FROM {src} WHERE {col} IS NOT NULL),
clean AS (SELECT term FROM toks WHERE NOT regexp_matches(term, '^[0-9]+$') AND length(term) > 0
          AND term NOT IN (SELECT term FROM stop))
SELECT term, count(*) AS n FROM clean GROUP BY term ORDER BY n DESC, term LIMIT {top}"""


@register("term_frequency_documents", "WITH " + _tf_sql("documents", "text", 80))
def q_term_frequency_documents(spark, sf_dir):
    return D.term_frequency(read_table(spark, sf_dir, "documents", ["text"]), "text", top=80)


@register("term_frequency_conversations", "WITH " + _tf_sql("conversations", "text", 60))
def q_term_frequency_conversations(spark, sf_dir):
    return D.term_frequency(read_table(spark, sf_dir, "conversations", ["text"]), "text", top=60)


@register("term_frequency_motivation", with_enc(", " + _tf_sql("enc", "purchase_motivation", 80, ";")))
def q_term_frequency_motivation(spark, sf_dir):
    return D.term_frequency(encoded(spark, sf_dir), "purchase_motivation", top=80, separators=";")


@register("term_frequency_content", with_enc(", " + _tf_sql("enc", "content_type", 60, "[;/]")))
def q_term_frequency_content(spark, sf_dir):
    return D.term_frequency(encoded(spark, sf_dir), "content_type", top=60, separators="[;/]")


# -- B1-B3 -----------------------------------------------------------------------------------------
def _campaigns(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    orders = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice"])
    return B.campaigns_from_orders(cust, orders)


_TIERS = [t[0] for t in S.TIER_BENCHMARKS]
_PLATS = [p[0] for p in S.PLATFORM_MULTIPLIERS]
_CAMPAIGNS_SQL = f"""
{values_sql('bench', ['tier', 'cpm', 'ctr', 'cvr'], S.TIER_BENCHMARKS)},
{values_sql('mult', ['platform', 'reach_mult', 'ctr_mult', 'cpm_mult'], S.PLATFORM_MULTIPLIERS)},
camp AS (
  SELECT c.c_name AS name,
         ([{', '.join(q(t) for t in _TIERS)}])[CAST(c.c_custkey % {len(_TIERS)} AS BIGINT) + 1] AS tier,
         ([{', '.join(q(p) for p in _PLATS)}])[CAST(c.c_custkey % {len(_PLATS)} AS BIGINT) + 1] AS platform,
         CAST((s.cents + 50) // 100 AS DOUBLE) AS budget, CAST(1500.0 AS DOUBLE) AS aov, CAST(0.6 AS DOUBLE) AS commission,
         CAST(0.2 AS DOUBLE) AS retargeting, CAST(0.3 AS DOUBLE) AS dropoff,
         CAST(c.c_custkey % 10 + 1 AS INTEGER) AS n_influencers
  FROM customer c JOIN (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1) s
    ON s.o_custkey = c.c_custkey),
rated AS (SELECT camp.*, bench.cpm, bench.ctr, bench.cvr, mult.reach_mult, mult.ctr_mult, mult.cpm_mult
          FROM camp JOIN bench ON camp.tier = bench.tier JOIN mult ON camp.platform = mult.platform)"""


def _score_sql(budget: str, commission: str, retargeting: str) -> str:
    return f"""
  {budget} * {commission} AS content_budget, {budget} * {retargeting} AS ad_budget,
  {budget} * (1 - {commission} - {retargeting}) AS other_budget,
  ({budget} * {commission}) / (cpm * cpm_mult) * 1000.0 * reach_mult AS reach,
  CASE WHEN {budget} * {retargeting} > 0 THEN ({budget} * {retargeting}) / (cpm * cpm_mult * 0.6) * 1000.0 ELSE 0.0 END AS rr"""


@register("campaign_scores", f"""WITH {_CAMPAIGNS_SQL.strip()},
s1 AS (SELECT *, {_score_sql('budget', 'commission', 'retargeting')} FROM rated),
s2 AS (SELECT *, reach * ctr * ctr_mult AS clicks, reach * ctr * ctr_mult * cvr * (1 - dropoff) AS conversions,
              rr * ctr * 0.7 * cvr * (1 - dropoff) AS retargeting_conversions FROM s1),
s3 AS (SELECT *, conversions + retargeting_conversions AS total_conversions,
              (conversions + retargeting_conversions) * aov AS revenue FROM s2)
SELECT name, tier, platform, {r('budget')} AS budget, {r('content_budget')} AS content_budget, {r('ad_budget')} AS ad_budget,
       {r('other_budget')} AS other_budget, {r('reach')} AS reach, {r('clicks')} AS clicks, {r('conversions')} AS conversions,
       {r('retargeting_conversions')} AS retargeting_conversions, {r('total_conversions')} AS total_conversions,
       {r('revenue')} AS revenue, {r('CASE WHEN budget > 0 THEN (revenue - budget) / budget * 100.0 ELSE 0.0 END')} AS roi_pct,
       {r('CASE WHEN total_conversions > 0 THEN budget / total_conversions ELSE 0.0 END')} AS cpa,
       {r('CASE WHEN budget > 0 THEN revenue / budget ELSE 0.0 END')} AS roas, n_influencers,
       {r('reach / n_influencers')} AS reach_per_influencer, {r('content_budget / n_influencers')} AS budget_per_influencer,
       CAST(floor(budget / aov) AS BIGINT) AS break_even_conversions
FROM s3""")
def q_campaign_scores(spark, sf_dir):
    return rounded(B.score_campaigns(_campaigns(spark, sf_dir)))


@register("campaign_budget_sweep", f"""WITH {_CAMPAIGNS_SQL.strip()},
sw AS (SELECT rated.*, CAST(step AS INTEGER) AS step,
              10000.0 + step * (greatest(budget * 2, 500000.0) - 10000.0) / 59.0 AS b
       FROM rated, range(60) t(step)),
s1 AS (SELECT *, {_score_sql('b', 'commission', 'retargeting')} FROM sw),
s2 AS (SELECT *, (reach * ctr * ctr_mult * cvr * (1 - dropoff) + rr * ctr * 0.7 * cvr * (1 - dropoff)) * aov AS revenue FROM s1)
SELECT name, step, {r('b')} AS sweep_budget, {r('CASE WHEN b > 0 THEN (revenue - b) / b * 100.0 ELSE 0.0 END')} AS roi_pct
FROM s2""")
def q_campaign_budget_sweep(spark, sf_dir):
    return rounded(B.budget_sweep(_campaigns(spark, sf_dir)))


_SCEN_SQL = values_sql("scen", ["pos", "strategy", "s_tier", "s_platform", "s_commission", "s_retargeting", "s_n"],
                       [(i, *s) for i, s in enumerate(S.SCENARIOS)])


@register("campaign_scenarios", f"""WITH {_CAMPAIGNS_SQL.strip()}, {_SCEN_SQL},
x AS (SELECT camp.name, camp.budget, camp.aov, camp.dropoff, scen.*, bench.cpm, bench.ctr, bench.cvr,
             mult.reach_mult, mult.ctr_mult, mult.cpm_mult
      FROM camp, scen JOIN bench ON scen.s_tier = bench.tier JOIN mult ON scen.s_platform = mult.platform),
s1 AS (SELECT *, {_score_sql('budget', 's_commission', 's_retargeting')} FROM x),
s2 AS (SELECT *, reach * ctr * ctr_mult * cvr * (1 - dropoff) AS conv, rr * ctr * 0.7 * cvr * (1 - dropoff) AS rc FROM s1)
SELECT name, CAST(pos AS INTEGER) AS pos, strategy, s_tier AS tier, s_platform AS platform, CAST(s_n AS INTEGER) AS n_influencers,
       {r('reach')} AS reach, {r('conv + rc')} AS total_conversions, {r('(conv + rc) * aov')} AS revenue,
       {r('CASE WHEN budget > 0 THEN ((conv + rc) * aov - budget) / budget * 100.0 ELSE 0.0 END')} AS roi_pct,
       {r('CASE WHEN conv + rc > 0 THEN budget / (conv + rc) ELSE 0.0 END')} AS cpa, {r('conv * aov')} AS content_revenue
FROM s2""")
def q_campaign_scenarios(spark, sf_dir):
    table, _ = B.compare_scenarios(_campaigns(spark, sf_dir))
    return rounded(table)


@register("campaign_best_strategy", f"""WITH {_CAMPAIGNS_SQL.strip()}, {_SCEN_SQL},
x AS (SELECT camp.name, camp.budget, camp.aov, camp.dropoff, scen.*, bench.cpm, bench.ctr, bench.cvr,
             mult.reach_mult, mult.ctr_mult, mult.cpm_mult
      FROM camp, scen JOIN bench ON scen.s_tier = bench.tier JOIN mult ON scen.s_platform = mult.platform),
s AS (SELECT name, pos, strategy, (budget * s_commission) / (cpm * cpm_mult) * 1000.0 * reach_mult * ctr * ctr_mult * cvr
                                   * (1 - dropoff) * aov AS key FROM x)
SELECT name, strategy AS best_strategy FROM (
  SELECT name, strategy, row_number() OVER (PARTITION BY name ORDER BY key DESC, pos) AS rn FROM s) t
WHERE rn = 1""")
def q_campaign_best_strategy(spark, sf_dir):
    _, winner = B.compare_scenarios(_campaigns(spark, sf_dir))
    return winner
