"""Registered queries: sources, encoding, filters and descriptive aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.operators import aggregate as A
from panelspark.operators import filters as FL
from panelspark.plans.common import encoded, values_sql
from panelspark.plans.oracle import q, r, with_enc, with_responses
from panelspark.plans.registry import register, rounded
from panelspark.sources.io import preview, rename_columns
from panelspark.sources.responses import RAW_COLUMNS

PLATFORM_FLAGS = {f"platform_{p.lower()}": p for p in S.PLATFORMS_FILTER}
_ENC_COLS = [
    "spending_ord", "daily_time_ord", "engagement_ord", "purchase_ord", "ad_click_ord", "age_ord",
    "searched_binary", "ad_influenced_binary", "high_ad_responsive", "made_purchase",
] + ["platform_" + p.lower() for p in S.PLATFORMS_DASHBOARD] + list(S.MOTIVATION_FLAGS_DASHBOARD)


def _domain_sql(name: str, col: str, values: list[str], pos: str = "pos") -> str:
    return values_sql(name, [col, pos], [(v, i) for i, v in enumerate(values)])


# -- S1/S2/P1-P5: the encoded response table -----------------------------------------------------
_RAW_NO_TS = [c for c in RAW_COLUMNS if c not in ("start_time", "end_time")]


@register("encoded_responses", with_enc(
    "SELECT " + ", ".join(_RAW_NO_TS + _ENC_COLS)
    + ", CAST(CAST(start_time AS DATE) AS VARCHAR) AS start_day, CAST(CAST(end_time AS DATE) AS VARCHAR) AS end_day"
    + " FROM enc"))
def q_encoded_responses(spark, sf_dir):
    df = encoded(spark, sf_dir)
    return rounded(df.select(*_RAW_NO_TS, *_ENC_COLS,
                             F.to_date("start_time").cast("string").alias("start_day"),
                             F.to_date("end_time").cast("string").alias("end_day")))


@register("renamed_questions", with_responses("""
SELECT id, start_time, end_time, age_group, gender, spending, platforms, daily_time, follows_influencers, content_type,
       trust_factor, engagement_freq, product_interest_score, searched_product, purchase_freq, purchase_motivation,
       satisfaction_score, ad_click_freq, ad_influenced, retargeting_score, preferred_ad_format FROM responses"""))
def q_renamed_questions(spark, sf_dir):
    """An export under all 24 question texts, renamed, and without the personal columns."""
    from panelspark.sources.responses import responses
    raw = responses(spark, sf_dir)
    export = raw.select(*[(F.col(short) if short in raw.columns else F.lit("n/a")).alias(text)
                          for text, short in S.QUESTION_ALIASES.items()])
    return rename_columns(export, S.QUESTION_ALIASES).drop(*S.PERSONAL_COLUMNS)


@register("preview_rows", with_enc("""
SELECT id, age_group, gender, spending, trust_factor, purchase_freq, engagement_freq,
       preferred_ad_format, satisfaction_score, made_purchase
FROM enc WHERE age_group IS NOT NULL ORDER BY id LIMIT 50"""))
def q_preview_rows(spark, sf_dir):
    """S8 on the encoded table; the SQL spells its columns out, so a wrong list shows."""
    rows = encoded(spark, sf_dir).where(F.col("age_group").isNotNull())
    return preview(rows, ["id"] + S.PREVIEW_COLUMNS, n=50, order_by="id")


@register("export_rows", with_enc("""
SELECT id, age_group, gender, spending, platforms, daily_time, follows_influencers, trust_factor,
       engagement_freq, product_interest_score, purchase_freq, satisfaction_score, ad_click_freq,
       ad_influenced, retargeting_score, preferred_ad_format, purchase_ord, engagement_ord,
       spending_ord, made_purchase, high_ad_responsive
FROM enc"""))
def q_export_rows(spark, sf_dir):
    """The rows and columns of the CSV export."""
    return encoded(spark, sf_dir).select("id", *S.EXPORT_COLUMNS)


# -- A15 cohort summary (flagship) -----------------------------------------------------------
COHORT_SQL = with_enc(f""",
{_domain_sql('dom', 'spending', S.SPENDING_LEVELS, 'cohort_pos')},
g AS (
  SELECT spending, count(*) AS n, avg(engagement_ord) AS avg_engagement,
         avg(made_purchase) * 100.0 AS purchase_rate, avg(satisfaction_score) AS avg_satisfaction,
         avg(high_ad_responsive) * 100.0 AS ad_click_rate, avg(product_interest_score) AS avg_interest
  FROM enc GROUP BY spending
),
present AS (SELECT d.cohort_pos, g.* FROM dom d JOIN g ON d.spending = g.spending)
SELECT spending AS cohort, cohort_pos, n, {r('avg_engagement')} AS avg_engagement,
       {r('purchase_rate')} AS purchase_rate, {r('avg_satisfaction')} AS avg_satisfaction,
       {r('ad_click_rate')} AS ad_click_rate, {r('avg_interest')} AS avg_interest
FROM present
WHERE (SELECT count(*) FROM present) >= 2 AND (SELECT sum(n) FROM present) >= 20""")


@register("cohort_summary", COHORT_SQL)
def q_cohort_summary(spark, sf_dir):
    return rounded(A.cohort_summary(encoded(spark, sf_dir)))


# -- A1 KPI row, with and without the dashboard's default segment filter ----------------------
def _kpi_sql(src: str) -> str:
    return f"""
SELECT count(*) AS n,
       {r('coalesce(avg(made_purchase) * 100.0, 0)')} AS purchase_rate,
       {r('coalesce(avg(product_interest_score), 0)')} AS avg_interest,
       {r('coalesce(avg(satisfaction_score), 0)')} AS avg_satisfaction,
       {r('coalesce(avg(high_ad_responsive) * 100.0, 0)')} AS ad_responsive_rate,
       {r('coalesce(avg(engagement_ord), 0)')} AS avg_engagement,
       {r("coalesce(avg(CAST(coalesce(trim(preferred_ad_format) = 'Reels', false) AS INTEGER)) * 100.0, 0)")} AS reels_pct
FROM {src}"""


@register("kpi_summary", with_enc(_kpi_sql("enc")))
def q_kpi_summary(spark, sf_dir):
    return rounded(A.kpi_summary(encoded(spark, sf_dir)))


SEGMENT = {"ages": ["19-24", "25-30", "40+"], "genders": ["Female", "Male"], "spending": [],
           "trust": ["Content quality", "Authenticity", "Expertise in niche"]}


def _in(col, vals):
    return f"{col} IN (" + ", ".join(q(v) for v in vals) + ")"


_SEG_WHERE = " AND ".join([
    _in("age_group", SEGMENT["ages"]), _in("gender", SEGMENT["genders"]), _in("trust_factor", SEGMENT["trust"]),
    "(" + " OR ".join(f"{c} = 1" for c in PLATFORM_FLAGS) + ")",
])


@register("segment_kpis", with_enc(", seg AS (SELECT * FROM enc WHERE " + _SEG_WHERE + ")" + _kpi_sql("seg")))
def q_segment_kpis(spark, sf_dir):
    df = FL.dashboard_filter(encoded(spark, sf_dir), ages=SEGMENT["ages"], genders=SEGMENT["genders"],
                             spending=SEGMENT["spending"], trust=SEGMENT["trust"], platforms=S.PLATFORMS_FILTER)
    return rounded(A.kpi_summary(df))


@register("facet_spending", with_enc(f""",
{_domain_sql('dom', 'spending', S.SPENDING_LEVELS)}
SELECT spending, pos FROM dom WHERE spending IN (SELECT spending FROM enc WHERE spending IS NOT NULL)"""))
def q_facet_spending(spark, sf_dir):
    return FL.facet_values(encoded(spark, sf_dir), "spending", S.SPENDING_LEVELS)


@register("facet_trust", with_enc("""
SELECT trust_factor, CAST(row_number() OVER (ORDER BY trust_factor) AS INTEGER) AS pos
FROM (SELECT DISTINCT trust_factor FROM enc WHERE trust_factor IS NOT NULL)"""))
def q_facet_trust(spark, sf_dir):
    return FL.facet_values(encoded(spark, sf_dir), "trust_factor")


# -- A2-A5 ---------------------------------------------------------------------------------------
@register("value_counts_trust", with_enc(
    "SELECT trust_factor, count(*) AS n FROM enc WHERE trust_factor IS NOT NULL GROUP BY trust_factor"))
def q_value_counts_trust(spark, sf_dir):
    return A.value_counts(encoded(spark, sf_dir), "trust_factor")


@register("value_share_age", with_enc(f"""
SELECT age_group, n, {r('n * 100.0 / sum(n) OVER ()')} AS share_pct
FROM (SELECT age_group, count(*) AS n FROM enc WHERE age_group IS NOT NULL GROUP BY age_group)"""))
def q_value_share_age(spark, sf_dir):
    return rounded(A.value_share(encoded(spark, sf_dir), "age_group"))


@register("value_share_ad_format", with_enc(f"""
SELECT preferred_ad_format, n, {r('n * 100.0 / sum(n) OVER ()')} AS share_pct
FROM (SELECT trim(preferred_ad_format) AS preferred_ad_format, count(*) AS n FROM enc
      WHERE preferred_ad_format IS NOT NULL GROUP BY 1)"""))
def q_value_share_ad_format(spark, sf_dir):
    return rounded(A.value_share(encoded(spark, sf_dir), "preferred_ad_format", trim=True))


@register("domain_counts_engagement", with_enc(f""",
{_domain_sql('dom', 'engagement_freq', S.ENGAGEMENT_LEVELS)},
c AS (SELECT engagement_freq, count(*) AS n FROM enc WHERE engagement_freq IS NOT NULL GROUP BY 1)
SELECT d.engagement_freq, d.pos, coalesce(c.n, 0) AS n FROM dom d LEFT JOIN c ON d.engagement_freq = c.engagement_freq"""))
def q_domain_counts_engagement(spark, sf_dir):
    return A.domain_counts(encoded(spark, sf_dir), "engagement_freq", S.ENGAGEMENT_LEVELS, fill=0)


@register("domain_counts_purchase_nb", with_enc(f""",
{_domain_sql('dom', 'purchase_freq', S.PURCHASE_LEVELS + ['Sometimes'])},
c AS (SELECT purchase_freq, count(*) AS n FROM enc WHERE purchase_freq IS NOT NULL GROUP BY 1)
SELECT d.purchase_freq, d.pos, c.n FROM dom d LEFT JOIN c ON d.purchase_freq = c.purchase_freq"""))
def q_domain_counts_purchase_nb(spark, sf_dir):
    """Notebook variant: an absent level stays null (the extra level never occurs)."""
    return A.domain_counts(encoded(spark, sf_dir), "purchase_freq", S.PURCHASE_LEVELS + ["Sometimes"], fill=None)


_PLAT_COLS = ["platform_" + p.lower() for p in S.PLATFORMS_DASHBOARD]


@register("flag_totals_platforms", with_enc(
    "SELECT flag, CAST(total AS BIGINT) AS total FROM (SELECT "
    + ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in _PLAT_COLS)
    + " FROM enc) UNPIVOT (total FOR flag IN (" + ", ".join(_PLAT_COLS) + "))"))
def q_flag_totals_platforms(spark, sf_dir):
    return A.flag_totals(encoded(spark, sf_dir), _PLAT_COLS)


# -- A6-A10 --------------------------------------------------------------------------------------
@register("group_mean_purchase_by_trust", with_enc(f"""
SELECT trust_factor, count(*) AS n, {r('avg(made_purchase) * 100.0')} AS mean
FROM enc WHERE trust_factor IS NOT NULL GROUP BY trust_factor"""))
def q_group_mean_purchase_by_trust(spark, sf_dir):
    return rounded(A.group_mean(encoded(spark, sf_dir), "trust_factor", "made_purchase", scale=100.0))


@register("group_mean_satisfaction_by_age", with_enc(f"""
SELECT age_group, count(*) AS n, {r('avg(satisfaction_score)')} AS mean
FROM enc WHERE age_group IS NOT NULL GROUP BY age_group"""))
def q_group_mean_satisfaction_by_age(spark, sf_dir):
    return rounded(A.group_mean(encoded(spark, sf_dir), "age_group", "satisfaction_score"))


@register("group_rates_engagement", with_enc(f""",
{_domain_sql('dom', 'engagement_freq', S.ENGAGEMENT_LEVELS)},
g AS (SELECT engagement_freq, count(*) AS n, avg(made_purchase) * 100.0 AS made_purchase_rate,
             avg(high_ad_responsive) * 100.0 AS high_ad_responsive_rate
      FROM enc WHERE engagement_freq IS NOT NULL GROUP BY 1)
SELECT d.engagement_freq, d.pos, g.n, {r('g.made_purchase_rate')} AS made_purchase_rate,
       {r('g.high_ad_responsive_rate')} AS high_ad_responsive_rate
FROM dom d LEFT JOIN g ON d.engagement_freq = g.engagement_freq"""))
def q_group_rates_engagement(spark, sf_dir):
    return rounded(A.group_rates(encoded(spark, sf_dir), "engagement_freq",
                                 ["made_purchase", "high_ad_responsive"], S.ENGAGEMENT_LEVELS))


def _member_union_sql(measure: str, flags: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {q(lab)} AS member, {measure} AS v FROM enc WHERE {f} = 1"
                              for f, lab in flags.items())


@register("rate_by_platform", with_enc(f"""
SELECT member, count(*) AS n, {r('avg(v) * 100.0')} AS rate
FROM ({_member_union_sql('made_purchase', PLATFORM_FLAGS)}) GROUP BY member HAVING count(*) > 10"""))
def q_rate_by_platform(spark, sf_dir):
    return rounded(A.rate_by_member(encoded(spark, sf_dir), PLATFORM_FLAGS, "made_purchase", min_n=10))


def _funnel_sql(first: tuple[str, str]) -> str:
    stages = [first, ("Searched Product", "searched_binary = 1"), ("Made Purchase", "made_purchase = 1"),
              ("High Frequency (3+x)", "purchase_ord >= 3")]
    sums = ", ".join(f"CAST(sum(CAST(coalesce({c}, false) AS INTEGER)) AS BIGINT) AS s{i}" for i, (_, c) in enumerate(stages))
    rows = " UNION ALL ".join(
        f"SELECT {i + 1} AS stage_no, {q(n)} AS stage, coalesce(s{i}, 0) AS n, base FROM w" for i, (n, _) in enumerate(stages))
    return f""", w AS (SELECT count(*) AS base, {sums} FROM enc)
SELECT stage_no, stage, n, {r('n * 100.0 / base')} AS pct_of_base FROM ({rows})"""


@register("funnel_notebook", with_enc(_funnel_sql(("Follow Influencers", "follows_influencers = 'Yes'"))))
def q_funnel_notebook(spark, sf_dir):
    return rounded(A.funnel(encoded(spark, sf_dir), A.notebook_funnel_stages()))


@register("funnel_dashboard", with_enc(_funnel_sql(("All Respondents", "true"))))
def q_funnel_dashboard(spark, sf_dir):
    return rounded(A.funnel(encoded(spark, sf_dir), A.dashboard_funnel_stages()))


@register("kpi_normalized", with_enc(" UNION ALL ".join(
    f"SELECT {q(c)} AS kpi, {r(f"avg({c})")} AS mean, CAST({float(m)} AS DOUBLE) AS max_value, {r(f'avg({c}) / {float(m)} * 100.0')} AS pct_of_max FROM enc"
    for c, m in A.NOTEBOOK_KPI_MAXIMA.items())))
def q_kpi_normalized(spark, sf_dir):
    return rounded(A.kpi_normalized(encoded(spark, sf_dir), A.NOTEBOOK_KPI_MAXIMA))


# -- A11-A14, A17 ------------------------------------------------------------------------------
_MISSING_COLS = RAW_COLUMNS


@register("missing_profile", with_responses(f"""
SELECT "column", n_missing, {r('n_missing * 100.0 / n')} AS pct_missing FROM (
""" + " UNION ALL ".join(
    f"SELECT {q(c)} AS \"column\", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, count(*) AS n FROM responses"
    for c in _MISSING_COLS) + ") WHERE n_missing > 0"))
def q_missing_profile(spark, sf_dir):
    from panelspark.sources.responses import responses
    return rounded(A.missing_profile(responses(spark, sf_dir), _MISSING_COLS))


_DESCRIBE_SRC = """
SELECT 'c_acctbal' AS "column", CAST(c_acctbal AS DOUBLE) AS v FROM customer
UNION ALL SELECT 's_acctbal', CAST(s_acctbal AS DOUBLE) FROM supplier"""


@register("describe_balances", f"""
SELECT "column", count(v) AS count, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS min,
       {r('quantile_cont(v, 0.25)')} AS p25, {r('quantile_cont(v, 0.5)')} AS p50, {r('quantile_cont(v, 0.75)')} AS p75,
       {r('max(v)')} AS max
FROM ({_DESCRIBE_SRC}) WHERE v IS NOT NULL GROUP BY "column" """)
def q_describe_balances(spark, sf_dir):
    from panelspark.sources.tables import read_table
    cust = read_table(spark, sf_dir, "customer", ["c_acctbal"])
    supp = read_table(spark, sf_dir, "supplier", ["s_acctbal"])
    a = A.describe_numeric(cust, ["c_acctbal"])
    b = A.describe_numeric(supp, ["s_acctbal"])
    return rounded(a.unionByName(b))


@register("describe_scores", with_enc(f"""
SELECT "column", count(v) AS count, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS min,
       {r('quantile_cont(v, 0.25)')} AS p25, {r('quantile_cont(v, 0.5)')} AS p50, {r('quantile_cont(v, 0.75)')} AS p75,
       {r('max(v)')} AS max
FROM (""" + " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", CAST({c} AS DOUBLE) AS v FROM enc" for c in S.NUMERIC_FEATURES)
    + """) WHERE v IS NOT NULL GROUP BY "column" """))
def q_describe_scores(spark, sf_dir):
    return rounded(A.describe_numeric(encoded(spark, sf_dir), S.NUMERIC_FEATURES))


def _dist_sql(src: str, bins: int, lo: str | None = None, hi: str | None = None) -> str:
    """Histogram + moments; skewness written out as population moments."""
    lo = lo or "min(v)"
    hi = hi or "max(v)"
    return f""",
base AS ({src}),
st AS (SELECT {lo} AS lo, {hi} AS hi, avg(v) AS mean, median(v) AS median,
              avg(v) AS m1, avg(v * v) AS m2, count(*) AS cnt FROM base),
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


@register("distribution_interest", with_enc(_dist_sql(
    "SELECT CAST(product_interest_score AS DOUBLE) AS v FROM enc WHERE product_interest_score IS NOT NULL", 5)))
def q_distribution_interest(spark, sf_dir):
    return rounded(A.distribution(encoded(spark, sf_dir), "product_interest_score", bins=5))


@register("top_trust_factor", with_enc(f"""
SELECT trust_factor, n, {r('share_pct')} AS share_pct FROM (
  SELECT trust_factor, n, n * 100.0 / sum(n) OVER () AS share_pct
  FROM (SELECT trust_factor, count(*) AS n FROM enc WHERE trust_factor IS NOT NULL GROUP BY 1))
ORDER BY n DESC, trust_factor ASC LIMIT 1"""))
def q_top_trust_factor(spark, sf_dir):
    return rounded(A.top_category(encoded(spark, sf_dir), "trust_factor"))


@register("top_platform", with_enc(f"""
SELECT label, total FROM (
""" + " UNION ALL ".join(f"SELECT {q(lab)} AS label, CAST(coalesce(sum({f}), 0) AS BIGINT) AS total, {i} AS pos FROM enc"
                         for i, (f, lab) in enumerate(PLATFORM_FLAGS.items())) + """)
ORDER BY total DESC, pos ASC LIMIT 1"""))
def q_top_platform(spark, sf_dir):
    return A.top_flag(encoded(spark, sf_dir), PLATFORM_FLAGS)


@register("findings", with_enc(f""",
tt AS (SELECT trust_factor, n, n * 100.0 / sum(n) OVER () AS share_pct
       FROM (SELECT trust_factor, count(*) AS n FROM enc WHERE trust_factor IS NOT NULL GROUP BY 1)
       ORDER BY n DESC, trust_factor LIMIT 1)
SELECT 'top_trust_factor' AS finding, trust_factor AS label, {r('share_pct')} AS value FROM tt
""" + "".join(f"UNION ALL SELECT 'motivation_pct', {q(lab)}, {r(f'avg({f}) * 100.0')} FROM enc\n"
              for f, lab in S.MOTIVATION_FLAGS_DASHBOARD.items())
    + f"""UNION ALL SELECT 'reels_pct', 'Reels', {r("coalesce(avg(CAST(coalesce(trim(preferred_ad_format) = 'Reels', false) AS INTEGER)) * 100.0, 0)")} FROM enc
UNION ALL SELECT 'not_ad_responsive_pct', '', {r('100.0 - coalesce(avg(high_ad_responsive) * 100.0, 0)')} FROM enc"""))
def q_findings(spark, sf_dir):
    return rounded(A.findings(encoded(spark, sf_dir)))


@register("tail_bias_profile", with_enc(f"""
SELECT 'age_group' AS "column", label, n, {r('share_pct')} AS share_pct FROM (
  SELECT age_group AS label, n, n * 100.0 / sum(n) OVER () AS share_pct
  FROM (SELECT age_group, count(*) AS n FROM enc WHERE age_group IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, label LIMIT 1)
UNION ALL
SELECT 'gender', label, n, {r('share_pct')} FROM (
  SELECT gender AS label, n, n * 100.0 / sum(n) OVER () AS share_pct
  FROM (SELECT gender, count(*) AS n FROM enc WHERE gender IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, label LIMIT 1)"""))
def q_tail_bias_profile(spark, sf_dir):
    """How dominant the largest age group and gender are (share of non-null answers)."""
    enc = encoded(spark, sf_dir)
    parts = [A.top_category(enc, c).select(F.lit(c).alias("column"), F.col(c).alias("label"), "n", "share_pct")
             for c in ("age_group", "gender")]
    return rounded(parts[0].unionByName(parts[1]))
