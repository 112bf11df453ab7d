"""Registered queries: cross-tabs, ranks, correlation and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.operators import crosstab as X
from panelspark.operators import hypothesis as H
from panelspark.operators import network as N
from panelspark.operators import ranks as RK
from panelspark.operators.aggregate import explode_members
from panelspark.plans.common import encoded, values_sql
from panelspark.plans.oracle import q, r, with_enc
from panelspark.plans.registry import register, rounded
from panelspark.sources.tables import read_table

PLATFORM_FLAGS = {f"platform_{p.lower()}": p for p in S.PLATFORMS_FILTER}


def _exact(expr: str) -> str:
    """Stands in for the rounding of statistics that SQL goes on to use."""
    return f"({expr})"


def _rank_sql(v: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    pv = f"PARTITION BY {part + ', ' if part else ''}{v}"
    return f"(rank() OVER ({p}ORDER BY {v}) + (count(*) OVER ({pv}) - 1) / 2.0)"


def _split_sql(col: str) -> str:
    return f"list_filter(list_transform(string_split({col}, ';'), lambda x: trim(x)), lambda x: x <> '')"


# -- X1-X4 ----------------------------------------------------------------------------------------
@register("crosstab_trust_purchase", with_enc("""
SELECT trust_factor, made_purchase, count(*) AS n FROM enc
WHERE trust_factor IS NOT NULL AND made_purchase IS NOT NULL GROUP BY 1, 2"""))
def q_crosstab_trust_purchase(spark, sf_dir):
    return X.crosstab(encoded(spark, sf_dir), "trust_factor", "made_purchase")


_GENDERS = ["Female", "Male", "Other"]


@register("crosstab_wide_age_gender", with_enc(
    "SELECT age_group, " + ", ".join(
        f"count(*) FILTER (WHERE gender = {q(g)}) AS \"{g}\"" for g in _GENDERS)
    + " FROM enc WHERE age_group IS NOT NULL AND gender IS NOT NULL GROUP BY age_group"))
def q_crosstab_wide_age_gender(spark, sf_dir):
    return X.crosstab_wide(encoded(spark, sf_dir), "age_group", "gender", _GENDERS)


@register("crosstab_pct_age_engagement", with_enc(f"""
SELECT age_group, engagement_freq, n, {r('n * 100.0 / sum(n) OVER (PARTITION BY age_group)')} AS row_pct
FROM (SELECT age_group, engagement_freq, count(*) AS n FROM enc
      WHERE age_group IS NOT NULL AND engagement_freq IS NOT NULL GROUP BY 1, 2)"""))
def q_crosstab_pct_age_engagement(spark, sf_dir):
    return rounded(X.crosstab_pct(encoded(spark, sf_dir), "age_group", "engagement_freq"))


def _multi_sql(a: str, multi: str) -> str:
    return with_enc(f"""
SELECT {a}, item, count(*) AS n FROM (
  SELECT {a}, unnest({_split_sql(multi)}) AS item FROM enc WHERE {a} IS NOT NULL AND {multi} IS NOT NULL)
GROUP BY 1, 2""")


@register("crosstab_age_content", _multi_sql("age_group", "content_type"))
def q_crosstab_age_content(spark, sf_dir):
    return X.crosstab_multi(encoded(spark, sf_dir), "age_group", "content_type")


@register("crosstab_trust_motivation", _multi_sql("trust_factor", "purchase_motivation"))
def q_crosstab_trust_motivation(spark, sf_dir):
    return X.crosstab_multi(encoded(spark, sf_dir), "trust_factor", "purchase_motivation")


@register("crosstab_age_motivation", _multi_sql("age_group", "purchase_motivation"))
def q_crosstab_age_motivation(spark, sf_dir):
    return X.crosstab_multi(encoded(spark, sf_dir), "age_group", "purchase_motivation")


@register("dense_grid_trust_motivation", with_enc(f""",
{values_sql('ta', ['trust_factor'], [(t,) for t in S.TRUST_FACTORS])},
{values_sql('mo', ['item'], [(m,) for m in S.MOTIVATIONS])},
w AS (SELECT trust_factor, item, CAST(count(*) AS BIGINT) AS weight FROM (
  SELECT trim(trust_factor) AS trust_factor, unnest({_split_sql('purchase_motivation')}) AS item
  FROM enc WHERE trust_factor IS NOT NULL AND trim(trust_factor) <> '') GROUP BY 1, 2)
SELECT ta.trust_factor, mo.item, coalesce(w.weight, 0) AS weight
FROM ta CROSS JOIN mo LEFT JOIN w ON w.trust_factor = ta.trust_factor AND w.item = mo.item"""))
def q_dense_grid_trust_motivation(spark, sf_dir):
    edges = N.bipartite(encoded(spark, sf_dir), "trust_factor", "purchase_motivation")
    cells = edges.select(F.col("src").alias("trust_factor"), F.col("dst").alias("item"), "weight")
    return X.dense_grid(cells, "trust_factor", "item", S.TRUST_FACTORS, S.MOTIVATIONS, value="weight")


# -- C1-C6 ----------------------------------------------------------------------------------------
@register("avg_rank_acctbal", f"""
SELECT c_custkey, c_acctbal, {_rank_sql('c_acctbal')} AS rank FROM customer""")
def q_avg_rank_acctbal(spark, sf_dir):
    """High-cardinality path: range-partitioned running counts + partition offsets."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return RK.avg_rank(cust, "c_acctbal").select("c_custkey", "c_acctbal", "rank")


@register("avg_rank_quantity", f"""
SELECT l_quantity, cnt, {r('rnk')} AS rank FROM (
  SELECT l_quantity, count(*) AS cnt, min(rnk) AS rnk FROM (
    SELECT l_quantity, {_rank_sql('l_quantity')} AS rnk FROM lineitem) GROUP BY l_quantity)""")
def q_avg_rank_quantity(spark, sf_dir):
    """Rank table of a heavily tied column (value, count, average rank)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_quantity"])
    return rounded(RK.rank_table(li, "l_quantity").select("l_quantity", "cnt", "rank"))


_CORR_COLS = S.NUMERIC_FEATURES + ["purchase_ord"]


def _listwise_sql() -> str:
    cols = _CORR_COLS
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    ranks = ", ".join(f"{_rank_sql(c)} AS r_{c}" for c in cols)
    parts = []
    for a in cols:
        for b in cols:
            rho = "CASE WHEN count(*) > 1 THEN 1.0 END" if a == b else f"corr(r_{a}, r_{b})"
            parts.append(f"SELECT {q(a)} AS x, {q(b)} AS y, {r(rho)} AS rho, count(*) AS n FROM rk")
    return with_enc(f""", rk AS (SELECT {ranks} FROM enc WHERE {complete})
""" + "\nUNION ALL ".join(parts))


@register("spearman_matrix", _listwise_sql())
def q_spearman_matrix(spark, sf_dir):
    return rounded(RK.spearman_matrix(encoded(spark, sf_dir), _CORR_COLS, high_cardinality=False))


_PAIR_COLS = ["spending_ord", "daily_time_ord", "engagement_ord", "product_interest_score",
              "purchase_ord", "satisfaction_score", "ad_click_ord", "retargeting_score"]


def _pairwise_sql() -> str:
    parts = []
    for a in _PAIR_COLS:
        for b in _PAIR_COLS:
            if a == b:
                parts.append(f"SELECT {q(a)} AS x, {q(b)} AS y, 1.0 AS rho, count(*) AS n FROM enc WHERE {a} IS NOT NULL")
            else:
                parts.append(f"""SELECT {q(a)} AS x, {q(b)} AS y, {r(f'corr(ra, rb)')} AS rho, count(*) AS n FROM (
  SELECT {_rank_sql(a)} AS ra, {_rank_sql(b)} AS rb FROM enc WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return with_enc("\nUNION ALL ".join(parts))


@register("spearman_matrix_pairwise", _pairwise_sql())
def q_spearman_matrix_pairwise(spark, sf_dir):
    return rounded(RK.spearman_matrix(encoded(spark, sf_dir), _PAIR_COLS, mode="pairwise", high_cardinality=False))


def _vs_purchase_sql() -> str:
    parts = [f"""SELECT {q(c)} AS feature, count(*) AS n, {r('corr(ra, rb)')} AS rho FROM (
  SELECT {_rank_sql(c)} AS ra, {_rank_sql('purchase_ord')} AS rb FROM enc WHERE {c} IS NOT NULL AND purchase_ord IS NOT NULL)"""
             for c in S.NUMERIC_FEATURES]
    return with_enc("\nUNION ALL ".join(parts))


def _spearman_vs_purchase(spark, sf_dir):
    enc = encoded(spark, sf_dir)
    out = None
    for c in S.NUMERIC_FEATURES:
        sp = RK.spearman_pair(enc, c, "purchase_ord", high_cardinality=False).select(F.lit(c).alias("feature"), "n", "rho")
        out = sp if out is None else out.unionByName(sp)
    return out


@register("spearman_vs_purchase", _vs_purchase_sql())
def q_spearman_vs_purchase(spark, sf_dir):
    return rounded(_spearman_vs_purchase(spark, sf_dir))


@register("top_drivers_purchase", with_enc(f""", rk AS (
  SELECT {', '.join(f'{_rank_sql(c)} AS r_{c}' for c in _CORR_COLS)} FROM enc
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _CORR_COLS)}),
m AS ({' UNION ALL '.join(f"SELECT {q(c)} AS feature, corr(r_{c}, r_purchase_ord) AS rho FROM rk" for c in S.NUMERIC_FEATURES)})
SELECT feature, {r('rho')} AS rho FROM m ORDER BY abs(rho) DESC, feature LIMIT 3"""))
def q_top_drivers_purchase(spark, sf_dir):
    m = RK.spearman_matrix(encoded(spark, sf_dir), _CORR_COLS, high_cardinality=False)
    return rounded(RK.top_drivers(m, "purchase_ord", k=3))


@register("line_fit_interest_satisfaction", with_enc(f"""
SELECT count(*) AS n, {r('regr_slope(satisfaction_score, product_interest_score)')} AS slope,
       {r('regr_intercept(satisfaction_score, product_interest_score)')} AS intercept,
       {r('regr_r2(satisfaction_score, product_interest_score)')} AS r2
FROM enc WHERE satisfaction_score IS NOT NULL AND product_interest_score IS NOT NULL"""))
def q_line_fit(spark, sf_dir):
    return rounded(RK.line_fit(encoded(spark, sf_dir), "product_interest_score", "satisfaction_score"))


@register("line_fit_by_platform", with_enc(f"""
SELECT member, count(*) AS n, {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept,
       {r('regr_r2(y, x)')} AS r2
FROM (""" + " UNION ALL ".join(
    f"SELECT {q(lab)} AS member, CAST(daily_time_ord AS DOUBLE) AS x, CAST(purchase_ord AS DOUBLE) AS y FROM enc "
    f"WHERE {f} = 1 AND daily_time_ord IS NOT NULL AND purchase_ord IS NOT NULL"
    for f, lab in PLATFORM_FLAGS.items()) + ") GROUP BY member HAVING count(*) >= 10"))
def q_line_fit_by_platform(spark, sf_dir):
    return rounded(RK.line_fit_by_member(encoded(spark, sf_dir), PLATFORM_FLAGS, "daily_time_ord", "purchase_ord"))


# -- p-values in SQL: finite sums and a series of positive terms, nothing shared with functions/pvalues.py ----------
def _chi2_p_sql(x: str, dof: str) -> str:
    """Upper tail of chi-square for even degrees of freedom: exp(-x/2) * sum of (x/2)^i / i!."""
    return f"(exp(-{x} / 2) * list_sum(list_transform(range(0, CAST({dof} AS BIGINT) // 2), lambda i: pow({x} / 2, i) / gamma(i + 1))))"


def _normal_p_sql(z: str) -> str:
    """Upper normal tail: 1/2 - density * sum of z^(2i+1) / (1 * 3 * ... * (2i+1))."""
    return (f"(0.5 - sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 400), lambda i: "
            f"exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300)) - (i + 1) * ln(2) - lgamma(i + 1.5) + ln(pi()) / 2))))")


def _t_p_sql(t: str, dof: str) -> str:
    """Upper tail of Student's t for t >= 0 and whole degrees of freedom, by its finite sums in cos(atan(t / sqrt(dof)))."""
    v = f"CAST({dof} AS BIGINT)"
    cos2 = f"({v} / ({v} + {t} * {t}))"
    sin = f"({t} / sqrt({v} + {t} * {t}))"
    even = (f"{sin} * list_sum(list_transform(range(0, {v} // 2), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln({cos2})) / sqrt(pi())))")
    odd = (f"2 / pi() * (atan({t} / sqrt({v})) + {sin} * coalesce(list_sum(list_transform(range(0, ({v} - 1) // 2), lambda k: "
           f"exp(lgamma(k + 1) - lgamma(k + 1.5) + (k + 0.5) * ln({cos2})) * sqrt(pi()) / 2)), 0))")
    return f"((1 - CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END) / 2)"


def _spearman_tests_sql() -> str:
    parts = [f"""SELECT {q(label)} AS hypothesis, count(*) AS n, corr(ra, rb) AS rho FROM (
  SELECT {_rank_sql(x)} AS ra, {_rank_sql(y)} AS rb FROM enc WHERE {x} IS NOT NULL AND {y} IS NOT NULL)""" for label, x, y in (
        ("H1: Trust → Purchase", "product_interest_score", "purchase_ord"),
        ("H2: Engagement → Purchase", "engagement_ord", "purchase_ord"),
        ("H3: Satisfaction → Retargeting", "satisfaction_score", "retargeting_score"),
        ("H4: Daily Time → Engagement", "daily_time_ord", "engagement_ord"),
        ("H5: Product Interest → Ad Click", "product_interest_score", "ad_click_ord"))]
    union = "\nUNION ALL ".join(parts)
    return with_enc(f""", st AS ({union}),
t AS (SELECT *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM st),
pv AS (SELECT *, 2 * {_t_p_sql('t', 'n - 2')} AS p FROM t)
SELECT hypothesis, n, {r('rho')} AS rho, {r('p')} AS p_value,
       CASE WHEN rho > 0 THEN 'Positive' ELSE 'Negative' END AS direction,
       CASE WHEN abs(rho) > 0.4 THEN 'Strong' WHEN abs(rho) > 0.2 THEN 'Moderate' ELSE 'Weak' END AS strength,
       CASE WHEN abs(rho) > 0.3 THEN '***' WHEN abs(rho) > 0.2 THEN '**' WHEN abs(rho) > 0.1 THEN '*' ELSE '' END AS stars,
       CASE WHEN p < 0.05 THEN 'SIGNIFICANT' ELSE 'NOT SIGNIFICANT' END AS status
FROM pv""")


@register("spearman_tests", _spearman_tests_sql())
def q_spearman_tests(spark, sf_dir):
    """The five hypotheses with p-values (t approximation, n - 2 df, two-sided) and labels."""
    return rounded(RK.spearman_test(encoded(spark, sf_dir), high_cardinality=False))


# -- H1-H8 ----------------------------------------------------------------------------------------
def _mw_sql(cond_a: str, cond_b: str, measure: str, r=r) -> str:
    return with_enc(f""",
lng AS (SELECT 'a' AS g, CAST({measure} AS DOUBLE) AS v FROM enc WHERE coalesce({cond_a}, false) AND {measure} IS NOT NULL
        UNION ALL
        SELECT 'b' AS g, CAST({measure} AS DOUBLE) AS v FROM enc WHERE coalesce({cond_b}, false) AND {measure} IS NOT NULL),
rk AS (SELECT g, v, {_rank_sql('v')} AS rnk FROM lng),
ties AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM lng GROUP BY v)),
s AS (SELECT count(*) FILTER (WHERE g = 'a') AS n_a, count(*) FILTER (WHERE g = 'b') AS n_b,
             sum(rnk) FILTER (WHERE g = 'a') AS ra,
             avg(v) FILTER (WHERE g = 'a') AS mean_a, avg(v) FILTER (WHERE g = 'b') AS mean_b,
             median(v) FILTER (WHERE g = 'a') AS median_a, median(v) FILTER (WHERE g = 'b') AS median_b FROM rk),
u AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u FROM s, ties)
SELECT n_a, n_b, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, {r('median_a')} AS median_a, {r('median_b')} AS median_b,
       {r('u')} AS u,
       {r('(u - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - tie / ((n_a + n_b) * (n_a + n_b - 1.0))))')} AS z
FROM u""")


@register("mann_whitney_followers", _mw_sql("follows_influencers = 'Yes'", "follows_influencers = 'No'", "purchase_ord"))
def q_mw_followers(spark, sf_dir):
    enc = encoded(spark, sf_dir)
    return rounded(H.mann_whitney_stats(enc, F.col("follows_influencers") == "Yes",
                                        F.col("follows_influencers") == "No", "purchase_ord", high_cardinality=False))


@register("mann_whitney_spenders", _mw_sql("spending_ord >= 3", "spending_ord <= 2", "engagement_ord"))
def q_mw_spenders(spark, sf_dir):
    enc = encoded(spark, sf_dir)
    return rounded(H.mann_whitney_stats(enc, F.col("spending_ord") >= 3, F.col("spending_ord") <= 2, "engagement_ord",
                                        high_cardinality=False))


def _kw_sql(long_sql: str, min_n: int = 5, r=r) -> str:
    return with_enc(f""",
lng0 AS ({long_sql}),
keep AS (SELECT g FROM lng0 GROUP BY g HAVING count(*) >= {min_n}),
lng AS (SELECT * FROM lng0 WHERE g IN (SELECT g FROM keep)),
rk AS (SELECT g, v, {_rank_sql('v')} AS rnk FROM lng),
ties AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM lng GROUP BY v)),
gs AS (SELECT g, count(*) AS n, sum(rnk) AS rs FROM rk GROUP BY g),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(rs * rs / n) AS s FROM gs),
h AS (SELECT k, nn, (12.0 / (nn * (nn + 1.0)) * s - 3.0 * (nn + 1)) / (1 - tie / (CAST(nn AS DOUBLE) * nn * nn - nn)) AS h FROM t, ties)
SELECT CAST(k AS BIGINT) AS k, CAST(nn AS BIGINT) AS n, {r('h')} AS h, {r('greatest((h - k + 1) / (nn - k), 0.0)')} AS eta2
FROM h WHERE k >= 2""")


_KW_AGE = "SELECT age_group AS g, CAST(purchase_ord AS DOUBLE) AS v FROM enc WHERE age_group IS NOT NULL AND purchase_ord IS NOT NULL"
_KW_PLATFORMS = " UNION ALL ".join(
    f"SELECT {q(lab)} AS g, CAST(ad_click_ord AS DOUBLE) AS v FROM enc WHERE {f} = 1 AND ad_click_ord IS NOT NULL"
    for f, lab in PLATFORM_FLAGS.items())


@register("kruskal_age", _kw_sql(_KW_AGE))
def q_kruskal_age(spark, sf_dir):
    enc = encoded(spark, sf_dir)
    return rounded(H.kruskal_stats(enc.select(F.col("age_group").alias("g"), F.col("purchase_ord").alias("v")),
                                   high_cardinality=False))


@register("kruskal_platforms", _kw_sql(_KW_PLATFORMS))
def q_kruskal_platforms(spark, sf_dir):
    """H3: overlapping groups -- a respondent is in every platform group they use."""
    long = explode_members(encoded(spark, sf_dir), PLATFORM_FLAGS, keep=["ad_click_ord"])
    return rounded(H.kruskal_stats(long.select(F.col("member").alias("g"), F.col("ad_click_ord").alias("v")),
                                   high_cardinality=False))


def _dunn_sql(long_sql: str, min_n: int = 5) -> str:
    return with_enc(f""",
lng0 AS ({long_sql}),
keep AS (SELECT g FROM lng0 GROUP BY g HAVING count(*) >= {min_n}),
lng AS (SELECT * FROM lng0 WHERE g IN (SELECT g FROM keep)),
rk AS (SELECT g, {_rank_sql('v')} AS rnk FROM lng),
ties AS (SELECT sum(c * c * c - c) AS tie, sum(c) AS nn FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM lng GROUP BY v)),
gs AS (SELECT g, count(*) AS n, avg(rnk) AS mr FROM rk GROUP BY g),
z AS (SELECT x.g AS a, y.g AS b, x.n AS n_a, y.n AS n_b, x.mr AS ma, y.mr AS mb,
      (x.mr - y.mr) / sqrt((nn * (nn + 1) / 12 - tie / (12 * (nn - 1))) * (1.0 / x.n + 1.0 / y.n)) AS z FROM gs x, gs y, ties WHERE x.g < y.g),
p AS (SELECT *, least(1, 2 * {_normal_p_sql('abs(z)')}) AS p, count(*) OVER () AS m FROM z),
h AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS i FROM p),
f AS (SELECT *, max(least(1, (m - i + 1) * p)) OVER (ORDER BY p, a, b) AS holm FROM h)
SELECT a, b, n_a, n_b, {r('ma')} AS mean_rank_a, {r('mb')} AS mean_rank_b, {r('z')} AS z, {r('p')} AS p_value,
       {r('least(1, m * p)')} AS p_bonferroni, {r('holm')} AS p_holm,
       CASE WHEN holm < 0.05 THEN 'REJECT H0' ELSE 'FAIL TO REJECT H0' END AS decision FROM f""")


@register("dunn_platforms", _dunn_sql(_KW_PLATFORMS))
def q_dunn_platforms(spark, sf_dir):
    """H3 post-hoc: every pair of platforms on ad clicks, with adjusted p-values."""
    long = explode_members(encoded(spark, sf_dir), PLATFORM_FLAGS, keep=["ad_click_ord"])
    return rounded(H.dunn(long.select(F.col("member").alias("g"), F.col("ad_click_ord").alias("v")), high_cardinality=False))


@register("dunn_age", _dunn_sql(_KW_AGE))
def q_dunn_age(spark, sf_dir):
    """H2 post-hoc: every pair of age groups on purchases."""
    return rounded(H.dunn(encoded(spark, sf_dir).select(F.col("age_group").alias("g"), F.col("purchase_ord").alias("v")),
                          high_cardinality=False))


def _t_sql(r=r) -> str:
    mean, sd, n = "avg(satisfaction_score)", "stddev_samp(satisfaction_score)", "count(satisfaction_score)"
    return with_enc(f"""
SELECT {n} AS n, {r(mean)} AS mean, {r(sd)} AS sd, {r(f'({mean} - 3.0) / ({sd} / sqrt({n}))')} AS t,
       {r(f'({mean} - 3.0) / {sd}')} AS cohens_d
FROM enc""")


@register("t_test_satisfaction", _t_sql())
def q_t_test_satisfaction(spark, sf_dir):
    return rounded(H.t_test_1samp_stats(encoded(spark, sf_dir), "satisfaction_score", S.NEUTRAL_SCORE))


def _chi_sql_one(la: str, lb: str, a: str, b: str, r=r) -> str:
    return f"""(WITH cells AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM enc
                WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
  ra AS (SELECT a, sum(o) AS rt FROM cells GROUP BY a),
  cb AS (SELECT b, sum(o) AS ct FROM cells GROUP BY b),
  tot AS (SELECT sum(o) AS n, (SELECT count(*) FROM ra) AS nr, (SELECT count(*) FROM cb) AS nc FROM cells),
  grid AS (SELECT ra.a, cb.b, ra.rt * cb.ct / CAST(tot.n AS DOUBLE) AS e, coalesce(cells.o, 0) AS o, tot.n, tot.nr, tot.nc
           FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b),
  adj AS (SELECT *, CASE WHEN (nr - 1) * (nc - 1) = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END AS d FROM grid),
  st AS (SELECT sum(d * d / e) AS chi2, max(n) AS n, max(nr) AS nr, max(nc) AS nc FROM adj)
  SELECT {q(la)} AS var_a, {q(lb)} AS var_b, {r('chi2')} AS chi2, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof,
         CAST(n AS BIGINT) AS n, {r('sqrt(chi2 / (n * (least(nr, nc) - 1)))')} AS cramers_v
  FROM st WHERE nr >= 2 AND nc >= 2)"""


@register("chi_square_stats", with_enc("\n" + "\nUNION ALL ".join(
    "SELECT * FROM " + _chi_sql_one(*p) for p in H.DEFAULT_CHI_PAIRS)))
def q_chi_square_stats(spark, sf_dir):
    return rounded(H.chi_square_stats_many(encoded(spark, sf_dir), H.DEFAULT_CHI_PAIRS))


def _chi_tests_sql(pairs=H.DEFAULT_CHI_PAIRS) -> str:
    """The statistics again, unrounded, with the p-values of even degrees of freedom and the labels."""
    return with_enc(", st AS (" + "\nUNION ALL ".join("SELECT * FROM " + _chi_sql_one(*p, r=_exact) for p in pairs)
                    + f"), pv AS (SELECT *, {_chi2_p_sql('chi2', 'dof')} AS p FROM st)")


_CHI_COLUMNS = f"""var_a, var_b, {r('chi2')} AS chi2, dof, n, {r('cramers_v')} AS cramers_v, {r('p')} AS p_value, p < 0.05 AS significant,
       CASE WHEN cramers_v > 0.3 THEN 'Strong' WHEN cramers_v > 0.15 THEN 'Moderate' ELSE 'Weak' END AS strength"""


@register("chi_square_tests", _chi_tests_sql() + f" SELECT {_CHI_COLUMNS} FROM pv")
def q_chi_square_tests(spark, sf_dir):
    return rounded(H.chi_square(encoded(spark, sf_dir)))


@register("strongest_association", _chi_tests_sql()
          + f" SELECT {_CHI_COLUMNS} FROM pv WHERE p < 0.05 ORDER BY cramers_v DESC, var_a, var_b LIMIT 1")
def q_strongest_association(spark, sf_dir):
    return rounded(H.strongest(H.chi_square(encoded(spark, sf_dir))))


# pairs that do depend on each other: spending stands for the value of the order
_DEPENDENT_PAIRS = [("Spending", "Purchases", "spending_ord", "purchase_ord"),
                    ("Engagement", "Made Purchase", "engagement_ord", "made_purchase"),
                    ("Purchases", "Made Purchase", "purchase_ord", "made_purchase")]


@register("strongest_dependent_pair", _chi_tests_sql(_DEPENDENT_PAIRS)
          + f" SELECT {_CHI_COLUMNS} FROM pv WHERE p < 0.05 ORDER BY cramers_v DESC, var_a, var_b LIMIT 1")
def q_strongest_dependent_pair(spark, sf_dir):
    """H8 on pairs of which some are associated."""
    return rounded(H.strongest(H.chi_square(encoded(spark, sf_dir), _DEPENDENT_PAIRS)))


def _hypothesis_sql() -> str:
    """CTE ``tests``: H1-H5 from the statistics' own SQL, each with its p-value and effect."""
    mw = [("H1", "purchases: people who follow influencers against the rest",
           _mw_sql("follows_influencers = 'Yes'", "follows_influencers = 'No'", "purchase_ord", r=_exact)),
          ("H5", "engagement: upper two spending bands against the lower two",
           _mw_sql("spending_ord >= 3", "spending_ord <= 2", "engagement_ord", r=_exact))]
    kw = [("H2", "purchases by age band", _kw_sql(_KW_AGE, r=_exact)), ("H3", "ad clicks by platform in use", _kw_sql(_KW_PLATFORMS, r=_exact))]
    parts = [f"""SELECT {q(h)} AS hypothesis, {q(d)} AS description, 'Mann-Whitney U (one-tailed)' AS test, u AS statistic,
       {_normal_p_sql('z')} AS p_value, z / sqrt(n_a + n_b) AS effect_size, 'r' AS effect_name FROM ({sql})""" for h, d, sql in mw]
    parts += [f"""SELECT {q(h)}, {q(d)}, 'Kruskal-Wallis H', h, {_chi2_p_sql('h', '(k - 1)')}, eta2, 'eta2' FROM ({sql})"""
              for h, d, sql in kw]
    parts.append(f"""SELECT 'H4', 'satisfaction above the scale''s middle, 3.0', 'One-sample t-test (one-tailed)', t,
       CASE WHEN t > 0 THEN {_t_p_sql('greatest(t, 0.0)', '(n - 1)')} ELSE 1.0 END, cohens_d, 'cohens_d' FROM ({_t_sql(r=_exact)})""")
    return "WITH tests AS (" + "\nUNION ALL ".join(parts) + ")"


@register("hypothesis_tests", _hypothesis_sql() + f"""
SELECT hypothesis, description, test, {r('statistic')} AS statistic, {r('p_value')} AS p_value,
       {r('effect_size')} AS effect_size, effect_name,
       CASE WHEN p_value < 0.05 THEN 'REJECT H0' ELSE 'FAIL TO REJECT H0' END AS decision FROM tests""")
def q_hypothesis_tests(spark, sf_dir):
    table, _ = H.hypothesis_summary(H.standard_tests(encoded(spark, sf_dir)))
    return rounded(table)


@register("hypothesis_decisions", _hypothesis_sql() + """
SELECT CASE WHEN p_value < 0.05 THEN 'REJECT H0' ELSE 'FAIL TO REJECT H0' END AS decision, count(*) AS n FROM tests GROUP BY 1""")
def q_hypothesis_decisions(spark, sf_dir):
    _, counts = H.hypothesis_summary(H.standard_tests(encoded(spark, sf_dir)))
    return counts
