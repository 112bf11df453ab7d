"""Hypothesis tests (H1-H8) on compressed rank tables.

Each test reduces the rows to a small ``(group, value, count)`` table with one grouped aggregate
(partial aggregation first, so a hot group costs nothing extra), computes ranks and tie terms on
that table (``ranks.rank_table``), and produces ONE result row per test.  Only that row goes
through the p-value UDF (T1).  The ``*_stats`` variants stop before the p-value and are
plain-SQL checkable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.pvalues import chi2_survival, normal_isf, normal_sf, t_survival
from panelspark.operators.ranks import group_medians, rank_table


def _decision(p: Column, alpha: float = S.ALPHA) -> Column:
    return F.when(p < alpha, "REJECT H0").otherwise("FAIL TO REJECT H0")


def group_value_counts(long: DataFrame, group: str = "g", value: str = "v") -> DataFrame:
    return (long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
            .groupBy(group, value).agg(F.count(F.lit(1)).alias("cnt")))


def rank_sums(gv: DataFrame, group: str = "g", value: str = "v", high_cardinality: bool = True) -> DataFrame:
    """``(g, n, rank_sum, tie_part)`` from a ``(g, v, cnt)`` table; ranks pool all groups.

    ``tie_part`` sums cnt * (t^2 - 1) with t the pooled count of the value, so adding it over the
    groups gives the tie term sum(t^3 - t) without a separate pass or join.
    """
    rt = rank_table(gv, value, weight="cnt", high_cardinality=high_cardinality).select(value, F.col("cnt").alias("tcnt"), "rank")
    t = F.col("tcnt").cast("double")
    return (gv.join(rt, value)
            .groupBy(group).agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.col("rank")).alias("rank_sum"),
                                F.sum(F.col("cnt") * (t * t - 1)).alias("tie_part")))


def _two_sample_long(df: DataFrame, cond_a: Column, cond_b: Column, measure: str) -> DataFrame:
    # one scan: a row that meets both conditions counts in both groups; the measure keeps its own type
    g = F.explode(F.array(F.when(cond_a, F.lit("a")), F.when(cond_b, F.lit("b"))))
    return df.select(g.alias("g"), F.col(measure).alias("v")).where(F.col("g").isNotNull() & F.col("v").isNotNull())


def mann_whitney_stats(df: DataFrame, cond_a: Column, cond_b: Column, measure: str,
                       high_cardinality: bool = True) -> DataFrame:
    """H1/H5 statistic: one row ``(n_a, n_b, mean_a, mean_b, median_a, median_b, u, z)``.

    ``u`` is the statistic of sample a; ``z`` is the normal approximation of the one-sided
    (a > b) test with tie correction and continuity correction 0.5.
    """
    gv = group_value_counts(_two_sample_long(df, cond_a, cond_b, measure))
    desc = group_medians(gv, "g", "v", high_cardinality).select("g", "mean", "median")
    pg = rank_sums(gv, high_cardinality=high_cardinality).join(desc, "g")
    row = pg.agg(
        *[F.max(F.when(F.col("g") == s, F.col(c))).alias(f"{c}_{s}")
          for s in ("a", "b") for c in ("n", "rank_sum", "mean", "median")],
        F.sum("tie_part").alias("tie_term"))
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("rank_sum_a") - n_a * (n_a + 1) / 2.0
    mu = n_a * n_b / 2.0
    nn = n_a + n_b
    sigma = F.sqrt(n_a * n_b / 12.0 * ((nn + 1) - F.col("tie_term") / (nn * (nn - 1))))
    z = F.try_divide(u - mu - 0.5, sigma)
    return row.select(
        F.coalesce(F.col("n_a"), F.lit(0).cast("long")).alias("n_a"),
        F.coalesce(F.col("n_b"), F.lit(0).cast("long")).alias("n_b"),
        "mean_a", "mean_b", "median_a", "median_b", u.alias("u"), z.alias("z"))


def mann_whitney(df: DataFrame, cond_a: Column, cond_b: Column, measure: str, hypothesis: str = "",
                 description: str = "", high_cardinality: bool = True) -> DataFrame:
    """H1/H5: one-tailed (greater) Mann-Whitney U with p-value and effect r = z(p)/sqrt(N)."""
    st = mann_whitney_stats(df, cond_a, cond_b, measure, high_cardinality)
    st = st.where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    p = normal_sf(F.col("z"))
    out = st.withColumn("p_value", p)
    out = out.withColumn("effect_size", normal_isf(F.col("p_value")) / F.sqrt(F.col("n_a") + F.col("n_b")))
    return out.select(F.lit(hypothesis).alias("hypothesis"), F.lit(description).alias("description"),
                      F.lit("Mann-Whitney U (one-tailed)").alias("test"), F.col("u").alias("statistic"),
                      "p_value", "effect_size", F.lit("r").alias("effect_name"),
                      _decision(F.col("p_value")).alias("decision"), "n_a", "n_b")


def kruskal_stats(long: DataFrame, group: str = "g", value: str = "v", min_n: int = 5,
                  high_cardinality: bool = True) -> DataFrame:
    """H2/H3 statistic: one row ``(k, n, h, eta2)``; groups with fewer than ``min_n`` rows drop out
    before ranking.  Tie-corrected H; eta2 = (H - k + 1) / (N - k) floored at 0."""
    lv = long.select(F.col(group).alias("g"), F.col(value).alias("v"))
    gv = group_value_counts(lv)
    sizes = gv.groupBy("g").agg(F.sum("cnt").alias("gn")).where(F.col("gn") >= min_n).select("g")
    gv = gv.join(sizes, "g", "left_semi")
    row = rank_sums(gv, high_cardinality=high_cardinality).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum("tie_part").alias("tie_term"),
                            F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"))
    nn = F.col("N").cast("double")
    h_raw = 12.0 / (nn * (nn + 1)) * F.col("s") - 3.0 * (nn + 1)
    h = F.try_divide(h_raw, 1 - F.col("tie_term") / (nn * nn * nn - nn))
    eta = F.greatest(F.try_divide(h - F.col("k") + 1, nn - F.col("k")), F.lit(0.0))
    return row.where(F.col("k") >= 2).select(
        F.col("k").cast("long").alias("k"), F.col("N").cast("long").alias("n"), h.alias("h"), eta.alias("eta2"))


def kruskal(long: DataFrame, group: str = "g", value: str = "v", min_n: int = 5, hypothesis: str = "",
            description: str = "", high_cardinality: bool = True) -> DataFrame:
    st = kruskal_stats(long, group, value, min_n, high_cardinality)
    out = st.withColumn("p_value", chi2_survival(F.col("h"), F.col("k") - 1))
    return out.select(F.lit(hypothesis).alias("hypothesis"), F.lit(description).alias("description"),
                      F.lit("Kruskal-Wallis H").alias("test"), F.col("h").alias("statistic"), "p_value",
                      F.col("eta2").alias("effect_size"), F.lit("eta2").alias("effect_name"),
                      _decision(F.col("p_value")).alias("decision"), "k", "n")


def dunn(long: DataFrame, group: str = "g", value: str = "v", min_n: int = 5, high_cardinality: bool = True) -> DataFrame:
    """H3 post-hoc (Dunn 1964): which groups of a Kruskal-Wallis test differ, one row for each pair ``a < b`` of groups.

    ``z`` compares the mean ranks over all rows of the kept groups with the tie-corrected pooled variance; ``p_value`` is
    two-sided, ``p_bonferroni`` and ``p_holm`` are adjusted for the number of pairs (Holm steps down in the order of
    p-value, then names).  Groups below ``min_n`` rows drop out before ranking, as in ``kruskal``.  Where all values are
    equal the variance is 0 and every z and p is null.  Overlapping groups (a respondent in several) are compared as if
    apart, as the test before does.  The rows are ranked once for all pairs; pairs are as many as the groups allow.
    """
    gv = group_value_counts(long.select(F.col(group).alias("g"), F.col(value).alias("v")))
    sizes = gv.groupBy("g").agg(F.sum("cnt").alias("gn")).where(F.col("gn") >= min_n).select("g")
    per = rank_sums(gv.join(sizes, "g", "left_semi"), high_cardinality=high_cardinality).select(
        "g", "n", (F.col("rank_sum") / F.col("n")).alias("mean_rank"), "tie_part")
    # one row for each group from here on
    total = per.agg(F.sum("n").cast("double").alias("N"), F.sum("tie_part").alias("tie"))
    left = per.select(F.col("g").alias("a"), F.col("n").alias("n_a"), F.col("mean_rank").alias("mean_rank_a"))
    right = per.select(F.col("g").alias("b"), F.col("n").alias("n_b"), F.col("mean_rank").alias("mean_rank_b"))
    nn = F.col("N")
    variance = (nn * (nn + 1) / 12 - F.col("tie") / (12 * (nn - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    z = F.when(variance > 1e-12, (F.col("mean_rank_a") - F.col("mean_rank_b")) / F.sqrt(variance))
    pairs = left.join(F.broadcast(right), F.col("a") < F.col("b")).join(F.broadcast(total), F.lit(True)).withColumn("z", z)
    pairs = pairs.withColumn("p_value", F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), 2 * normal_sf(F.abs("z")))))
    everything = Window.partitionBy(F.lit(0))
    down = everything.orderBy(F.asc_nulls_last("p_value"), "a", "b")
    pairs = pairs.withColumn("m", F.count(F.lit(1)).over(everything)).withColumn("i", F.row_number().over(down))
    step = F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col("p_value"))
    holm = F.max(step).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = pairs.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("m") * F.col("p_value"))).withColumn("p_holm", holm)
    some = F.col("p_value").isNotNull()
    return out.select("a", "b", "n_a", "n_b", "mean_rank_a", "mean_rank_b", "z", "p_value",
                      F.when(some, F.col("p_bonferroni")).alias("p_bonferroni"), F.when(some, F.col("p_holm")).alias("p_holm"),
                      F.when(some, _decision(F.col("p_holm"))).alias("decision"))


def t_test_1samp_stats(df: DataFrame, c: str, mu: float = S.NEUTRAL_SCORE) -> DataFrame:
    """H4 statistic: ``(n, mean, sd, t, cohens_d)`` with the sample sd."""
    a = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
    t = F.try_divide(F.col("mean") - mu, F.col("sd") / F.sqrt(F.col("n")))
    return a.select("n", "mean", "sd", t.alias("t"), F.try_divide(F.col("mean") - mu, F.col("sd")).alias("cohens_d"))


def t_test_1samp(df: DataFrame, c: str, mu: float = S.NEUTRAL_SCORE, hypothesis: str = "",
                 description: str = "") -> DataFrame:
    """H4: one-tailed (greater) one-sample t-test: p = p_two/2 if t > 0 else 1."""
    st = t_test_1samp_stats(df, c, mu).where(F.col("n") > 1)
    p_one = F.when(F.col("t") > 0, t_survival(F.col("t"), F.col("n") - 1)).otherwise(F.lit(1.0))
    out = st.withColumn("p_value", p_one)
    return out.select(F.lit(hypothesis).alias("hypothesis"), F.lit(description).alias("description"),
                      F.lit("One-sample t-test (one-tailed)").alias("test"), F.col("t").alias("statistic"),
                      "p_value", F.col("cohens_d").alias("effect_size"), F.lit("cohens_d").alias("effect_name"),
                      _decision(F.col("p_value")).alias("decision"), "n")


def chi_square_stats(df: DataFrame, a: str, b: str, label_a: str | None = None, label_b: str | None = None) -> DataFrame:
    """H7 statistic for one pair; see ``chi_square_stats_many``."""
    return chi_square_stats_many(df, [(label_a or a, label_b or b, a, b)])


def chi_square_stats_many(df: DataFrame, pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """H7 statistics, one row per pair ``(var_a, var_b, chi2, dof, n, cramers_v)``; no row when
    either variable has fewer than 2 levels.

    All pairs share ONE scan and ONE grouped count: every row emits one ``(test, a, b)`` cell key
    per pair.  The rest runs on the small cell table: sum over all cells of (o-e)^2/e equals the
    sum over present cells plus (n - sum of present e), so no dense level grid is built; for 2x2
    tables (dof 1) the Yates correction uses |o - e| = D, equal in every cell, and
    sum 1/e = n (sum 1/R)(sum 1/C).
    """
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
                     for i, (_, _, a, b) in enumerate(pairs)])
    cells = (df.select(F.inline(keys)).where(F.col("a").isNotNull() & F.col("b").isNotNull())
             .groupBy("t", "a", "b").agg(F.count(F.lit(1)).alias("o")))
    w = Window.partitionBy("t")
    rows = (cells.groupBy("t", "a").agg(F.sum("o").alias("row_total"))
            .withColumn("n_rows", F.count(F.lit(1)).over(w))
            .withColumn("inv_r", F.sum(1.0 / F.col("row_total")).over(w)))
    cols = (cells.groupBy("t", "b").agg(F.sum("o").alias("col_total"))
            .withColumn("n_cols", F.count(F.lit(1)).over(w))
            .withColumn("inv_c", F.sum(1.0 / F.col("col_total")).over(w)))
    full = cells.join(rows, ["t", "a"]).join(cols, ["t", "b"]).withColumn("n", F.sum("o").over(w))
    e = F.col("row_total") * F.col("col_total") / F.col("n")
    agg = full.groupBy("t").agg(
        F.first("n").alias("n"), F.first("n_rows").alias("nr"), F.first("n_cols").alias("nc"),
        F.first("inv_r").alias("inv_r"), F.first("inv_c").alias("inv_c"),
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("sum_present"), F.sum(e).alias("sum_e"),
        F.max(F.abs(F.col("o") - e)).alias("d"))
    general = F.col("sum_present") + F.col("n") - F.col("sum_e")
    corr = F.col("d") - F.least(F.lit(0.5), F.col("d"))
    yates = corr * corr * F.col("n") * F.col("inv_r") * F.col("inv_c")
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    chi2 = F.when(dof == 1, yates).otherwise(general)
    v = F.sqrt(chi2 / (F.col("n") * (F.least(F.col("nr"), F.col("nc")) - 1)))
    la = F.element_at(F.array(*[F.lit(p[0]) for p in pairs]), F.col("t") + 1)
    lb = F.element_at(F.array(*[F.lit(p[1]) for p in pairs]), F.col("t") + 1)
    return agg.where((F.col("nr") >= 2) & (F.col("nc") >= 2)).select(
        la.alias("var_a"), lb.alias("var_b"), chi2.alias("chi2"),
        dof.cast("long").alias("dof"), F.col("n").cast("long").alias("n"), v.alias("cramers_v"))


DEFAULT_CHI_PAIRS = S.CHI_PAIRS


def chi_square(df: DataFrame, pairs: Sequence[tuple[str, str, str, str]] = DEFAULT_CHI_PAIRS) -> DataFrame:
    """H7: chi-square independence tests with p-value, significance and strength labels."""
    out = chi_square_stats_many(df, pairs)
    p = chi2_survival(F.col("chi2"), F.col("dof"))
    lo, hi = S.CRAMERS_V_CUTS[1], S.CRAMERS_V_CUTS[0]
    return (out.withColumn("p_value", p)
            .withColumn("significant", F.col("p_value") < S.ALPHA)
            .withColumn("strength", F.when(F.col("cramers_v") > hi, "Strong")
                        .when(F.col("cramers_v") > lo, "Moderate").otherwise("Weak")))


def strongest(chi: DataFrame) -> DataFrame:
    """H8: the significant test with the largest Cramer's V (ties by variable names)."""
    return chi.where(F.col("significant")).orderBy(F.desc("cramers_v"), "var_a", "var_b").limit(1)


def hypothesis_summary(results: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """H6: all test rows in one table, and the count of rows per decision."""
    cols = ["hypothesis", "description", "test", "statistic", "p_value", "effect_size", "effect_name", "decision"]
    table = None
    for r in results:
        r = r.select(*cols)
        table = r if table is None else table.unionByName(r, allowMissingColumns=True)
    counts = table.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return table, counts


def standard_tests(enc: DataFrame, platforms: Mapping[str, str] | None = None) -> list[DataFrame]:
    """The notebook's five tests H1-H5 on an encoded response table, whose measures are answer codes."""
    from panelspark.operators.aggregate import explode_members
    platforms = platforms or {f"platform_{p.lower()}": p for p in S.PLATFORMS_FILTER}
    h1 = mann_whitney(enc, F.col("follows_influencers") == "Yes", F.col("follows_influencers") == "No",
                      "purchase_ord", "H1", "purchases: people who follow influencers against the rest",
                      high_cardinality=False)
    h2 = kruskal(enc.select(F.col("age_group").alias("g"), F.col("purchase_ord").alias("v")),
                 hypothesis="H2", description="purchases by age band", high_cardinality=False)
    h3_long = explode_members(enc, platforms, keep=["ad_click_ord"]).select(
        F.col("member").alias("g"), F.col("ad_click_ord").alias("v"))
    h3 = kruskal(h3_long, hypothesis="H3", description="ad clicks by platform in use", high_cardinality=False)
    h4 = t_test_1samp(enc, "satisfaction_score", S.NEUTRAL_SCORE, "H4",
                      f"satisfaction above the scale's middle, {S.NEUTRAL_SCORE}")
    h5 = mann_whitney(enc, F.col("spending_ord") >= 3, F.col("spending_ord") <= 2, "engagement_ord", "H5",
                      "engagement: upper two spending bands against the lower two", high_cardinality=False)
    return [h1, h2, h3, h4, h5]
