"""Descriptive aggregations.

Every operator is one (or a few) grouped aggregates over the response table, so Spark runs
partial aggregation before the shuffle: a category holding a third of all rows costs one
pre-aggregated row per map task, not a hot reducer.  Fixed answer domains are tiny literal
tables and are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.literals import local_table


def domain_table(spark, c: str, values: Sequence, pos: str = "pos") -> DataFrame:
    """Fixed answer domain as a small ``(c, pos)`` table (size bounded by the literal list)."""
    return local_table(spark, [(v, i) for i, v in enumerate(values)], f"`{c}` string, `{pos}` int")


def _pct(c: Column) -> Column:
    return c * F.lit(100.0)


def kpi_summary(df: DataFrame) -> DataFrame:
    """A1: respondents, purchase rate %, mean interest, mean satisfaction, ad-responsive %,
    mean engagement, Reels-preferred %.  Means are 0 on an empty table (guarded)."""
    z = F.lit(0.0)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(_pct(F.avg("made_purchase")), z).alias("purchase_rate"),
        F.coalesce(F.avg("product_interest_score"), z).alias("avg_interest"),
        F.coalesce(F.avg("satisfaction_score"), z).alias("avg_satisfaction"),
        F.coalesce(_pct(F.avg("high_ad_responsive")), z).alias("ad_responsive_rate"),
        F.coalesce(F.avg("engagement_ord"), z).alias("avg_engagement"),
        F.coalesce(_pct(F.avg(F.coalesce(F.trim("preferred_ad_format") == "Reels", F.lit(False)).cast("int"))), z)
        .alias("reels_pct"),
    )


def value_counts(df: DataFrame, c: str, trim: bool = False) -> DataFrame:
    """A2: ``(c, n)`` for non-null values."""
    v = F.trim(F.col(c)) if trim else F.col(c)
    return df.select(v.alias(c)).where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def value_share(df: DataFrame, c: str, trim: bool = False) -> DataFrame:
    """A3: ``(c, n, share_pct)``, share of the non-null answers.  The window runs on the
    aggregated (one row per level) table only."""
    counts = value_counts(df, c, trim)
    return counts.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def domain_counts(df: DataFrame, c: str, domain: Sequence[str], fill: int | None = 0) -> DataFrame:
    """A4: counts re-indexed to a fixed domain; absent level -> ``fill`` (0 dashboard, null notebook)."""
    dom = F.broadcast(domain_table(df.sparkSession, c, domain))
    counts = value_counts(df, c)
    out = dom.join(counts, c, "left")
    if fill is not None:
        out = out.withColumn("n", F.coalesce(F.col("n"), F.lit(fill).cast("long")))
    return out.select(c, "pos", "n")


def flag_totals(df: DataFrame, flag_cols: Sequence[str]) -> DataFrame:
    """A5: ``(flag, total)`` -- one aggregate over all flag columns, then unpivot."""
    wide = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in flag_cols])
    return wide.unpivot([], list(flag_cols), "flag", "total")


def group_mean(df: DataFrame, by: str, measure: str, scale: float = 1.0) -> DataFrame:
    """``(by, n, mean)`` for non-null groups; mean skips null measures."""
    return (df.where(F.col(by).isNotNull()).groupBy(by)
            .agg(F.count(F.lit(1)).alias("n"), (F.avg(measure) * F.lit(scale)).alias("mean")))


def group_rates(df: DataFrame, by: str, flags: Sequence[str], domain: Sequence[str]) -> DataFrame:
    """Rate (%) of each 0/1 flag per level, re-indexed to the domain (absent level -> null)."""
    g = (df.where(F.col(by).isNotNull()).groupBy(by)
         .agg(F.count(F.lit(1)).alias("n"), *[_pct(F.avg(f)).alias(f"{f}_rate") for f in flags]))
    dom = F.broadcast(domain_table(df.sparkSession, by, domain))
    return dom.join(g, by, "left")


def members(flag_to_label: Mapping[str, str]) -> Column:
    """Array of member labels whose 0/1 flag is set (a row can be in several groups)."""
    arr = F.array(*[F.when(F.col(f) == 1, F.lit(lab)) for f, lab in flag_to_label.items()])
    return F.filter(arr, lambda x: x.isNotNull())


def explode_members(df: DataFrame, flag_to_label: Mapping[str, str], out: str = "member",
                    keep: Sequence[str] | None = None) -> DataFrame:
    """Long ``(member, ...)`` rows for overlapping flag groups."""
    keep = list(keep) if keep is not None else [c for c in df.columns]
    return df.select(*keep, F.explode(members(flag_to_label)).alias(out))


def rate_by_member(df: DataFrame, flag_to_label: Mapping[str, str], measure: str, min_n: int = 10,
                   scale: float = 100.0) -> DataFrame:
    """Mean of ``measure`` (x scale) per overlapping group; groups with n <= min_n dropped."""
    long = explode_members(df, flag_to_label, keep=[measure])
    return (long.groupBy("member").agg(F.count(F.lit(1)).alias("n"), (F.avg(measure) * F.lit(scale)).alias("rate"))
            .filter(F.col("n") > min_n))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]], base: Column | None = None) -> DataFrame:
    """``(stage_no, stage, n, pct_of_base)`` -- one aggregate of conditional sums, unpivoted."""
    base_n = F.count(F.lit(1)) if base is None else F.sum(F.coalesce(base, F.lit(False)).cast("int"))
    aggs = [base_n.cast("long").alias("__base")]
    for i, (_, cond) in enumerate(stages):
        aggs.append(F.sum(F.coalesce(cond, F.lit(False)).cast("int")).cast("long").alias(f"s{i}"))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"),
                              F.coalesce(F.col(f"s{i}"), F.lit(0).cast("long")).alias("n"))
                     for i, (name, _) in enumerate(stages)])
    long = wide.select("__base", F.inline(rows))
    return long.select("stage_no", "stage", "n",
                       F.try_divide(F.col("n") * 100.0, F.col("__base")).alias("pct_of_base"))


def notebook_funnel_stages() -> list[tuple[str, Column]]:
    return [
        ("Follow Influencers", F.col("follows_influencers") == "Yes"),
        ("Searched Product", F.col("searched_binary") == 1),
        ("Made Purchase", F.col("made_purchase") == 1),
        ("High Frequency (3+x)", F.col("purchase_ord") >= 3),
    ]


def dashboard_funnel_stages() -> list[tuple[str, Column]]:
    return [("All Respondents", F.lit(True))] + notebook_funnel_stages()[1:]


def kpi_normalized(df: DataFrame, maxima: Mapping[str, float]) -> DataFrame:
    """A10: ``(kpi, mean, max_value, pct_of_max)`` for each measure."""
    wide = df.agg(*[F.avg(c).alias(c) for c in maxima])
    rows = F.array(*[F.struct(F.lit(c).alias("kpi"), F.col(c).cast("double").alias("mean"),
                              F.lit(float(m)).alias("max_value")) for c, m in maxima.items()])
    return wide.select(F.inline(rows)).withColumn("pct_of_max", F.col("mean") / F.col("max_value") * 100.0)


NOTEBOOK_KPI_MAXIMA = {
    "product_interest_score": 5.0, "purchase_ord": 4.0, "satisfaction_score": 5.0,
    "ad_click_ord": 3.0, "retargeting_score": 5.0,
}


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_missing, pct_missing)`` for columns with at least one null."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.sum(F.col(c).isNull().cast("int")).cast("long").alias(f"m{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(cols)])
    long = wide.select("__n", F.inline(rows))
    return (long.where(F.col("n_missing") > 0)
            .select("column", "n_missing", (F.col("n_missing") * 100.0 / F.col("__n")).alias("pct_missing")))


def describe_numeric(df: DataFrame, cols: Sequence[str], high_cardinality: bool = True) -> DataFrame:
    """Pandas-style ``describe``: count, mean, sample sd, min, linear-interpolated quartiles, max.

    Moments and extremes come from one constant-memory aggregate; the quartiles of all columns are exact order
    statistics read off one distributed rank table, so memory never grows with the number of distinct values.
    ``high_cardinality=False`` says that every column holds a few values only (answer codes).
    """
    from panelspark.operators.ranks import quantiles_exact
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    quartiles = quantiles_exact(df, cols, [0.25, 0.5, 0.75], high_cardinality)
    out = [(c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"], *quartiles[c], row[f"hi{i}"])
           for i, c in enumerate(cols)]
    return local_table(df.sparkSession, out, "column string, count long, mean double, std double, min double, "
                                              "p25 double, p50 double, p75 double, max double")


def distribution(df: DataFrame, c: str, bins: int = 5, lo: float | None = None, hi: float | None = None,
                 high_cardinality: bool = True) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed) with the column's mean,
    median and population skewness on every row: ``(bin, lower, upper, n, mean, median, skewness)``.

    One global aggregate gives the bin edges (a single row read back to the driver); rows are then
    bucketed by arithmetic and counted -- no sort, partial aggregation before the shuffle.
    """
    from panelspark.operators.ranks import quantiles_exact
    base = df.select(F.col(c).cast("double").alias("v")).where(F.col("v").isNotNull())
    st = base.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"),
                  F.skewness("v").alias("skewness")).first().asDict()
    st["median"] = quantiles_exact(base, ["v"], [0.5], high_cardinality)["v"][0]
    lo = st["lo"] if lo is None else float(lo)
    hi = st["hi"] if hi is None else float(hi)
    spark = df.sparkSession
    schema = "bin int, lower double, upper double, n long, mean double, median double, skewness double"
    if lo is None:
        return local_table(spark, [], schema)
    width = (hi - lo) / bins
    if width == 0:
        b = F.lit(0)
    else:
        b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    hist = base.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(hist, "bin", "left")
    return out.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"),
        F.lit(st["mean"]).cast("double").alias("mean"),
        F.lit(st["median"]).cast("double").alias("median"),
        F.lit(st["skewness"]).cast("double").alias("skewness"))


def top_category(df: DataFrame, c: str) -> DataFrame:
    """Most frequent value and its share (%); ties broken by the value itself."""
    shares = value_share(df, c)
    return shares.orderBy(F.desc("n"), F.asc(c)).limit(1)


def top_flag(df: DataFrame, flag_to_label: Mapping[str, str]) -> DataFrame:
    """A14 (platform form): label of the flag with the largest total; ties -> first listed."""
    order = {f: i for i, f in enumerate(flag_to_label)}
    tot = flag_totals(df, list(flag_to_label))
    lab = F.create_map(*[F.lit(x) for kv in flag_to_label.items() for x in kv])
    pos = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return (tot.select(lab[F.col("flag")].alias("label"), "total", pos[F.col("flag")].alias("pos"))
            .orderBy(F.desc("total"), F.asc("pos")).limit(1).drop("pos"))


def cohort_summary(df: DataFrame, by: str = "spending", domain: Sequence[str] = S.SPENDING_LEVELS,
                   min_cohorts: int = 2, min_rows: int = 20) -> DataFrame:
    """Per-cohort count, mean engagement, purchase %, mean satisfaction, ad-click %, mean interest.

    One grouped aggregate (the source loops once per cohort); only levels of the fixed domain are
    reported, in domain order.  The guards (>= ``min_cohorts`` present levels and >= ``min_rows``
    rows in total) are window sums over the few cohort rows, so failing them yields no rows.
    """
    dom = F.broadcast(domain_table(df.sparkSession, by, domain, "cohort_pos"))
    g = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("engagement_ord").alias("avg_engagement"),
        _pct(F.avg("made_purchase")).alias("purchase_rate"),
        F.avg("satisfaction_score").alias("avg_satisfaction"),
        _pct(F.avg("high_ad_responsive")).alias("ad_click_rate"),
        F.avg("product_interest_score").alias("avg_interest"),
    )
    present = dom.join(g, by, "inner")
    w = Window.partitionBy()
    guarded = (present.withColumn("__levels", F.count(F.lit(1)).over(w))
               .withColumn("__total", F.sum("n").over(w))
               .filter((F.col("__levels") >= min_cohorts) & (F.col("__total") >= min_rows)))
    return guarded.drop("__levels", "__total").withColumnRenamed(by, "cohort")


def findings(df: DataFrame, trust_col: str = "trust_factor", format_col: str = "preferred_ad_format",
             motiv_flags: Mapping[str, str] | None = None) -> DataFrame:
    """The live shares quoted by the recommendations, as ``(finding, label, value)`` rows:
    top trust driver and its share, Reels-preferred %, share per motivation, and the share that
    is *not* ad-responsive."""
    motiv_flags = motiv_flags or S.MOTIVATION_FLAGS_DASHBOARD
    top_trust = top_category(df, trust_col).select(
        F.lit("top_trust_factor").alias("finding"), F.col(trust_col).alias("label"), F.col("share_pct").alias("value"))
    kpi = kpi_summary(df)
    wide = df.agg(*[_pct(F.avg(f)).alias(f) for f in motiv_flags])
    motiv_rows = F.array(*[F.struct(F.lit("motivation_pct").alias("finding"), F.lit(lab).alias("label"),
                                    F.col(f).alias("value")) for f, lab in motiv_flags.items()])
    motiv = wide.select(F.inline(motiv_rows))
    other = kpi.select(F.inline(F.array(
        F.struct(F.lit("reels_pct").alias("finding"), F.lit("Reels").alias("label"), F.col("reels_pct").alias("value")),
        F.struct(F.lit("not_ad_responsive_pct").alias("finding"), F.lit("").alias("label"),
                 (F.lit(100.0) - F.col("ad_responsive_rate")).alias("value")),
    )))
    return top_trust.unionByName(motiv).unionByName(other)
