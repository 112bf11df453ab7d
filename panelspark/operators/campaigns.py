"""Campaign return scoring (B1-B3), over a table of campaigns.

Benchmarks per influencer tier and multipliers per platform are fixed tables of 4 and 5 rows
(their size is known up front), so they are broadcast; everything else is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.literals import local_table


def benchmarks(spark: SparkSession) -> DataFrame:
    return local_table(spark, S.TIER_BENCHMARKS, "tier string, cpm double, ctr double, cvr double")


def multipliers(spark: SparkSession) -> DataFrame:
    return local_table(spark, S.PLATFORM_MULTIPLIERS,
                                 "platform string, reach_mult double, ctr_mult double, cpm_mult double")


def _with_rates(campaigns: DataFrame) -> DataFrame:
    spark = campaigns.sparkSession
    return (campaigns.join(F.broadcast(benchmarks(spark)), "tier")
            .join(F.broadcast(multipliers(spark)), "platform"))


def _score(budget: Column, commission: Column, retargeting: Column, dropoff: Column, aov: Column) -> dict[str, Column]:
    cpm_eff = F.col("cpm") * F.col("cpm_mult")
    content_budget = budget * commission
    ad_budget = budget * retargeting
    reach = content_budget / cpm_eff * 1000.0 * F.col("reach_mult")
    clicks = reach * F.col("ctr") * F.col("ctr_mult")
    conversions = clicks * F.col("cvr") * (1 - dropoff)
    retarg_reach = F.when(ad_budget > 0, ad_budget / (cpm_eff * S.RETARGETING_CPM_FACTOR) * 1000.0).otherwise(F.lit(0.0))
    retarg_conv = retarg_reach * F.col("ctr") * S.RETARGETING_CTR_FACTOR * F.col("cvr") * (1 - dropoff)
    total = conversions + retarg_conv
    revenue = total * aov
    return {
        "content_budget": content_budget,
        "ad_budget": ad_budget,
        "other_budget": budget * (1 - commission - retargeting),
        "reach": reach,
        "clicks": clicks,
        "conversions": conversions,
        "retargeting_conversions": retarg_conv,
        "total_conversions": total,
        "revenue": revenue,
        "roi_pct": F.when(budget > 0, (revenue - budget) / budget * 100.0).otherwise(F.lit(0.0)),
        "cpa": F.when(total > 0, budget / total).otherwise(F.lit(0.0)),
        "roas": F.when(budget > 0, revenue / budget).otherwise(F.lit(0.0)),
    }


def score_campaigns(campaigns: DataFrame) -> DataFrame:
    """B1: ``campaigns(name, tier, platform, budget, aov, commission, retargeting, dropoff,
    n_influencers)`` -> reach, clicks, conversions, revenue, ROI %, CPA, ROAS, budget parts,
    per-influencer reach and budget, break-even conversions."""
    c = _with_rates(campaigns)
    sc = _score(F.col("budget"), F.col("commission"), F.col("retargeting"), F.col("dropoff"), F.col("aov"))
    out = c.select("name", "tier", "platform", "budget", *[v.alias(k) for k, v in sc.items()],
                   "n_influencers", "aov")
    return out.select(
        "*",
        F.try_divide(F.col("reach"), F.col("n_influencers")).alias("reach_per_influencer"),
        F.try_divide(F.col("content_budget"), F.col("n_influencers")).alias("budget_per_influencer"),
        F.floor(F.try_divide(F.col("budget"), F.col("aov"))).cast("long").alias("break_even_conversions"),
    ).drop("aov")


def budget_sweep(campaigns: DataFrame, n: int = 60, low: float = 10000.0, floor_high: float = 500000.0) -> DataFrame:
    """B2: ROI % at ``n`` evenly spaced budgets from ``low`` to max(2 x budget, floor_high)."""
    c = _with_rates(campaigns)
    hi = F.greatest(F.col("budget") * 2, F.lit(floor_high))
    step = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step")
    swept = c.select("*", step)
    b = F.lit(low) + F.col("step") * (hi - F.lit(low)) / F.lit(float(n - 1))
    sc = _score(b, F.col("commission"), F.col("retargeting"), F.col("dropoff"), F.col("aov"))
    return swept.select("name", "step", b.alias("sweep_budget"), sc["roi_pct"].alias("roi_pct"))


def compare_scenarios(campaigns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The three preset strategies evaluated at each campaign's budget, AOV and drop-off,
    and the winner per campaign.  The winner key is content revenue only (no retargeting),
    as in the source dashboard; ties go to the earlier preset."""
    spark = campaigns.sparkSession
    presets = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(nm).alias("strategy"), F.lit(t).alias("s_tier"),
                                 F.lit(p).alias("s_platform"), F.lit(cm).alias("s_commission"),
                                 F.lit(rt).alias("s_retargeting"), F.lit(ni).alias("s_n_influencers"))
                        for i, (nm, t, p, cm, rt, ni) in enumerate(S.SCENARIOS)])
    exploded = campaigns.select("name", "budget", "aov", "dropoff", F.inline(presets))
    rated = (exploded.join(F.broadcast(benchmarks(spark)), exploded.s_tier == F.col("tier"))
             .join(F.broadcast(multipliers(spark)), exploded.s_platform == F.col("platform")))
    sc = _score(F.col("budget"), F.col("s_commission"), F.col("s_retargeting"), F.col("dropoff"), F.col("aov"))
    content_revenue = sc["conversions"] * F.col("aov")
    table = rated.select("name", "pos", "strategy", F.col("s_tier").alias("tier"), F.col("s_platform").alias("platform"),
                         F.col("s_n_influencers").alias("n_influencers"), sc["reach"].alias("reach"),
                         sc["total_conversions"].alias("total_conversions"), sc["revenue"].alias("revenue"),
                         sc["roi_pct"].alias("roi_pct"), sc["cpa"].alias("cpa"),
                         content_revenue.alias("content_revenue"))
    winner = table.groupBy("name").agg(
        F.max_by("strategy", F.struct(F.col("content_revenue"), -F.col("pos"))).alias("best_strategy"))
    return table, winner


def campaigns_from_orders(customers: DataFrame, orders: DataFrame, aov: float = 1500.0, commission: float = 0.6,
                          retargeting: float = 0.2, dropoff: float = 0.3) -> DataFrame:
    """A campaign per customer with orders: budget = rounded order total, tier and platform
    chosen by the customer key, fixed AOV and budget shares."""
    tiers = F.array(*[F.lit(t[0]) for t in S.TIER_BENCHMARKS])
    plats = F.array(*[F.lit(p[0]) for p in S.PLATFORM_MULTIPLIERS])
    # exact: sum whole cents as integers, then round half up to whole currency units
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    spend = orders.groupBy("o_custkey").agg(cents.alias("cents")).select(
        "o_custkey", F.expr("(cents + 50) div 100").alias("budget"))
    c = customers.join(spend, customers.c_custkey == spend.o_custkey)
    return c.select(
        F.col("c_name").alias("name"),
        F.element_at(tiers, (F.col("c_custkey") % len(S.TIER_BENCHMARKS)).cast("int") + 1).alias("tier"),
        F.element_at(plats, (F.col("c_custkey") % len(S.PLATFORM_MULTIPLIERS)).cast("int") + 1).alias("platform"),
        F.col("budget").cast("double").alias("budget"),
        F.lit(aov).alias("aov"), F.lit(commission).alias("commission"), F.lit(retargeting).alias("retargeting"),
        F.lit(dropoff).alias("dropoff"), (F.col("c_custkey") % 10 + 1).cast("int").alias("n_influencers"))
