"""Association rules towards a fixed consequent.

Every row contributes one record per antecedent it satisfies -- each single item and each
unordered pair of its active items (bounded by the item list, a parameter) -- and ONE grouped
count over ``antecedent`` yields ``n(A)`` and ``n(A and C)`` for all rules at once: a single
shuffle, with map-side partial aggregation, instead of one column scan per rule.  A sentinel
antecedent counted for every row carries ``n`` and ``n(C)`` through the same aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.encode import flag

_ALL = "\u0000all"


def notebook_items() -> dict[str, Column]:
    """R1, notebook variant: 16 items."""
    c = F.col
    return {
        "High_Engagement": flag(c("engagement_ord") >= 2),
        "Low_Engagement": flag(c("engagement_ord") == 1),
        "Trust_ContentQuality": flag(c("trust_factor") == "Content quality"),
        "Trust_Transparency": flag(c("trust_factor") == "Transparency in reviews"),
        "Trust_Authenticity": flag(c("trust_factor") == "Authenticity"),
        "Made_Purchase": flag(c("purchase_ord") > 0),
        "High_Purchase": flag(c("purchase_ord") >= 2),
        "High_AdClick": flag(c("ad_click_ord") >= 2),
        "Low_AdClick": flag(c("ad_click_ord") <= 1),
        "Motiv_PosReviews": F.coalesce(c("motiv_positive_reviews"), F.lit(0)),
        "Motiv_Coupon": F.coalesce(c("motiv_discount__coupon_code"), F.lit(0)),
        "Motiv_Trust": F.coalesce(c("motiv_trust_in_influencer"), F.lit(0)),
        "Uses_Instagram": F.coalesce(c("platform_instagram"), F.lit(0)),
        "Uses_YouTube": F.coalesce(c("platform_youtube"), F.lit(0)),
        "High_Interest": flag(c("product_interest_score") >= 4),
        "High_Satisfaction": flag(c("satisfaction_score") >= 4),
    }


def dashboard_items() -> dict[str, Column]:
    """R1, dashboard variant: 15 items (null inputs read as 0)."""
    c = F.col
    return {
        "High_Engagement": flag(c("engagement_ord") >= 2),
        "ContentQuality_Trust": flag(c("trust_factor") == "Content quality"),
        "Transparency_Trust": flag(c("trust_factor") == "Transparency in reviews"),
        "Authenticity_Trust": flag(c("trust_factor") == "Authenticity"),
        "High_Interest": flag(c("product_interest_score") >= 4),
        "High_Satisfaction": flag(c("satisfaction_score") >= 4),
        "Made_Purchase": flag(c("purchase_ord") > 0),
        "High_Purchase": flag(c("purchase_ord") >= 2),
        "High_AdClick": flag(c("ad_click_ord") >= 2),
        "Motiv_Reviews": F.coalesce(c("motiv_positive_reviews"), F.lit(0)),
        "Motiv_Coupon": F.coalesce(c("motiv_coupon"), F.lit(0)),
        "Uses_Instagram": F.coalesce(c("platform_instagram"), F.lit(0)),
        "Uses_YouTube": F.coalesce(c("platform_youtube"), F.lit(0)),
        "High_TimeSpent": flag(c("daily_time_ord") >= 3),
        "High_Retargeting": flag(c("retargeting_score") >= 4),
    }


def report_items() -> dict[str, Column]:
    """R1, report variant: 6 items."""
    d = dashboard_items()
    return {k: d[k] for k in ["High_Engagement", "ContentQuality_Trust", "High_Interest", "High_Satisfaction",
                              "Made_Purchase", "High_TimeSpent"]}


def transaction_items(df: DataFrame, items: Mapping[str, Column], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Wide 0/1 item columns (one projection)."""
    return df.select(*keep, *[e.alias(n) for n, e in items.items()])


def _ordered_pairs(active: Column) -> Column:
    n = F.size(active)
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.transform(F.filter(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: j <= n),
                              lambda j: F.concat(F.element_at(active, i), F.lit(" + "), F.element_at(active, j)))))


def association_rules(items_df: DataFrame, antecedents: Sequence[str], consequent: str,
                      min_support: float = 0.1, min_confidence: float = 0.5, max_len: int = 2,
                      exclude: Sequence[str] = ()) -> DataFrame:
    """Rules ``antecedent -> consequent`` with support, confidence and lift.

    Antecedents are single items and (``max_len=2``) unordered pairs named ``"a + b"`` in list
    order.  Thresholds apply to unrounded values (kept when support >= min_support and confidence
    >= min_confidence); outputs are rounded to 3 places, half to even.

    Rows are first collapsed to their item set (in practice a few hundred distinct ones):
    ``groupBy(items)`` with map-side partial aggregation turns any number of rows -- and any hot
    item set -- into one weighted row per set.  Singles and pairs are then expanded from that
    small table only.
    """
    banned = set(exclude) | {consequent}
    ants = [a for a in antecedents if a not in banned]
    held = F.array_compact(F.array(*[F.when(F.col(a) == 1, F.lit(a)) for a in ants]).cast("array<string>"))
    cons = F.coalesce(F.col(consequent), F.lit(0)).cast("long")
    sets = items_df.select(held.alias("items"), cons.alias("c")).groupBy("items").agg(
        F.count(F.lit(1)).alias("w"), F.sum("c").alias("wc"))
    active = F.col("items")
    all_names = F.concat(F.array(F.lit(_ALL)), active)
    if max_len >= 2:
        all_names = F.concat(all_names, _ordered_pairs(active))
    long = sets.select(F.explode(all_names).alias("antecedent"), "w", "wc")
    g = long.groupBy("antecedent").agg(F.sum("w").alias("n_a"), F.sum("wc").alias("n_ac"))
    w = Window.partitionBy()  # over the aggregated rule rows only
    g = (g.withColumn("n", F.max(F.when(F.col("antecedent") == _ALL, F.col("n_a"))).over(w))
         .withColumn("n_c", F.max(F.when(F.col("antecedent") == _ALL, F.col("n_ac"))).over(w))
         .where(F.col("antecedent") != _ALL))
    sup = F.col("n_ac") / F.col("n")
    conf = F.col("n_ac") / F.col("n_a")
    cons_rate = F.col("n_c") / F.col("n")
    lift = F.when(cons_rate > 0, conf / cons_rate).otherwise(F.lit(0.0))
    kept = g.where((sup >= min_support) & (F.col("n_a") > 0) & (conf >= min_confidence))
    return kept.select(
        "antecedent", F.lit(consequent).alias("consequent"),
        _round3(sup).alias("support"), _round3(conf).alias("confidence"), _round3(lift).alias("lift"),
        (F.size(F.split("antecedent", " \\+ "))).alias("length"))


def _round3(c: Column) -> Column:
    """Half-to-even rounding at 3 places of the binary product x * 1000 (as NumPy rounds)."""
    return F.bround(c * F.lit(1000.0), 0) / F.lit(1000.0)


def top_rules(rules: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` rules with the highest lift (ties by antecedent name)."""
    return rules.orderBy(F.desc("lift"), F.asc("antecedent")).limit(k)


def rules_summary(rules: DataFrame) -> DataFrame:
    """Rule count, best lift, best confidence and the antecedent of the best-lift rule."""
    return rules.agg(F.count(F.lit(1)).alias("n_rules"), F.max("lift").alias("best_lift"),
                     F.max("confidence").alias("best_confidence"),
                     F.min_by("antecedent", F.struct(-F.col("lift"), F.col("antecedent"))).alias("best_rule"))
