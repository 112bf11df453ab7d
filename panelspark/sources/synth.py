"""S3: synthetic survey responses generated on the executors.

``spark.range(n)`` supplies the ids; every answer is a deterministic function of (seed, id,
column) through ``xxhash64``, so any row can be regenerated independently on any executor and
the generator scales to billions of rows without a driver-side loop.  Weighted single choices use
a cumulative-weight ``CASE``; multi-select answers order the option list by a per-row hash and
keep a hash-chosen number of items (no repeats).  Values follow the reference's weights but are
not bit-equal to a NumPy generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import schema as S

# FIXED VALUES: answer weights of the synthetic survey (domain order).
WEIGHTS = {
    "age_group": (S.AGE_GROUPS, [1 / 8, 4 / 8, 1 / 8, 1 / 8, 1 / 8]),
    "gender": (["Male", "Female"], [2 / 3, 1 / 3]),
    "spending": (S.SPENDING_LEVELS, [0.25, 0.47, 0.17, 0.11]),
    "daily_time": (S.DAILY_TIME_LEVELS, [0.32, 0.40, 0.18, 0.10]),
    "follows_influencers": (["Yes", "No"], [0.95, 0.05]),
    "trust_factor": (S.TRUST_FACTORS, [0.376, 0.276, 0.2, 0.1, 0.029, 0.019]),
    "engagement_freq": (S.ENGAGEMENT_LEVELS, [0.476, 0.433, 0.081, 0.01]),
    "product_interest_score": ([1, 2, 3, 4, 5], [0.105, 0.129, 0.419, 0.29, 0.057]),
    "searched_product": (["Yes", "No"], [0.93, 0.07]),
    "purchase_freq": (S.PURCHASE_LEVELS, [0.243, 0.543, 0.105, 0.062, 0.047]),
    "satisfaction_score": ([1, 2, 3, 4, 5], [0.057, 0.09, 0.419, 0.372, 0.062]),
    "ad_click_freq": (S.AD_CLICK_LEVELS, [0.286, 0.505, 0.195, 0.014]),
    "ad_influenced": (["Yes", "No", "Not sure"], [0.7, 0.1, 0.2]),
    "retargeting_score": ([1, 2, 3, 4, 5], [0.281, 0.281, 0.29, 0.105, 0.043]),
    "preferred_ad_format": (S.AD_FORMATS, [0.624, 0.152, 0.133, 0.062, 0.029]),
}
MULTI = {
    "platforms": (S.PLATFORMS_FILTER, 1, 3),
    "content_type": (S.CONTENT_TYPES, 1, 4),
    "purchase_motivation": (S.MOTIVATIONS, 1, 3),
}


def _uniform(seed: int, salt: str) -> Column:
    """Uniform [0, 1) from a 64-bit hash of (seed, salt, id)."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), F.col("id"))
    return (F.pmod(h, F.lit(1 << 30)).cast("double")) / float(1 << 30)


def _weighted(values, weights, u: Column) -> Column:
    total = float(sum(weights))
    acc = 0.0
    expr = None
    for v, w in zip(values[:-1], weights[:-1]):
        acc += w / total
        expr = F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def _multi(seed: int, name: str, options, lo: int, hi: int) -> Column:
    opts = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(name), F.col("id"), F.lit(o)).alias("k"),
                              F.lit(o).alias("v")) for o in options])
    size = (F.floor(_uniform(seed, name + "#n") * (hi - lo + 1)) + lo).cast("int")
    picked = F.slice(F.array_sort(opts), 1, size)
    return F.array_join(F.transform(picked, lambda s: s["v"]), ";")


def synthesize_responses(spark: SparkSession, n: int, seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    """``n`` synthetic responses with ids 1..n (raw string answers, like the survey export)."""
    base = spark.range(1, n + 1, numPartitions=num_partitions)
    cols = {name: _weighted(vals, ws, _uniform(seed, name)) for name, (vals, ws) in WEIGHTS.items()}
    cols.update({name: _multi(seed, name, opts, lo, hi) for name, (opts, lo, hi) in MULTI.items()})
    return base.withColumns(cols)
