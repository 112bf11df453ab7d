"""Distinct weighted points: rows that agree in every feature become one point that carries their number.

Answer codes collapse to at most the product of their levels, however many rows there are, so fits that read their data
many times (k-means, silhouette) read the points instead.  Continuous features do not collapse; the same code then works
on as many points as rows, spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import checkpoint_dir


#: Points that a task should at least have before they are spread over more tasks.
POINTS_OF_A_TASK = 2048


def weighted_points(df: DataFrame, cols: Sequence[str], key: str = "id") -> tuple[DataFrame, dict]:
    """``(pid, w, x)`` of each distinct complete row of ``cols`` and the (mean, sd) of the columns.

    ``pid`` is the smallest key of the point's rows, ``w`` their number, ``x`` the standardized features (population sd;
    0 counts as 1).  Rows with a null feature or key are left out.  The points are checkpointed in the shared folder.
    """
    checkpoint_dir(df.sparkSession)
    raw = F.array(*[F.col(c).cast("double") for c in cols])
    base = df.select(F.col(key).alias("pid"), raw.alias("x")).where(F.col("pid").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    grouped = base.groupBy("x").agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("w")).checkpoint(eager=True)
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + grouped.count() // POINTS_OF_A_TASK)
    if parts > grouped.rdd.getNumPartitions():
        grouped = grouped.repartition(parts).checkpoint(eager=True)
    stats = weighted_stats(grouped, cols)
    z = [(F.col("x")[j] - F.lit(stats[c][0])) / F.lit(stats[c][1] if stats[c][1] > 0 else 1.0) for j, c in enumerate(cols)]
    # a fit reads its points in every round: they are scaled once
    return grouped.select("pid", "w", F.array(*z).alias("x")).checkpoint(eager=True), stats


def weighted_stats(points: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population sd of each feature, counting every point as often as its weight (0 and 0 of no points)."""
    n = F.sum("w").cast("double")
    means = points.agg(*[(F.sum(F.col("w") * F.col("x")[j]) / n).alias(f"m{j}") for j in range(len(cols))]).first()
    if means[0] is None:
        return {c: (0.0, 0.0) for c in cols}
    off = [F.col("x")[j] - F.lit(means[j]) for j in range(len(cols))]
    spread = points.agg(*[F.sqrt(F.sum(F.col("w") * o * o) / n).alias(f"s{j}") for j, o in enumerate(off)]).first()
    return {c: (means[j], spread[j]) for j, c in enumerate(cols)}


def squared_distance(cols: Sequence[Column], centre: Sequence[float]) -> Column:
    """Squared Euclidean distance of a row to a fixed centre, as one expression."""
    total = None
    for c, v in zip(cols, centre):
        part = (c - F.lit(float(v))) * (c - F.lit(float(v)))
        total = part if total is None else total + part
    return total
