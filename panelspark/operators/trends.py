"""Time trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.ranks import running_sums


def daily_trend(df: DataFrame, ts: str, measures: dict[str, str], count_name: str = "responses") -> DataFrame:
    """Per calendar day of ``ts``: row count and the mean of each measure (``{out: col}``)."""
    base = df.where(F.col(ts).isNotNull())
    return base.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias(count_name), *[F.avg(c).alias(o) for o, c in measures.items()])


def hourly_counts(df: DataFrame, ts: str) -> DataFrame:
    """``(hour, n)`` for rows with a timestamp."""
    return (df.where(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour"))
            .agg(F.count(F.lit(1)).alias("n")))


def rolling_mean(df: DataFrame, ts: str, value: str, window: int = 20, min_periods: int = 5,
                 by: Sequence[str] = (), order_tiebreak: str = "id", out: str = "rolling",
                 chunk_rows: int = 65_536) -> DataFrame:
    """Mean of ``value`` over the last ``window`` rows in ``ts`` order (null until
    ``min_periods`` rows), per ``by`` group; rows with a null ts or value are dropped first, a null key is a group.

    Scales without one task per group: rows get their position in the group from ``running_sums``, the group is cut
    into chunks of ``chunk_rows`` positions, the last ``window - 1`` rows of a chunk also travel to the next one, and
    the window runs inside (group, chunk).  One user with a third of all rows is therefore split across tasks.
    """
    if window > chunk_rows:
        raise ValueError("chunk_rows must be at least window")
    by = list(by)
    base = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withColumn("__one", F.lit(1).cast("long"))
    placed = running_sums(base, [ts, order_tiebreak], {"__pos": "__one"}, by)
    chunk = F.floor(F.col("__pos") / chunk_rows)
    spilled = F.pmod(F.col("__pos"), F.lit(chunk_rows)) > chunk_rows - window
    dealt = placed.withColumn("__chunk", F.explode(F.when(spilled, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    frame = Window.partitionBy(*by, "__chunk").orderBy("__pos").rowsBetween(1 - window, 0)
    mean = F.when(F.count(value).over(frame) >= min_periods, F.avg(value).over(frame)).cast("double")
    return dealt.withColumn(out, mean).where(F.col("__chunk") == chunk).select(*df.columns, out)
