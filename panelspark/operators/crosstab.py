"""Cross-tabulations.

The long ``(a, b, n)`` form is the primary result: one grouped count, which scales with the
number of level pairs, not rows.  Wide (pivoted) output takes the column levels as an argument,
so Spark never has to collect the distinct levels first (``DataFrame.crosstab`` would).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.encode import split_multi, split_multi_distinct
from panelspark.functions.literals import local_table


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, n)`` over rows where both are non-null; absent pairs are simply absent."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))


def crosstab_wide(df: DataFrame, a: str, b: str, b_levels: Sequence) -> DataFrame:
    """X1 wide form: one row per level of ``a``, one column per given level of ``b``, 0-filled."""
    wide = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a).pivot(b, list(b_levels)).agg(F.count(F.lit(1))))
    return wide.fillna(0, subset=[str(v) for v in b_levels])


def crosstab_pct(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row percentages ``(a, b, n, row_pct)``; the window runs on the aggregated cells."""
    cells = crosstab(df, a, b)
    return cells.withColumn("row_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(a)))


def crosstab_multi(df: DataFrame, a: str, multi: str, item: str = "item", distinct: bool = False) -> DataFrame:
    """``(a, item, n)`` with the multi-select column exploded (a row counts once per item)."""
    arr = split_multi_distinct(multi) if distinct else split_multi(multi)
    long = df.where(F.col(a).isNotNull()).select(a, F.explode(arr).alias(item))
    return long.groupBy(a, item).agg(F.count(F.lit(1)).alias("n"))


def dense_grid(cells: DataFrame, a: str, b: str, a_levels: Sequence[str], b_levels: Sequence[str],
               value: str = "n") -> DataFrame:
    """Every (a, b) pair of the two fixed level lists, 0 where no cell exists.

    The grid is built from the two literal lists (size = len(a) * len(b), known up front) and
    broadcast; the data side is only left-joined to it.
    """
    spark = cells.sparkSession
    grid = local_table(spark, [(x, y) for x in a_levels for y in b_levels], f"`{a}` string, `{b}` string")
    out = F.broadcast(grid).join(cells.select(a, b, value), [a, b], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(0).cast(cells.schema[value].dataType)))
