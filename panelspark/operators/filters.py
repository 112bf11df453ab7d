"""Segment filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.literals import local_table


def segment_filter(df: DataFrame, selections: Mapping[str, Sequence]) -> DataFrame:
    """conjunction of ``col IN (values)``; an empty selection means no filter on that column.

    A null answer never passes a non-empty list.  Plain ``isin`` predicates reach the Parquet scan
    as pushed filters when the column comes straight from a file.
    """
    for c, values in selections.items():
        values = list(values or [])
        if values:
            df = df.filter(F.col(c).isin(values))
    return df


def any_flag(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == 1, F.lit(False)) for c in cols])


def any_flag_filter(df: DataFrame, flag_cols: Sequence[str]) -> DataFrame:
    """keep rows with at least one of the selected 0/1 flags set (OR); empty list = no filter.

    Flags missing from the table are ignored, as in the source dashboard.
    """
    present = [c for c in flag_cols if c in df.columns]
    if not flag_cols:
        return df
    if not present:
        return df.filter(F.lit(False))
    return df.filter(any_flag(present))


def platform_flag_names(platforms: Sequence[str]) -> list[str]:
    return ["platform_" + p.lower().replace(" ", "") for p in platforms]


def dashboard_filter(df: DataFrame, ages=(), genders=(), spending=(), trust=(), platforms=()) -> DataFrame:
    """The dashboard's sidebar filter: F1 on four demographics, then F2 on platforms."""
    out = segment_filter(df, {"age_group": ages, "gender": genders, "spending": spending, "trust_factor": trust})
    return any_flag_filter(out, platform_flag_names(platforms)) if platforms else out


def facet_values(df: DataFrame, c: str, order: Sequence[str] | None = None) -> DataFrame:
    """distinct non-null values of ``c``; with ``order`` only the listed values, in that order.

    Returns ``(c, pos)``; ``pos`` is the fixed-order position, or the sorted position.
    """
    vals = df.select(c).where(F.col(c).isNotNull()).distinct()
    if order is None:
        from pyspark.sql import Window
        return vals.withColumn("pos", F.row_number().over(Window.orderBy(c)).cast("int"))
    dom = local_table(df.sparkSession, [(v, i) for i, v in enumerate(order)], f"`{c}` string, pos int")
    return F.broadcast(dom).join(vals, c, "left_semi")


def min_count(agg_df: DataFrame, count_col: str, k: int) -> DataFrame:
    """sample-size guard on an aggregated table (``HAVING count >= k``)."""
    return agg_df.filter(F.col(count_col) >= k)
