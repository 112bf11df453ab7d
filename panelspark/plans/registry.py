"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus its SQL cross-check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
ROUND_DIGITS = 6


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` (DuckDB) is omitted for non-SQL-expressible operators."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_to(c, digits: int = ROUND_DIGITS):
    """round(x * 10^d) / 10^d: the scaled product is formed in binary first, so every engine that
    rounds the same double half away from zero gets the same result (no decimal-string ties)."""
    scale = float(10 ** digits)
    return F.round(c.cast("double") * F.lit(scale)) / F.lit(scale)


def rounded(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    """Round every floating column (compare-friendly output; operators keep full precision)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_to(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
