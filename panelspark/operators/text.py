"""Term frequency over free or multi-select text (D1) -- the counts behind the word clouds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.literals import local_table

# FIXED VALUE: a token is a letter/digit/underscore followed by at least one more such character
# or apostrophe (two characters minimum); Unicode classes keep non-ASCII words whole.
TOKEN_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def raw_tokens(text: Column, separators: str | None = None) -> Column:
    """Array of lower-cased regex tokens of a text column (separators replaced by spaces first)."""
    t = F.lower(text)
    if separators:
        t = F.regexp_replace(t, separators, " ")
    return F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), 0)


def clean_token(tok: Column) -> Column:
    """A trailing possessive ``'s`` removed (per-token column expression, codegen-friendly)."""
    return F.when(tok.endswith("'s"), tok.substr(F.lit(1), F.length(tok) - 2)).otherwise(tok)


def is_term(tok: Column) -> Column:
    """Keep tokens that are not made only of digits."""
    return (F.length(tok) > 0) & (F.translate(tok, "0123456789", "") != "")


def words(df: DataFrame, col: str, separators: str | None = None) -> DataFrame:
    """``(term)`` rows: every token of every (whole) text, cleaned."""
    exploded = df.where(F.col(col).isNotNull()).select(F.explode(raw_tokens(F.col(col), separators)).alias("__tok"))
    cleaned = exploded.select(clean_token(F.col("__tok")).alias("term"))
    return cleaned.where(is_term(F.col("term")))


def term_frequency(df: DataFrame, col: str, top: int | None = 80, stopwords: Sequence[str] = S.STOPWORDS,
                   separators: str | None = None) -> DataFrame:
    """``(term, n)``, the ``top`` most frequent terms (ties by term).  Whole texts are
    tokenised on the executors; the stop list is a fixed small table, broadcast for the anti-join;
    counting is a partial + final hash aggregate."""
    stop = local_table(df.sparkSession, [(w,) for w in sorted(set(stopwords))], "term string")
    counts = (words(df, col, separators).join(F.broadcast(stop), "term", "left_anti")
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    if top is None:
        return counts
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(top)
