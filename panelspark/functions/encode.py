"""Column-level encoders (ordinal maps, flags, multi-select parsing, clipping, labels).

All helpers return JVM-side ``Column`` expressions, so they stay inside whole-stage codegen.
Pandas semantics that differ from SQL are made explicit here: a comparison on a null answer is
*false* (flag 0), not null.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import schema as S


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_lookup(mapping: Mapping, c: str | Column) -> Column:
    """``mapping[c]`` as a map-literal lookup; unmapped or null -> null."""
    if not mapping:
        return F.lit(None)
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[_col(c)]


def ordinal(c: str | Column, mapping: Mapping[str, int | float], default=None) -> Column:
    """Ordinal code of a label; unmapped -> ``default`` (null when not given)."""
    code = map_lookup(mapping, c)
    return code if default is None else F.coalesce(code, F.lit(default))


def flag(cond: Column) -> Column:
    """0/1 integer flag; a null comparison counts as 0 (pandas semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def contains_flag(c: str | Column, label: str) -> Column:
    """P5: 1 when the raw multi-select string contains ``label``; null -> 0."""
    return flag(_col(c).contains(label))


def split_multi(c: str | Column, sep: str = ";") -> Column:
    """Split + trim + drop empty items of a multi-select string (null -> null)."""
    parts = F.transform(F.split(_col(c), re.escape(sep)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def split_multi_distinct(c: str | Column, sep: str = ";") -> Column:
    """Split items without repeats, sorted (a repeated answer never pairs with itself)."""
    return F.array_sort(F.array_distinct(split_multi(c, sep)))


def explode_multi(df: DataFrame, c: str, out: str = "item", keep: Sequence[str] = ("id",),
                  distinct: bool = False) -> DataFrame:
    """Long rows ``(keep..., item)``; rows with no item drop out."""
    arr = split_multi_distinct(c) if distinct else split_multi(c)
    return df.select(*keep, F.explode(arr).alias(out))


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """P10: clip to [lo, hi], keeping nulls null (``least``/``greatest`` would skip them)."""
    x = _col(c)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def relabel(c: str | Column, mapping: Mapping, default: str | None = None) -> Column:
    """Level -> label with a default for unmapped/null values."""
    out = map_lookup(mapping, c)
    return out if default is None else F.coalesce(out, F.lit(default))


def label_strength(c: str | Column, cuts: Sequence[float], labels: Sequence[str], absolute: bool = True) -> Column:
    """``labels[i]`` for the first cut with value > cut; last label otherwise."""
    x = F.abs(_col(c)) if absolute else _col(c)
    expr = None
    for cut, lab in zip(cuts, labels):
        expr = F.when(x > cut, lab) if expr is None else expr.when(x > cut, lab)
    return expr.otherwise(labels[len(cuts)])


def minutes_between(start: str | Column, end: str | Column, unit_seconds: float = 60.0) -> Column:
    """(end - start) in minutes (or another unit) as double; works for timestamp_ntz."""
    return (F.expr("timestampdiff(MICROSECOND, {}, {})".format(_sql(start), _sql(end)))
            / F.lit(unit_seconds * 1e6))


def _sql(c: str | Column) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("minutes_between takes column names")


def slug(label: str) -> str:
    """Notebook-style flag suffix: lower case, spaces -> '_', '/' and '.' removed."""
    return label.lower().replace(" ", "_").replace("/", "").replace(".", "")


def encode(df: DataFrame, profile: str = "dashboard") -> DataFrame:
    """Encoded response table.

    ``profile='dashboard'``: six platform flags, fixed motivation flag names, ``ad_influenced``
    nulls filled with 0.5, missing source columns replaced by constant defaults.
    ``profile='notebook'``: seven platform flags (incl. TikTok), generated motivation flag names,
    ``ad_influenced`` null kept, plus ``completion_minutes`` and ``trust_factor_enc``.
    """
    if profile not in ("dashboard", "notebook"):
        raise ValueError(f"unknown profile {profile!r}")
    cols = set(df.columns)
    d = S.MISSING_COLUMN_DEFAULTS

    def enc(src: str, mapping, name: str, default=None):
        if src in cols:
            return ordinal(src, mapping, default).alias(name)
        if profile == "notebook":
            raise ValueError(f"missing column {src!r}")
        return F.lit(d[name]).alias(name)

    exprs = [
        enc("spending", S.SPENDING_MAP, "spending_ord"),
        enc("daily_time", S.DAILY_TIME_MAP, "daily_time_ord"),
        enc("engagement_freq", S.ENGAGEMENT_MAP, "engagement_ord"),
        enc("purchase_freq", S.PURCHASE_MAP, "purchase_ord"),
        enc("ad_click_freq", S.AD_CLICK_MAP, "ad_click_ord"),
        enc("age_group", S.AGE_MAP, "age_ord", default=2),
    ]
    if "searched_product" in cols:
        exprs.append(flag(F.col("searched_product") == "Yes").alias("searched_binary"))
    else:
        exprs.append(F.lit(d["searched_binary"]).alias("searched_binary"))
    if "ad_influenced" in cols:
        fill = 0.5 if profile == "dashboard" else None
        exprs.append(ordinal("ad_influenced", S.AD_INFLUENCED_MAP, fill).cast("double").alias("ad_influenced_binary"))
    else:
        exprs.append(F.lit(d["ad_influenced_binary"]).cast("double").alias("ad_influenced_binary"))
    out = df.select("*", *exprs)
    out = out.withColumns({
        "high_ad_responsive": flag(F.col("ad_click_ord") >= 2),
        "made_purchase": flag(F.col("purchase_ord") > 0),
    })

    platforms = S.PLATFORMS_DASHBOARD if profile == "dashboard" else S.PLATFORMS_NOTEBOOK
    flags = {}
    for p in platforms:
        name = "platform_" + p.lower().replace(" ", "")
        flags[name] = contains_flag("platforms", p) if "platforms" in cols else F.lit(0)
    if profile == "dashboard":
        motiv = S.MOTIVATION_FLAGS_DASHBOARD
    else:
        motiv = {"motiv_" + slug(lab): lab for lab in S.MOTIVATIONS}
    for name, lab in motiv.items():
        flags[name] = contains_flag("purchase_motivation", lab) if "purchase_motivation" in cols else F.lit(0)
    out = out.withColumns(flags)

    if profile == "notebook":
        extra = {}
        if "start_time" in cols and "end_time" in cols:
            extra["completion_minutes"] = minutes_between("start_time", "end_time")
        if extra:
            out = out.withColumns(extra)
        out = label_encode(out, "trust_factor", "trust_factor_enc", null_label="Unknown")
    return out


def label_encode(df: DataFrame, c: str, out: str, null_label: str = "Unknown") -> DataFrame:
    """Integer codes in sorted order of the distinct labels (nulls read as ``null_label``).

    The distinct label set is small (categorical), so the codes are computed on it with a window
    and joined back on the label -- one aggregate, no row-level sort.
    """
    lab = F.coalesce(F.col(c), F.lit(null_label))
    keyed = df.withColumn("__lab", lab)
    codes = (keyed.select("__lab").distinct()
             .withColumn(out, (F.row_number().over(Window.orderBy("__lab")) - 1).cast("int")))
    return keyed.join(codes, "__lab", "left").drop("__lab")


def standardize_exprs(stats: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """P13 projection: z = (x - mean) / sd, sd 0 (or undefined) -> divide by 1."""
    out = {}
    for c, (mean, sd) in stats.items():
        sd = sd if sd and sd > 0 else 1.0
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(sd)
    return out


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """One aggregate pass: mean and population sd per column (one small row to the driver)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in cols}


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Add (or replace, when ``suffix`` is empty) z-score columns."""
    stats = column_stats(df, cols)
    exprs = standardize_exprs(stats)
    return df.withColumns({f"{c}{suffix}": e for c, e in exprs.items()})
