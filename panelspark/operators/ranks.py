"""Tie-aware ranks and rank correlation.

Average ranks are computed on the *value-count* table, never by sorting raw rows:

1. ``groupBy(value).count`` -- partial aggregation collapses duplicates map-side, so a value that
   holds a third of all rows becomes one row per task;
2. the running count before each distinct value gives ``rank = before + (cnt + 1) / 2``.

Step 2 is ``running_sums``: the distinct values are range-partitioned, every range sums its own rows and
one row for each range and group supplies the offsets, so no task sees all distinct values.  Callers that
know a column to hold a few values only (survey answer codes) say so with ``high_cardinality=False`` and
get one window; the library never guesses it from types or sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.encode import label_strength
from panelspark.functions.literals import local_table
from panelspark.functions.pvalues import t_survival
from panelspark.session import checkpoint_dir


def value_counts_for_rank(df: DataFrame, c: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    g = df.where(F.col(c).isNotNull()).groupBy(*by, c)
    cnt = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return g.agg(cnt.cast("long").alias("cnt"))


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``{out: col}``: the sum of ``col`` over the rows before this one in ``order``, within each ``by`` group.

    ``order`` must be unique within a group.  Rows are dealt to ranges of (by, order) and each keeps the number of its
    range; a reliable checkpoint pins those numbers, as sums inside the ranges and totals of the ranges are two
    readers of them.  A window holds one group's rows of one range, the offsets one row for each range and group.
    """
    by, order = list(by), list(order)
    checkpoint_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id())
              .checkpoint(eager=True))
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(*before)
    across = Window.partitionBy(*by).orderBy("__range").rowsBetween(*before)
    zero = F.lit(0).cast("long")
    totals = ranged.groupBy("__range", *by).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    offsets = totals.select(F.col("__range").alias("__at"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)],
                            *[F.coalesce(F.sum(f"__t_{o}").over(across), zero).alias(f"__o_{o}") for o in sums])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)],
                  F.col("__range") == F.col("__at"))
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"__l_{o}") for o, c in sums.items()])
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"__l_{o}") + F.col(f"__o_{o}")).alias(o) for o in sums])


def rank_table(df: DataFrame, c: str, by: Sequence[str] = (), high_cardinality: bool = True,
               weight: str | None = None, out: str = "rank") -> DataFrame:
    """``(by..., c, cnt, before, rank)`` -- average rank (ties share the mean position) of each
    distinct non-null value of ``c`` within each ``by`` group."""
    by = list(by)
    counts = value_counts_for_rank(df, c, by, weight)
    if high_cardinality:
        ranked = running_sums(counts, [c], {"before": "cnt"}, by)
    else:
        w = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0)).cast("long"))
    return ranked.withColumn(out, F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0))


def avg_rank(df: DataFrame, c: str, by: Sequence[str] = (), out: str = "rank",
             high_cardinality: bool = True) -> DataFrame:
    """Add the average rank of ``c`` to every row (null value -> null rank)."""
    rt = rank_table(df, c, by, high_cardinality, out=out).select(*by, c, out)
    return df.join(rt, [*by, c], "left")


def tie_term(rt: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """sum(t^3 - t) over tie groups, from a rank table."""
    t = F.col("cnt").cast("double")
    return rt.groupBy(*by).agg(F.sum(t * t * t - t).alias("tie_term"), F.sum("cnt").alias("n"))


def spearman_pair(df: DataFrame, x: str, y: str, high_cardinality: bool = True) -> DataFrame:
    """C3 statistic: ``(n, rho)`` over pairwise-complete rows.

    Works on the compressed ``(x, y, cnt)`` table: ranks of x and of y come from its marginals,
    and rho is the weighted Pearson correlation of the centred ranks (mean rank = (n+1)/2).
    """
    pairs = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("cnt")))
    rx = rank_table(pairs, "x", weight="cnt", out="rx", high_cardinality=high_cardinality).select("x", "rx")
    ry = rank_table(pairs, "y", weight="cnt", out="ry", high_cardinality=high_cardinality).select("y", "ry")
    # both sides are compressed tables; the planner (AQE) picks the join strategy from runtime size
    joined = pairs.join(rx, "x").join(ry, "y")
    return weighted_corr(joined, "cnt", "rx", "ry")


def weighted_corr(t: DataFrame, w: str, a: str, b: str) -> DataFrame:
    """``(n, rho)``: Pearson correlation of a and b with integer weights ``w``, one aggregate."""
    wc = F.col(w).cast("double")
    agg = t.agg(F.sum(w).cast("long").alias("n"), F.sum(wc * F.col(a)).alias("sa"), F.sum(wc * F.col(b)).alias("sb"),
                F.sum(wc * F.col(a) * F.col(b)).alias("sab"), F.sum(wc * F.col(a) * F.col(a)).alias("saa"),
                F.sum(wc * F.col(b) * F.col(b)).alias("sbb"))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    return agg.select(F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"),
                      F.when(va * vb > 0, cov / F.sqrt(va * vb)).alias("rho"))


def spearman_test(df: DataFrame, pairs: Sequence[tuple[str, str, str]] = S.SPEARMAN_PAIRS,
                  high_cardinality: bool = True) -> DataFrame:
    """One row per ``(label, x, y)``: ``(hypothesis, n, rho, p_value, direction, strength, stars, status)``.

    Two-sided p-value from t with n - 2 degrees of freedom: 0 where |rho| is 1, null below three rows or where a
    column is constant; the labels are null where rho is.
    """
    stat = reduce(DataFrame.unionByName, [spearman_pair(df, x, y, high_cardinality).select(
        F.lit(label).alias("hypothesis"), "n", "rho") for label, x, y in pairs])
    rho, n, p = F.col("rho"), F.col("n"), F.col("p_value")
    t = F.abs(rho) * F.sqrt(F.try_divide(n - 2, 1 - rho * rho))
    out = stat.withColumn("p_value", F.when((n >= 3) & (F.abs(rho) >= 1), F.lit(0.0))
                          .when(n >= 3, 2 * t_survival(t, n - 2)))
    some = rho.isNotNull()
    return out.select(
        "hypothesis", "n", "rho", "p_value",
        F.when(rho > 0, "Positive").when(some, "Negative").alias("direction"),
        F.when(some, label_strength("rho", S.RHO_CUTS, ["Strong", "Moderate", "Weak"])).alias("strength"),
        F.when(some, label_strength("rho", S.STAR_CUTS, ["***", "**", "*", ""])).alias("stars"),
        F.when(p < S.ALPHA, "SIGNIFICANT").when(p.isNotNull(), "NOT SIGNIFICANT").alias("status"))


def spearman_matrix(df: DataFrame, cols: Sequence[str], mode: str = "listwise",
                    high_cardinality: bool = True) -> DataFrame:
    """Long ``(x, y, rho, n)`` for every ordered pair of ``cols`` (diagonal = 1).

    ``listwise``: rows with a null in any column are dropped first, every column is ranked once
    over the remaining rows, in the column's own type (rank tables joined back on the value), and all
    pair correlations come from ONE aggregate of products of centred ranks.
    ``pairwise``: each pair is ranked inside its own complete rows, all pairs in one grouped pass.
    """
    cols = list(cols)
    checkpoint_dir(df.sparkSession)
    # the raw rows are read once: answers collapse to their distinct combinations, and all ranks come from those
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).checkpoint(eager=True)
    if mode == "pairwise":
        return _pairwise_matrix(rows, cols, high_cardinality)
    complete = rows.dropna()
    # average ranks have mean (n + 1) / 2 exactly, so centred ranks let plain sums of products give every correlation
    mid = ((complete.agg(F.sum("__n")).first()[0] or 0) + 1) / 2.0
    ranked = complete
    for c in cols:
        rt = rank_table(complete, c, weight="__n", high_cardinality=high_cardinality).select(c, (F.col("rank") - F.lit(mid)).alias(f"__r_{c}"))
        ranked = ranked.join(rt, c)
    sums = [F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n")]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            sums.append(F.sum(F.col("__n") * F.col(f"__r_{a}") * F.col(f"__r_{b}")).alias(f"{a}__{b}"))
    wide = ranked.agg(*sums)

    def rho(a, b):
        i, j = cols.index(a), cols.index(b)
        key = f"{a}__{b}" if i <= j else f"{b}__{a}"
        va, vb = F.col(f"{a}__{a}"), F.col(f"{b}__{b}")
        return F.when((va > 0) & (vb > 0), F.col(key) / F.sqrt(va * vb))

    rows = []
    for a in cols:
        for b in cols:
            r = F.when(F.col("n") > 1, F.lit(1.0)) if a == b else rho(a, b)
            rows.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.cast("double").alias("rho")))
    return wide.select("n", F.inline(F.array(*rows))).select("x", "y", "rho", "n")


def _pairwise_matrix(rows: DataFrame, cols: list[str], high_cardinality: bool) -> DataFrame:
    """Every pair on its own complete rows.  A value is replaced by its place in its column, a whole number that orders
    as the value does, so columns of any type melt into one ``(pair, x, y, weight)`` table that is ranked by pair."""
    coded = rows
    for c in cols:
        places = rank_table(rows, c, weight="__n", high_cardinality=high_cardinality).select(c, F.col("before").alias(f"__p_{c}"))
        coded = coded.join(places, c, "left")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(f"__p_{cols[i]}").alias("x"), F.col(f"__p_{cols[j]}").alias("y"))
                               for n, (i, j) in enumerate(pairs)])).alias("e")
    cells = (coded.select("__n", each).select("e.*", "__n").where(F.col("x").isNotNull() & F.col("y").isNotNull())
             .groupBy("pair", "x", "y").agg(F.sum("__n").alias("cnt")))
    for side in ("x", "y"):
        ranks = rank_table(cells, side, ["pair"], high_cardinality, "cnt", f"r{side}").select("pair", side, f"r{side}")
        cells = cells.join(ranks, ["pair", side])
    w, n = F.col("cnt").cast("double"), F.col("n")
    found = cells.groupBy("pair").agg(F.sum("cnt").cast("long").alias("n"), F.sum(w * F.col("rx")).alias("sx"), F.sum(w * F.col("ry")).alias("sy"),
                                      F.sum(w * F.col("rx") * F.col("ry")).alias("sxy"), F.sum(w * F.col("rx") * F.col("rx")).alias("sxx"),
                                      F.sum(w * F.col("ry") * F.col("ry")).alias("syy"))
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    rho = F.when(spread > 0, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread))
    names = local_table(rows.sparkSession, [(k, cols[a], cols[b]) for k, (i, j) in enumerate(pairs) for a, b in {(i, j), (j, i)}],
                        "pair int, x string, y string")
    return F.broadcast(names).join(found.select("pair", "n", rho.alias("rho")), "pair", "left").select(
        "x", "y", F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(F.col("rho")).alias("rho"),
        F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"))


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, v)`` rows: every listed column as a double value (nulls dropped)."""
    arr = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.explode(arr).alias("e")).select("e.col", "e.v").where(F.col("v").isNotNull())


def top_drivers(matrix: DataFrame, outcome: str, k: int = 3, by_abs: bool = True) -> DataFrame:
    """C4: the ``k`` strongest correlations with ``outcome`` (ties broken by feature name)."""
    m = matrix.where((F.col("y") == outcome) & (F.col("x") != outcome))
    key = F.abs("rho") if by_abs else F.col("rho")
    return m.orderBy(key.desc(), F.col("x")).limit(k).select(F.col("x").alias("feature"), "rho")


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line (degree-1 polyfit) with built-in regression aggregates."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = g.groupBy(*by) if by else g.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"),
                 F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                 F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                 F.regr_r2(F.col(y).cast("double"), F.col(x).cast("double")).alias("r2"))


def line_fit_by_member(df: DataFrame, flag_to_label: dict[str, str], x: str, y: str, min_n: int = 10) -> DataFrame:
    """Per overlapping group (e.g. platform users) fit of y on x; groups with n < min_n dropped."""
    from panelspark.operators.aggregate import explode_members
    long = explode_members(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), flag_to_label, keep=[x, y])
    return line_fit(long, x, y, by=["member"]).where(F.col("n") >= min_n)


def quantiles_exact(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                    high_cardinality: bool = True) -> dict[str, list]:
    """Exact quantiles of each column with linear interpolation (position (n - 1) q, as pandas / SQL
    ``quantile_cont``); ``None`` entries for a column without a value.

    All columns share one ``(col, v, cnt)`` rank table.  Only the (at most two for each quantile) order
    statistics needed come back to the driver, so no task holds all distinct values of a column.
    """
    rt = rank_table(long_values(df, cols), "v", by=["col"], high_cardinality=high_cardinality)
    total = rt.groupBy("col").agg(F.sum("cnt").alias("n"))  # one row for each column
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(q))).alias("h"))
                                for i, q in enumerate(qs)])).alias("q")
    wanted = total.select("col", "n", spots).select(
        "col", F.col("q.i").alias("i"), F.col("q.h").alias("h"), F.floor("q.h").alias("lo"),
        F.least(F.floor("q.h") + 1, F.col("n") - 1).alias("hi"))
    hit = (F.col("before") <= F.col("hi")) & (F.col("before") + F.col("cnt") > F.col("lo"))
    at = lambda p: F.max(F.when((F.col("before") <= F.col(p)) & (F.col("before") + F.col("cnt") > F.col(p)), F.col("v")))
    found = (rt.join(F.broadcast(wanted), "col").where(hit).groupBy("col", "i")
             .agg(at("lo").alias("v_lo"), at("hi").alias("v_hi"), F.max(F.col("h") - F.col("lo")).alias("part")))
    got = {(r["col"], r["i"]): r["v_lo"] + (r["v_hi"] - r["v_lo"]) * r["part"] for r in found.collect()}
    return {c: [got.get((c, i)) for i in range(len(qs))] for c in cols}


def group_medians(gv: DataFrame, group: str, value: str, high_cardinality: bool = True) -> DataFrame:
    """``(group, n, mean, median)`` from a ``(group, value, cnt)`` table."""
    rt = rank_table(gv, value, by=[group], weight="cnt", high_cardinality=high_cardinality)
    n = gv.groupBy(group).agg(F.sum("cnt").alias("n"), (F.sum(F.col(value).cast("double") * F.col("cnt"))
                                                        / F.sum("cnt")).alias("mean"))
    last = F.col("before") + F.col("cnt")
    holds = lambda p: ((F.col("before") <= p) & (last > p)).cast("int")
    times = holds(F.floor((F.col("n") - 1) / 2)) + holds(F.floor(F.col("n") / 2))
    mid = (rt.join(n.select(group, "n"), group).where(times > 0).groupBy(group)
           .agg((F.sum(F.col(value).cast("double") * times) / 2).alias("median")))
    return n.join(mid, group)
