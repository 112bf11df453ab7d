"""The driver's order tables viewed as a table of survey responses.

One row per order.  Order-level answers come straight from ``orders`` / ``customer`` /
``nation`` / ``region``; item-level answers come from one aggregate of ``lineitem`` joined with
``part`` per order, computed *before* the left join so that orders without items keep null
answers (and score bands are not produced from nulls).

Plan shape at scale: lineitem |><| part is a shuffle join on the part key (part grows with the
data, so it is not broadcast unless the optimizer's size statistics allow it); the per-order
aggregate runs on one shuffle by ``l_orderkey`` of narrow rows; ``orders`` left-joins it on the same
key; ``customer`` joins on the customer key; ``nation`` and ``region`` are fixed 25/5-row
dimension tables and are broadcast.  Multi-select answers are presence bits over fixed label
domains (6-7 values), so no group ever collects a list.  Codes of strings become numbers at the scan, before any
shuffle.  What can fail on an odd value (casts, picks by number) is worked out behind the joins, on joined rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.sources.tables import read_table

# ----------------------------------------------------------------------------------------------
# FIXED VALUES: how driver codes map onto survey answer labels.
# ----------------------------------------------------------------------------------------------
PART_TYPE_TO_PLATFORM = {
    "ECONOMY": "Instagram", "LARGE": "YouTube", "MEDIUM": "Pinterest",
    "PROMO": "Snapchat", "SMALL": "Facebook", "STANDARD": "Twitter",
}
FLAGS_TO_MOTIVATION = {
    "AF": "Positive reviews", "AO": "Discount / coupon code", "NF": "Trust in influencer",
    "NO": "Attractive content", "RF": "Curiosity", "RO": "Trend / FOMO",
}
SEGMENT_TO_TRUST = {
    "AUTOMOBILE": "Content quality", "BUILDING": "Transparency in reviews", "FURNITURE": "Authenticity",
    "HOUSEHOLD": "Expertise in niche", "MACHINERY": "High follower count",
}
STATUS_TO_GENDER = {"F": "Female", "O": "Male", "P": "Other"}
# Quantity cut points for daily-time bands; supplier-count cut points for engagement bands.
QTY_CUTS = (60, 96, 139)
SUPPLIER_CUTS = (1, 3, 5)
PRICE_BAND_WIDTH = 125000.0

RAW_COLUMNS = [
    "id", "start_time", "end_time", "age_group", "gender", "spending", "platforms", "daily_time",
    "follows_influencers", "content_type", "trust_factor", "engagement_freq",
    "product_interest_score", "searched_product", "purchase_freq", "purchase_motivation",
    "satisfaction_score", "ad_click_freq", "ad_influenced", "retargeting_score",
    "preferred_ad_format",
]


def _lookup(mapping: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def _pick(labels: list[str], idx: Column) -> Column:
    """labels[idx] for a 0-based int column (null when idx is null)."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), idx.cast("int") + 1)


def _label_bits(label: Column, labels: list[str], first: int) -> Column:
    """The bit of a label of a fixed domain, counted from bit ``first``; 0 for a null or other label."""
    return F.coalesce(_lookup({x: 1 << (first + i) for i, x in enumerate(labels)}, label), F.lit(0))


def _joined_from_bits(bits: str, labels: list[str], first: int) -> Column:
    """';'-joined labels present, in code-point order (as sorting the distinct set would give)."""
    order = sorted(range(len(labels)), key=lambda i: labels[i])
    parts = [F.when(F.col(bits).bitwiseAND(1 << (first + i)) != 0, F.lit(labels[i])) for i in order]
    return F.concat_ws(";", *parts)


_PLATFORM_LABELS = list(dict.fromkeys(PART_TYPE_TO_PLATFORM.values()))
_MOTIVATION_LABELS = list(dict.fromkeys(FLAGS_TO_MOTIVATION.values()))
_CONTENT_LABELS = list(S.CONTENT_TYPES)
_MOTIVATION_BIT = len(_PLATFORM_LABELS)
_CONTENT_BIT = _MOTIVATION_BIT + len(_MOTIVATION_LABELS)
_OPEN_BIT = _CONTENT_BIT + len(_CONTENT_LABELS)
# not answers: the return flag of an item is known, is N, is R
_FLAG_BIT, _N_BIT, _R_BIT = _OPEN_BIT + 1, _OPEN_BIT + 2, _OPEN_BIT + 3
_GENDERS = list(STATUS_TO_GENDER.values())
_TRUST_LABELS = list(SEGMENT_TO_TRUST.values())


def _code(mapping: dict, labels: list[str], key: Column) -> Column:
    """Number of the label of a key in ``labels``; null for a null or other key."""
    return _lookup({k: labels.index(x) for k, x in mapping.items()}, key)


def _bit_if(cond: Column, bit: int) -> Column:
    return F.when(cond, 1 << bit).otherwise(0)


def _known_flag(bit: int) -> Column:
    """1 or 0 where an item has a return flag, null without."""
    def has(b: int) -> Column:
        return F.col("bits").bitwiseAND(1 << b) != 0
    return F.when(has(_FLAG_BIT), has(bit).cast("int"))


def _item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and presence bits of every order that has items.

    Items and parts meet as rows of numbers, and the joined items travel once, by order, as a row of seven numbers.
    There they are sorted by supplier and the first row of each supplier is marked, so the marks add up to the distinct
    suppliers and one grouped aggregate on the partitioning at hand gives the rest.  Nothing is aggregated before that
    shuffle: an order has a handful of items and (order, supplier) hardly repeats, so a map-side table would hold every
    row and spill.
    """
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
    returned = F.col("l_returnflag")
    motiv = _lookup(FLAGS_TO_MOTIVATION, F.concat("l_returnflag", "l_linestatus"))
    line_bits = (_label_bits(motiv, _MOTIVATION_LABELS, _MOTIVATION_BIT)
                 .bitwiseOR(_bit_if(F.col("l_linestatus") == "O", _OPEN_BIT))
                 .bitwiseOR(_bit_if(returned.isNotNull(), _FLAG_BIT))
                 .bitwiseOR(_bit_if(returned == "N", _N_BIT))
                 .bitwiseOR(_bit_if(returned == "R", _R_BIT)))
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate",
                   line_bits.alias("line_bits"))
    plat = _lookup(PART_TYPE_TO_PLATFORM, F.col("p_type"))
    part = part.select("p_partkey", "p_size", _label_bits(plat, _PLATFORM_LABELS, 0).alias("part_bits"))
    items = li.join(part, li.l_partkey == part.p_partkey, "inner")
    content = _pick(S.CONTENT_TYPES, F.floor((F.col("p_size") - 1) / 8).cast("int"))
    bits = (F.col("line_bits").bitwiseOR(F.col("part_bits"))
            .bitwiseOR(_label_bits(content, _CONTENT_LABELS, _CONTENT_BIT)))
    narrow = items.select(
        F.col("l_orderkey").alias("id"), "l_suppkey", F.col("l_shipdate").alias("end_time"), F.col("l_quantity").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc_pct"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax_pct"), bits.alias("bits"))
    of_supplier = F.row_number().over(Window.partitionBy("id", "l_suppkey").orderBy("l_suppkey"))
    marked = narrow.repartition("id").withColumn("first", (of_supplier == 1).cast("int"))
    return marked.groupBy("id").agg(
        F.max("end_time").alias("end_time"), F.sum("qty").alias("qty"),
        F.sum("first").alias("n_supp"), F.count(F.lit(1)).alias("n_items"),
        F.sum(_known_flag(_N_BIT)).alias("n_flag_n"), F.sum(_known_flag(_R_BIT)).alias("n_flag_r"),
        F.sum("disc_pct").alias("disc_pct"), F.sum("tax_pct").alias("tax_pct"), F.bit_or("bits").alias("bits"))


def _item_answers() -> list[Column]:
    """The item answers of a row of totals; null where an order has no items."""
    q1, q2, q3 = QTY_CUTS
    s1, s2, s3 = SUPPLIER_CUTS
    qty_band = (F.when(F.col("qty") < q1, 0).when(F.col("qty") < q2, 1)
                .when(F.col("qty") < q3, 2).otherwise(3))
    supp_band = (F.when(F.col("n_supp") <= s1, 0).when(F.col("n_supp") <= s2, 1)
                 .when(F.col("n_supp") <= s3, 2).otherwise(3))
    answers = {
        "platforms": _joined_from_bits("bits", _PLATFORM_LABELS, 0),
        "purchase_motivation": _joined_from_bits("bits", _MOTIVATION_LABELS, _MOTIVATION_BIT),
        "content_type": _joined_from_bits("bits", _CONTENT_LABELS, _CONTENT_BIT),
        "daily_time": _pick(S.DAILY_TIME_LEVELS, qty_band),
        "engagement_freq": _pick(S.ENGAGEMENT_LEVELS, supp_band),
        "purchase_freq": _pick(S.PURCHASE_LEVELS, F.least(F.col("n_flag_n"), F.lit(4))),
        "ad_click_freq": _pick(S.AD_CLICK_LEVELS, F.least(F.col("n_flag_r"), F.lit(3))),
        "satisfaction_score": F.least(F.lit(5), 1 + F.expr("disc_pct div (2 * n_items)")).cast("int"),
        "retargeting_score": F.least(F.lit(5), 1 + F.expr("(10 * tax_pct) div (16 * n_items)")).cast("int"),
        "searched_product": F.when(F.col("bits").bitwiseAND(1 << _OPEN_BIT) != 0, "Yes").otherwise("No"),
    }
    return [F.col("end_time"), *[F.when(F.col("n_items").isNotNull(), e).alias(c) for c, e in answers.items()]]


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order item answers (one row per order that has items)."""
    return _item_totals(spark, sf_dir).select("id", *_item_answers())


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw response table (string answers, like a loaded questionnaire export)."""
    orders = read_table(spark, sf_dir, "orders", [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey"])
    items = _item_totals(spark, sf_dir)

    band = F.least(F.floor(F.col("o_totalprice") / PRICE_BAND_WIDTH), F.lit(3))
    orders = orders.select(
        F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", band.alias("band"),
        _code(STATUS_TO_GENDER, _GENDERS, F.col("o_orderstatus")).alias("gender_code"),
        F.substring("o_orderpriority", 1, 1).alias("priority"))
    customer = customer.select(
        "c_custkey", "c_nationkey", (F.col("c_acctbal") >= 0).alias("follows"),
        _code(SEGMENT_TO_TRUST, _TRUST_LABELS, F.col("c_mktsegment")).alias("trust_code"))
    geo = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))
    base = (orders
            .join(customer, orders.o_custkey == customer.c_custkey, "inner")
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "inner"))
    # numbers and codes are joined; labels are spelt out behind the last shuffle
    joined = base.join(items, "id", "left")
    return joined.select(
        "id",
        F.col("o_orderdate").alias("start_time"),
        _pick(S.AGE_GROUPS, F.col("r_regionkey")).alias("age_group"),
        _lookup(dict(enumerate(_GENDERS)), F.col("gender_code")).alias("gender"),
        _pick(S.SPENDING_LEVELS, F.col("band")).alias("spending"),
        F.when(F.col("follows"), "Yes").otherwise("No").alias("follows_influencers"),
        _lookup(dict(enumerate(_TRUST_LABELS)), F.col("trust_code")).alias("trust_factor"),
        (6 - F.col("priority").cast("int")).alias("product_interest_score"),
        _pick(S.AD_INFLUENCED_LEVELS, (F.col("id") % 3).cast("int")).alias("ad_influenced"),
        _pick(S.AD_FORMATS, (F.col("c_custkey") % 5).cast("int")).alias("preferred_ad_format"),
        *_item_answers()).select(*RAW_COLUMNS)
