from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.encode import clip, encode, flag, label_encode, ordinal, split_multi
from panelspark.operators import filters as FL
from tests.conftest import rows


def test_encoder_domain_unmapped_and_null(spark):
    df = spark.createDataFrame([(1, "Rarely"), (2, "frequently"), (3, "Frequently"), (4, None)], "id int, e string")
    out = df.select("id", ordinal("e", S.ENGAGEMENT_MAP).alias("o"), flag(F.col("e") == "Rarely").alias("f"))
    assert rows(out) == [(1, 1, 1), (2, 3, 0), (3, None, 0), (4, None, 0)]


def test_age_default_and_both_forty_labels(spark):
    df = spark.createDataFrame([("40",), ("40+",), ("??",), (None,)], "age_group string")
    out = df.select(ordinal("age_group", S.AGE_MAP, 2).alias("a"))
    assert sorted(r.a for r in out.collect()) == [2, 2, 5, 5]


def test_encode_dashboard_flags_and_fill(spark):
    df = spark.createDataFrame(
        [(1, "Instagram; YouTube", "Discount / coupon code", "Not sure", "Sometimes", "Never"),
         (2, None, None, None, None, None)],
        "id long, platforms string, purchase_motivation string, ad_influenced string, ad_click_freq string, "
        "purchase_freq string")
    out = {r.id: r for r in encode(df, "dashboard").collect()}
    assert out[1].platform_instagram == 1 and out[1].platform_youtube == 1 and out[1].platform_twitter == 0
    assert out[1].motiv_coupon == 1 and out[1].high_ad_responsive == 1 and out[1].made_purchase == 0
    assert out[1].ad_influenced_binary == 0.5 and out[2].ad_influenced_binary == 0.5
    # null answers: flags 0, not null (pandas comparison semantics)
    assert out[2].platform_instagram == 0 and out[2].high_ad_responsive == 0 and out[2].made_purchase == 0
    # missing source column -> dashboard default
    assert out[1].spending_ord == 2 and out[1].age_ord == 2


def test_encode_notebook_names(spark):
    df = spark.createDataFrame([(1, "Tik Tok", "Trend / FOMO", None, "A")],
                               "id long, platforms string, purchase_motivation string, ad_influenced string, "
                               "trust_factor string")
    for c in ["spending", "daily_time", "engagement_freq", "purchase_freq", "ad_click_freq", "age_group"]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    r = encode(df, "notebook").collect()[0]
    assert r.platform_tiktok == 1 and r.motiv_trend__fomo == 1 and r.ad_influenced_binary is None


def test_multi_select_parse(spark):
    df = spark.createDataFrame([(";a;; b",), (None,), ("x;x",)], "m string")
    got = [r.s for r in df.select(split_multi("m").alias("s")).collect()]
    assert got == [["a", "b"], None, ["x", "x"]]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (10.0,), (50.0,), (None,)], "v double")
    assert [r.c for r in df.select(clip("v", 0, 30).alias("c")).collect()] == [0.0, 10.0, 30.0, None]


def test_label_encode_sorted_with_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    out = {r.t: r.code for r in label_encode(df, "t", "code").collect()}
    assert out == {None: 0, "a": 1, "b": 2}  # code-point order: "Unknown" < "a" < "b"


def test_filters_empty_selection_null_and_platforms(spark):
    df = spark.createDataFrame(
        [(1, "19-24", 1, 0), (2, None, 1, 0), (3, "25-30", 0, 0)],
        "id int, age_group string, platform_instagram int, platform_youtube int")
    assert FL.segment_filter(df, {"age_group": []}).count() == 3
    assert [r.id for r in FL.segment_filter(df, {"age_group": ["19-24", "25-30"]}).collect()] == [1, 3]
    assert [r.id for r in FL.any_flag_filter(df, ["platform_instagram", "platform_youtube"]).collect()] == [1, 2]
