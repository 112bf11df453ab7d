"""Vocabulary spelt out, so that a changed constant shows even where queries and SQL share it."""

from panelspark import schema as S
from panelspark.operators import rules


def test_preview_columns():
    assert S.PREVIEW_COLUMNS == ["age_group", "gender", "spending", "trust_factor", "purchase_freq", "engagement_freq",
                                 "preferred_ad_format", "satisfaction_score", "made_purchase"]


def test_export_columns():
    assert len(S.EXPORT_COLUMNS) == 20
    assert S.EXPORT_COLUMNS[-5:] == ["purchase_ord", "engagement_ord", "spending_ord", "made_purchase", "high_ad_responsive"]
    assert not {"id", "content_type", "searched_product", "purchase_motivation"} & set(S.EXPORT_COLUMNS)


def test_aliases_cover_the_raw_export():
    assert len(S.QUESTION_ALIASES) == 24
    assert S.QUESTION_ALIASES["Completion time"] == "end_time"


def test_report_items(spark):
    assert set(rules.report_items()) == {"High_Engagement", "ContentQuality_Trust", "High_Interest", "High_Satisfaction",
                                         "Made_Purchase", "High_TimeSpent"}


def test_clean_token_works_on_any_column(spark):
    from pyspark.sql import functions as F

    from panelspark.operators.text import clean_token
    df = spark.createDataFrame([("dog's",), ("cat",)], "w string")
    assert [r[0] for r in df.select(clean_token(F.col("w"))).collect()] == ["dog", "cat"]


def test_describe_keeps_all_null_columns(spark):
    from panelspark.operators.aggregate import describe_numeric
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert {r["column"]: r["count"] for r in describe_numeric(df, ["a", "b"]).collect()} == {"a": 2, "b": 0}
