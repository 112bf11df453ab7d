import random

from pyspark.sql import functions as F

from panelspark.operators import filters as FL
from panelspark.operators import hypothesis as H
from panelspark.operators import models as M
from tests.conftest import SF001


def _brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_hot_value_rank_statistics_match_brute_force(spark):
    rnd = random.Random(7)
    hot = [3] * 400                                    # one value holds a third of all rows
    rest = [rnd.randint(0, 9) for _ in range(800)]
    vals = hot + rest
    groups = ["a" if rnd.random() < 0.5 else "b" for _ in vals]
    df = spark.createDataFrame(list(zip(groups, vals)), "g string, v int").repartition(7)
    st = H.mann_whitney_stats(df, F.col("g") == "a", F.col("g") == "b", "v").collect()[0]
    a = [v for g, v in zip(groups, vals) if g == "a"]
    b = [v for g, v in zip(groups, vals) if g == "b"]
    assert abs(st.u - _brute_u(a, b)) < 1e-9


def test_auc_on_continuous_scores_uses_range_path_and_matches_brute_force(spark):
    rnd = random.Random(3)
    data = [(int(rnd.random() < 0.4), round(rnd.random(), 3)) for _ in range(1500)]
    df = spark.createDataFrame(data, "label int, score double").repartition(5)
    got = M.auc(df).collect()[0].auc
    pos = [s for l, s in data if l == 1]
    neg = [s for l, s in data if l == 0]
    assert abs(got - _brute_u(pos, neg) / (len(pos) * len(neg))) < 1e-12


def test_segment_filter_reaches_parquet_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    out = FL.segment_filter(df, {"c_mktsegment": ["BUILDING", "MACHINERY"]}).select("c_custkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(c_mktsegment, [BUILDING,MACHINERY])]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_prepared_table_is_scanned_with_its_columns_and_filters(spark):
    from panelspark.plans.common import encoded
    df = encoded(spark, SF001).where(F.col("age_group") == "19-24").groupBy("gender").count()
    plan = df._jdf.queryExecution().toString()
    schema = plan[plan.rindex("ReadSchema"):].split("\n")[0]
    assert "gender" in schema and "age_group" in schema and "spending" not in schema
    assert "EqualTo(age_group,19-24)" in plan and "InMemoryTableScan" not in plan
