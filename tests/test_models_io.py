import os
import tempfile

from pyspark.sql import functions as F

from panelspark.operators import models as M
from panelspark.sources.io import export_csv, load_responses, rename_columns
from panelspark.sources.synth import synthesize_responses
from panelspark import schema as S


def test_auc_equals_pairwise_count(spark):
    data = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.3), (0, 0.2), (0, 0.1)]
    df = spark.createDataFrame(data, "label int, score double")
    got = M.auc(df).collect()[0].auc
    pos = [s for l, s in data if l == 1]
    neg = [s for l, s in data if l == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12


def test_confusion_grid_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (0, 0)], "label int, prediction int")
    cm = {(r.label, r.prediction): r.n for r in M.confusion(df).collect()}
    assert cm == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    rep = {r.row: r for r in M.classification_report(df).collect()}
    assert abs(rep["1"].precision - 2 / 3) < 1e-12 and rep["1"].recall == 1.0 and rep["accuracy"].precision == 0.75


def test_pca_ratios_sum_to_one_and_orthonormal(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"),
                                 ((F.col("id") * 3) % 11).cast("double").alias("b"),
                                 ((F.col("id") * 5) % 13).cast("double").alias("c"))
    scree = M.pca_scree(df, ["a", "b", "c"]).collect()
    assert abs(scree[-1].cumulative_pct - 100.0) < 1e-9
    load = M.pca_loadings(df, ["a", "b", "c"], k=3).collect()
    import numpy as np
    mat = np.zeros((3, 3))
    for r in load:
        mat[["a", "b", "c"].index(r.feature), r.component - 1] = r.loading
    assert np.allclose(mat.T @ mat, np.eye(3), atol=1e-9)


def test_export_and_load_round_trip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="panelspark-test-"), "export")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    export_csv(df, out)
    back = load_responses(spark, ["/nonexistent/x.csv", out], schema="id int, v string", fmt="csv")
    assert sorted((r.id, r.v) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_rename_tolerates_missing_and_dots(spark):
    q = ". How likely are you to buy a product after seeing repeated ads for it (retargeting)?"
    df = spark.createDataFrame([(1, 3)], "`Age Group` int, `" + q + "` int")
    out = rename_columns(df, S.QUESTION_ALIASES)
    assert out.columns == ["age_group", "retargeting_score"]


def test_synthetic_generator_is_deterministic_and_in_domain(spark):
    a = synthesize_responses(spark, 500, seed=42)
    b = synthesize_responses(spark, 500, seed=42, num_partitions=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.spending for r in a.select("spending").distinct().collect()} <= set(S.SPENDING_LEVELS)
    sizes = [len(r.platforms.split(";")) for r in a.select("platforms").collect()]
    assert min(sizes) >= 1 and max(sizes) <= 3


def test_repartition_invariance_of_aggregates(spark):
    from panelspark.operators import aggregate as A
    df = spark.range(1000).select((F.col("id") % 4).cast("string").alias("g"), (F.col("id") % 5).alias("m"))
    a = sorted(map(tuple, A.group_mean(df, "g", "m").collect()))
    b = sorted(map(tuple, A.group_mean(df.repartition(13), "g", "m").collect()))
    assert a == b


def test_export_reports(spark):
    from panelspark.functions.encode import encode
    from panelspark.sources.io import export_reports
    from panelspark.sources.responses import responses
    enc = encode(responses(spark, "/root/testdata/sf0.001"))
    out = tempfile.mkdtemp(prefix="panelspark-test-reports-")
    paths = export_reports(enc, out, ["satisfaction_score", "purchase_ord"], ["satisfaction_score", "purchase_ord"])
    back = spark.read.option("header", True).csv(paths["correlation"])
    assert back.count() == 2 and set(back.columns) == {"x", "satisfaction_score", "purchase_ord"}
    rows_back = spark.read.option("header", True).csv(paths["rows"])
    assert rows_back.count() == enc.count() and "made_purchase" in rows_back.columns
