"""Fits, splits and folds against closed forms and optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import clustering as K
from panelspark.operators import models as M
from panelspark.operators import network as N
from panelspark.operators import ranks as RK


@pytest.fixture(scope="module")
def table(spark):
    x = F.col("id") * 7919 % 101 / 101.0
    z = F.col("id") * 104729 % 53 / 53.0
    noise = F.col("id") * 31 % 17 / 17.0
    return spark.range(240).select("id", x.alias("x"), z.alias("z"), (2 * x - z + noise).alias("y"),
                                   (x + noise > 1.0).cast("int").alias("c")).cache()


def _scaled(train, test, cols):
    a, b = (np.array([[r[c] for c in cols] for r in rows]) for rows in (train, test))
    mean, sd = a.mean(0), a.std(0)
    return (a - mean) / sd, (b - mean) / sd


def test_split_is_exact_per_class_and_repeats(spark, table):
    train, test = M.split(table, 0.75, stratify="c")
    again, _ = M.split(table.repartition(7), 0.75, stratify="c")
    ids = {r.id for r in train.collect()}
    assert ids == {r.id for r in again.collect()} and not ids & {r.id for r in test.collect()}
    sizes = {r.c: r["count"] for r in table.groupBy("c").count().collect()}
    got = {r.c: r["count"] for r in train.groupBy("c").count().collect()}
    assert got == {c: round(n * 0.75) for c, n in sizes.items()}


def test_folds_are_contiguous_and_even(spark, table):
    folds = M.contiguous_folds(table.limit(0).unionByName(table.where("id < 23")), 5).orderBy("id").collect()
    assert [r.fold for r in folds] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
    per = M.contiguous_folds(table, 5, stratify="c").groupBy("c", "fold").count().collect()
    for c in (0, 1):
        n = [r["count"] for r in per if r.c == c]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_ols_is_least_squares_with_training_scales(spark, table):
    coefs, metrics = M.ols(table, ["x", "z"], "y")
    train, test = (d.collect() for d in M.split(table.select("id", F.col("y"), "x", "z"), 0.75))
    a, b = _scaled(train, test, ["x", "z"])
    beta, *_ = np.linalg.lstsq(np.c_[a, np.ones(len(a))], np.array([r.y for r in train]), rcond=None)
    got = {r.feature: r.coef for r in coefs.collect()}
    assert np.allclose([got["x"], got["z"], got["(intercept)"]], beta, atol=1e-8)
    y = np.array([r.y for r in test])
    err = y - np.c_[b, np.ones(len(b))] @ beta
    m = metrics.collect()[0]
    assert abs(m.rmse - np.sqrt((err ** 2).mean())) < 1e-8
    assert abs(m.r2 - (1 - (err ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-8


def test_ols_cv_and_constant_labels(spark, table):
    rows = M.cross_validate_ols(table, ["x", "z"], "y", k=5).collect()
    assert len(rows) == 5 and abs(rows[0].mean_r2 - np.mean([r.r2 for r in rows])) < 1e-12
    flat = table.withColumn("y", F.lit(1.0))
    assert M.ols(flat, ["x", "z"], "y")[1].collect()[0].r2 is None


def test_logistic_has_no_gradient_at_its_solution(spark, table):
    coefs, pred = M.logistic(table, ["x", "z"], "c")
    train, test = (d.collect() for d in M.split(table.select("id", F.col("c").cast("double").alias("c"), "x", "z"),
                                                0.75, stratify="c"))
    a, _ = _scaled(train, test, ["x", "z"])
    w = {r.feature: r.coef for r in coefs.collect()}
    beta = np.array([w["x"], w["z"]])
    p = 1 / (1 + np.exp(-(a @ beta + w["(intercept)"])))
    y = np.array([r.c for r in train])
    assert np.allclose(a.T @ (p - y) + beta, 0, atol=1e-2) and abs((p - y).sum()) < 1e-2
    assert pred.count() == len(test) and M.auc(pred).collect()[0].auc > 0.5


def test_classifiers_decline_too_few_rows(spark, table):
    few = table.where("id < 20")
    one_class = table.withColumn("c", F.lit(1))
    for df in (few, one_class):
        assert [d.count() for d in M.logistic(df, ["x", "z"], "c")] == [0, 0]
        assert [d.count() for d in M.forest_importance(df, ["x", "z"], "c")] == [0, 0]
        assert M.forest_cv_auc(df, ["x", "z"], "c").count() == 0


def test_forest_importances_and_folds(spark, table):
    imp, pred = M.forest_importance(table, ["x", "z"], "c", trees=20)
    got = {r.feature: r.importance for r in imp.collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["x"] > got["z"]
    assert M.auc(pred).collect()[0].auc > 0.6
    cv = M.forest_cv_auc(table, ["x", "z"], "c", k=3, trees=10).collect()
    assert len(cv) == 3 and all(0.5 < r.auc <= 1 for r in cv)


def test_kmeans_finds_separated_groups(spark):
    df = spark.range(90).select("id", (F.col("id") % 3 * 100 + F.col("id") / 30).alias("a"),  # three even lines
                                (F.col("id") % 3 * -50).alias("b"))
    assigned, centers, _, cost = K.kmeans(df, ["a", "b"], k=3, n_init=3)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.id % 3, set()).add(r.cluster)
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1] and len(centers) == 3 and cost < 1
    scan = K.k_scan(df, ["a", "b"], ks=range(2, 5), n_init=2).collect()
    assert {r.best_k for r in scan} == {3}
    assert [r.inertia for r in scan] == sorted((r.inertia for r in scan), reverse=True)


def test_running_sums_with_null_groups_and_a_hot_one(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g"), F.lit(2).cast("long").alias("w"))
    got = RK.running_sums(df, ["id"], {"s": "w"}, by=["g"]).collect()
    for g in ("hot", None):
        assert [r.s for r in sorted((r for r in got if r.g == g), key=lambda r: r.id)] == list(range(0, 2 * sum(r.g == g for r in got), 2))


def test_large_longs_keep_their_order(spark):
    df = spark.createDataFrame([(2 ** 53, 1), (2 ** 53 + 1, 2), (2 ** 53 + 2, 3)], "x long, y int")
    r = RK.spearman_test(df, [("a", "x", "y")]).collect()[0]
    assert r.rho == 1.0 and r.p_value == 0.0 and r.direction == "Positive" and r.strength == "Strong" and r.stars == "***"
    two = RK.spearman_test(df.limit(2), [("a", "x", "y")]).collect()[0]
    assert two.p_value is None and two.status is None


def test_quantiles_of_several_columns(spark):
    df = spark.createDataFrame([(v, v * v if v < 4 else None, None) for v in range(6)], "a int, b int, c double")
    for wide in (True, False):
        q = RK.quantiles_exact(df, ["a", "b", "c"], [0.25, 0.5, 1.0], wide)
        assert q == {"a": [1.25, 2.5, 5.0], "b": [0.75, 2.5, 9.0], "c": [None] * 3}


def test_pagerank_says_when_it_has_not_converged(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1)], "src string, dst string, weight long")
    with pytest.raises(RuntimeError):
        N.pagerank(nodes, edges, max_iter=1)


def test_betweenness_with_ties_and_irrational_shares(spark):
    # from a to e three equal ways, each through its own middle node
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    edges = spark.createDataFrame([(s, t, 1) for m in "bcd" for s, t in (("a", m), (m, "e"))],
                                  "src string, dst string, weight long")
    got = {r.node: r.betweenness for r in N.betweenness(nodes, edges).collect()}
    assert all(abs(got[m] - 2 * (1 / 3) / 12) < 1e-12 for m in "bcd")
    assert abs(got["a"] - 6 * 0.5 / 12) < 1e-12 and abs(got["e"] - 6 * 0.5 / 12) < 1e-12


def test_t_tail_tends_to_the_normal_one():
    from panelspark.functions.pvalues import norm_sf, t_sf
    for t in (0.5, 2.0, 5.0):
        assert abs(t_sf(t, 1e12) / norm_sf(t) - 1) < 1e-9
        assert abs(t_sf(t, 99_999.0) / t_sf(t, 100_001.0) - 1) < 1e-6
