import math

from pyspark.sql import functions as F

from panelspark.functions import pvalues as P
from panelspark.operators import hypothesis as H
from panelspark.operators import ranks as RK
from tests.conftest import rows


def test_average_ranks_with_ties_both_paths(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 3, 3, 3]], "v int")
    for hc in (False, True):
        rt = RK.rank_table(df, "v", high_cardinality=hc)
        assert rows(rt, "v", "rank") == [(1, 1.0), (2, 2.5), (3, 5.0)]


def test_range_rank_matches_window_rank(spark):
    df = spark.range(0, 2000).select((F.col("id") % 97).cast("double").alias("v"))
    a = rows(RK.rank_table(df, "v", high_cardinality=True), "v", "rank")
    b = rows(RK.rank_table(df, "v", high_cardinality=False), "v", "rank")
    assert a == b


def test_spearman_reversed_is_minus_one(spark):
    df = spark.createDataFrame([(i, 10 - i) for i in range(10)], "x int, y int")
    r = RK.spearman_pair(df, "x", "y").collect()[0]
    assert r.n == 10 and abs(r.rho + 1) < 1e-12
    m = {(r.x, r.y): r.rho for r in RK.spearman_matrix(df, ["x", "y"]).collect()}
    assert abs(m[("x", "y")] + 1) < 1e-12 and m[("x", "x")] == 1.0


def test_mann_whitney_by_hand(spark):
    # a = [3, 4, 4], b = [1, 2, 4]; pooled ranks: 1->1, 2->2, 3->3, 4->5 (x3)
    data = [("a", 3), ("a", 4), ("a", 4), ("b", 1), ("b", 2), ("b", 4)]
    df = spark.createDataFrame(data, "g string, v int")
    st = H.mann_whitney_stats(df, F.col("g") == "a", F.col("g") == "b", "v").collect()[0]
    # R_a = 3 + 5 + 5 = 13, U = 13 - 6 = 7
    assert st.u == 7.0
    tie = 3 ** 3 - 3
    sigma = math.sqrt(9 / 12 * (7 - tie / 30))
    assert abs(st.z - (7 - 4.5 - 0.5) / sigma) < 1e-12


def test_kruskal_invariant_under_monotone_transform_and_min_group(spark):
    data = [("x", v) for v in [1, 2, 3, 4, 5]] + [("y", v) for v in [3, 4, 5, 6, 7]] + [("z", 1), ("z", 2)]
    df = spark.createDataFrame(data, "g string, v int")
    a = H.kruskal_stats(df).collect()[0]
    b = H.kruskal_stats(df.withColumn("v", F.col("v") * F.col("v") + 100)).collect()[0]
    assert a.k == 2 and a.n == 10  # group z (2 rows) excluded before ranking
    assert abs(a.h - b.h) < 1e-12


def test_chi_square_yates_2x2_and_skip_single_level(spark):
    data = [("A", 1)] * 10 + [("A", 0)] * 20 + [("B", 1)] * 30 + [("B", 0)] * 15
    df = spark.createDataFrame(data, "a string, b int")
    st = H.chi_square_stats(df, "a", "b").collect()[0]
    n, (a, b, c, d) = 75, (10, 20, 30, 15)
    expected = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert st.dof == 1 and abs(st.chi2 - expected) < 1e-9
    one = spark.createDataFrame([("A", 1), ("A", 0)], "a string, b int")
    assert H.chi_square_stats(one, "a", "b").count() == 0


def test_chi_square_general_with_absent_cell(spark):
    data = [("A", "x")] * 5 + [("A", "y")] * 5 + [("B", "x")] * 10 + [("C", "y")] * 10
    df = spark.createDataFrame(data, "a string, b string")
    st = H.chi_square_stats(df, "a", "b").collect()[0]
    obs = {("A", "x"): 5, ("A", "y"): 5, ("B", "x"): 10, ("B", "y"): 0, ("C", "x"): 0, ("C", "y"): 10}
    R = {"A": 10, "B": 10, "C": 10}
    C = {"x": 15, "y": 15}
    chi = sum((o - R[k[0]] * C[k[1]] / 30) ** 2 / (R[k[0]] * C[k[1]] / 30) for k, o in obs.items())
    assert st.dof == 2 and abs(st.chi2 - chi) < 1e-9


def test_pvalue_closed_forms():
    assert abs(P.norm_sf(1.959963984540054) - 0.025) < 1e-12
    assert abs(P.chi2_sf(3.0, 2) - math.exp(-1.5)) < 1e-12          # even df closed form
    assert abs(P.t_sf(1.0, 1) - 0.25) < 1e-12                       # Cauchy
    assert abs(P.t_sf(2.0, 2) - 0.5 * (1 - 2 / math.sqrt(6))) < 1e-12
    assert abs(P.norm_isf(0.025) - 1.959963984540054) < 1e-9


def test_pvalue_even_df_chi2_and_large_df_t():
    x = 7.3
    closed = math.exp(-x / 2) * (1 + x / 2)          # chi-square sf, 4 degrees of freedom
    assert abs(P.chi2_sf(x, 4) - closed) < 1e-12
    assert abs(P.t_sf(1.5, 1e7) - P.norm_sf(1.5)) < 1e-6
    assert abs(P.t_sf(-1.0, 1) - 0.75) < 1e-12


def test_spearman_matrix_ranks_large_longs_in_their_own_type(spark):
    df = spark.createDataFrame([((1 << 53) + i, i) for i in range(3)], "x long, y long")
    m = {(r.x, r.y): r.rho for r in RK.spearman_matrix(df, ["x", "y"]).collect()}
    assert abs(m[("x", "y")] - 1) < 1e-12


def test_mann_whitney_counts_a_row_in_both_groups(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 0, 2.0), (0, 1, 3.0), (None, 1, 4.0), (0, 0, 5.0)], "a int, b int, v double")
    r = H.mann_whitney_stats(df, F.col("a") == 1, F.col("b") == 1, "v").collect()[0]
    assert (r.n_a, r.n_b) == (2, 3) and r.u == 1.5
