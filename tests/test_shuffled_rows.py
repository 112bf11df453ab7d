"""How much of the rows travels: few shuffles, narrow rows, and results against plain Python on rows of our own."""

import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.operators import clustering as K
from panelspark.operators import forest as FO
from panelspark.operators import models as M
from panelspark.operators import points as P
from panelspark.sources import responses as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _item_tables(spark, folder):
    lines = [  # order, part, supplier, quantity, discount, tax, return flag, line status
        (1, 1, 7, 10.0, 0.10, 0.08, "N", "O"), (1, 1, 7, 20.0, 0.00, 0.02, "A", "F"), (1, 2, None, 5.0, 0.04, 0.00, "R", "F"),
        (1, 2, None, None, None, 0.04, None, "F"), (2, 2, 9, 150.0, 0.02, 0.02, "N", None), (2, 3, 8, 1.0, 0.02, 0.02, "X", "O"),
        (3, 3, 1, None, None, None, None, None), (None, 1, 1, 1.0, 0.0, 0.0, "N", "O"), (4, 99, 1, 1.0, 0.0, 0.0, "N", "O")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string").withColumn(
        "l_shipdate", F.expr("timestamp_ntz'1995-01-01 00:00:00'")).write.parquet(f"{folder}/lineitem.parquet")
    parts = [(1, "ECONOMY", 1), (2, "PROMO", 17), (3, None, 25), (3, "no such type", 9)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return lines, parts


def _shuffled_strings(df):
    """Names of the string columns that any exchange of a plan carries."""
    found, nodes = set(), [df._jdf.queryExecution().executedPlan().initialPlan()]
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            columns = [node.output().apply(i) for i in range(node.output().size())]
            found |= {c.name() for c in columns if c.dataType().simpleString() == "string"}
        nodes += below
    return found


def test_joins_of_large_parts_shuffle_codes_instead_of_strings(spark, tmp_path):
    sf = str(tmp_path)
    _item_tables(spark, sf)
    day = F.expr("timestamp_ntz'1994-12-01 00:00:00'")
    orders = [(1, 1, "F", 130000.0, "1-URGENT"), (2, 2, None, None, "5-LOW"), (3, 3, "zz", 10.0, "2-HIGH"), (9, 1, "P", 9e9, "3-MEDIUM"),
              (8, 7, "O", 1.0, "no customer")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
                          ).withColumn("o_orderdate", day).write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame([(1, 0, 5.0, "BUILDING"), (2, 1, None, None), (3, 1, -1.0, "none")],
                          "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{sf}/customer.parquet")
    spark.createDataFrame([(0, 4), (1, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{sf}/nation.parquet")
    spark.createDataFrame([(0,), (4,)], "r_regionkey int").write.parquet(f"{sf}/region.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")   # as on large tables: the planner broadcasts neither part nor customer
    try:
        df = R.responses(spark, sf)
        assert _shuffled_strings(df) <= {"priority"}   # the first letter of the order's priority
        got = {r["id"]: r for r in df.collect()}
    finally:
        spark.conf.set(key, before)
    answers = {k: (r["gender"], r["spending"], r["follows_influencers"], r["trust_factor"], r["product_interest_score"]) for k, r in got.items()}
    top = S.SPENDING_LEVELS[3]
    assert answers == {1: ("Female", S.SPENDING_LEVELS[1], "Yes", "Transparency in reviews", 5), 2: (None, top, "No", None, 1),
                       3: (None, S.SPENDING_LEVELS[0], "No", None, 4), 9: ("Other", top, "Yes", "Transparency in reviews", 3)}
    assert got[9]["platforms"] is None and got[1]["platforms"] == "Instagram;Snapchat" and got[1]["purchase_freq"] == S.PURCHASE_LEVELS[1]


def test_items_travel_by_order_once_and_answers_match_plain_python(spark, tmp_path):
    lines, parts = _item_tables(spark, str(tmp_path))
    df = R.order_items(spark, str(tmp_path))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _plan(df))
    assert len(keys) <= 3 and not any("l_suppkey" in k for k in keys)   # lineitem and part by part, the items by order
    assert sum("Aggregate" in line and "l_suppkey" in line for line in _plan(df).splitlines()) == 0
    got = {r["id"]: r for r in df.collect() if r["id"] is not None}
    assert set(got) == {1, 2, 3}
    for order, r in got.items():
        rows = [(x, p) for x in lines for p in parts if x[0] == order and x[1] == p[0]]
        suppliers = len({x[2] for x, _ in rows})
        qty = [x[3] for x, _ in rows if x[3] is not None]
        band = next((i for i, c in enumerate(R.QTY_CUTS) if qty and sum(qty) < c), 3)
        assert r["daily_time"] == S.DAILY_TIME_LEVELS[band]
        assert r["engagement_freq"] == S.ENGAGEMENT_LEVELS[next((i for i, c in enumerate(R.SUPPLIER_CUTS) if suppliers <= c), 3)]
        flags = [x[6] for x, _ in rows if x[6] is not None]
        assert r["purchase_freq"] == S.PURCHASE_LEVELS[min(4, flags.count("N")) if flags else 4]
        assert r["ad_click_freq"] == S.AD_CLICK_LEVELS[min(3, flags.count("R")) if flags else 3]
        cents = [round(x[4] * 100) for x, _ in rows if x[4] is not None]
        assert r["satisfaction_score"] == (min(5, 1 + sum(cents) // (2 * len(rows))) if cents else 5)
        assert r["searched_product"] == ("Yes" if any(x[7] == "O" for x, _ in rows) else "No")
        assert r["platforms"] == ";".join(sorted({R.PART_TYPE_TO_PLATFORM[p[1]] for _, p in rows if p[1] in R.PART_TYPE_TO_PLATFORM}))
        both = {R.FLAGS_TO_MOTIVATION.get(x[6] + x[7]) for x, _ in rows if x[6] and x[7]} - {None}
        assert r["purchase_motivation"] == ";".join(sorted(both))
        assert r["content_type"] == ";".join(sorted({S.CONTENT_TYPES[(p[2] - 1) // 8] for _, p in rows}))


def _answers(spark, n=600):
    rows = [(i // 2 if i < 40 else i, i % 3 == 0, float(i * 7 % 4), float(i * 13 % 3)) for i in range(n)]  # the first keys repeat
    return spark.createDataFrame([(k, int(y), a, b) for k, y, a, b in rows], "id long, y int, a double, b double")


def test_split_is_a_filter_that_moves_no_rows_and_takes_the_exact_share_of_repeated_keys(spark):
    df = _answers(spark).where("id >= 20")
    for side in M.split(df, 0.75, "id", 42, "y"):
        assert "Exchange hashpartitioning" not in _plan(side) and "rangepartitioning" not in _plan(side)
    for rows, by in ((df, None), (df, "y"), (_answers(spark), None), (_answers(spark), "y"), (df.union(df), "y"), (df.where("id < 21"), "y"),
                     (df.where("id < 0"), "y"), (df.withColumn("id", F.lit(5).cast("long")), "y")):
        for frac in (0.75, 0.5):
            train, test = (sorted(map(tuple, d.collect())) for d in M.split(rows, frac, "id", 42, by))
            every = sorted(map(tuple, rows.collect()))
            assert sorted(train + test) == every
            for c in {r[1] for r in every} if by else {None}:
                of = lambda part: sum(1 for r in part if by is None or r[1] == c)
                assert of(train) == math.floor(of(every) * frac + 0.5)
            order = lambda r: (by and r[1], hashlib.md5(f"{r[0]}:42".encode()).hexdigest())
            last = {}
            for r in train:
                last[order(r)[0]] = max(last.get(order(r)[0], ""), order(r)[1])
            assert all(order(r)[1] >= last.get(order(r)[0], "") for r in test)


def test_forest_points_draw_weights_behind_the_shuffle(spark):
    df = _answers(spark)
    seen = {}
    for id_, y, a, b in map(tuple, df.collect()):
        words = [hashlib.md5(f"{id_}:7:{k}".encode()).hexdigest() for k in range(2)]
        draws = [int("".join(words)[4 * t: 4 * t + 4], 16) for t in range(11)]
        cell = seen.setdefault((a, b, y), [0] * 12)
        for t, d in enumerate(draws):
            cell[t] += sum(d >= s for s in FO.poisson_steps())
        cell[11] += 1
    for bootstrap in (True, False):
        got = {}
        for r in FO.forest_points(df.repartition(5), ["a", "b"], "y", "id", 11, 7, bootstrap=bootstrap).collect():
            cell = got.setdefault((*r["x"], r["label"]), [0] * 12)
            for t, w in enumerate([*r["w"], r["n"]]):
                cell[t] += w
        assert got == (seen if bootstrap else {k: [c[11]] * 12 for k, c in seen.items()})


def test_cross_validation_scores_points_not_rows(spark, monkeypatch):
    df = _answers(spark)
    points = FO.forest_points(M.contiguous_folds(df, 3, "id", "y"), ["a", "b"], "y", "id", 4, 42, "fold")
    forest = FO.grow(points, 2, 4, 2, 42, folds=3)
    rows = FO.predicted(M.contiguous_folds(df, 3, "id", "y"), forest, ["a", "b"], "y", "id", 4, "fold")
    want = sorted((r["fold"], round(r["auc"], 9)) for r in M.auc_by(rows, "fold").collect())
    monkeypatch.setattr(M, "predicted", None)
    got = M.forest_cv_auc(df, ["a", "b"], "y", k=3, trees=4, depth=2).collect()
    assert sorted((r["fold"], round(r["auc"], 9)) for r in got) == want


def test_scaled_points_are_pinned_and_wide_points_find_the_same_centres(spark):
    rnd = np.random.default_rng(5)
    cols = [f"c{j}" for j in range(20)]
    df = spark.createDataFrame([(i, *map(float, rnd.normal(size=20))) for i in range(90)], ["id", *cols])
    points, _ = P.weighted_points(df, cols)
    assert not any(word in _plan(points) for word in ("Project", "Exchange", "Aggregate"))   # a round reads, and scales nothing
    x = rnd.integers(-2, 3, (400, 20)).astype(float)              # many equal distances
    fits = [x[:5].copy(), np.concatenate([x[7:9], x[7:9]]), x[20:21] + 1e-7]
    for (place, units), centres in zip(K._nearest(x, fits), fits):
        want = K._units(x, centres)
        assert (place == want.argmin(1)).all() and (np.abs(units - want.min(1)) <= 1).all() and (units[want.min(1) == 0] == 0).all()
    pids = np.array([0, 7, -3, 2 ** 60])
    assert K._uniforms(pids, 42, 3, 1).tolist() == [
        (int(hashlib.md5(f"{p}:42:3:1".encode()).hexdigest()[:13], 16) + 0.5) / 16.0 ** 13 for p in pids.tolist()]
