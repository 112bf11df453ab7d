"""Post-hoc test, k-means, silhouettes, components, folds, forests and rank matrices against plain Python."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import clustering as K
from panelspark.operators import forest as FO
from panelspark.operators import hypothesis as H
from panelspark.operators import models as M
from panelspark.operators import ranks as RK


@pytest.fixture(scope="module")
def answers(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        a, b = rng.randint(1, 4), rng.randint(1, 5)
        c = min(5, max(1, a + rng.randint(-1, 1)))
        rows.append((i, a, b if rng.random() > 0.05 else None, c, float(rng.choice([0.0, 0.5, 1.0])), int(a + b + rng.randint(-2, 2) > 6)))
    return spark.createDataFrame(rows, "id long, a int, b int, c int, d double, y int").repartition(5).cache()


def _complete(df, cols):
    return sorted([tuple(r) for r in df.select("id", *cols).dropna().collect()])


# -- Dunn ------------------------------------------------------------------------------------------
def _dunn(groups):
    pooled = pd.Series([v for g in groups.values() for v in g])
    ranks, n, at = pooled.rank(), len(pooled), 0
    mean = {}
    for g, values in groups.items():
        mean[g] = ranks.iloc[at: at + len(values)].mean()
        at += len(values)
    tie = sum(t ** 3 - t for t in Counter(pooled).values())
    out = []
    for a, b in itertools.combinations(sorted(groups), 2):
        var = (n * (n + 1) / 12 - tie / (12 * (n - 1))) * (1 / len(groups[a]) + 1 / len(groups[b]))
        z = (mean[a] - mean[b]) / math.sqrt(var)
        out.append([a, b, z, math.erfc(abs(z) / math.sqrt(2))])
    m, top = len(out), 0.0
    for i, row in enumerate(sorted(out, key=lambda r: (r[3], r[0], r[1]))):
        top = max(top, min(1.0, (m - i) * row[3]))
        row += [min(1.0, m * row[3]), top]
    return out


@pytest.mark.parametrize("high_cardinality", [True, False])
def test_dunn(spark, high_cardinality):
    rng = random.Random(3)
    groups = {"p": [rng.randint(1, 5) for _ in range(40)], "q": [rng.randint(2, 6) for _ in range(25)], "r": [rng.randint(1, 5) for _ in range(33)],
              "s": [rng.randint(4, 9) for _ in range(12)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("few", 1)] * 4 + [(None, 2), ("p", None)]
    got = H.dunn(spark.createDataFrame(rows, "g string, v int"), high_cardinality=high_cardinality).collect()
    want = {(r[0], r[1]): r[2:] for r in _dunn(groups)}
    assert {(r.a, r.b) for r in got} == set(want)
    for r in got:
        assert np.allclose([r.z, r.p_value, r.p_bonferroni, r.p_holm], want[r.a, r.b], atol=1e-9)
        assert r.decision == ("REJECT H0" if r.p_holm < 0.05 else "FAIL TO REJECT H0")


def test_dunn_of_constant_values_and_single_groups(spark):
    flat = spark.createDataFrame([("a", 1)] * 6 + [("b", 1)] * 6, "g string, v int")
    row = H.dunn(flat).collect()
    assert len(row) == 1 and row[0].z is None and row[0].p_holm is None and row[0].decision is None
    assert H.dunn(flat.where("g = 'a'")).count() == 0 and H.dunn(flat.where("false")).count() == 0


# -- k-means and silhouettes -----------------------------------------------------------------------
def _silhouette(x, labels, squared):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d = d if squared else np.sqrt(d)
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) - {own})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("distance,blocks", [("euclidean", None), ("euclidean", 3), ("squared", 2)])
def test_silhouettes_equal_all_pairs(answers, distance, blocks):
    cols = ["a", "b", "c"]
    points, stats = K.weighted_points(answers, cols)
    fits = {k: c for k, (c, _, _) in K.fit_all(points, [2, 4], 3, starts=3).items()}
    got = K.silhouettes(points, fits, distance, blocks)
    x = np.array([r[1:] for r in _complete(answers, cols)], float)
    assert np.allclose([stats[c] for c in cols], np.c_[x.mean(0), x.std(0)])
    x = (x - x.mean(0)) / x.std(0)
    for k, centres in fits.items():
        labels = K._units(x, centres).argmin(1)
        assert abs(got[k] - _silhouette(x, labels, distance == "squared")) < 1e-9


def test_kmeans_is_settled_and_repeats(spark, answers):
    cols = ["a", "b", "c"]
    assigned, centres, _, cost = K.kmeans(answers, cols, k=3, n_init=4)
    again = K.kmeans(answers.repartition(9), cols, k=3, n_init=4)
    assert np.allclose(centres, again[1], atol=1e-9) and abs(cost - again[3]) < 1e-6
    rows = assigned.collect()
    x = np.array([[r[c] for c in cols] for r in rows], float)
    z = (x - x.mean(0)) / x.std(0)
    nearest = ((z[:, None] - np.array(centres)[None]) ** 2).sum(2)
    assert [r.cluster - 1 for r in rows] == nearest.argmin(1).tolist() and abs(nearest.min(1).sum() - cost) < 1e-5
    sizes = Counter(r.cluster for r in rows)
    assert sizes[1] >= sizes[2] >= sizes[3] > 0


def test_kmeans_of_few_and_no_points(spark):
    two = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0), (4, None)], "id long, a double")
    assigned, centres, _, cost = K.kmeans(two, ["a"], k=5, n_init=2)
    assert {r.id: r.cluster for r in assigned.collect()} == {1: 1, 2: 1, 3: 2} and len(centres) == 2 and cost == 0
    same, centres, _, _ = K.kmeans(two.where("id < 3"), ["a"], k=2, n_init=2)
    assert [r.cluster for r in same.collect()] == [1, 1] and len(centres) == 1
    none, centres, _, _ = K.kmeans(two.where("false"), ["a"], k=2, n_init=2)
    assert none.count() == 0 and centres == [] and K.k_scan(two.where("false"), ["a"]).count() == 0
    assert [r.silhouette for r in K.k_scan(two.where("id < 3"), ["a"], ks=[2]).collect()] == [None]


# -- components ------------------------------------------------------------------------------------
def test_jacobi_equals_numpy():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 30):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        values, vectors = M.jacobi_eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1]) and np.allclose(vectors @ np.diag(values) @ vectors.T, a)
        assert (vectors[np.abs(vectors).argmax(0), np.arange(n)] > 0).all()
    values, vectors = M.jacobi_eigen(np.eye(4))  # equal eigenvalues keep the features' order
    assert (vectors == np.eye(4)).all() and (values == 1).all()


def test_components_of_rows(answers):
    cols = ["a", "b", "c", "d"]
    x = np.array([r[1:] for r in _complete(answers, cols)], float)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    scree = M.pca_scree(answers, cols).orderBy("component").collect()
    assert np.allclose([r.explained_pct for r in scree], values[::-1] / values.sum() * 100)
    first = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    rows = {r.id: r.pc1 for r in M.pca_project(answers, cols, k=1).collect()}
    assert np.allclose([rows[r[0]] for r in _complete(answers, cols)], z @ first)
    assert [r.explained_pct for r in M.pca_scree(answers.where("false"), cols).collect()] == [None] * 4


# -- folds and rank matrices -----------------------------------------------------------------------
def test_folds_by_subtraction_equal_fits_over_rows(answers):
    cols = ["a", "b", "d"]
    folded = M.contiguous_folds(answers.select("id", F.col("c").cast("double").alias("c"), *cols).dropna(), 4).collect()
    got = {r.fold: r.r2 for r in M.cross_validate_ols(answers, cols, "c", k=4).collect()}
    for f in range(4):
        train, test = [r for r in folded if r.fold != f], [r for r in folded if r.fold == f]
        x, t = (np.array([[1.0, *(r[c] for c in cols)] for r in rows]) for rows in (train, test))
        beta = np.linalg.lstsq(x, np.array([r.c for r in train]), rcond=None)[0]
        y = np.array([r.c for r in test])
        assert abs(got[f] - (1 - ((y - t @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


@pytest.mark.parametrize("mode,high_cardinality", [("pairwise", True), ("pairwise", False), ("listwise", True), ("listwise", False)])
def test_rank_matrix_equals_pandas(spark, answers, mode, high_cardinality):
    big = 2 ** 60
    df = answers.withColumn("b", F.col("b").cast("long") + F.lit(big)).withColumn("e", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("c") * 1.5))
    cols = ["a", "b", "d", "e"]
    table = pd.DataFrame([[r[c] for c in cols] for r in answers.withColumn("e", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("c") * 1.5)).collect()],
                         columns=cols, dtype=float)
    want = (table.dropna() if mode == "listwise" else table).corr(method="spearman")
    rows = RK.spearman_matrix(df, cols, mode, high_cardinality).collect()
    assert len(rows) == 16
    for r in rows:
        assert abs(r.rho - want.loc[r.x, r.y]) < 1e-9
        assert r.n == len(table.dropna() if mode == "listwise" else table[[r.x, r.y]].dropna())


def test_rank_matrix_of_nothing(spark, answers):
    for mode in ("pairwise", "listwise"):
        rows = RK.spearman_matrix(answers.where("false"), ["a", "b"], mode).collect()
        assert len(rows) == 4 and all(r.n == 0 for r in rows) and all(r.rho is None for r in rows if r.x != r.y)


# -- forest ----------------------------------------------------------------------------------------
def _poisson(key, tree, seed):
    word = int(hashlib.md5(f"{key}:{seed}:{tree // 8}".encode()).hexdigest()[4 * (tree % 8): 4 * (tree % 8) + 4], 16)
    k, total, term = 0, math.exp(-1), math.exp(-1)
    while k < len(FO.poisson_steps()) and word >= math.floor(total * 65536):
        k += 1
        term /= k
        total += term
    return k


def _tree(rows, depth, seed, tree, width, node=1, gains=None):
    """``rows`` of (features, label, weight); the tree as nested tuples."""
    zeros, ones = (sum(w for _, y, w in rows if y == c) for c in (0, 1))
    best = None
    if node < 1 << depth and zeros and ones:
        for f in FO.tried_features(seed, tree, node, width):
            for v in sorted({x[f] for x, _, _ in rows})[:-1]:
                l0, l1 = (sum(w for x, y, w in rows if y == c and x[f] <= v) for c in (0, 1))
                r0, r1 = zeros - l0, ones - l1
                gain = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1) - (zeros * zeros + ones * ones) / (zeros + ones)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, f, v
    if best is None:
        return ones / (zeros + ones)
    gains[best[1]] += best[0]
    sides = ([r for r in rows if r[0][best[1]] <= best[2]], [r for r in rows if r[0][best[1]] > best[2]])
    return best[1], best[2], *(_tree(s, depth, seed, tree, width, 2 * node + i, gains) for i, s in enumerate(sides))


def _leaf(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def test_forest_equals_plain_trees(answers):
    cols, trees, depth, seed = ["a", "b", "c", "d"], 11, 3, 42
    imp, pred = M.forest_importance(answers, cols, "y", trees=trees, depth=depth)
    base = answers.select("id", "y", *cols).dropna()
    train, test = (sorted(map(tuple, d.collect())) for d in M.split(base, 0.75, "id", seed, "y"))
    forest, importance = [], np.zeros(4)
    for t in range(trees):
        gains = [0.0] * 4
        rows = [(r[2:], r[1], _poisson(r[0], t, seed)) for r in train]
        forest.append(_tree([r for r in rows if r[2]], depth, seed, t, 4, 1, gains))
        importance += np.array(gains) / max(sum(gains), 1e-300)
    assert np.allclose([r.importance for r in sorted(imp.collect(), key=lambda r: cols.index(r.feature))], importance / importance.sum())
    got = {r.id: (r.label, r.score, r.prediction) for r in pred.collect()}
    assert len(got) == len(test)
    for r in test:
        score = np.mean([_leaf(t, r[2:]) for t in forest])
        assert got[r[0]][0] == r[1] and abs(got[r[0]][1] - score) < 1e-8 and got[r[0]][2] == int(score > 0.5)


def test_forest_folds_and_wide_features(spark, answers):
    cols, k = ["a", "c", "d"], 3
    cv = {r.fold: r.auc for r in M.forest_cv_auc(answers, cols, "y", k=k, trees=4, depth=2).collect()}
    folded = M.contiguous_folds(answers.select("id", "y", *cols).dropna(), k, "id", stratify="y")
    for f in range(k):
        model = FO.grow(FO.forest_points(folded.where(F.col("fold") != f), cols, "y", "id", 4, 42), 3, 4, 2, 42)
        one = M.auc(FO.predicted(folded.where(F.col("fold") == f), model, cols, "y", "id", 4)).first()["auc"]
        assert abs(one - cv[f]) < 1e-12
    noisy = answers.withColumn("e", F.col("y") + F.col("id") / 1000.0)  # 400 values, cut at 256 quantiles; separates the classes
    imp, pred = M.forest_importance(noisy, ["e"], "y", trees=5, depth=3)
    assert M.auc(pred).first()["auc"] > 0.97 and imp.first()["importance"] == 1.0
