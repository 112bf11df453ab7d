"""Random forests (M10, M11) grown level by level from Gini histograms of distinct weighted rows.

Rows that agree in features, label and fold become one point.  A tree's bootstrap gives every *row* a Poisson(1) weight
from md5("key:seed:block"), sixteen bits for each of eight trees, and a point carries the sum of its rows' weights, so the
raw rows are read and shuffled once, without weights, however many trees and levels there are.  A level is one grouped aggregate for all nodes of all
trees of all folds: tasks send (tree, node, feature, value) histograms of two counts, whose sums give every split.  A node
tries sqrt(m) features, those with the smallest md5("seed:tree:node:feature").  Counts are whole numbers, so any engine
finds the same splits; equal gains go to the first feature, then the smallest value.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import checkpoint_dir

TREES_OF_A_DRAW = 8
#: A feature with more distinct values is cut at as many of its quantiles.
MAX_VALUES = 256
LEAST_GAIN = 1e-9


def poisson_steps() -> list[int]:
    """Sixteen-bit draws from which the weight grows by one: the cumulative Poisson(1) probabilities."""
    out, term, total = [], math.exp(-1.0), 0.0
    for k in range(1, 10):
        total += term
        term /= k
        if total * 65536 >= 65535.5:
            break
        out.append(math.floor(total * 65536))
    return out


def _drawn(width: int, trees: int, bootstrap: bool):
    """Sums the weights of runs of equal rows: one row for each run of a batch."""
    blocks = [f":{b}".encode() for b in range(-(-trees // TREES_OF_A_DRAW))]
    weight_of = np.searchsorted(poisson_steps(), np.arange(65536), "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            new = np.ones(n, bool)
            new[1:] = (x[1:] != x[:-1]).any(1)
            for c in ("label", "fold"):
                v = batch.column(c).fill_null(-2).to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            first = np.flatnonzero(new)
            if bootstrap:
                heads = [k.encode() for k in batch.column("head").to_pylist()]
                words = b"".join([hashlib.md5(h + b, usedforsecurity=False).digest() for h in heads for b in blocks])
                weights = weight_of[np.frombuffer(words, ">u2").reshape(n, -1)[:, :trees]]
            else:
                weights = np.ones((n, trees), np.int64)
            sums = np.add.reduceat(weights, first, axis=0).astype(np.int64)
            at = pa.array(np.arange(0, sums.size + 1, trees), pa.int32())
            kept = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("x").take(kept), batch.column("label").take(kept), batch.column("fold").take(kept),
                 pa.ListArray.from_arrays(at, pa.array(sums.ravel())), pa.array(np.diff(np.append(first, n)), pa.int64())],
                names=["x", "label", "fold", "w", "n"])
    return run


def forest_points(rows: DataFrame, features: Sequence[str], label: str, key: str, trees: int, seed: int,
                  fold: str | None = None, bootstrap: bool = True) -> DataFrame:
    """``(x, label, fold, w, n)``: rows that agree in ``x``, label and fold, ``w`` their weight in every tree and ``n``
    their number.  Checkpointed.

    The rows travel once, with their key and before any weight is drawn, so that a tree adds nothing to the shuffle and
    no table of weights is held.  Equal rows come together there and are summed run by run.  A combination may come in a
    few points (a run that a batch or a split of a large partition cuts): all uses of the points are sums.
    """
    checkpoint_dir(rows.sparkSession)
    x = F.array(*[F.col(c).cast("double") for c in features])
    base = rows.select(F.concat_ws(":", F.col(key), F.lit(seed)).alias("head"), x.alias("x"), F.col(label).cast("int").alias("label"),
                       (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))
    near = base.withColumn("at", F.xxhash64("x", "label", "fold")).hint("rebalance", "at").sortWithinPartitions("at")
    return near.drop("at").mapInArrow(_drawn(len(features), trees, bootstrap),
                                      "x array<double>, label int, fold int, w array<long>, n long").checkpoint(eager=True)


def _binned(points: DataFrame, width: int) -> DataFrame:
    """Features of very many values are cut at their quantiles (a value becomes the next cut above it)."""
    many = points.agg(*[F.approx_count_distinct(F.col("x")[j]).alias(f"n{j}") for j in range(width)]).first()
    wide = [j for j in range(width) if (many[j] or 0) > MAX_VALUES]
    if not wide:
        return points
    at = [(i + 1) / MAX_VALUES for i in range(MAX_VALUES)]
    cuts = points.agg(*[F.percentile_approx(F.col("x")[j], at, 100_000).alias(f"c{j}") for j in wide]).first()
    def cut_above(j: int):
        value, edges = F.col("x")[j], F.array(*[F.lit(v) for v in sorted(set(cuts[f"c{j}"]))])
        return F.coalesce(F.array_min(F.filter(edges, lambda e: e >= value)), F.array_max(edges))

    cells = [cut_above(j) if j in wide else F.col("x")[j] for j in range(width)]
    return points.withColumn("x", F.array(*cells)).checkpoint(eager=True)


class Forest:
    """Trees in heap order (root 1, children 2n and 2n+1): split feature (-1: leaf), threshold and share of ones."""

    def __init__(self, trees: int, depth: int, width: int):
        size = 2 << depth
        self.feature = np.full((trees, size), -1)
        self.threshold = np.zeros((trees, size))
        self.share = np.zeros((trees, size))
        self.gain = np.zeros((trees, width))

    def nodes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row reaches in a tree."""
        at = np.ones(len(x), np.int64)
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                return at
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[tree, at]
            at = np.where(inner, 2 * at + right, at)

    def importances(self, trees: slice = slice(None)) -> np.ndarray:
        gain = self.gain[trees]
        totals = gain.sum(1, keepdims=True)
        each = np.divide(gain, totals, out=np.zeros_like(gain), where=totals > 0).sum(0)
        return each / each.sum() if each.sum() > 0 else each

    def scores(self, x: np.ndarray, trees: range) -> np.ndarray:
        """Mean share of ones over trees, to nine places."""
        total = np.zeros(len(x))
        for t in trees:
            total += self.share[t, self.nodes(x, t)]
        return np.floor(total / len(trees) * 1e9 + 0.5) / 1e9


def tried_features(seed: int, tree: int, node: int, width: int) -> list[int]:
    """The features that a node may split on."""
    count = max(1, math.isqrt(width))
    drawn = sorted(range(width), key=lambda f: hashlib.md5(f"{seed}:{tree}:{node}:{f}".encode(), usedforsecurity=False).hexdigest())
    return sorted(drawn[:count])


def _arrays(batch: pa.RecordBatch, trees: int):
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(n, trees)
    return x, w, batch.column("label").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)


def _histograms(forest: Forest, trees: int, folds: int, level: int, seed: int):
    """Counts of both labels by (tree, node, feature, value) for the open nodes of a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, w, label, fold = _arrays(batch, trees)
            columns = [np.unique(x[:, j], return_inverse=True) for j in range(x.shape[1])]
            out = []
            for t in range(trees * folds):
                weight = np.where(fold == t // trees, 0, w[:, t % trees]) if folds > 1 else w[:, t]
                node = forest.nodes(x, t)
                use = np.flatnonzero((weight > 0) & (node >= 1 << level))
                if len(use) == 0:
                    continue
                open_, at = np.unique(node[use], return_inverse=True)
                subset = np.zeros((len(open_), x.shape[1]), bool)
                for i, n in enumerate(open_.tolist()):
                    subset[i, tried_features(seed, t % trees, n, x.shape[1])] = True
                for j, (values, code) in enumerate(columns):
                    mine = subset[at, j]
                    if not mine.any():
                        continue
                    cell = at[mine] * len(values) + code[use[mine]]
                    ones = np.bincount(cell, weight[use[mine]] * label[use[mine]], len(open_) * len(values)).astype(np.int64)
                    both = np.bincount(cell, weight[use[mine]], len(open_) * len(values)).astype(np.int64)
                    hit = np.flatnonzero(both)
                    out.append((np.full(len(hit), t), open_[hit // len(values)], np.full(len(hit), j), values[hit % len(values)], both[hit] - ones[hit], ones[hit]))
            if out:
                tree, node, feature, value, zeros, ones = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(node, pa.int32()), pa.array(feature, pa.int32()),
                                                  pa.array(value, pa.float64()), pa.array(zeros, pa.int64()), pa.array(ones, pa.int64())],
                                                 names=["tree", "node", "feature", "value", "n0", "n1"])
    return run


def _best_splits(histograms: DataFrame) -> DataFrame:
    """One row for each node: its counts, and where a split gains, the best of them."""
    cells = histograms.groupBy("tree", "node", "feature", "value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    one = Window.partitionBy("tree", "node", "feature")
    before = one.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select("tree", "node", "feature", "value", F.sum("n0").over(before).cast("double").alias("l0"),
                         F.sum("n1").over(before).cast("double").alias("l1"), F.sum("n0").over(one).cast("double").alias("t0"),
                         F.sum("n1").over(one).cast("double").alias("t1"), F.lead("value").over(one.orderBy("value")).alias("next"))

    def purity(a, b):
        return F.coalesce(F.try_divide(a * a + b * b, a + b), F.lit(0.0))

    l0, l1, t0, t1 = (F.col(c) for c in ("l0", "l1", "t0", "t1"))
    gain = purity(l0, l1) + purity(t0 - l0, t1 - l1) - purity(t0, t1)
    cells = cells.withColumn("gain", F.when(F.col("next").isNotNull(), gain).otherwise(F.lit(-1.0)))
    key = F.struct(F.col("gain"), (-F.col("feature")).alias("f"), (-F.col("value")).alias("v"), "l0", "l1", "t0", "t1", "next")
    return cells.groupBy("tree", "node").agg(F.max(key).alias("b")).select("tree", "node", "b.*")


def grow(points: DataFrame, width: int, trees: int, depth: int, seed: int, folds: int = 1) -> Forest:
    """All trees, level by level.  With ``folds`` beyond 1 the trees are grown anew for each fold, without its rows:
    trees ``f * trees`` to ``(f + 1) * trees - 1`` belong to fold f.  The model (trees x 2**depth nodes) is what the
    driver holds; a level returns one row for each of its nodes."""
    forest = Forest(trees * folds, depth, width)
    points = _binned(points, width)
    schema = "tree int, node int, feature int, value double, n0 long, n1 long"
    for level in range(depth):
        rows = _best_splits(points.mapInArrow(_histograms(forest, trees, folds, level, seed), schema)).collect()
        if not rows:
            break
        for r in rows:
            t, n = r["tree"], r["node"]
            forest.share[t, n] = r["t1"] / (r["t0"] + r["t1"])
            if r["gain"] > LEAST_GAIN and r["t0"] > 0 and r["t1"] > 0:
                feature = -r["f"]
                forest.feature[t, n], forest.threshold[t, n] = feature, -r["v"]
                forest.gain[t, feature] += r["gain"]
                forest.share[t, 2 * n] = r["l1"] / (r["l0"] + r["l1"])
                forest.share[t, 2 * n + 1] = (r["t1"] - r["l1"]) / (r["t0"] - r["l0"] + r["t1"] - r["l1"])
    return forest


def scored_points(points: DataFrame, forest: Forest, width: int, trees: int) -> DataFrame:
    """``(label, fold, score, n)`` of points: a combination of answers is scored once, however many rows share it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            score = _scores(forest, x, batch.column("fold").to_numpy(zero_copy_only=False), trees)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("fold"), pa.array(score), batch.column("n")],
                                             names=["label", "fold", "score", "n"])
    return points.select("x", "label", "fold", "n").mapInArrow(run, "label int, fold int, score double, n long")


def _scores(forest: Forest, x: np.ndarray, fold: np.ndarray, trees: int) -> np.ndarray:
    """Each row's score by the trees of its fold."""
    score = np.zeros(len(x))
    for f in np.unique(fold).tolist():
        mine = fold == f
        first = max(f, 0) * trees
        score[mine] = forest.scores(x[mine], range(first, first + trees))
    return score


def predicted(rows: DataFrame, forest: Forest, features: Sequence[str], label: str, key: str, trees: int, fold: str | None = None) -> DataFrame:
    """``(key, label, prediction, score[, fold])``: a row's score is the mean share of ones in the leaves it reaches, of
    its fold's trees where ``fold`` is given; above one half it is predicted 1."""
    id_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features))
            score = _scores(forest, x, batch.column("fold").to_numpy(zero_copy_only=False), trees)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array((score > 0.5).astype(np.int32)),
                                              pa.array(score), batch.column("fold")], names=["key", "label", "prediction", "score", "fold"])

    x = F.array(*[F.col(c).cast("double") for c in features])
    base = rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), x.alias("x"),
                       (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))
    out = base.mapInArrow(run, f"key {id_type}, label int, prediction int, score double, fold int")
    return out.select(F.col("key").alias(key), "label", "prediction", "score", *(["fold"] if fold else []))
