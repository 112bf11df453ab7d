"""k-means segmentation (K1-K4) on standardized features, fitted on distinct weighted points.

The fit is one that any engine can repeat: seeds come from md5, not from a generator, and distances are compared in whole
billionths, so that the last bit of a sum decides nothing.

* Seeding is greedy k-means++.  Every point draws ``-ln(u) / (w d^2)`` with ``u`` from md5("pid:seed:start:step"); the
  three smallest draws are a weighted sample without replacement, and the one that leaves the least total distance
  becomes the next centre.  One sequence of centres for each start serves every k.
* A Lloyd round is one grouped aggregate for all k and all starts together: a task assigns its points and sends a row for
  each centre.  Fits whose centres hardly moved leave the rounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions.encode import standardize_exprs
from panelspark.functions.literals import local_table
from panelspark.operators.points import squared_distance, weighted_points

#: Candidates of a greedy seeding step, units in which distances are compared, Lloyd rounds at most, and the sum of
#: squared moves of all centres (standardized units) below which a fit has settled.
CANDIDATES, UNITS, MAX_ITER, TOLERANCE = 3, 1e9, 100, 1e-4
#: Points of more features than this are compared with centres by products of matrices.
WIDE = 16
#: Points of a block of the exact silhouette.
BLOCK = 2048


def _points_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    n = batch.num_rows
    return batch.column("pid").to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False), flat.reshape(n, len(flat) // max(n, 1))


def _units(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to centres (columns) in whole units."""
    out = np.empty((len(x), len(centres)), np.int64)
    for j, c in enumerate(centres):
        d = x - c
        out[:, j] = np.floor((d * d).sum(1) * UNITS + 0.5)
    return out


def _all_units(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances as ``_units``; of wide points by one product of matrices, which may be off by a unit."""
    if x.shape[1] <= WIDE:
        return _units(x, centres)
    near = (x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1)
    return np.floor(np.maximum(near, 0.0) * UNITS + 0.5).astype(np.int64)


def _nearest(x: np.ndarray, fits: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each fit the place of every point's nearest centre (the first of equally near ones) and its distance in units.

    Wide points meet the centres of all fits in one product of matrices; where that leaves the nearest centre open, or the
    distance too small for it, the differences themselves decide.
    """
    if x.shape[1] <= WIDE:
        for centres in fits:
            units = _units(x, centres)
            yield units.argmin(1), units.min(1)
        return
    every = np.concatenate(list(fits))
    size, others = (x * x).sum(1), (every * every).sum(1)
    near = size[:, None] - 2.0 * (x @ every.T) + others
    blur = 2.0 / UNITS + 1e-12 * (size + others.max(initial=0.0))
    at = 0
    for centres in fits:
        mine = near[:, at: at + len(centres)]
        at += len(centres)
        place, least = mine.argmin(1), mine.min(1)
        units = np.floor(np.maximum(least, 0.0) * UNITS + 0.5).astype(np.int64)
        open_ = np.flatnonzero(((mine <= (least + blur)[:, None]).sum(1) > 1) | (least <= blur))
        if len(open_):
            exact = _units(x[open_], centres)
            place[open_], units[open_] = exact.argmin(1), exact.min(1)
        yield place, units


def _uniforms(pids: np.ndarray, seed: int, start: int, step: int) -> np.ndarray:
    """Of each point a number between 0 and 1 from the first thirteen hex digits of md5("pid:seed:start:step")."""
    tail = f":{seed}:{start}:{step}".encode()
    heads = b"".join([hashlib.md5(b"%d" % p + tail, usedforsecurity=False).digest()[:8] for p in pids.tolist()])
    return ((np.frombuffer(heads, ">u8") >> np.uint64(12)).astype(np.float64) + 0.5) / 16.0 ** 13


def _draws(centres: dict[int, np.ndarray], seed: int, starts: int, step: int, keep: int):
    """Each task's smallest draws of every start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, w, x = _points_of(batch)
            rows: list[tuple] = []
            for s in range(starts):
                weight = w.astype(np.float64)
                if step:
                    weight = weight * next(_nearest(x, [centres[s]]))[1]
                some = np.flatnonzero(weight > 0)
                draw = -np.log(_uniforms(pid[some], seed, s, step)) / weight[some]
                best = np.lexsort((pid[some], draw))[:keep]
                rows += [(s, float(draw[b]), int(pid[some[b]]), x[some[b]].tolist()) for b in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.float64()))],
                names=["start", "draw", "pid", "x"])
    return run


def _potentials(centres: dict[int, np.ndarray], tried: dict[int, np.ndarray]):
    """What the total distance of each start would be with each candidate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, w, x = _points_of(batch)
            rows = []
            for s, candidates in tried.items():
                near = next(_nearest(x, [centres[s]]))[1]
                total = (np.minimum(near[:, None], _all_units(x, candidates)) * w[:, None].astype(np.float64)).sum(0)
                rows += [(s, c, float(t)) for c, t in enumerate(total)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2] for r in rows], pa.float64())], names=["start", "candidate", "total"])
    return run


def seed_centres(points: DataFrame, k: int, starts: int, seed: int) -> dict[int, np.ndarray]:
    """Up to ``k`` first centres of every start, in the order drawn (fewer where there are fewer distinct points)."""
    weight = points.agg(F.sum("w")).first()[0] or 0
    centres: dict[int, np.ndarray] = {}
    best = Window.partitionBy("start").orderBy("draw", "pid")
    for step in range(k):
        keep = CANDIDATES if step else 1
        drawn = points.mapInArrow(_draws(centres, seed, starts, step, keep), "start int, draw double, pid long, x array<double>")
        # at most three rows for each start
        rows = drawn.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).orderBy("start", "n").collect()
        tried = {s: np.array([r["x"] for r in rows if r["start"] == s]) for s in sorted({r["start"] for r in rows})}
        if not tried:
            break
        if step == 0:
            centres = tried
            continue
        totals = points.mapInArrow(_potentials(centres, tried), "start int, candidate int, total double") \
            .groupBy("start", "candidate").agg(F.sum("total").alias("total")).collect()
        mean = {(r["start"], r["candidate"]): math.floor(r["total"] / weight / UNITS * 1e6 + 0.5) for r in totals}
        for s, candidates in tried.items():
            pick = min(range(len(candidates)), key=lambda c: (mean[s, c], c))
            centres[s] = np.vstack([centres[s], candidates[pick]])
    return centres


def _round(fits: dict[tuple[int, int], np.ndarray], names: list[str]):
    """Sums of weights, features and distances of the points next to each centre."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, w, x = _points_of(batch)
            keys, sums = [], []
            weighted = w[:, None] * x if x.shape[1] > WIDE else None
            for ((k, s), centres), (nearest, units) in zip(fits.items(), _nearest(x, list(fits.values()))):
                cost = w * (units / UNITS)
                if weighted is None:
                    columns = [w.astype(np.float64), cost, *(w * x[:, j] for j in range(x.shape[1]))]
                    table = np.stack([np.bincount(nearest, c, len(centres)) for c in columns], 1)
                else:
                    member = (nearest == np.arange(len(centres))[:, None]).astype(np.float64)
                    table = np.concatenate([member @ np.stack([w.astype(np.float64), cost], 1), member @ weighted], 1)
                keys += [(k, s, c) for c in range(len(centres))]
                sums.append(table)
            table = np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in keys], pa.int32()) for i in range(3)]
                                             + [pa.array(table[:, j], pa.float64()) for j in range(table.shape[1])], names=["k", "start", "c", *names])
    return run


def fit_all(points: DataFrame, ks: Sequence[int], dims: int, starts: int = 10, seed: int = 42,
            max_iter: int = MAX_ITER) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """K1 for several k at once: of each k the ``(centres, weights, cost)`` of its best start (lowest cost, then first)."""
    seeds = seed_centres(points, max(ks), starts, seed)
    names = ["w", "cost", *[f"s{j}" for j in range(dims)]]
    schema = "k int, start int, c int, " + ", ".join(f"{n} double" for n in names)
    open_ = {(k, s): c[:k] for k in ks for s, c in seeds.items()}
    done: dict[tuple[int, int], tuple] = {}
    for turn in range(max_iter + 1):
        if not open_:
            break
        # a row for each centre of each fit
        rows = points.mapInArrow(_round(open_, names), schema).groupBy("k", "start", "c").agg(*[F.sum(n).alias(n) for n in names]).collect()
        by_fit: dict[tuple[int, int], list] = {}
        for r in rows:
            by_fit.setdefault((r["k"], r["start"]), []).append(r)
        moved = {}
        for fit, found in by_fit.items():
            old = open_[fit]
            new, weights, cost = old.copy(), np.zeros(len(old)), 0.0
            for r in found:
                weights[r["c"]] = r["w"]
                cost += r["cost"]
                if r["w"] > 0:  # a centre without points stays where it is
                    new[r["c"]] = [r[f"s{j}"] / r["w"] for j in range(dims)]
            if np.square(new - old).sum() <= TOLERANCE or turn == max_iter:
                done[fit] = old, weights, cost
            else:
                moved[fit] = new
        open_ = moved
    out = {}
    for k in ks:
        starts_of = [s for kk, s in done if kk == k]
        if starts_of:
            weight = max(1.0, done[k, starts_of[0]][1].sum())
            out[k] = done[k, min(starts_of, key=lambda s: (math.floor(done[k, s][2] / weight * 1e6 + 0.5), s))]
    return out


def _in_order(centres: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters by falling size, then by their first coordinates."""
    order = sorted(range(len(centres)), key=lambda j: (-weights[j], np.round(centres[j], 6).tolist()))
    return centres[order], weights[order]


def nearest_cluster(cols: Sequence[str], stats: dict, centres: np.ndarray) -> Column:
    """Number from 1 of the centre next to a row (the first of equally near ones), as one expression."""
    z = list(standardize_exprs({c: stats[c] for c in cols}).values())
    return F.array_min(F.array(*[F.struct(F.floor(squared_distance(z, c) * UNITS + 0.5).alias("d"), F.lit(j + 1).alias("j"))
                                 for j, c in enumerate(centres)]))["j"]


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, n_init: int = 10, seed: int = 42,
           keep: Sequence[str] = ("id",), key: str = "id"):
    """K1: best of ``n_init`` seeded fits (lowest within-cluster sum of squares).

    Returns ``(assigned, centers, stats, cost)``: the complete rows with a ``cluster`` id from 1 by falling cluster size;
    ``centers`` are in standardized units.  Fewer distinct rows than ``k`` give as many clusters as there are; an empty
    table gives none.
    """
    points, stats = weighted_points(df, cols, key)
    fits = fit_all(points, [k], len(cols), n_init, seed)
    rows = df.select(*dict.fromkeys([*keep, *cols])).dropna(subset=list(cols))
    if not fits:
        return rows.withColumn("cluster", F.lit(None).cast("int")), [], stats, 0.0
    centres, weights, cost = fits[k]
    centres, _ = _in_order(centres, weights)
    return rows.withColumn("cluster", nearest_cluster(cols, stats, centres)), centres.tolist(), stats, cost


# -- silhouette (K2) -------------------------------------------------------------------------------
def _labelled(points: DataFrame, fits: dict[int, np.ndarray]) -> DataFrame:
    """Points with the cluster (from 0) that each k gives them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, x = _points_of(batch)
            labels = np.stack([place for place, _ in _nearest(x, list(fits.values()))], 1).astype(np.int32)
            flat = pa.array(labels.ravel(), pa.int32())
            at = pa.array(np.arange(0, labels.size + 1, labels.shape[1]), pa.int32())
            yield batch.append_column("labels", pa.ListArray.from_arrays(at, flat))
    return points.mapInArrow(run, "pid long, w long, x array<double>, labels array<int>")


def _distance_sums(offsets: list[int], width: int, squared: bool):
    """Of one block's points the weighted distances to the points of another, summed over each cluster of each k."""
    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        one, other = one.combine_chunks(), other.combine_chunks()
        pid, _, x = _points_of(one.to_batches()[0]) if one.num_rows else (np.empty(0, np.int64), None, None)
        if one.num_rows == 0 or other.num_rows == 0:
            return pa.table({"pid": pa.array([], pa.int64())} | {f"d{j}": pa.array([], pa.float64()) for j in range(width)})
        batch = other.to_batches()[0]
        _, w, y = _points_of(batch)
        labels = batch.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(len(w), -1)
        member = np.zeros((len(w), width))
        for i, offset in enumerate(offsets):
            member[np.arange(len(w)), offset + labels[:, i]] = w
        out = np.empty((len(pid), width))
        for lo in range(0, len(pid), 128):
            part = x[lo: lo + 128]
            d = np.zeros((len(part), len(w)))
            for j in range(x.shape[1]):
                d += np.square(part[:, j, None] - y[None, :, j])
            out[lo: lo + 128] = (d if squared else np.sqrt(d)) @ member
        return pa.table({"pid": pa.array(pid, pa.int64())} | {f"d{j}": pa.array(out[:, j], pa.float64()) for j in range(width)})
    return run


def silhouettes(points: DataFrame, fits: dict[int, np.ndarray], distance: str = "euclidean", blocks: int | None = None) -> dict[int, float | None]:
    """K2: mean silhouette of every row for each k, from distinct weighted points.

    Exact: every block of points meets every other, and only sums over clusters leave a task, never pairs.  The work is
    the square of the number of *distinct* points; memory is that of two blocks.  A row's own copies are at distance 0,
    a row alone in its cluster scores 0, one cluster alone has no silhouette (null).  ``distance="squared"`` takes squared
    Euclidean distances.
    """
    if distance not in ("euclidean", "squared"):
        raise ValueError("distance is 'euclidean' or 'squared'")
    ks = [k for k, c in fits.items() if len(c) > 1]
    out: dict[int, float | None] = {k: None for k in fits}
    if not ks:
        return out
    offsets, width = [], 0
    for k in ks:
        offsets.append(width)
        width += len(fits[k])
    labelled = _labelled(points, {k: fits[k] for k in ks}).checkpoint(eager=True)
    n = labelled.count()
    blocks = blocks or max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = labelled.select("pid", "w", "x", block.alias("a"), every.alias("b"))
    right = labelled.select("pid", "w", "x", "labels", block.alias("b"), every.alias("a"))
    names = [f"d{j}" for j in range(width)]
    sums = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(
        _distance_sums(offsets, width, distance == "squared"), "pid long, " + ", ".join(f"{c} double" for c in names))
    sums = sums.groupBy("pid").agg(*[F.sum(c).alias(c) for c in names])
    # a row for each k and cluster
    sizes: dict[tuple[int, int], float] = {}
    weights = labelled.select("w", F.posexplode("labels").alias("i", "c")).groupBy("i", "c").agg(F.sum("w").alias("w"))
    for r in weights.collect():
        sizes[r["i"], r["c"]] = float(r["w"])
    rows = sums.join(labelled.select("pid", "w", "labels"), "pid")
    parts = []
    for i, k in enumerate(ks):
        own = F.col("labels")[i]
        inside, nearest, size = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")
        for c in range(len(fits[k])):
            if (i, c) not in sizes:
                continue
            total = F.col(names[offsets[i] + c])
            inside = F.when(own == c, total).otherwise(inside)
            size = F.when(own == c, F.lit(sizes[i, c])).otherwise(size)
            mean = F.when(own != c, total / F.lit(sizes[i, c]))
            nearest = F.least(nearest, mean)  # skips nulls
        a = inside / (size - 1)
        score = F.when(size > 1, F.coalesce(F.try_divide(nearest - a, F.greatest(a, nearest)), F.lit(0.0))).otherwise(0.0)
        parts.append((F.sum(F.col("w") * score) / F.sum("w")).alias(f"k{k}"))
    found = rows.agg(*parts).first()
    for k in ks:
        out[k] = found[f"k{k}"]
    return out


def k_scan(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 8), n_init: int = 10,
           seed: int = 42, distance: str = "euclidean", key: str = "id") -> DataFrame:
    """K2: ``(k, inertia, silhouette, best_k)``: within-cluster sum of squares and mean silhouette of the best fit of each
    k; best k has the largest silhouette (the smaller k of equal ones)."""
    points, _ = weighted_points(df, cols, key)
    fits = fit_all(points, list(ks), len(cols), n_init, seed)
    scores = silhouettes(points, {k: c for k, (c, _, _) in fits.items()}, distance)
    known = [k for k in fits if scores[k] is not None]
    best = min(known, key=lambda k: (-round(scores[k], 9), k)) if known else None
    return local_table(df.sparkSession, [(int(k), float(fits[k][2]), scores[k], best) for k in fits],
                       "k int, inertia double, silhouette double, best_k int").where("k IS NOT NULL")


def cluster_profile(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """K3: per cluster count, mean spending / engagement / interest / satisfaction, purchase and
    ad-responsive rates (fractions)."""
    return assigned.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("spending_ord").alias("avg_spending"),
        F.avg("engagement_ord").alias("avg_engagement"),
        F.avg("product_interest_score").alias("avg_interest"),
        F.avg("satisfaction_score").alias("avg_satisfaction"),
        F.avg("made_purchase").alias("purchase_rate"),
        F.avg("high_ad_responsive").alias("ad_responsive_rate"))


def centers_original_scale(spark, centers: list[list[float]], cols: Sequence[str], stats: dict) -> DataFrame:
    """K3: centres mapped back to answer units (centre * sd + mean), long form."""
    rows = []
    for i, c in enumerate(centers):
        for j, name in enumerate(cols):
            mean, sd = stats[name]
            sd = sd if sd and sd > 0 else 1.0
            rows.append((i + 1, name, float(c[j] * sd + mean)))
    return local_table(spark, rows, "cluster int, feature string, center double")


def cluster_name(purchase_rate: Column, engagement: Column) -> Column:
    """K4: rule-based segment name from purchase rate (fraction) and mean engagement."""
    n = S.CLUSTER_NAMES
    return (F.when((purchase_rate > 0.85) & (engagement > 2.5), n[0])
            .when((purchase_rate > 0.7) & (engagement <= 2.5), n[1])
            .when((purchase_rate <= 0.5) & (engagement > 2), n[2])
            .otherwise(n[3]))


def name_clusters(profile: DataFrame) -> DataFrame:
    return profile.withColumn("segment", cluster_name(F.col("purchase_rate"), F.col("avg_engagement")))
