"""Connected components of an edge table by alternating star contractions, staged after every round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

_EDGE = "a long, b long"


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of ``n`` indexes over the given pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch as stars around the least node they connect: no more edges than nodes."""
    for batch in batches:
        a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        label = local_labels(at[: len(a)], at[len(a):], len(nodes))
        other = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], names=["a", "b"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of the edges ``(a, b)``; the component is its least node.

    Each round links every node to the least node in its neighbourhood, first towards larger nodes, then among smaller
    ones; the number of rounds grows with the logarithm of the longest path.  Sums over a node's neighbours are partial
    aggregates and joins, so a node with very many neighbours is not gathered in one task."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(edges.mapInArrow(_forest, _EDGE).distinct(), name)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stage(stars.select("e.a", "e.b").where("a != b").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
