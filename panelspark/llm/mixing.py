"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources each belongs to).  A flow routes each pattern's token
capacity to the quotas of its sources: the first pass over a pattern is free, each further pass costs more, so the flow
repeats as little as it can.  What a pattern sends is then taken as whole passes over all its documents and one last,
partial pass over documents in a seeded order.

The flow is solved on the driver; its graph has one node for each pattern and source, whose number is that of the
mixture's configuration, not of documents.  More than ``max_patterns`` patterns raise an error rather than being cut.
The last pass needs no sort of all rows: patterns are histogrammed over 2^16 hash ranges, and only the documents next to
the place where the quota ends are ordered.

Edge cases: null text has size 0; a null source is a source of its own, last in order; repeated rows are separate
documents; empty texts have size 0 and are never taken; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, small_batches, stage, text_buffers, word_spans

SEED = 20
PASSES = 3
_BUCKET_BITS = 16
_TAIL = 512


def word_counts(docs: DataFrame, name: str = "size") -> DataFrame:
    """``docs`` with the number of words of ``text`` in place of the text."""
    fields = [f for f in docs.schema.fields if f.name != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            _, _, bounds = word_spans(*text_buffers(batch.column("text")))
            keep = [k for k, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.diff(bounds), pa.int64())],
                                             names=[*(batch.schema.names[k] for k in keep), name])

    return docs.mapInArrow(count, T.StructType([*fields, T.StructField(name, T.LongType())]))


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is shared again by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    rest = total
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not above:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in above:
            targets[i] = float(most * sizes[i])
            rest -= targets[i]
        open_ -= above
    return targets


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], passes: int = PASSES) -> list[int]:
    """Words each pattern sends when the quotas are met as far as possible at the least cost of repetition.

    Arcs: origin to pattern once for each pass (costs rise with the pass), pattern to its sources, source to sink.  A way
    from the origin never comes back to it, so it costs what its first arc does: the cheapest flow is a greatest flow
    over the first passes, then one over the second passes on top of it, and so on.  Each is found by blocking flows in
    layered graphs, whose ways may also go back from a source to a pattern that has sent to it."""
    n, m = len(capacity), len(quota)
    givers: list[list[int]] = [[] for _ in range(m)]
    for p in range(n):
        for s in members[p]:
            givers[s].append(p)
    sent = [dict.fromkeys(of, 0) for of in members]
    free, room = [0] * n, list(quota)

    def layers() -> tuple[list[int], list[int]] | None:
        """Distance of patterns and sources from the origin, up to the first source with room; None without one."""
        far_p, far_s = [-1] * n, [-1] * m
        front = [p for p in range(n) if free[p] and members[p]]
        for p in front:
            far_p[p] = 0
        depth = 0
        while front:
            reached = []
            for p in front:
                for s in members[p]:
                    if far_s[s] < 0:
                        far_s[s] = depth + 1
                        reached.append(s)
            if any(room[s] for s in reached):
                return far_p, far_s
            front = []
            for s in reached:
                for p in givers[s]:
                    if far_p[p] < 0 and sent[p][s]:
                        far_p[p] = depth + 2
                        front.append(p)
            depth += 2
        return None

    def block(far_p: list[int], far_s: list[int]) -> None:
        """Sends along ways of the layered graph until none is left; each pattern and source keeps its next arc."""
        at_p, at_s = [0] * n, [0] * m
        for first in range(n):
            while far_p[first] == 0 and free[first]:
                way = [first]  # patterns and sources in turn
                while way:
                    if len(way) % 2:
                        p = way[-1]
                        while at_p[p] < len(members[p]) and far_s[members[p][at_p[p]]] != far_p[p] + 1:
                            at_p[p] += 1
                        if at_p[p] < len(members[p]):
                            way.append(members[p][at_p[p]])
                            continue
                    else:
                        s = way[-1]
                        if room[s]:
                            break
                        while at_s[s] < len(givers[s]) and not (far_p[givers[s][at_s[s]]] == far_s[s] + 1 and sent[givers[s][at_s[s]]][s]):
                            at_s[s] += 1
                        if at_s[s] < len(givers[s]):
                            way.append(givers[s][at_s[s]])
                            continue
                    way.pop()
                    if way:  # a dead end: the one before tries its next arc
                        if len(way) % 2:
                            at_p[way[-1]] += 1
                        else:
                            at_s[way[-1]] += 1
                if not way:
                    break
                flow = min(free[first], room[way[-1]], *(sent[way[k + 1]][way[k]] for k in range(1, len(way) - 1, 2)))
                for k in range(0, len(way), 2):
                    sent[way[k]][way[k + 1]] += flow
                for k in range(1, len(way) - 1, 2):
                    sent[way[k + 1]][way[k]] -= flow
                free[first] -= flow
                room[way[-1]] -= flow

    for _ in range(passes):
        # what a pass has left over would stay cheaper, but no way leads from it any more
        free = list(capacity)
        while (found := layers()) is not None:
            block(*found)
    return [sum(of.values()) for of in sent]


def mix_sources(docs: DataFrame, sources: Column, weights: Sequence[float] = (1, 2, 3), seed: int = SEED,
                passes: int = PASSES, max_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Take documents so that sources meet weighted shares of all words.

    ``sources`` is an array of the sources a document belongs to; sources in code point order (null last) weigh
    ``weights``, repeating.  Returns the documents (``doc_id, members, size, passes``: how often each is taken) and the
    sources (``name, source_size, target``)."""
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(sources.cast("array<string>")))
    rows = word_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), members.alias("members"), "text"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 64 - 40)
    rows = stage(rows.withColumn("draw", draw), "mixing-sizes")
    found = rows.groupBy("members").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found = sorted(((list(r["members"] or []), int(r["size"] or 0)) for r in found), key=lambda x: str(x[0]))
    names = sorted({s for of, _ in found for s in of}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: k for k, s in enumerate(names)}
    sizes = [0] * len(names)
    for of, size in found:
        for s in of:
            sizes[at[s]] += size
    targets = capped_targets(sizes, [weights[k % len(weights)] for k in range(len(names))], passes)
    sent = min_cost_flow([size for _, size in found], [[at[s] for s in of] for of, _ in found], [round(t) for t in targets], passes)
    plan = [(of, flow // size if size else 0, flow % size if size else 0) for (of, size), flow in zip(found, sent)]
    quotas = spark.createDataFrame(plan, "members array<string>, whole long, rest long")
    chosen = _last_pass(rows, quotas)
    taken = chosen.select("doc_id", "members", "size", (F.col("whole") + F.col("extra").cast("long")).alias("passes"))
    return taken, spark.createDataFrame(list(zip(names, sizes, targets)), "name string, source_size long, target double")


def _last_pass(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Rows with ``whole`` passes and whether they are in the partial one, which comes as near to ``rest`` as it can.

    Hash ranges that fit into ``rest`` are taken whole; of the next documents (``_TAIL`` at least, and no more than that
    and one hash range) each is taken that still fits.  ``quotas`` has a row for each pattern, which ``max_patterns``
    bounds; it is broadcast."""
    key = F.to_json(F.struct(F.coalesce("members", F.array().cast("array<string>")).alias("m")), {"ignoreNullFields": "false"})
    quotas = F.broadcast(quotas.select(key.alias("pattern"), "whole", "rest"))
    rows = rows.withColumn("pattern", key).join(quotas, "pattern").withColumn("bucket", F.shiftright("draw", 40 - _BUCKET_BITS))
    sums = rows.where("rest > 0").groupBy("pattern", "rest", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    order = Window.partitionBy("pattern").orderBy("bucket")
    sums = sums.withColumn("end", F.sum("words").over(order)).withColumn("n_end", F.sum("n").over(order)).withColumn("fits", F.col("end") <= F.col("rest"))
    fits = lambda c, none: F.coalesce(F.max(F.when(F.col("fits"), F.col(c))).over(Window.partitionBy("pattern")), F.lit(none))
    sums = sums.withColumn("cut", fits("bucket", -1)).withColumn("cut_words", fits("end", 0)).withColumn("cut_n", fits("n_end", 0))
    cuts = sums.groupBy("pattern").agg(F.max("cut").alias("cut"), F.max("cut_words").alias("cut_words"),
                                       F.min(F.when(F.col("n_end") >= F.col("cut_n") + _TAIL, F.col("bucket"))).alias("last"))
    cuts = cuts.withColumn("last", F.coalesce("last", F.lit(1 << _BUCKET_BITS)))
    rows = rows.join(F.broadcast(cuts), "pattern", "left")
    near = F.coalesce((F.col("bucket") > F.col("cut")) & (F.col("bucket") <= F.col("last")), F.lit(False))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "doc_id", "size"], kind="stable")
        room, extra = int(group["rest"].iloc[0] - group["cut_words"].iloc[0]), []
        for size in group["size"]:
            extra.append(0 < size <= room)
            room -= size if extra[-1] else 0
        # what is left may be nearer to one more document than to none
        over = [(abs(room - size), k) for k, size in enumerate(group["size"]) if size and not extra[k]]
        if over and min(over)[0] < room:
            extra[min(over)[1]] = True
        return group.assign(extra=extra)[["pattern", "doc_id", "size", "whole", "extra"]]

    columns = ["pattern", "doc_id", "size", "whole", "extra"]
    tail = rows.where(near).groupBy("pattern").applyInPandas(fill, "pattern string, doc_id long, size long, whole long, extra boolean")
    others = rows.where(~near).withColumn("extra", F.coalesce(F.col("bucket") <= F.col("cut"), F.lit(False)))
    parsed = F.from_json("pattern", "m array<string>")["m"]
    return others.select(*columns).unionByName(tail.select(*columns)).withColumn("members", parsed)


def mixed_documents(docs: DataFrame, sources: Column, **options) -> DataFrame:
    """The documents with their own columns, each as many times as the mix takes it; ids are expected to be unique."""
    taken, _ = mix_sources(docs, sources, **options)
    own, of, passes, number = fresh_names(docs, "__id", "__members", "__passes", "__n")
    text = {"ignoreNullFields": "false"}
    rows = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(of, F.to_json(F.struct(
        F.array_sort(F.array_distinct(sources.cast("array<string>"))).alias("m")), text))
    taken = taken.where("passes > 0").select(F.col("doc_id").alias(own), F.to_json(F.struct(F.col("members").alias("m")), text).alias(of),
                                            F.col("passes").cast("int").alias(passes))
    # rows that repeat an id share its passes: each of them stands once
    taken = taken.groupBy(own, of).agg(F.max(passes).alias(passes))
    joined = rows.join(taken, rows[own].eqNullSafe(taken[own]) & (rows[of] == taken[of])).drop(own, of)
    return joined.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(passes)))).drop(number, passes)
