"""Exact dedup by content sort.

Rows are range-partitioned on their normalised bytes by sampled splitters and sorted on disk within each range, so that
equal texts lie next to each other; neighbouring full comparisons find the runs.  The ``doc_id`` is the last part of the
splitters, so a group of copies that holds a third of all rows spreads over many tasks; the runs that touch the edge of
a range (two at most for each) are put together by one small aggregate on their full text.

Splitters would hold whole texts if they were made from them, so the content order is: leading 32 bytes, SHA-256, then
all bytes.  Equal texts are neighbours in it like in plain byte order.

Edge cases: null text counts as empty, and empty texts are equal to each other; repeated rows (same id and text) are
separate members of their group, of which one is kept (they share a range, as splitters hold the id); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, lower_ascii, release_memory, shuffle_width, small_batches, stage, text_buffers

HEAD = 32
NO_ID = -2**63  # stands for a null identifier

_RUNS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()),
    T.StructField("edge", T.BooleanType()), T.StructField("best", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("digest", T.BinaryType()), T.StructField("edge_text", T.BinaryType()), T.StructField("again", T.BooleanType()),
])
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("edge", pa.bool_()),
                    ("best", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("edge_text", pa.binary()), ("again", pa.bool_())])
_FLUSH = 20_000


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the text as lower-cased bytes (A-Z only) and the key that leads the content order."""
    for batch in small_batches(batches, "text"):
        data, at = text_buffers(batch.column("text"))
        raw = lower_ascii(data).tobytes()
        texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        keys = [t[:HEAD] + b"\x00" + hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([pc.fill_null(batch.column("doc_id"), NO_ID), pa.array(texts, pa.binary()), pa.array(keys, pa.binary()),
                                          *batch.columns[2:]], names=["doc_id", "norm", "key", *batch.schema.names[2:]])


def _runs(keep_largest: bool):
    """Compares neighbours of one sorted range; holds the ids of the current run, no texts but the run's own."""
    pick = max if keep_largest else min

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        pending = 0
        run, current, ids = 0, None, []

        def close(last: bool) -> None:
            nonlocal pending
            edge = run == 0 or last
            out.append((np.array(ids, np.int64), run, edge, pick(ids), len(ids), hashlib.sha256(current).digest(),
                        current if edge else None))
            pending += len(ids)

        def flush() -> pa.RecordBatch:
            nonlocal pending
            sizes = [len(o[0]) for o in out]
            each = lambda k, t: pa.array(np.repeat(np.array([o[k] for o in out], t), sizes))
            which = np.repeat(np.arange(len(out)), sizes)
            first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            texts: list[bytes | None] = [None] * int(sum(sizes))
            for o, at in zip(out, first):
                texts[at] = o[6]
            flat = np.concatenate([o[0] for o in out])
            again = np.concatenate(([False], flat[1:] == flat[:-1]))
            again[first] = False
            batch = pa.RecordBatch.from_arrays([
                pa.array(flat), pa.array(np.full(sum(sizes), part, np.int32)),
                each(1, np.int64), each(2, bool), each(3, np.int64), each(4, np.int64),
                pa.array([o[5] for o in out], pa.binary()).take(pa.array(which)), pa.array(texts, pa.binary()), pa.array(again)], schema=_ARROW)
            out.clear()
            pending = 0
            return batch

        for batch in batches:
            texts, doc_ids = batch.column("norm"), batch.column("doc_id").to_pylist()
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if text != current:
                    if current is not None:
                        close(False)
                        run += 1
                        ids = []
                    current = text
                    if pending >= _FLUSH:
                        yield flush()
                ids.append(doc_ids[i])
        if current is not None:
            close(True)
            yield flush()

    return compare


def exact_duplicates(docs: DataFrame, keep_largest: bool = False, partitions: int | None = None) -> DataFrame:
    """Group of every document: ``doc_id, keep_id, group_size, kept, digest`` (SHA-256 of the normalised text).

    The smallest identifier of a group is retained, or the largest with ``keep_largest``.  A null id stands as the
    smallest long."""
    width = partitions or shuffle_width(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_normalise, "doc_id long, norm binary, key binary")
    sorted_rows = rows.repartitionByRange(width, "key", "doc_id").sortWithinPartitions("key", "norm", "doc_id")
    runs = stage(sorted_rows.select("doc_id", "norm").mapInArrow(_runs(keep_largest), _RUNS), "content-sort")
    pick = F.max if keep_largest else F.min
    # a run at the edge of a range may go on in the next ranges: two rows for each range at most
    edges = runs.where("edge and edge_text is not null").select("part", "run", "best", "size", "edge_text")
    whole = edges.groupBy("edge_text").agg(pick("best").alias("whole_best"), F.sum("size").alias("whole_size"),
                                           F.collect_list(F.struct("part", "run")).alias("of"))
    whole = whole.select(F.explode("of").alias("at"), "whole_best", "whole_size").select("at.part", "at.run", "whole_best", "whole_size")
    joined = runs.drop("edge_text").join(F.broadcast(whole), ["part", "run"], "left")
    keep = F.coalesce("whole_best", "best")
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("whole_size", "size").alias("group_size"),
                         ((F.col("doc_id") == keep) & ~F.col("again")).alias("kept"), "digest")


def drop_exact_duplicates(docs: DataFrame, keep_largest: bool = False) -> DataFrame:
    """The documents that stay, one row for each kept text, with their own columns."""
    key = fresh_names(docs, "__id", "__digest")
    kept = exact_duplicates(docs, keep_largest).where("kept").select("doc_id", "digest").toDF(*key)
    rows = docs.withColumn(key[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rows = rows.mapInArrow(_with_digest(key[1]), T.StructType([*rows.schema.fields, T.StructField(key[1], T.BinaryType())]))
    return rows.join(kept, key, "left_semi").dropDuplicates(key).drop(*key)


def _with_digest(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            raw = lower_ascii(data).tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, name])
        release_memory()
    return run
