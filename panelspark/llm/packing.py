"""Lexical retrieval packing: a BM25 index for each shard returns unused neighbours of a seed, which fill its window.

Whole texts become ids (and an end id).  Documents are range-partitioned on a minhash of their id pairs and their
``doc_id``, so texts that share wording tend to meet, and a third of all rows with one minhash still spreads over many
tasks.  Each task cuts its rows into index shards of a bounded number of tokens and documents.

In a shard, every full window of a long document is a sequence of its own; what is left of each document is a tail.  A
seed tail scores all tails by BM25 over its own ids; unused neighbours follow in order of score while they fit whole,
then the best one left is cut to fill the window, and its rest stays unused.  A shard's last tokens become sequences
whose lengths are powers of two, so no sequence needs padding.

Edge cases: null and empty texts hold the end id alone; repeated rows are packed each; texts longer than a shard make a
shard of their own; an empty table gives no piece; extra columns are ignored; a null id is kept as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, mix, ranges, shuffle_width, small_batches, stage, text_buffers
from .tokens import encoder

WINDOW = 2048
SHARD_TOKENS = 2 << 20
SHARD_DOCS = 2048
K1, B = 1.2, 0.75


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        if code.dtype != np.uint16:
            raise ValueError("packing stores ids as 16 bits; the vocabulary has more")
        for batch in small_batches(batches, "text"):
            ids, bounds = code.encode(*text_buffers(batch.column("text")))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u2")
            bounds = bounds + np.arange(len(bounds))
            pairs = mix((ids.astype(U) << U(16) | np.append(ids[1:], 0).astype(U)) + U(1))
            pairs[bounds[1:] - 1] = mix(U(1) << U(40) | ids[bounds[1:] - 1].astype(U))
            low = np.minimum.reduceat(pairs, bounds[:-1]).view(np.int64)
            blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(low), pa.array(np.diff(bounds)), blob],
                                             names=["doc_id", "low", "n_tokens", "ids"])

    return encode


class Index:
    """BM25 over the tails of one shard; terms are token ids."""

    def __init__(self, tails: list[np.ndarray]):
        n = len(tails)
        lengths = np.array([len(t) for t in tails], np.int64)
        key = np.repeat(np.arange(n, dtype=np.int64), lengths) << 32 | np.concatenate(tails).astype(np.int64)
        key, counts = np.unique(key, return_counts=True)
        doc, term = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int64)
        self.n = n
        self.terms, self.first = term, np.searchsorted(doc, np.arange(n + 1))
        df = np.bincount(term)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[doc] / lengths.mean()))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order].astype(np.float32)
        self.begin = np.concatenate(([0], np.cumsum(df)))
        # terms that a quarter of the tails hold have a row with every tail, at most four times as wide as their postings
        common = np.flatnonzero(df * 4 >= n)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        at = ranges(self.begin[common], df[common])
        self.rows[np.repeat(np.arange(len(common)), df[common]), self.docs[at]] = self.weights[at]

    def scores(self, i: int) -> np.ndarray:
        terms = self.terms[self.first[i]: self.first[i + 1]]
        row = self.row[terms]
        common, rare = row[row >= 0], terms[row < 0]
        at = ranges(self.begin[rare], self.begin[rare + 1] - self.begin[rare])
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n) + self.rows[common].sum(0)


def pack(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard; every id lies in exactly one."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    start = []
    for i, ids in enumerate(docs):
        whole = len(ids) // window
        pieces += [(i, k * window, window, sequence + k, 0) for k in range(whole)]
        sequence += whole
        start.append(whole * window)
    left = np.array([len(ids) - s for ids, s in zip(docs, start)], np.int64)
    at = np.array(start, np.int64)
    here = np.flatnonzero(left)
    if not len(here):
        return pieces
    index = Index([docs[i][at[i]:] for i in here])
    total = int(left.sum())
    unused = np.ones(len(here), bool)
    left, at, here = left[here].tolist(), at[here].tolist(), here.tolist()
    for seed in range(len(here)):
        while left[seed]:
            if total < window:  # what remains of the shard: lengths that are powers of two
                sizes = [1 << b for b in range(window.bit_length() - 1, -1, -1) if total >> b & 1]
            else:
                sizes = [window]
            order = None
            for size in sizes:
                offset = 0
                while offset < size:
                    space = size - offset
                    if left[seed]:
                        j = seed
                    else:
                        if order is None:
                            score = index.scores(seed)
                            open_ = np.flatnonzero(unused)
                            order = open_[np.argsort(-score[open_], kind="stable")].tolist()
                        k = next((k for k, j in enumerate(order) if left[j] <= space), 0)
                        j = order.pop(k) if left[order[k]] <= space else order[k]
                    take = min(space, left[j])
                    pieces.append((here[j], at[j], take, sequence, offset))
                    at[j] += take
                    left[j] -= take
                    unused[j] = left[j] > 0
                    total -= take
                    offset += take
                sequence += 1
    return pieces


_OUT = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")])
_IDS, _CRC = T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType())


def _pack(window: int, crc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sequence = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        docs: list = []
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal held, sequence
            pieces = pack(ids, window)
            for a in range(0, len(pieces), 4096):
                part = pieces[a: a + 4096]
                number = lambda k: pa.array([p[k] for p in part], pa.int64())
                own = (ids[p[0]][p[1]: p[1] + p[2]].astype("<u4") for p in part)
                last = pa.array([crc32(x) for x in own], pa.int64()) if crc else pa.array([x.tobytes() for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array([docs[p[0]] for p in part], pa.int64()), number(1), number(2),
                    pa.array([len(ids[p[0]]) for p in part], pa.int64()), pa.array([sequence + p[3] for p in part], pa.int64()), number(4),
                    last], names=[*_OUT.names, (_CRC if crc else _IDS).name])
            sequence += max(p[3] for p in pieces) + 1
            held = 0
            ids.clear()
            docs.clear()

        for batch in batches:
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                one = np.frombuffer(blob.as_py(), "<u2")
                if ids and (held + len(one) > SHARD_TOKENS or len(ids) >= SHARD_DOCS):
                    yield from emit()
                ids.append(one)
                docs.append(doc_id)
                held += len(one)
        if ids:
            yield from emit()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, crc: bool = False) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset`` and their ``ids`` (uint32).

    With ``crc``, the unsigned crc32 of those ids (``ids_crc32``) stands in place of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = stage(rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, low long, n_tokens long, ids binary"), "packing-ids")
    dealt = coded.repartitionByRange(shuffle_width(docs.sparkSession), "low", "doc_id").sortWithinPartitions("low", "doc_id", "n_tokens")
    return dealt.select("doc_id", "ids").mapInArrow(_pack(window, crc), T.StructType([*_OUT, _CRC if crc else _IDS]))
