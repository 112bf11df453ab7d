"""Token ids as wavelet matrices: one compressed file for each shard, with access, counting and occurrence lookup.

File format (little endian): magic, header of seven int64 (tokens, distinct ids, levels, documents, first document's ids
before the shard, level bytes, zero), then zstd frames of: the sorted distinct ids (uint32), the documents (id, offset in
the shard as int64 pairs), and for each level the bits (packed, most significant first).  The zeros of a level and its
rank directory (ones before each 512 bits) are rebuilt from the bits when a file is opened.

Bit-planes hold the rank of an id among the shard's distinct ids, most significant bit first; each level stably parts
zeros from ones.  ``access``, ``rank`` and ``select`` take one step for each level.

Documents are range-partitioned by ``doc_id``, encoded, and cut into shards at the first
document that reaches a number of tokens, so no document crosses shards.  Each shard is one Parquet file of one row in the shared folder, written by Spark's committer, so a lost
executor leaves no half-written file.

Edge cases: null text counts as empty and holds the end id alone; repeated ids are kept as separate documents; an empty
table writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exact_longs, shuffle_width, small_batches, stage, text_buffers
from .tokens import encoder

MAGIC = b"WAVELET1"
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<8s7q")
_STEP = 512
_CHUNK = 1 << 16
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def _frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=1).compress(data)
    return struct.pack("<q", len(packed)) + packed


def _parted(seq: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Elements whose bit is zero, then the others, each in order; worked through in chunks that fit the cache."""
    out = np.empty_like(seq)
    zero, one = 0, len(seq) - int(np.count_nonzero(bit))
    for at in range(0, len(seq), _CHUNK):
        part, ones = seq[at: at + _CHUNK], bit[at: at + _CHUNK]
        low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
        out[zero: zero + len(low)] = part.take(low)
        out[one: one + len(high)] = part.take(high)
        zero, one = zero + len(low), one + len(high)
    return out


def build(ids: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray, before: int = 0) -> bytes:
    """One shard's file: ``offsets`` are the places in ``ids`` at which the documents begin."""
    top = int(ids.max()) + 1 if len(ids) else 1
    seen = np.bincount(ids, minlength=top) > 0
    symbols = np.flatnonzero(seen).astype(np.uint32)
    rank = np.cumsum(seen) - 1
    seq = rank.astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)[ids] if len(ids) else np.empty(0, np.uint16)
    levels = max(1, int(max(len(symbols) - 1, 1)).bit_length())
    planes = []
    for level in range(levels - 1, -1, -1):
        bit = (seq & seq.dtype.type(1 << level)).astype(bool)
        planes.append(np.packbits(bit))
        seq = _parted(seq, bit) if level else seq
    width = (len(ids) + 7) // 8
    docs = np.stack([np.asarray(doc_ids, np.int64), np.asarray(offsets, np.int64)], 1)
    head = _HEAD.pack(MAGIC, len(ids), len(symbols), levels, len(docs), before, width, 0)
    return b"".join([head, _frame(symbols.tobytes()), _frame(docs.tobytes()), *(_frame(p.tobytes()) for p in planes)])


class WaveletMatrix:
    """A shard opened from its file."""

    def __init__(self, file: bytes):
        magic, self.n, symbols, self.levels, _, self.before, _, _ = _HEAD.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at, parts = _HEAD.size, []
        unpack = zstandard.ZstdDecompressor()
        for _ in range(self.levels + 2):
            (size,) = struct.unpack_from("<q", file, at)
            parts.append(unpack.decompress(file[at + 8: at + 8 + size], max_output_size=1 << 31))
            at += 8 + size
        self.symbols = np.frombuffer(parts[0], np.uint32)
        docs = np.frombuffer(parts[1], np.int64).reshape(-1, 2)
        self.doc_ids, self.doc_offsets = docs[:, 0], docs[:, 1]
        self.planes = [np.frombuffer(p, np.uint8) for p in parts[2:]]
        self._ranks: list[np.ndarray] | None = None
        if len(self.symbols) != symbols:
            raise ValueError("damaged wavelet matrix file")

    def _directory(self) -> list[np.ndarray]:
        """Ones before each block of 512 bits, for each level."""
        if self._ranks is None:
            step = _STEP // 8
            self._ranks = []
            for plane in self.planes:
                ones = np.add.reduceat(_ONES[plane].astype(np.int64), np.arange(0, max(len(plane), 1), step)) if len(plane) else np.zeros(1, np.int64)
                self._ranks.append(np.concatenate(([0], np.cumsum(ones))))
            self.zeros = [self.n - int(r[-1]) for r in self._ranks]
        return self._ranks

    def _rank1(self, level: int, i: int) -> int:
        block = i // _STEP
        ones = int(self._directory()[level][block])
        start, end = block * (_STEP // 8), i // 8
        plane = self.planes[level]
        ones += int(_ONES[plane[start:end]].sum())
        return ones + (int(_ONES[plane[end] >> (8 - i % 8)]) if i % 8 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of the kind: directory, then bytes of one block."""
        ranks = self._directory()[level]
        counts = ranks if bit else np.minimum(np.arange(len(ranks)) * _STEP, self.n) - ranks
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (_STEP // 8): (block + 1) * (_STEP // 8)])[: self.n - block * _STEP]
        return block * _STEP + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The i-th token id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        self._directory()
        value = 0
        for level in range(self.levels):
            bit = int(self.planes[level][i // 8] >> (7 - i % 8)) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.symbols[value])

    def _code(self, token: int) -> int:
        k = int(np.searchsorted(self.symbols, token))
        return k if k < len(self.symbols) and self.symbols[k] == token else -1

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs among the first i tokens."""
        code = self._code(token)
        if code < 0:
            return 0
        self._directory()
        a, b = 0, min(max(i, 0), self.n)
        for level in range(self.levels):
            ones_a, ones_b = self._rank1(level, a), self._rank1(level, b)
            if code >> (self.levels - 1 - level) & 1:
                a, b = self.zeros[level] + ones_a, self.zeros[level] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code, start = self._code(token), 0
        for level in range(self.levels):
            ones = self._rank1(level, start)
            start = self.zeros[level] + ones if code >> (self.levels - 1 - level) & 1 else start - ones
        i = start + k
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All token ids, by undoing the levels from the last to the first."""
        values = np.zeros(self.n, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for shift, plane in enumerate(reversed(self.planes)):
            bit = np.unpackbits(plane)[: self.n].view(bool)
            zeros = self.n - int(np.count_nonzero(bit))
            values[zeros:] |= values.dtype.type(1 << shift)
            out = np.empty_like(values)
            low = 0
            for at in range(0, self.n, _CHUNK):
                part, ones = out[at: at + _CHUNK], bit[at: at + _CHUNK]
                zero, one = np.flatnonzero(~ones), np.flatnonzero(ones)
                part[zero] = values[low: low + len(zero)]
                low += len(zero)
                high = zeros + at + len(part) - low
                part[one] = values[high - len(one): high]
            values = out
        return self.symbols[values]


_SHARDS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.LongType()),
                        T.StructField("tokens", T.LongType()), T.StructField("file", T.BinaryType())])


def _shards(path: str, end_id: int, shard_tokens: int):
    """Encodes one range of documents in order and emits its files; holds one shard's ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, code = TaskContext.get().partitionId(), encoder(path)
        ids: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        begins: list[np.ndarray] = []
        held = before = shard = 0

        def emit() -> pa.RecordBatch:
            nonlocal held, before, shard
            file = build(np.concatenate(ids), np.concatenate(docs), np.concatenate(begins), before)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int64()),
                                              "tokens": pa.array([held], pa.int64()), "file": pa.array([file], pa.binary())})
            held, before, shard = 0, before + held, shard + 1
            for x in (ids, docs, begins):
                x.clear()
            return out

        for batch in small_batches(batches, "text"):
            flat, bounds = code.encode(*text_buffers(batch.column("text")))
            begins.append(held + bounds[:-1] + np.arange(len(bounds) - 1))
            docs.append(exact_longs(batch.column("doc_id")))
            ids.append(np.insert(flat, bounds[1:], end_id))
            held += len(ids[-1])
            if held >= shard_tokens:
                yield emit()
        if held:
            yield emit()

    return encode


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts in ascending ``doc_id`` order and write one wavelet-matrix file for each shard.

    Returns the table of files: ``part`` and ``shard`` in order, ``tokens``, and the bytes of the ``file``.  A null id comes
    first and is stored as the smallest long; a null text is empty.  One text may hold up to half a billion ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # ties of a repeated id are ordered by text, so that reruns agree
    rows = rows.repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return stage(rows.mapInArrow(_shards(tokenizer, end_id, shard_tokens), _SHARDS), "wavelet-shards", rows_per_file=1)


_PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "shard", "doc_id", "offset", "n_tokens")]
                       + [T.StructField("ids", T.BinaryType())])


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents as read back from the files: ids before them in their range, and ids as uint32 bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column("file")[i].as_py())
                ids = np.ascontiguousarray(matrix.ids(), "<u4").view(np.uint8)
                ends = np.append(matrix.doc_offsets[1:], matrix.n)
                n = len(ends)
                shard = [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int64)) for c in ("part", "shard")]
                blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(matrix.doc_offsets, matrix.n).astype(np.int32) * 4), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*shard, pa.array(matrix.doc_ids), pa.array(matrix.before + matrix.doc_offsets),
                                                  pa.array(ends - matrix.doc_offsets), blob], names=[f.name for f in _PIECES])

    return shards.select("part", "shard", "file").mapInArrow(decode, _PIECES)


def document_digests(shards: DataFrame) -> DataFrame:
    """For each document, from the files: ids before it in the whole corpus, number of ids, and their crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32
        for batch in batches:
            data, at = text_buffers(batch.column("ids"))
            raw = memoryview(data)
            crcs = [crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "offset", "n_tokens")), pa.array(crcs, pa.int64())],
                                             names=["part", "doc_id", "offset", "n_tokens", "ids_crc32"])

    pieces = read_shards(shards).mapInArrow(digest, "part long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    totals = shards.groupBy(F.col("part").cast("long").alias("part")).agg(F.sum("tokens").alias("tokens"))
    # one row for each range of the write, as many as shuffle partitions
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("part", before.alias("before"))
    return pieces.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
