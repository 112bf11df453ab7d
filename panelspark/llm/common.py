"""Helpers shared by the operators: session folders, staged tables, Arrow text access, vectorised word hashing.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which is also what ``bytes.split`` yields.
All hashing works on UTF-8 bytes, 64 bits wide, without per-word Python.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------------------------------------- session

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; sessions must name one in ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # one process, as in tests: any folder is shared
        path = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="panelspark-shared-")
        _local[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)
    staged.staged_at = path
    return staged


def discard(staged: DataFrame) -> None:
    """Delete the files of a table from ``stage`` that nothing reads any more."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when their query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has (names differ by more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions; clusters size it to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------------------------------------- Arrow text

def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string or binary column; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds at most ``max_bytes`` (a single longer text stands alone)."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if n == 0:
            continue
        _, at = text_buffers(batch.column(column))
        while start < n:
            end = int(np.searchsorted(at, at[start] + max_bytes, side="right")) - 1
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


def exact_longs(column: pa.Array, null: int = -2**63) -> np.ndarray:
    """64-bit integers of a column, never by way of doubles; a null counts as the smallest long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), pa.scalar(null, pa.int64())).to_numpy(zero_copy_only=False)


def release_memory() -> None:
    """Hand freed memory back to the system, as a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def long_array(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), pa.int64())


def blob_column(blobs) -> pa.Array:
    return pa.array(list(blobs), pa.binary())


# ---------------------------------------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n+1 positions in them at which each text's words begin.

    ``gap`` says for each byte whether it lies between words (white space, unless given).
    """
    solid = ~gap[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    if len(data):  # a word never crosses from one text into the next
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BLOCK = 1 << 20
_BASE = 0x5851F42D4C957F2D
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.ones(size, U)
        step, done = base, 1
        while done < size:
            have[done: 2 * done] = have[:done] * U(step)
            step, done = step * step & _MASK, 2 * done
        _powers[base] = have
    return have[:n]


_BYTES = _splitmix(256, 0xB17E)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each ordered, non-overlapping byte span, from prefix sums modulo 2^64 over blocks of bytes."""
    out = np.empty(len(starts), U)
    inverse = pow(_BASE, -1, 1 << 64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTES[data[lo:hi]] * _power_table(_BASE, hi - lo), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        shift = _power_table(inverse, hi - lo)
        out[i:j] = (sums[e] - sums[s]) * shift[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)
        i = j
    return mix(out ^ U(seed & _MASK))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive hashes (n - width + 1 of them, across whatever the caller put together)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= U(0x9FB21C651E98DF25)
        out += hashes[k: n + k]
        out ^= out >> U(29)
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated integer ranges start .. start+length-1."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Positions at which a new value begins in a sorted array."""
    if len(sorted_keys) == 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
