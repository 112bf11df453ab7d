"""Runs of periodically repeated words, found by recursive frequency splitting and a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``max(6, 4 q)`` words
long, that no neighbouring word extends.  Every word of a run occurs at least four times in it, so a word that occurs
fewer times within a segment lies in no run of that segment and splits it.  The parts are counted anew until no word
splits any more; on ordinary prose nothing is left after two or three rounds.

A surviving segment is scanned lag by lag.  In a run of smallest period q a window of m words, q <= m < 2 q, occurs next
exactly q words later, at more than q places.  Windows are numbered for m = 1, 2, 4, ... by doubling, so a lag is
scanned only where that many windows recur at it: at most about sqrt(n) lags for n words, however long the text.

Words are compared by their bytes, not by hashes.  Each text is handled alone, so nothing is shuffled and no group grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

LEAST_WORDS = 6
LEAST_PERIODS = 4

RUN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])
_ARROW_RUN = pa.list_(pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, by first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def surviving_segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Segments in which every word occurs often enough for a run, in text order."""
    open_, stable = [(0, len(ids))], []
    while open_:
        lo, hi = open_.pop()
        if hi - lo < LEAST_WORDS:
            continue
        part = ids[lo:hi]
        _, at, counts = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[at] < LEAST_PERIODS)
        if len(rare) == 0:
            stable.append((lo, hi))
            continue
        begins = np.concatenate(([0], rare + 1))
        ends = np.concatenate((rare, [hi - lo]))
        long_ = ends - begins >= LEAST_WORDS
        open_.extend(zip((lo + begins[long_]).tolist(), (lo + ends[long_]).tolist()))
    return sorted(stable)


def _supported_lags(part: np.ndarray) -> Iterator[int]:
    """Ascending lags at which enough windows recur for a run to have them as its smallest period."""
    n, m, names = len(part), 1, part
    while 2 * m <= n and m // 2 + 1 <= n // LEAST_PERIODS:
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        if not same.any():
            return
        gaps = (order[1:] - order[:-1])[same]
        gaps = gaps[(gaps > m // 2) & (gaps <= min(m, n // LEAST_PERIODS))]
        lags, counts = np.unique(gaps, return_counts=True)
        yield from lags[counts > lags].tolist()
        pairs = names[:n - 2 * m + 1] * (int(names.max()) + 1) + names[m: m + n - 2 * m + 1]
        names = np.unique(pairs, return_inverse=True)[1]
        m *= 2


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    found = []
    for lo, hi in surviving_segments(ids):
        _, part = np.unique(ids[lo:hi], return_inverse=True)
        seen = set()  # a stretch comes first at its smallest period, then at multiples of it
        for lag in _supported_lags(part):
            equal = np.concatenate(([0], (part[:-lag] == part[lag:]).view(np.int8), [0]))
            edges = np.flatnonzero(np.diff(equal))
            begins, lengths = edges[::2], edges[1::2] - edges[::2] + lag
            good = lengths >= max(LEAST_WORDS, LEAST_PERIODS * lag)
            for start, length in zip(begins[good].tolist(), lengths[good].tolist()):
                if (start, length) not in seen:
                    seen.add((start, length))
                    found.append((lo + start, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        counts, runs, kept = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            words = (text.as_py() or b"").split()
            found = runs_of(word_numbers(words)) if len(words) >= LEAST_WORDS else []
            keep = np.ones(len(words), bool)
            for start, length, period in found:
                keep[start + period: start + length] = False
            counts.append(len(words))
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            kept.append(b" ".join(compress(words, keep.tolist()) if found else words))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(runs, _ARROW_RUN),
                                          pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    ``collapsed`` holds the words that stay, one space between them: of a run only the first period stays, unless another
    run covers it beyond its own first period.  A null text has no words, no runs and an empty ``collapsed``; null and
    repeated ids are carried as they are, each row on its own.  Other columns of ``docs`` are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType(), False),
                           T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])
    return rows.mapInArrow(_analyse, schema).withColumnRenamed("id", id_col)
