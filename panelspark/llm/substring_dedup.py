"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  Its minimiser is the least hash of the ``m`` consecutive words
within it.  Consecutive windows that share a minimiser travel as one packed string (a super-k-mer) to the minimiser's
bucket, so equal windows meet in one bucket; there a sort of the windows finds equal ones exactly (hash order, then the
words themselves).  Every window but the first occurrence (least ``doc_id``, then least start) is a repeat.

A hot passage is first reduced where it is read: of equal windows in one chunk of documents only the first travels, so a
bucket holds a passage at most once for each chunk, however many documents share it.  Packed strings are compressed.

A line between differing words gives distinct windows with one minimiser.  Minimisers are counted on a sample of the
documents; windows of those that fill more than an average bucket (and more than ``HOT`` windows) go by the hash of the
whole window, so equal ones still meet.  The sample decides only where windows meet, not what is found.

Edge cases: null and empty texts have no words; documents shorter than a window keep all words; overlapping repeats in
one document count; rows that agree in ``doc_id`` and text are one document and do not remove each other's words; rows
of one ``doc_id`` with different texts are documents of their own, ordered by a hash of the text; a null id is ordered
first and stands as the smallest long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, group_starts, ranges, rolling, shuffle_width, small_batches, span_hashes, stage, text_buffers, word_spans

WIDTH, M = 20, 4
CHUNK_BYTES = 6 << 20
HOT = 1 << 16    # windows of one minimiser that stay together in any case
SAMPLED = 1 / 16  # share of the documents whose minimisers are counted
NO_ID = -2**63


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _intervals(starts: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts of one owner, as ``(owner, first word, end word)``."""
    if not len(starts):
        return owner, starts, starts
    new = np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])))
    last = np.concatenate((new[1:], [True]))
    return owner[new], starts[new], starts[last] + width


_SENT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("repeats", T.BinaryType()), T.StructField("places", T.BinaryType()),
                      T.StructField("text", T.BinaryType())])
_FOUND = "doc_id long, tag long, first long, end long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in small_batches(batches, "text"):
        held.append(batch)
        size += int(text_buffers(batch.column("text"))[1][-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _send(buckets: int, width: int, m: int, hot):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches):
            yield _chunk(held, buckets, width, m, hot.value)

    return send


def _minimisers(hashes: np.ndarray, width: int, m: int) -> np.ndarray:
    return sliding_min(rolling(hashes, m), width - m + 1)


def _count(width: int, m: int):
    """Windows of each minimiser in a chunk, equal windows once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches):
            data, offsets = text_buffers(pa.Table.from_batches(held).column("text"))
            starts, ends, bounds = word_spans(data, offsets)
            hashes = span_hashes(data, starts, ends)
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            windows = rolling(hashes, width)
            n = len(windows)
            valid = np.flatnonzero(doc[:n] == doc[width - 1: n + width - 1]) if n else np.empty(0, np.int64)
            valid = valid[np.unique(windows[valid], return_index=True)[1]]
            value, times = np.unique(_minimisers(hashes, width, m)[valid] if n else np.empty(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], names=["minimiser", "windows"])

    return count


def _hot_minimisers(rows: DataFrame, buckets: int, width: int, m: int) -> np.ndarray:
    """Sorted minimisers to split: no more than there are buckets, as each fills one."""
    sample = rows.sample(SAMPLED, 9) if SAMPLED < 1 else rows
    counted = stage(sample.mapInArrow(_count(width, m), "minimiser long, windows long").groupBy("minimiser").agg(F.sum("windows").alias("windows")), "substring-minimisers")
    total = counted.agg(F.sum("windows")).first()[0] or 0
    found = counted.where(F.col("windows") > max(HOT * SAMPLED, total / buckets)).select("minimiser").collect()
    return np.sort(np.array([r["minimiser"] for r in found], np.int64).view(U))


def _documents(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Rising numbers of the documents, rows that agree in id and tag having one; rows are in order."""
    new = np.ones(len(ids), np.int64)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    return np.cumsum(new)


def _same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, later: np.ndarray, leader: np.ndarray, width: int) -> np.ndarray:
    """Which windows hold the very words of their leaders.  Neighbouring windows share words, which are compared once."""
    if not len(later):
        return np.empty(0, bool)
    off = leader - later
    head = np.flatnonzero(np.concatenate(([True], (later[1:] != later[:-1] + 1) | (off[1:] != off[:-1]))))
    count = np.diff(np.append(head, len(later)))
    mine = ranges(later[head], count + width - 1)
    other = mine + np.repeat(off[head], count + width - 1)
    lengths = ends[mine] - starts[mine]
    differ = lengths != ends[other] - starts[other]
    alike = np.flatnonzero(~differ)
    bytes_before = np.cumsum(lengths[alike]) - lengths[alike]
    cuts = np.searchsorted(bytes_before, np.arange(0, int(lengths[alike].sum()) + 1, 1 << 20))
    for a, b in zip(cuts, [*cuts[1:], len(alike)]):  # about a million bytes at a time
        k = alike[a:b]
        if len(k):
            equal = data[ranges(starts[mine[k]], lengths[k])] == data[ranges(starts[other[k]], lengths[k])]
            differ[k] = ~np.logical_and.reduceat(equal, np.cumsum(lengths[k]) - lengths[k])
    total = np.concatenate(([0], np.cumsum(differ)))
    first = ranges(np.cumsum(count + width - 1) - (count + width - 1), count)
    return total[first + width] == total[first]


def _chunk(held: list[pa.RecordBatch], buckets: int, width: int, m: int, hot: np.ndarray) -> pa.RecordBatch:
    """Super-k-mers of the windows that occur first in these documents, by bucket, and the repeats among them."""
    table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("tag", "ascending")]).combine_chunks()
    ids, tags = np.asarray(table.column("doc_id")), np.asarray(table.column("tag"))
    who = _documents(ids, tags)
    data, offsets = text_buffers(table.column("text"))
    starts, ends, bounds = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
    windows = rolling(hashes, width)
    n = len(windows)
    valid = np.flatnonzero(doc[:n] == doc[width - 1: n + width - 1]) if n else np.empty(0, np.int64)
    order = valid[np.argsort(windows[valid], kind="stable")]
    first_of = group_starts(windows[order])
    is_first = np.zeros(n, bool)
    is_first[order[first_of]] = True
    # equal rows are one document: a window at the same document and start as the first is not later
    leader = np.repeat(order[first_of], np.diff(np.append(first_of, len(order))))
    at = np.arange(len(starts)) - bounds[doc]
    is_later = (who[doc[order]] != who[doc[leader]]) | (at[order] != at[leader])
    later, leader = order[is_later], leader[is_later]
    by = np.argsort(later)
    later, leader = later[by], leader[by]
    # equal hashes of different words: such a window goes to its bucket, which compares all that meet there
    same = _same_words(data, starts, ends, later, leader, width)
    is_first[later[~same]] = True
    later = later[same]
    owner, begin, end = _intervals(at[later], doc[later], width) if len(later) else (later, later, later)
    repeats = np.stack([ids[owner], tags[owner], begin, end], 1).astype("<i8") if len(later) else np.empty((0, 4), "<i8")

    least = _minimisers(hashes, width, m)
    if len(hot):
        least = np.where(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least, windows, least)
    send = np.flatnonzero(is_first)
    breaks = np.concatenate(([True], (send[1:] != send[:-1] + 1) | (least[send[1:]] != least[send[:-1]]))) if len(send) else np.empty(0, bool)
    head = np.flatnonzero(breaks)
    count = np.diff(np.append(head, len(send)))
    word = send[head]
    bucket = (least[word] % U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    group = group_starts(bucket[by])
    raw, rows = data.tobytes(), []
    pack = zstandard.ZstdCompressor(level=1)
    for a, b in zip(group.tolist(), np.append(group[1:], len(by)).tolist()):
        k = by[a:b]
        texts = [raw[i:j] for i, j in zip(starts[word[k]].tolist(), ends[word[k] + count[k] + width - 2].tolist())]
        places = np.stack([ids[doc[word[k]]], tags[doc[word[k]]], at[word[k]], count[k]], 1).astype("<i8")
        rows.append((int(bucket[k[0]]), None, pack.compress(places.tobytes()), pack.compress(b"\n".join(texts))))
    if len(repeats):  # to any bucket, which hands them on
        rows.append((int(repeats[0, 0]) % buckets, repeats.tobytes(), None, None))
    return pa.RecordBatch.from_pylist([dict(zip(("bucket", "repeats", "places", "text"), r)) for r in rows],
                                      schema=pa.schema([("bucket", pa.int64()), ("repeats", pa.binary()), ("places", pa.binary()), ("text", pa.binary())]))


def _bucket_repeats(width: int):
    def repeats(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        places, texts, found = [], [], []
        for a, b, c in zip(*(table.column(n).to_pylist() for n in ("places", "text", "repeats"))):
            if c is not None:
                found.append(np.frombuffer(c, "<i8").reshape(-1, 4))
            else:
                places.append(np.frombuffer(unpack.decompress(a, max_output_size=1 << 31), "<i8").reshape(-1, 4))
                texts.append(unpack.decompress(b, max_output_size=1 << 31))
        if places:
            found.append(_sorted_repeats(np.concatenate(places), b"\n".join(texts), width))
        rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
        return pa.table(dict(zip(("doc_id", "tag", "first", "end"), rows.T)))

    return repeats


def _sorted_repeats(places: np.ndarray, raw: bytes, width: int) -> np.ndarray:
    """``(doc_id, tag, first word, end word)`` of the windows of one bucket that are not the first of their words."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    windows = rolling(span_hashes(data, starts, ends), width)
    words = places[:, 3] + width - 1
    begin = np.cumsum(words) - words
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0]))  # windows by document and start, so a stable sort leaves the first in front
    places, begin = places[order], begin[order]
    count = places[:, 3]
    word = ranges(begin, count)
    row = np.repeat(np.arange(len(places)), count)
    doc, at = _documents(places[:, 0], places[:, 1])[row], ranges(places[:, 2], count)
    key = windows[word]
    order = np.argsort(key, kind="stable")
    new = group_starts(key[order])
    leader = np.repeat(order[new], np.diff(np.append(new, len(order))))
    same = (order == leader) | ((doc[order] == doc[leader]) & (at[order] == at[leader]))
    later, first = order[~same], leader[~same]
    # equal hashes are compared word by word
    text = lambda k: raw[starts[word[k]]: ends[word[k] + width - 1]]
    wrong = [k for k, (a, b) in enumerate(zip(later.tolist(), first.tolist())) if (x := text(a)) != (y := text(b)) and x.split() != y.split()]
    if wrong:
        again = np.ones(len(later), bool)
        for bad in {int(key[later[k]]) for k in wrong}:
            members, seen = order[key[order] == U(bad)].tolist(), {}
            keep = {k for k in members if seen.setdefault(tuple(text(k).split()), (doc[k], at[k])) == (doc[k], at[k])}
            again &= ~np.isin(later, list(keep))
        later = later[again]
    later.sort()
    _, a, b = _intervals(at[later], doc[later], width)
    if not len(later):
        return np.empty((0, 4), np.int64)
    head = places[row[later[np.concatenate(([True], (at[later[1:]] != at[later[:-1]] + 1) | (doc[later[1:]] != doc[later[:-1]])))]]]
    return np.stack([head[:, 0], head[:, 1], a, b], 1)


def _row_key() -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("tag")]


def repeated_spans(docs: DataFrame, width: int = WIDTH, m: int = M) -> DataFrame:
    """Word spans ``(doc_id, tag, first, end)`` covered by windows whose words also start earlier in the corpus; ``tag`` is
    a hash of the text, which tells rows of one id apart."""
    buckets = 4 * shuffle_width(docs.sparkSession)
    rows = docs.select(*_row_key(), "text")
    hot = docs.sparkSession.sparkContext.broadcast(_hot_minimisers(rows, buckets, width, m))
    sent = rows.mapInArrow(_send(buckets, width, m, hot), _SENT)
    return sent.groupBy("bucket").applyInArrow(_bucket_repeats(width), _FOUND)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words outside the spans, joined by one space."""
    by_doc = spans.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list(F.array("first", "end"))).alias("spans"))
    rows = docs.select(*_row_key(), "text").join(by_doc, ["doc_id", "tag"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            data, offsets = text_buffers(batch.column("text"))
            raw, kept, sizes, removed = data.tobytes(), [], [], []
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("spans")):
                words = raw[a:b].split()
                gone = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid:
                    at = np.asarray(spans.values)
                    np.add.at(gone, at[::2], 1)
                    np.add.at(gone, at[1::2], -1)
                gone = np.cumsum(gone)[:-1] > 0
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed[-1] else words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def drop_repeated_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Whole documents without the words of repeated windows."""
    return without_spans(docs, repeated_spans(docs, width))


