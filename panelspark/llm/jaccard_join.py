"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct word n-grams (shorter documents: their whole word sequence).  N-grams are ordered by
document frequency, rarest first.  Two sets whose Jaccard similarity reaches the threshold share at least
``t = ceil(threshold * size)`` of either's n-grams, so they share at least ``l`` among each one's first
``size - t + l``.  Each document takes the ``l`` that makes the estimated cost of its candidates least: a longer prefix
reads more posting lists but demands more shared n-grams before a pair is verified; a pair needs the smaller of its two
documents' ``l``.

Plan: (1) n-grams are counted bucket by bucket from packed hashes; an n-gram of a single document cannot be shared, so
only documents with enough n-grams that occur elsewhere go on.  (2) Equal sets become one.  (3) Each document is verified
against the candidate that shares most prefix n-grams with it among the leaders of its posting lists (first the most
central document of a list, then one drawn by hash, in ``ROUNDS`` rounds); links found so make components, which
near-copies of one text fill at once.  (4) All remaining candidate pairs, those between
different components, are found list by list: the shared prefix n-grams of its documents are counted in blocks, and only
pairs that share enough are handed on and verified.  No link between components is lost, and a group of
thousands of near copies is not expanded into all pairs.

N-grams are told apart by 64-bit hashes, of which 48 bits and the bucket travel.  Edge cases: null and empty texts have
an empty set and link with nothing; repeated rows are equal sets; null and repeated ids are allowed, as the join runs on
numbers of the distinct sets and maps them back at the end; very long texts are whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U, fresh_names, group_starts, lower_ascii, mix, ranges, release_memory, rolling, shuffle_width, small_batches, span_hashes,
                     stage, text_buffers, word_spans)
from .graph import components

N = 5
PERCENT = 75
LONGEST = 12     # largest l that is tried
ROUNDS = 2       # rounds of leaders before all remaining pairs
VERIFY = 20.0    # cost of verifying a candidate, in posting reads
CHUNK_BYTES = 6 << 20
BLOCK = 1024     # rows of a posting list that one group compares
CELLS = 1 << 24  # n-grams of pairs compared at a time, one bit each
NO_ID = -2**63
_LOW = U((1 << 48) - 1)


def needed(size):
    """Least overlap of a set of this size with any set at the threshold."""
    return (PERCENT * size + 99) // 100


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, end to end, and the offsets."""
    data = lower_ascii(data)
    starts, ends, bounds = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    sizes = np.diff(bounds)
    grams = rolling(hashes, n)
    count = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    value = grams[ranges(bounds[:-1], count)] if len(grams) else np.empty(0, U)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        whole = np.array([rolling(hashes[bounds[i]: bounds[i + 1]], int(sizes[i]))[0] ^ U(int(sizes[i])) for i in short], U)
        owner, value = np.concatenate((owner, short)), np.concatenate((value, mix(whole)))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.searchsorted(owner[keep], np.arange(len(sizes) + 1))


def _signatures(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = memoryview(np.ascontiguousarray(values).view(np.uint8))
    return [hashlib.blake2b(raw[8 * a: 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            values, at = shingle_sets(*text_buffers(batch.column("text")), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(at), pa.int64()),
                                              pa.array(_signatures(values, at), pa.binary())], names=["doc_id", "digest", "n_shingles", "sig"])
        release_memory()
    return run


_SENT = "bucket int, chunk string, docs binary, sigs binary, owner binary, low binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.string())] + [(n, pa.binary()) for n in ("docs", "sigs", "owner", "low")])
_FOUND = "chunk string, docs binary, sigs binary, owner binary, token binary, df binary"
_FOUND_ARROW = pa.schema([("chunk", pa.string())] + [(n, pa.binary()) for n in ("docs", "sigs", "owner", "token", "df")])
_SETS = "doc_id long, n_shingles long, sig binary, tokens binary, df binary"


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), kind)


def _send(buckets: int, n: int):
    """Distinct sets of each chunk, dealt by n-gram; of equal sets in a chunk the one with the least id travels."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
        ids = np.asarray(table.column("doc_id"))
        values, at = shingle_sets(*text_buffers(table.column("text")), n)
        sigs = np.array(_signatures(values, at), "S16")
        sizes = np.diff(at)
        _, first = np.unique(sigs, return_index=True)
        keep = np.sort(first[sizes[first] > 0])
        values, owner = values[ranges(at[keep], sizes[keep])], np.repeat(np.arange(len(keep), dtype=np.uint32), sizes[keep])
        name, rows = uuid.uuid4().hex, []
        bucket = ((values >> U(48)) * U(buckets) >> U(16)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = group_starts(bucket[by])
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(by)).tolist()):
            k = by[a:b]
            low = values[k].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((int(bucket[k[0]]), name, None, None, _zip(owner[k]), low.tobytes()))
        if len(keep):  # to any bucket, which hands it on
            docs = np.stack([ids[keep], sizes[keep]]).astype("<i8").tobytes()
            rows.append((int(values[0] % U(buckets)), name, docs, b"".join(s.ljust(16, b"\0") for s in sigs[keep].tolist()), None, None))
        return pa.RecordBatch.from_pylist([dict(zip(_SENT_ARROW.names, r)) for r in rows], schema=_SENT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in small_batches(batches, "text"):
            held.append(batch)
            size += int(text_buffers(batch.column("text"))[1][-1])
            if size >= CHUNK_BYTES:
                yield chunk(held)
                held, size = [], 0
        if held:
            yield chunk(held)
        release_memory()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """N-grams of one bucket that occur in several sets, handed back to the chunks with their frequency."""
    rows = table.to_pylist()
    out = [{"chunk": r["chunk"], "docs": r["docs"], "sigs": r["sigs"]} for r in rows if r["docs"] is not None]
    rows = [r for r in rows if r["low"] is not None]
    if rows:
        bucket = U(rows[0]["bucket"])
        lows = []
        for r in rows:
            wide = np.zeros((len(r["low"]) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(r["low"], np.uint8).reshape(-1, 6)
            lows.append(wide.view("<u8").ravel())
        unique, which, count = np.unique(np.concatenate(lows), return_inverse=True, return_counts=True)
        tokens = mix(unique ^ mix(bucket + U(1) + unique * U(0)))
        at = 0
        for r, low in zip(rows, lows):
            k = which[at: at + len(low)]
            at += len(low)
            more = count[k] > 1
            if more.any():
                out.append({"chunk": r["chunk"], "owner": _zip(_unzip(r["owner"], np.uint32)[more]), "token": tokens[k[more]].tobytes(),
                            "df": _zip(count[k[more]].astype(np.uint32))})
    return pa.Table.from_pylist(out, schema=_FOUND_ARROW)


def _sets(table: pa.Table) -> pa.Table:
    """Of one chunk, the sets with enough shared n-grams, these in order of frequency."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["docs"] is not None)
    ids, sizes = np.frombuffer(head["docs"], "<i8").reshape(2, -1)
    rows = [r for r in rows if r["owner"] is not None]
    out = []
    if rows:
        owner = np.concatenate([_unzip(r["owner"], np.uint32) for r in rows]).astype(np.int64)
        token = np.concatenate([np.frombuffer(r["token"], U) for r in rows])
        df = np.concatenate([_unzip(r["df"], np.uint32) for r in rows])
        enough = np.bincount(owner, minlength=len(ids)) >= needed(sizes)
        keep = enough[owner]
        owner, token, df = owner[keep], token[keep], df[keep]
        order = np.lexsort((token, df, owner))
        owner, token, df = owner[order], token[order], df[order]
        cuts = group_starts(owner)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(owner)).tolist()):
            i = int(owner[a])
            out.append({"doc_id": int(ids[i]), "n_shingles": int(sizes[i]), "sig": head["sigs"][16 * i: 16 * i + 16],
                        "tokens": token[a:b].tobytes(), "df": df[a:b].tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64())] + [(n, pa.binary()) for n in ("sig", "tokens", "df")]))


def choose_prefix(size: int, df: np.ndarray) -> tuple[int, int]:
    """``l`` and how many of the shared n-grams (in order) the prefix holds, at the least estimated cost."""
    t = needed(size)
    alone = size - len(df)
    l = np.arange(1, max(1, min(LONGEST, t)) + 1)
    held = np.clip(size - t + l - alone, 0, len(df))
    reads = np.concatenate(([0], np.cumsum(df.astype(np.float64))))[held]
    best = int(np.argmin(reads + VERIFY * reads / l))
    return int(l[best]), int(held[best])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [[], [], [], [], [], []]
        for doc, size, tokens, df in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_shingles", "tokens", "df"))):
            match, held = choose_prefix(size, np.frombuffer(df, np.uint32))
            columns[0].append(np.frombuffer(tokens, np.int64)[:held])
            centre = int(1000 * np.frombuffer(df, np.uint32).sum(dtype=np.int64) // size)
            for k, v in ((1, doc), (2, size), (3, match), (4, centre), (5, len(tokens) // 8 - held)):
                columns[k].append(np.full(held, v, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["token", "doc_id", "size", "match", "centre", "rest"])
    release_memory()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of every document's prefix, 64 bits each as in the posting lists, so that the first list of a pair is one that holds it."""
    for batch in batches:
        out = []
        for size, tokens, df in zip(*(batch.column(c).to_pylist() for c in ("n_shingles", "tokens", "df"))):
            _, held = choose_prefix(size, np.frombuffer(df, np.uint32))
            out.append(tokens[: 8 * held])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["prefix_of", "prefix"])


def _candidates(table: pa.Table) -> pa.Table:
    """Pairs of different components that share enough of their prefixes, each in the first list that both are in.

    The k-th of O shared n-grams lies within the first ``size - O + k`` of either set, so a pair at the threshold shares
    at least O less the larger number of n-grams beyond a prefix, and no less than the smaller ``l``."""
    token, doc, size, match, rest, component, block = (np.asarray(table.column(c)) for c in ("token", "doc_id", "size", "match", "rest", "component", "block"))
    prefix = table.column("prefix").to_pylist()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    order = np.argsort(token, kind="stable")
    cuts = group_starts(token[order])
    out = []
    for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
        at = order[lo:hi]
        if (component[at] == component[at[0]]).all():
            continue
        grams = [np.frombuffer(prefix[k], U) for k in at]
        values, which = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.repeat(np.arange(len(at)), [len(g) for g in grams])
        used = np.bincount(which, minlength=len(values)) > 1  # n-grams of one row add nothing
        column = np.cumsum(used) - 1
        has = np.zeros((len(at), int(used.sum())), np.float32)
        has[owner[used[which]], column[which[used[which]]]] = 1
        left, right = np.flatnonzero(block[at] == i), np.flatnonzero(block[at] == j)
        mine = int(np.searchsorted(values, token[at[0]].view(U)))
        mine = int(column[mine])
        early = np.packbits(has[:, :mine] > 0, axis=1)  # n-grams whose lists come before this one
        for start in range(0, len(left), 256):
            x = left[start: start + 256]
            shared = has[x] @ has[right].T
            a, b = at[x][:, None], at[right][None, :]
            need = (PERCENT * (size[a] + size[b]) + 99 + PERCENT) // (100 + PERCENT) - np.maximum(rest[a], rest[b])
            fits = (shared >= np.maximum(need, np.minimum(match[a], match[b]))) & (component[a] != component[b]) & (
                100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b]))
            p, q = np.nonzero(fits)
            p, q = x[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            if len(p) and mine:
                first = np.ones(len(p), bool)
                strip = max(1, CELLS // mine)  # pairs looked at together
                for k in range(0, len(p), strip):
                    first[k: k + strip] = ~(early[p[k: k + strip]] & early[q[k: k + strip]]).any(1)
                p, q = p[first], q[first]
            out.append(np.stack([doc[at[p]], doc[at[q]]], 1))
    rows = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return pa.table({"a": rows.min(1) if len(rows) else rows[:, 0], "b": rows.max(1) if len(rows) else rows[:, 1]})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("size_a", "size_b", "tokens_a", "tokens_b"))):
            shared = len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True))
            keep.append(100 * shared >= PERCENT * (m + n - shared))
        kept = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])
    release_memory()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that reach the threshold, from their whole sets."""
    one = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").mapInArrow(_verify, "a long, b long")


def _row_key() -> list:
    """Identifier and digest of the text: rows with both equal are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")]


def _classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, digest, n_shingles, sig`` of all documents; of each distinct set that is not empty its ``sig``, least
    document (``rep``) and component (null without a link); the links ``(a, b)`` between the ``rep`` ids."""
    spark = docs.sparkSession
    buckets = 4 * shuffle_width(spark)
    rows = docs.select(*_row_key(), "text")
    digests = stage(rows.mapInArrow(_digests(n), "doc_id long, digest binary, n_shingles long, sig binary"), "jaccard-digests")
    rows = rows.drop("digest")
    shared = rows.mapInArrow(_send(buckets, n), _SENT).groupBy("bucket").applyInArrow(_shared, _FOUND)
    sets = stage(shared.groupBy("chunk").applyInArrow(_sets, _SETS), "jaccard-sets")
    # equal sets of different chunks become one, with a number in place of the id, which may be null or repeated
    sets = stage(sets.dropDuplicates(["sig"]).withColumn("doc_id", F.monotonically_increasing_id()), "jaccard-sets")
    postings = stage(sets.mapInArrow(_postings, "token long, doc_id long, size long, match long, centre long, rest long"), "jaccard-postings")

    labelled, links = postings.withColumn("component", F.col("doc_id")), None
    for seed in range(ROUNDS):
        # the first leader of a list is its most central text, which a group of near copies resembles; later ones are drawn
        rank = F.col("centre") if seed == 0 else F.xxhash64("doc_id", F.lit(seed))
        head = F.max(F.struct(rank.alias("rank"), (-F.col("doc_id")).alias("least"), "component")).alias("head")
        heads = labelled.groupBy("token").agg(head, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        heads = heads.select("token", (-F.col("head.least")).alias("leader"), F.col("head.component").alias("of"))
        near = labelled.join(heads, "token").where("component != of").groupBy("doc_id", "leader").count()
        best = near.groupBy("doc_id").agg(F.max(F.struct("count", (-F.col("leader")).alias("least"))).alias("best"))
        found = _links(best.select(F.col("doc_id").alias("a"), (-F.col("best.least")).alias("b")), sets)
        links = stage(found if links is None else links.unionByName(found), "jaccard-links")
        groups = components(links, "jaccard-components")
        labelled = stage(postings.join(groups, postings["doc_id"] == groups["node"], "left").select(
            *postings.columns, F.coalesce("component", "doc_id").alias("component")), "jaccard-labelled")
    # lists that lie in one component have no pair left; longer ones are compared in pairs of blocks
    lists = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo != hi")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    open_ = labelled.drop("centre").join(lists.select("token", blocks.alias("blocks")), "token")
    prefixes = sets.mapInArrow(_prefixes, "prefix_of long, prefix binary")
    open_ = open_.join(prefixes, F.col("doc_id") == F.col("prefix_of")).drop("prefix_of")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    # short lists share a group, each long one has groups of its own
    long_list = F.col("blocks") > 1
    open_ = open_.withColumn("bucket", F.when(long_list, F.col("token")).otherwise(F.pmod(F.xxhash64("token"), F.lit(buckets)))).withColumn("long", long_list)
    pairs = open_.drop("blocks", "with").groupBy("long", "bucket", "i", "j").applyInArrow(_candidates, "a long, b long")
    more = _links(pairs.distinct(), sets)
    links = stage(links.unionByName(more), "jaccard-links")
    groups = components(links, "jaccard-components")

    reps = digests.where("n_shingles > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "digest")).alias("rep"))
    numbers = sets.select("sig", F.col("doc_id").alias("number"))
    reps = stage(reps.join(numbers, "sig", "left").join(groups, F.col("number") == F.col("node"), "left").select("sig", "rep", "number", "component"), "jaccard-reps")
    ids = reps.where("number is not null").select("number", F.col("rep.doc_id").alias("id"))
    ends = links.join(ids.toDF("a", "id_a"), "a").join(ids.toDF("b", "id_b"), "b")
    return digests, reps, ends.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def near_duplicates(docs: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, component_id`` of all documents, and the verified links between sets that are not equal.

    The links connect all that the threshold connects; of pairs within one component not each is listed.  A component is
    named by its least id, a null id standing as the smallest long, so classes of repeated ids can share a name."""
    digests, reps, links = _classes(docs, n)
    heads = reps.where("component is not null").groupBy("component").agg(F.min("rep.doc_id").alias("least"))
    named = reps.join(heads, "component", "left").select("sig", F.coalesce("least", "rep.doc_id").alias("component_id"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return digests.join(named, "sig", "left").select("doc_id", "n_shingles", component.alias("component_id")), links


def drop_near_duplicates(docs: DataFrame, n: int = N) -> DataFrame:
    """One document of each class (the least id, then the least digest of the text), with its own columns.

    Documents without words are classes of their own; rows with equal id and text are one document."""
    digests, reps, _ = _classes(docs, n)
    linked = reps.where("component is not null").groupBy("component").agg(F.min("rep").alias("rep")).select("rep")
    kept = reps.where("component is null").select("rep").unionByName(linked).select("rep.doc_id", "rep.digest")
    kept = kept.unionByName(digests.where("n_shingles = 0").select("doc_id", "digest"))
    names = fresh_names(docs, "__id", "__digest")
    rows = docs.withColumns(dict(zip(names, _row_key())))
    return rows.join(kept.toDF(*names), names, "left_semi").dropDuplicates(names).drop(*names)
