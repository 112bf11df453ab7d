"""Ranked lexical search of items over documents by a frequency-ordered trie and branch and bound.

Terms are the maximal runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased.  A document's vector
holds the terms that some item asks for, with their frequencies, the most frequent term of the corpus first, so documents
share paths from the root of a trie (an FP-tree of documents).  Every few thousand documents of a partition form a trie of
their own; nothing of the documents is shuffled but each trie's best rows.

A node of the trie stands for the documents below it: the largest frequency of each term among them and their smallest
length norm m bound any score below, as a term's share grows with its frequency and falls with m.  The walk is depth
first, the most promising child first.  Each item carries its own threshold, the score of its last kept document, and
leaves the walk at a node that cannot reach it; a node that no item follows is not opened.  Below ``LEAF`` documents
scores are computed.  Every sum is an integer below 2**53 held exactly in a double, or else a 64-bit integer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import group_starts, lower_ascii, ranges, small_batches, span_hashes, stage, text_buffers, word_spans

#: Documents of one trie, and the documents below which a node is scored instead of bounded.
TRIE_DOCS, LEAF = 8192, 8
#: Bytes of items handled in one pass over the documents, and terms x items of one walk.
PASS_BYTES, CELLS = 8 << 20, 4_000_000

_GAP = np.zeros(256, bool)
_GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _spans(data: np.ndarray, offsets: np.ndarray):
    return word_spans(data, offsets, _GAP)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low = lower_ascii(raw)
    starts, ends, _ = _spans(low, np.array([0, len(low)]))
    whole = low.tobytes()
    return [whole[i:j] for i, j in zip(starts.tolist(), ends.tolist())]


class Vocabulary:
    """The terms that a pass asks for, found in text by hash and then compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        lengths = np.fromiter(map(len, terms), np.int64, len(terms))
        pool = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum(lengths)
        hashes = span_hashes(pool, ends - lengths, ends)
        order = np.argsort(hashes)
        if len(group_starts(hashes[order])) < len(terms):
            raise ValueError("two terms of the items share a 64-bit hash")
        self.hashes, self.number, self.begin, self.length, self.pool = hashes[order], order, (ends - lengths)[order], lengths[order], pool

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms of the vocabulary, and their numbers."""
        if len(self.hashes) == 0 or len(starts) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = span_hashes(data, starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[place] == hashes) & (self.length[place] == ends - starts))
        place = place[hit]
        if len(hit):
            lengths = self.length[place]
            same = data[ranges(starts[hit], lengths)] == self.pool[ranges(self.begin[place], lengths)]
            right = np.logical_and.reduceat(same, np.cumsum(lengths) - lengths)
            hit, place = hit[right], place[right]
        return hit, self.number[place]


def _vectors(vocabulary: Vocabulary, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            data, offsets = text_buffers(batch.column("text"))
            data = lower_ascii(data)
            starts, ends, first = _spans(data, offsets)
            hit, term = vocabulary.find(data, starts, ends)
            doc = np.searchsorted(first, hit, side="right") - 1
            keys, tf = np.unique(doc * max(1, n_terms) + term, return_counts=True)
            bounds = np.searchsorted(keys, np.arange(batch.num_rows + 1) * max(1, n_terms))
            at = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((keys % max(1, n_terms), pa.int32()), (tf, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(first), pa.int64()), *lists], names=["id", "n", "terms", "tf"])
            yield out.filter(pa.array(np.diff(first) > 0))
    return run


class Block:
    """Items of one walk: their terms in the order of the paths, and how much each item makes of a term."""

    def __init__(self, items: list[tuple[int, Counter]], weight: dict[int, int], frequency: dict[int, int]):
        self.items = [i for i, _ in items]
        known = sorted({t for _, c in items for t in c if t in weight}, key=lambda t: (-frequency[t], t))
        self.rank = {t: r for r, t in enumerate(known)}
        table = np.zeros((len(known), len(items)), np.int64)
        for column, (_, counts) in enumerate(items):
            for t, c in counts.items():
                if t in self.rank:
                    table[self.rank[t], column] = c * weight[t]
        # a term adds at most its weight a million times
        self.table = table.astype(np.float64) if table.sum(0, dtype=np.float64).max(initial=0) * 1e6 < 2.0 ** 52 else table

    def path_places(self, n_terms: int) -> np.ndarray:
        """Of each term of the vocabulary its place in the paths, -1 if no item of the block asks for it."""
        out = np.full(n_terms, -1)
        out[list(self.rank)] = list(self.rank.values())
        return out


def _share(tf: np.ndarray, m) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Trie:
    """Documents in the order of their paths, and the nodes at which paths part."""

    def __init__(self, begin: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray):
        """``begin`` holds the n+1 positions of the documents' entries, each document's ranks ascending."""
        wide = rank.astype(">u4").tobytes()
        keys = [wide[4 * i: 4 * j] for i, j in zip(begin[:-1].tolist(), begin[1:].tolist())]
        self.docs = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        sizes = np.diff(begin)[self.docs]
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        take = ranges(begin[:-1][self.docs], sizes)
        self.rank, self.tf, self.m = rank[take], tf[take], m[self.docs]
        self.share = _share(self.tf, np.repeat(self.m, sizes))
        shared = self._shared_lengths()
        self.children: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._part(shared)

    def _shared_lengths(self) -> np.ndarray:
        """How many terms each document's path shares with the next one's."""
        sizes = np.diff(self.begin)
        least = np.minimum(sizes[:-1], sizes[1:])
        pair = np.repeat(np.arange(len(least)), least)
        a, b = ranges(self.begin[:-2], least), ranges(self.begin[1:-1], least)
        differ = np.flatnonzero(self.rank[a] != self.rank[b])
        out = least.copy()
        first = differ[group_starts(pair[differ])]
        out[pair[first]] = first - (np.cumsum(least) - least)[pair[first]]
        return out

    def _part(self, shared: np.ndarray) -> None:
        """Children of every node that is opened: the stretches between the places where paths share least."""
        todo = [(0, len(self.docs))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < LEAF:
                continue
            inner = shared[lo: hi - 1]
            cuts = np.flatnonzero(inner == inner.min()) + lo + 1
            parts = list(zip([lo, *cuts.tolist()], [*cuts.tolist(), hi]))
            self.children[lo, hi] = parts
            todo.extend(parts)

    def bound(self, lo: int, hi: int, table: np.ndarray, peak: np.ndarray) -> np.ndarray:
        """Of each item (column of ``table``) a score that no document of the node exceeds."""
        i, j = self.begin[lo], self.begin[hi]
        np.maximum.at(peak, self.rank[i:j], self.tf[i:j])
        present = np.flatnonzero(peak)
        out = _share(peak[present], int(self.m[lo:hi].min())).astype(table.dtype) @ table[present]
        peak[present] = 0
        return out

    def search(self, table: np.ndarray, k: int, tie: list) -> list[list[tuple]]:
        """The best ``k`` of each item, as ``(score, tie of the document, document)``."""
        n_items = table.shape[1]
        best: list[list[tuple]] = [[] for _ in range(n_items)]
        floor = np.ones(n_items, table.dtype)  # a document must reach it
        peak = np.zeros(table.shape[0], np.int64)

        def score(lo: int, hi: int, alive: np.ndarray) -> None:
            for place in range(lo, hi):
                i, j = self.begin[place], self.begin[place + 1]
                if i == j:
                    continue
                of = self.rank[i:j]
                rows = table[of] if 2 * len(alive) > n_items else table[np.ix_(of, alive)]
                got = self.share[i:j].astype(table.dtype) @ rows
                if rows.shape[1] != len(alive):
                    got = got[alive]
                for c in np.flatnonzero(got >= floor[alive]).tolist():
                    item, doc = int(alive[c]), int(self.docs[place])
                    entry, heap = (int(got[c]), tie[doc], doc), best[item]
                    if len(heap) < k:
                        heappush(heap, entry)
                    elif entry > heap[0]:
                        heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[item] = heap[0][0]

        everyone = np.arange(n_items)
        walk = [(0, len(self.docs), everyone, self.bound(0, len(self.docs), table, peak))]
        while walk:
            lo, hi, alive, bound = walk.pop()
            stays = bound >= floor[alive]
            alive = alive[stays]
            if len(alive) == 0:
                continue
            parts = self.children.get((lo, hi))
            if parts is None:
                score(lo, hi, alive)
                continue
            opened = []
            for a, b in parts:
                if b - a < LEAF:
                    score(a, b, alive)
                else:
                    opened.append((a, b, alive, self.bound(a, b, table, peak)[alive]))
            walk.extend(sorted(opened, key=lambda node: node[3].max()))
        return best


def _search(blocks: list[Block], n_terms: int, k: int, n_docs: int, n_words: int, id_type: pa.DataType):
    places = [b.path_places(n_terms) for b in blocks]

    def one(ids: list, n: np.ndarray, begin: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        if int(n.max()) * 25 * n_docs < 1 << 63:
            m = 75 + 25 * n * n_docs // n_words
        else:
            m = np.array([75 + 25 * int(x) * n_docs // n_words for x in n], np.int64)
        # equal scores: the smaller id is better, a null id comes after all others
        tie = [(0, 0) if i is None else (1, -i) for i in ids]
        items, docs, scores = [], [], []
        for block, place in zip(blocks, places):
            rank = place[terms]
            mine = np.flatnonzero(rank >= 0)
            doc = np.searchsorted(begin, mine, side="right") - 1
            order = np.lexsort((rank[mine], doc))
            mine, doc = mine[order], doc[order]
            used, at = np.unique(doc, return_index=True)
            if len(used) == 0:
                continue
            trie = Trie(np.append(at, len(doc)), rank[mine], tf[mine], m[used])
            for item, heap in zip(block.items, trie.search(block.table, k, [tie[d] for d in used.tolist()])):
                for score, _, d in heap:
                    items.append(item)
                    docs.append(ids[used[d]])
                    scores.append(score)
        return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(docs, id_type), pa.array(scores, pa.int64())],
                                          names=["item", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(batch.num_rows - at, TRIE_DOCS - rows)
                held.append(batch.slice(at, take))
                at, rows = at + take, rows + take
                if rows == TRIE_DOCS:
                    yield one(*_joined(held))
                    held, rows = [], 0
        if rows:
            yield one(*_joined(held))
    return run


def _joined(batches: list[pa.RecordBatch]):
    whole = pa.Table.from_batches(batches).combine_chunks()
    terms, tf = whole.column("terms").combine_chunks(), whole.column("tf").combine_chunks()
    begin = terms.offsets.to_numpy() - terms.offsets[0].as_py()
    return (whole.column("id").to_pylist(), whole.column("n").to_numpy(), begin, terms.flatten().to_numpy(), tf.flatten().to_numpy())


def _blocks(items: list[tuple[int, Counter]], weight: dict[int, int], frequency: dict[int, int]) -> list[Block]:
    out, held, seen = [], [], set()
    for number, counts in items:
        if held and len(seen | counts.keys()) * (len(held) + 1) > CELLS:
            out.append(Block(held, weight, frequency))
            held, seen = [], set()
        held.append((number, counts))
        seen |= counts.keys()
    return out + ([Block(held, weight, frequency)] if held else [])


def _one_pass(docs: DataFrame, rows: list, item_type: T.DataType, k: int, id_col: str, item_col: str) -> DataFrame:
    """The best documents of the items in ``rows`` (pairs of id and text)."""
    spark, id_type = docs.sparkSession, docs.schema["id"].dataType
    number: dict[bytes, int] = {}
    items = [(i, Counter(number.setdefault(t, len(number)) for t in terms_of(text))) for i, (_, text) in enumerate(rows)]
    vocabulary = Vocabulary(list(number))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    vectors = stage(docs.mapInArrow(_vectors(vocabulary, len(number)), schema), "term-vectors")
    n_docs, n_words = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # as many rows as the pass has terms
    frequency = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequency.items()}
    found = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    arrow_id = pa.int32() if isinstance(id_type, T.IntegerType) else pa.int64()
    blocks = _blocks([(i, c) for i, c in items if c], weight, frequency)
    best = vectors.mapInArrow(_search(blocks, len(number), k, n_docs, n_words, arrow_id), found)
    # an item's rows grow with the tries: ranked by parts first, so that no task holds them all
    order = [F.desc("score"), F.asc_nulls_last("id")]
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    best = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    best = best.where(F.col("rank") <= k).drop("part")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)],
                                  T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_col, item_type)]))
    return best.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Each item's ``k`` documents of highest score above 0: item id, ``rank`` (from 1), document id, ``score``.

    With N documents that have a term, L terms in all, n terms of a document, df documents that hold a term and tf its
    occurrences in a document: ``w = floor(1000 ln((2N+2)/(2df+1)))``, ``m = 75 + (25 n N) div L``, and a score sums
    ``w * ((10**9 tf) div (1000 tf + 12 m))`` over the item's terms, repeats included.  Equal scores go by ascending id,
    a null id last.  Ids are integers.  A null or empty text has no terms: such a document is neither counted nor found,
    such an item has no rows.  Repeated ids are documents and items of their own.  Columns beside the named ones are not
    looked at.  Items are query texts: those of one pass (``pass_bytes`` of them on average, an item is never cut) pass
    through the driver to all tasks; more items mean more passes over the documents.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType)):
        raise TypeError("document ids must be integers")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64))).first()[0] or 0
    passes = 1 + int(size) // pass_bytes
    out = None
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p).collect()
        one = _one_pass(docs, [tuple(r) for r in rows], items.schema["item"].dataType, k, id_col, item_col)
        out = one if out is None else out.unionByName(one)
    return out
