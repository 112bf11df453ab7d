"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context-frequency buckets.

A text is its lower-cased words and one end token.  The model mixes bigram and unigram relative frequencies with a
uniform share over the vocabulary; the mixture weights depend on how often the context was seen (buckets by its binary
logarithm) and are learned by expectation-maximisation on held-out counts: one part of the training documents is deleted
from the counts, and weights are chosen that make that part likely.  The final counts are those of all training documents.

Documents are cut into chunks of about a million words, each stored as a vocabulary of word hashes and a stream of
indexes.  A chunk asks for the counts of its distinct n-grams, once for each; requests are dealt by the hash of the whole
n-gram, so no frequent word makes a hot group, and are summed and answered bucket by bucket.  Nothing that grows with the
corpus reaches the driver: expectation-maximisation reads a histogram over a fixed grid of quantised estimates.

N-grams are told apart by 64-bit hashes.  Edge cases: null text counts as empty, and an empty text is its end token;
repeated rows are separate documents; without training documents every score is that of the uniform share; an empty
table gives an empty result; extra columns are ignored; a null id is crc32 of the empty string.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, group_starts, lower_ascii, mix, shuffle_width, small_batches, span_hashes, stage, text_buffers, word_spans

CHUNK_WORDS = 1_000_000
END = U(0xE0D0_0000_0000_0001)
CONTEXT_BUCKETS = 40
GRID = 10  # steps of the histogram for each decade of an estimate
TRAIN, HELD_OUT, DELETED = 0, 1, 2

_STORE = "chunk string, deleted boolean, doc_ids binary, sizes binary, roles binary, words binary, stream binary"
_REQUEST = "bucket int, chunk string, deleted boolean, first_order long, hashes binary, counts binary"
_ANSWER = "chunk string, bucket int, counts binary, types long, tokens long, deleted_tokens long"


def _zip(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unzip(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), dtype)


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents; the deleted part keeps to chunks of its own."""
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def emit(deleted: bool) -> pa.RecordBatch:
        hashes, sizes, ids, roles = (np.concatenate(x) for x in zip(*held[deleted]))
        words, stream = np.unique(hashes, return_inverse=True)
        row = {"chunk": uuid.uuid4().hex, "deleted": deleted, "doc_ids": _zip(ids), "sizes": _zip(sizes), "roles": _zip(roles),
               "words": words.tobytes(), "stream": _zip(stream.astype(np.uint32))}
        held[deleted], size[deleted] = [], 0
        return _batch([row], _STORE)

    for batch in small_batches(batches, "text"):
        roles, ids = np.asarray(batch.column("role")), np.asarray(batch.column("doc_id"))
        data, offsets = text_buffers(batch.column("text"))
        data = lower_ascii(data)
        starts, ends, bounds = word_spans(data, offsets)
        tokens = np.insert(span_hashes(data, starts, ends), bounds[1:], END)
        sizes = np.diff(bounds) + 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for deleted in (False, True):
            rows = (roles == DELETED) == deleted
            if rows.any():
                held[deleted].append((tokens[rows[owner]], sizes[rows], ids[rows], roles[rows].astype(np.int8)))
                size[deleted] += int(sizes[rows].sum())
                if size[deleted] >= CHUNK_WORDS:
                    yield emit(deleted)
    for deleted in (False, True):
        if held[deleted]:
            yield emit(deleted)


class _Chunk:
    """A stored chunk: token stream, previous tokens and distinct n-grams, in the order of the requests."""

    def __init__(self, row: dict, buckets: int):
        self.ids, self.sizes = _unzip(row["doc_ids"], np.int64), _unzip(row["sizes"], np.int64)
        self.roles = _unzip(row["roles"], np.int8)
        words = np.frombuffer(row["words"], U)
        stream = _unzip(row["stream"], np.uint32).astype(np.int64)
        end = int(np.searchsorted(words, END))
        before = np.concatenate(([end], stream[:-1]))  # a text's first word follows an end token
        pairs, self.pair = np.unique(before * len(words) + stream, return_inverse=True)
        a, b = pairs // len(words), pairs % len(words)
        hashes = np.concatenate((words, mix(mix(words[a]) * U(0x9FB21C651E98DF25) + words[b])))
        self.n_words, self.before, self.stream = len(words), before, stream
        bucket = (mix(hashes ^ U(0xB0C4)) % U(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = group_starts(bucket[self.order])
        self.buckets, self.hashes = bucket[self.order][self.cuts] if len(hashes) else bucket, hashes

    def parts(self):
        return zip(self.buckets.tolist(), self.cuts.tolist(), np.append(self.cuts[1:], len(self.order)).tolist())


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, buckets)
                learn = np.repeat(chunk.roles != HELD_OUT, chunk.sizes).astype(np.float64)
                counts = np.concatenate((np.bincount(chunk.stream, weights=learn, minlength=chunk.n_words), np.bincount(chunk.pair, weights=learn)))
                counts = counts.astype(np.uint32)
                rows = []
                for bucket, a, b in chunk.parts():
                    at = chunk.order[a:b]
                    rows.append({"bucket": bucket, "chunk": row["chunk"], "deleted": row["deleted"], "first_order": int((at < chunk.n_words).sum()),
                                 "hashes": chunk.hashes[at].tobytes(), "counts": _zip(counts[at])})
                yield _batch(rows, _REQUEST)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Counts in all training documents, and in the deleted part, for each request of one bucket."""
    rows = table.to_pylist()
    hashes = [np.frombuffer(r["hashes"], U) for r in rows]
    counts = [_unzip(r["counts"], np.uint32) for r in rows]
    sizes = [len(h) for h in hashes]
    owner_deleted = np.repeat(np.array([r["deleted"] for r in rows]), sizes)
    first_order = np.concatenate([np.arange(n) < r["first_order"] for n, r in zip(sizes, rows)])
    flat = np.concatenate(counts).astype(np.float64)
    unique, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, weights=flat, minlength=len(unique))
    deleted = np.bincount(which, weights=flat * owner_deleted, minlength=len(unique))
    is_word = np.zeros(len(unique), bool)
    is_word[which[first_order]] = True
    both = np.stack([total, deleted], 0).astype(np.uint64)[:, which]
    out, at = [], 0
    for r, n in zip(rows, sizes):
        out.append({"chunk": r["chunk"], "bucket": r["bucket"], "counts": _zip(both[:, at: at + n])})
        at += n
    out.append({"chunk": "", "bucket": rows[0]["bucket"], "types": int((is_word & (total > 0)).sum()), "tokens": int(total[is_word].sum()),
                "deleted_tokens": int(deleted[is_word].sum())})
    return pa.Table.from_batches([_batch(out, _ANSWER)])


def _with_answers(store: DataFrame, answers: DataFrame, buckets: int, use, ddl: str) -> DataFrame:
    """Apply ``use(chunk, counts, deleted counts)`` to every chunk and its answers."""

    def together(_, left: pa.Table, right: pa.Table) -> pa.Table:
        batches = []
        by_bucket = dict(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()))
        for row in left.to_pylist():
            chunk = _Chunk(row, buckets)
            counts = np.empty((2, len(chunk.hashes)), np.float64)
            for bucket, a, b in chunk.parts():
                counts[:, chunk.order[a:b]] = _unzip(by_bucket[bucket], np.uint64).reshape(2, -1)
            batches.append(use(chunk, counts[0], counts[1]))
        return pa.Table.from_batches(batches or [_batch([], ddl)])

    chunks = store.groupBy("chunk")
    return chunks.cogroup(answers.select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(together, ddl)


def _context_bucket(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(seen + 1).astype(np.int64), CONTEXT_BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a, dtype=np.float64), where=np.broadcast_to(np.asarray(b) > 0, a.shape))


def _estimates(chunk: _Chunk, counts: np.ndarray, total: float):
    word, pair = counts[: chunk.n_words], counts[chunk.n_words:]
    context = word[chunk.before]
    return _ratio(pair[chunk.pair], context), _ratio(word, total)[chunk.stream], _context_bucket(context)


def expectation_maximisation(bucket: np.ndarray, bigram: np.ndarray, unigram: np.ndarray, count: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket; a bucket without held-out tokens takes those of all."""

    def learn(rows: np.ndarray) -> np.ndarray:
        parts = np.stack([bigram[rows], unigram[rows], np.full(int(rows.sum()), uniform)])
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = parts * weight[:, None]
            share /= share.sum(0)
            weight = np.maximum((share * count[rows]).sum(1), 1e-9)
            weight /= weight.sum()
        return weight

    if not len(count):
        return np.tile(np.array([0.0, 0.0, 1.0]), (CONTEXT_BUCKETS, 1))
    whole = learn(np.ones(len(count), bool))
    out = np.tile(whole, (CONTEXT_BUCKETS, 1))
    for b in np.unique(bucket).tolist():
        out[b] = learn(bucket == b)
    return out


def score_documents(docs: DataFrame, held_out: Column, deleted: Column, alpha: float = 0.1) -> DataFrame:
    """Log10 probabilities of all documents under a model of those that are not ``held_out``.

    ``deleted`` names the part of the training documents on which the weights are learned.  Returns ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score`` (unigrams with ``alpha`` added) and ``score``."""
    spark = docs.sparkSession
    buckets = 2 * shuffle_width(spark)
    role = F.when(held_out, HELD_OUT).when(deleted, DELETED).otherwise(TRAIN).cast("int")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("doc_id"), role.alias("role"), "text")
    store = stage(rows.mapInArrow(_chunks, _STORE), "lm-chunks")
    answers = stage(store.mapInArrow(_ask(buckets), _REQUEST).groupBy("bucket").applyInArrow(_answer, _ANSWER), "lm-answers")
    sums = answers.where("chunk = ''").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "deleted_tokens"))).first()
    answers = answers.where("chunk != ''")
    types, tokens, gone = sums["types"], sums["tokens"], sums["deleted_tokens"]
    uniform = 1.0 / (types + 1)

    histogram_ddl = "bucket int, bigram int, unigram int, n long"

    def histogram(chunk: _Chunk, counts: np.ndarray, of_deleted: np.ndarray) -> pa.RecordBatch:
        bigram, unigram, context = _estimates(chunk, counts - of_deleted, tokens - gone)
        step = lambda x: np.where(x > 0, np.round(np.log10(np.maximum(x, 1e-30)) * GRID), 1).astype(np.int64)
        key = (context << 40) | (step(bigram) + 1000 << 20) | step(unigram) + 1000
        key, n = np.unique(key, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key >> 40, pa.int32()), pa.array((key >> 20 & 0xFFFFF) - 1000, pa.int32()),
                                           pa.array((key & 0xFFFFF) - 1000, pa.int32()), pa.array(n, pa.int64())], names=["bucket", "bigram", "unigram", "n"])

    grid = _with_answers(store.where("deleted"), answers, buckets, histogram, histogram_ddl).groupBy("bucket", "bigram", "unigram").agg(F.sum("n").alias("n")).toPandas()
    value = lambda q: np.where(q == 1, 0.0, 10.0 ** (q / GRID))
    weights = expectation_maximisation(grid["bucket"].to_numpy(), value(grid["bigram"].to_numpy(float)), value(grid["unigram"].to_numpy(float)),
                                       grid["n"].to_numpy(float), uniform)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(chunk: _Chunk, counts: np.ndarray, _) -> pa.RecordBatch:
        bigram, unigram, context = _estimates(chunk, counts, tokens)
        weight = weights[context]
        model = np.log10(weight[:, 0] * bigram + weight[:, 1] * unigram + weight[:, 2] * uniform)
        word = counts[: chunk.n_words]
        base = np.log10((word + alpha) / (tokens + alpha * (types + 1)))[chunk.stream]
        at = np.cumsum(chunk.sizes) - chunk.sizes
        total = lambda x: np.add.reduceat(x, at)
        return pa.RecordBatch.from_arrays([
            pa.array(chunk.ids), pa.array(chunk.roles == HELD_OUT), pa.array(chunk.sizes), pa.array(total((word > 0)[chunk.stream].astype(np.int64))),
            pa.array(np.full(len(at), tokens), pa.int64()), pa.array(total(base)), pa.array(total(model))], names=[f.split()[0] for f in ddl.split(", ")])

    return _with_answers(store, answers, buckets, score, ddl)
