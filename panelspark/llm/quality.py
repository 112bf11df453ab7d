"""Quality classifier: supervised subword embeddings with softmax output, trained by numpy stochastic gradient descent.

A document is the average of the learned vectors of its words' features.  Features of a word: the word itself, its
character n-grams of 3 and 4 letters (with boundary marks), the word together with the one before it (a word bigram), and
a mark when both are the same; all are hashed to a table of vectors.  A softmax over two classes reads the average.

Training takes a bounded sample of labelled rows (``max_rows`` of each class, those with the lowest seeded hash) and runs
in one task; its memory is bounded by ``max_rows`` and ``max_train_bytes``.  Scoring is linear in the average, so each
feature is one number: its vector times the difference of the two output rows.

Edge cases: null and empty texts score by the bias alone; rows without a label, or with a null label, are not learned
from; repeated labels of an id count once (the largest); without labels of both classes the score is the share of label
1 (0.5 without any); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, mix, ranges, small_batches, span_hashes, text_buffers, word_spans

TABLE = 1 << 18
DIM = 8
EPOCHS = 6
RATE = 2.0
LONGEST = 1.0
SEED = 10
MAX_ROWS = 3000
MAX_TRAIN_BYTES = 64 << 20
_REPEAT = 1  # slot of the repetition mark; slot 0 stays unused


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of each word, end to end, and the n+1 offsets."""
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    text = "".join("<" + w.decode("utf-8", "replace") + ">" for w in words)
    letters = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(U)
    sizes = np.array([len(w.decode("utf-8", "replace")) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    slots, owners = [], []
    whole = span_hashes(np.frombuffer(b"".join(words), np.uint8), *_spans(words), seed=7)
    slots.append(whole)
    owners.append(np.arange(len(words)))
    for width in (3, 4):
        count = np.maximum(sizes - width + 1, 0)
        at = ranges(starts, count)
        gram = np.full(len(at), U(width))
        for k in range(width):
            gram = gram * U(0x100000001B3) + letters[at + k]
        slots.append(mix(gram))
        owners.append(np.repeat(np.arange(len(words)), count))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    slot = (np.concatenate(slots)[order] % U(TABLE - 2)).astype(np.int64) + 2
    return slot, np.searchsorted(owner[order], np.arange(len(words) + 1))


def _spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in words])
    return ends - np.array([len(w) for w in words]), ends


def bigram_slots(hashes: np.ndarray) -> np.ndarray:
    """Feature slot of each word hash but the first together with the one before it."""
    pair = mix(hashes[:-1] * U(0x100000001B3) + mix(hashes[1:]))
    return (pair % U(TABLE - 2)).astype(np.int64) + 2


def _distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Distinct words of a batch; of each occurrence its word and text; slot and text of each bigram; and repetitions in
    each text."""
    starts, ends, bounds = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    inside = np.flatnonzero(text[1:] == text[:-1])
    same = inside[hashes[inside + 1] == hashes[inside]]
    pairs = bigram_slots(hashes)[inside] if len(hashes) else np.empty(0, np.int64)
    return words, which, text, pairs, text[inside], np.bincount(text[same], minlength=len(offsets) - 1)


def train(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict:
    """Vectors, output rows and bias, learned by minibatch gradient descent with a falling rate."""
    n = len(labels)
    share = float(labels.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        return {"scores": np.zeros(TABLE, np.float32), "bias": 0.0, "constant": share}
    words, which, text, pairs, pair_text, repeats = _distinct_words(data, offsets)
    slots, of = word_features(words)
    both, both_count = np.unique(pair_text.astype(np.int64) * TABLE + pairs, return_counts=True)
    both_first = np.searchsorted(both, np.arange(n + 1, dtype=np.int64) * TABLE)
    pair, count = np.unique(text.astype(np.int64) * (len(words) + 1) + which, return_counts=True)
    doc, word = pair // (len(words) + 1), pair % (len(words) + 1)
    first = np.searchsorted(doc, np.arange(n + 1))
    sizes = np.diff(of)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (TABLE, DIM)).astype(np.float32)
    output, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    # both classes weigh in as they occur in the labels: scores are probabilities under that mix
    steps, step, batch = EPOCHS * ((n + 31) // 32), 0, 32
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            rows = order[a: a + batch]
            spans = np.diff(first)[rows]
            at = ranges(first[rows], spans)
            used, weight = word[at], count[at].astype(np.float32)
            owner = np.repeat(np.arange(len(rows)), spans)
            wide = sizes[used]
            two_spans = np.diff(both_first)[rows]
            two = ranges(both_first[rows], two_spans)
            slot = np.concatenate((slots[ranges(of[used], wide)], both[two] % TABLE, np.full(len(rows), _REPEAT)))
            value = np.concatenate((np.repeat(weight, wide), both_count[two].astype(np.float32), repeats[rows].astype(np.float32)))
            owner = np.concatenate((np.repeat(owner, wide), np.repeat(np.arange(len(rows)), two_spans), np.arange(len(rows))))
            total = np.maximum(np.bincount(owner, weights=value, minlength=len(rows)), 1).astype(np.float32)
            value /= total[owner]
            unique, inverse = np.unique(slot, return_inverse=True)
            # documents by features, summed where a feature comes from several words
            table = np.bincount(owner * len(unique) + inverse, weights=value, minlength=len(rows) * len(unique)).astype(np.float32).reshape(len(rows), -1)
            mean = table @ vectors[unique]
            raw = mean @ output + bias
            raw -= raw.max(1, keepdims=True)
            p = np.exp(raw)
            p /= p.sum(1, keepdims=True)
            error = (p - target[rows]) / np.float32(len(rows))
            rate = np.float32(RATE * batch * (1 - step / steps))
            to_output, to_vectors = mean.T @ error, table.T @ (error @ output.T)
            # a step is no longer than LONGEST, which keeps texts of few and frequent words from blowing up
            length = rate * np.float32(np.sqrt((to_output ** 2).sum() + (to_vectors ** 2).sum()))
            rate *= np.float32(min(1.0, LONGEST / max(float(length), 1e-9)))
            output -= rate * to_output
            bias -= np.float32(0.1) * rate * error.sum(0)
            vectors[unique] -= rate * to_vectors
            step += 1
    return {"scores": vectors @ (output[:, 1] - output[:, 0]), "bias": float(bias[1] - bias[0]), "constant": None}


def score(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    n = len(offsets) - 1
    if model["constant"] is not None:
        return np.full(n, model["constant"])
    words, which, text, pairs, pair_text, repeats = _distinct_words(data, offsets)
    slots, of = word_features(words)
    sums = np.concatenate(([0.0], np.cumsum(model["scores"][slots].astype(np.float64))))
    value, size = sums[of[1:]] - sums[of[:-1]], np.diff(of).astype(np.float64)
    total = np.bincount(text, weights=value[which], minlength=n) + repeats * float(model["scores"][_REPEAT])
    total += np.bincount(pair_text, weights=model["scores"][pairs].astype(np.float64), minlength=n)
    count = np.bincount(text, weights=size[which], minlength=n) + np.bincount(pair_text, minlength=n) + repeats
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model["bias"], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = MAX_ROWS, max_train_bytes: int = MAX_TRAIN_BYTES) -> bytes:
    """Train on at most ``max_rows`` labelled rows of each class among those that ``learnable`` admits.

    The sample holds no more than ``max_train_bytes`` of text: rows beyond that, in hash order, are not learned from."""
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    order = F.xxhash64(F.col("label_id"), F.lit(SEED))
    known = known.where(learnable).withColumn("draw", order)
    picked = known.where("quality = 0").orderBy("draw", "label_id").limit(max_rows).unionByName(
        known.where("quality = 1").orderBy("draw", "label_id").limit(max_rows))
    both = known.groupBy("quality").count()
    shares = {r["quality"]: r["count"] for r in both.collect()}
    # at most 2 * max_rows narrow rows, so they are broadcast to the scan of the texts
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(picked), "label_id")
    rows = rows.select("text", "quality", "draw", "label_id").repartition(1).sortWithinPartitions("draw", "label_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, held = [], [], 0
        for batch in batches:
            for text, mark in zip(batch.column("text"), batch.column("quality").to_pylist()):
                raw = (text.as_py() or "").encode()
                if held + len(raw) <= max_train_bytes:
                    texts.append(raw)
                    marks.append(mark)
                    held += len(raw)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        model = train(np.frombuffer(b"".join(texts), np.uint8), offsets, np.array(marks, np.int64))
        if model["constant"] is None:  # from the sample's mix of classes to that of all labels
            kept = np.bincount(marks, minlength=2)
            model["bias"] += float(np.log(shares[1] / shares[0]) - np.log(kept[1] / kept[0]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    return rows.mapInArrow(learn, "model binary").first()["model"]


def scored(docs: DataFrame, model: bytes, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``name``, in place of a column of that name.  The model is a table of
    fixed size (a megabyte)."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in small_batches(batches, "text"):
            values = score(known, *text_buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
