"""Stages of the pipeline on a small table: exact and near copies against plain Python, mix and packing against what they promise."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, __digest string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 200))) for _ in range(60)]
    for _ in range(50):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), None, "", "", "three words here", "Three words here", "x " * 3000]
    rows = [(i, t, rng.choice([None, "en"]), rng.choice([None, "a", "b", "c"]), len(t or ""), 7, "mine") for i, t in enumerate(texts)]
    rows += [(None, "a text without an id", "en", "a", None, 7, "mine"), (None, "another text without an id", None, None, 1, 7, "mine")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _shingles(text):
    w = _lower(text).split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _kept_of_near(rows):
    sets = [_shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups.values()


def test_exact_and_near_copies_against_plain_python(spark, docs):
    rows = docs.collect()
    first = {}
    for r in rows:
        key = _lower(r["text"])
        if key not in first or (r["doc_id"] is None, r["doc_id"] or 0) < (first[key]["doc_id"] is None, first[key]["doc_id"] or 0):
            first[key] = r
    exact = P.exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    got = exact.collect()
    assert sorted(map(repr, got)) == sorted(map(repr, first.values()))
    near = P.near_copies(spark, exact, "")
    assert near.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in near.collect()}
    groups = _kept_of_near(got)
    assert len(kept) == len(groups)
    for group in groups:  # one document of each group, the one of the least id
        members = [(got[k]["doc_id"], got[k]["text"]) for k in group]
        assert sum(m in kept for m in members) == 1
        assert min(members, key=lambda m: -2 ** 63 if m[0] is None else m[0]) in kept


def test_mix_and_packing_keep_their_promises(spark, docs):
    mixed = P.source_mix(spark, P.near_copies(spark, P.exact_copies(spark, docs, ""), ""), "")
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    known = {repr(r) for r in docs.collect()}
    times = {}
    for r in rows:
        assert repr(r) in known
        times[repr(r)] = times.get(repr(r), 0) + 1
    assert rows and max(times.values()) <= 3
    pieces = P.pack(spark, mixed, "").collect()
    ids = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(ids)
    want = sorted(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(want) == sum(p["length"] for p in pieces)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    text_of = {r["doc_id"]: r["text"] or "" for r in rows if r["doc_id"] is not None}
    for p in pieces:
        if p["doc_id"] in text_of and p["length"] == p["doc_tokens"]:
            whole = np.array(tokenizer.encode(text_of[p["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
            assert p["start"] == 0 and p["ids_crc32"] == zlib.crc32(whole.tobytes())


def test_stages_of_an_empty_table(spark, docs):
    none = docs.where(F.lit(False))
    for stage in (P.exact_copies, P.near_copies, P.source_mix):
        out = stage(spark, none, "")
        assert out.columns == docs.columns and out.count() == 0
    assert P.pack(spark, none, "").count() == 0
