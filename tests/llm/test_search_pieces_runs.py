"""Lexical search, SentencePiece coding and periodic runs against brute force: nulls, empty and long texts, ties, repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import lexical_search, periodic_runs, piece_codec, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, id string, item string, n long, runs string, score string, rank int, part int"
EXTRA = ("x", "x", 1, "x", "x", 1, 1)
BIG = [9007199254740993, 9007199254740995]  # not exact as doubles


def _texts(n=120, seed=5):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(60)] + ["Über", "été", "x1", "The", "the", "a-b", "don't"]
    weights = [1 / (k + 1) for k in range(len(words))]
    out = [None, "", " \t\n", "--", "One", "one", "the the the the the the", "a b " * 4, "a b c " * 400 + "d", "漢字 " * 9 + "é"]
    while len(out) < n:
        out.append(" ".join(rng.choices(words, weights, k=rng.randint(1, 150))))
    return out + out[60:70]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *EXTRA) for i, t in enumerate(_texts())] + [(None, "w1 w2 w3", *EXTRA), (None, None, *EXTRA), (7, "w1 the Über", *EXTRA)]
    rows += [(i, "w3 w4 exact ids", *EXTRA) for i in BIG]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------------------------------------- 11

def _terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def _ranked(docs, items, k):
    counted = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs if _terms(t)]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in _terms(text) if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, row[3], -row[0]) for r, row in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return out


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("k,pass_bytes,cells", [(20, 8 << 20, 4_000_000), (3, 8 << 20, 40), (5, 900, 4_000_000)])
def test_search_equals_brute_force(spark, docs, monkeypatch, k, pass_bytes, cells):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    items = [(i, t, *EXTRA) for i, t in enumerate(["w1 w2 the", "THE the w5 w59", None, "", "nothing here", "über été w3 w3 w3", "w50 w51 w52 w53 x1"] * 3)]
    items += [(None, "w7", *EXTRA), (1, "w8 w9", *EXTRA)]
    table = spark.createDataFrame(items, DOCS.replace("doc_id", "item_id").replace("item string", "other string"))
    got = lexical_search.rank_documents(docs, table, k, pass_bytes=pass_bytes).collect()
    want = _ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [(i[0], i[1]) for i in items], k)
    assert _sorted(tuple(r) for r in got) == _sorted(want)


def test_search_of_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.rank_documents(empty, items).count() == 0
    assert lexical_search.rank_documents(docs, items.where("false")).count() == 0
    assert lexical_search.rank_documents(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0


def test_walk_bounds_and_prunes():
    """A node's bound is never below a score under it, and the walk opens few documents that cannot rank."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 30, 3000)
    rank = np.concatenate([np.sort(rng.choice(200, s, replace=False)) for s in sizes])
    tf, m = rng.integers(1, 9, len(rank)), rng.integers(76, 300, len(sizes))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    table = np.where(rng.random((200, 12)) < 0.1, rng.integers(1, 9000, (200, 12)), 0).astype(np.float64)
    trie = lexical_search.Trie(begin, rank, tf, m)
    share = lexical_search._share(tf, np.repeat(m, sizes))
    scores = np.array([share[i:j].astype(float) @ table[rank[i:j]] for i, j in zip(begin[:-1], begin[1:])])
    peak = np.zeros(200, np.int64)
    for lo, hi in trie.children:
        assert (trie.bound(lo, hi, table, peak) >= scores[trie.docs[lo:hi]].max(0)).all()
    best = trie.search(table, 5, [(1, -i) for i in range(3000)])
    for item, heap in enumerate(best):
        want = sorted(((int(s), -d) for d, s in enumerate(scores[:, item]) if s > 0), reverse=True)[:5]
        assert sorted(((s, -d) for s, _, d in heap), reverse=True) == want


# ---------------------------------------------------------------------------------------------- 12

@pytest.fixture(scope="module")
def model():
    return piece_codec.PieceModel(MODEL)


def _library(model, text):
    ids = model.library.encode(text)
    return ids, model.library.decode(ids)


def test_pieces_equal_the_library(docs, empty, model):
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["ids"]), r["decoded"])
                  for r in piece_codec.encode_pieces(docs, MODEL).collect()))
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(_library(model, r["text"] or "")[0]), _library(model, r["text"] or "")[1])
                  for r in docs.collect())
    assert got == want
    assert piece_codec.encode_pieces(empty, MODEL).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list(" \t\nabeginrstABé漢😀▁\x00.,1") + ["the", "  ", "<s>", "</s>", "<0x41>", "ing"]), max_size=90).map("".join), max_size=6))
def test_agenda_equals_the_library(model, texts):
    assert [x.tolist() for x in model.encode(texts)] == model.library.encode(texts)


def test_long_units_and_a_full_table(model, monkeypatch):
    texts = ["a" * 7000, " " * 4000, "ab" * 3000 + " " + "the" * 900, "漢é" * 500, "x"]
    want = model.library.encode(texts)
    assert [x.tolist() for x in model.encode(texts)] == want
    monkeypatch.setattr(piece_codec, "MAX_UNITS", 1)
    assert [x.tolist() for x in model.encode(texts)] == want
    long_, short = ["▁there", "▁,x", "▁a漢"], piece_codec.PieceModel(MODEL)
    symbols, counts = short.merged_side_by_side(long_)
    flat, counts = short._expanded(symbols, counts)
    assert np.split(flat, np.cumsum(counts)[:-1])[0].tolist() == short.unit_ids("▁there") and flat.tolist() == sum(map(short.unit_ids, long_), [])


def test_a_difference_from_the_library_is_an_error(model, monkeypatch):
    other = piece_codec.PieceModel(MODEL)
    other.rules[:, 1] = other.rules[::-1, 1]  # another order of merges
    with pytest.raises(ValueError, match="library"):
        other.encode(["there is something rather different here"])


# ---------------------------------------------------------------------------------------------- 13

def _brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            smallest = all(any(words[k] != words[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=7))
def test_runs_of_repeated_blocks(blocks):
    ids = [x for block, times in blocks for x in block * times]
    assert periodic_runs.runs_of(np.array(ids, np.int64)) == _brute_runs(ids)


def test_runs_of_fibonacci_words_and_random_binary_words():
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    rng = random.Random(4)
    for ids in (b, b[:89] * 5, [0] * 50, [0, 0, 1] * 30, [rng.randint(0, 1) for _ in range(200)], list(range(100)) * 4, list(range(100)) * 3):
        assert periodic_runs.runs_of(np.array(ids, np.int64)) == _brute_runs(ids)


def test_rare_words_split():
    ids = np.array([1, 2] * 5 + [9] + [1, 2] * 2 + [3] * 7)
    assert periodic_runs.surviving_segments(ids) == [(0, 10), (15, 22)]


def _check_runs(docs, rows):
    want = sorted(((r["doc_id"], _words(r["text"])) for r in docs.collect()), key=repr)
    want = sorted(((i, len(w), tuple(_brute_runs(w)), _collapsed(w, _brute_runs(w))) for i, w in want), key=repr)
    assert sorted(((r[0], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in rows), key=repr) == want


def test_periodic_runs(docs, empty):
    _check_runs(docs, periodic_runs.periodic_runs(docs).collect())
    assert periodic_runs.periodic_runs(empty).count() == 0


def _planted(doc_id, text):
    words = _words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or n == 0:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_query_of_runs(spark, tmp_path):
    texts = [t for t in _texts(400, 9)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words, r = _planted(i, text), got[i]
        runs = _brute_runs(words)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4))
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(_collapsed(words, runs).encode()).hexdigest()


def test_query_of_pieces(spark, tmp_path, model):
    texts = _texts(40, 2)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12(spark, str(tmp_path)).collect():
        ids, decoded = _library(model, texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
