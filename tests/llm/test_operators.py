"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from panelspark.llm import (embedding_neardup, exact_dedup, html_extract, html_pages, jaccard_join, lm_scoring, mixing, packing,
                            quality, substring_dedup, token_store)
from panelspark.llm.common import span_hashes

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string, component string, size string, score string, key string"


def _texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n // 2)]
    out = [None, "", " \t\n", "One", "one", "a b c", "A  b\tC", "x " * 3000]
    while len(out) < n:
        words_of = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words_of[rng.randrange(len(words_of))] = rng.choice(words)
        out.append(" ".join(words_of) + rng.choice(["", "", "\n" + base[0]]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "a", "b", "c"][i % 4], "x", "x", "x", "x") for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def _lower(text):
    return text.encode().lower()


# ---------------------------------------------------------------------------------------------- 8

def test_exact_duplicates(docs, empty):
    groups = {}
    for i, t in _texts_of(docs).items():
        groups.setdefault(_lower(t), []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t).digest()) for t, g in groups.items() for i in g}
    rows = exact_dedup.exact_duplicates(docs, keep_largest=True, partitions=7).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in rows} == want
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs.union(docs))  # repeated rows: one of them stays
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values()) and kept.columns == docs.columns


# ---------------------------------------------------------------------------------------------- 1

def test_wavelet_matrix_round_trip():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.4, 3000) % 700).astype(np.uint16)
    m = token_store.WaveletMatrix(token_store.build(ids, np.array([5, 9]), np.array([0, 1000]), 17))
    assert (m.ids() == ids).all() and m.before == 17
    for i in (0, 1, 511, 512, 513, 2999):
        assert m.access(i) == ids[i]
    for t in (int(ids[0]), int(ids[77]), 699, 65000):
        places = np.flatnonzero(ids == t)
        assert m.count(t) == len(places) and m.rank(t, 1500) == int((places < 1500).sum())
        for k in range(0, len(places), max(1, len(places) // 5)):
            assert m.select(t, k) == places[k]


def test_token_files(docs, empty):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(_texts_of(docs).items()):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    rows = token_store.document_digests(token_store.write_shards(docs, path, 0, shard_tokens=500)).collect()
    assert sorted(map(tuple, rows)) == want
    assert token_store.document_digests(token_store.write_shards(empty, path, 0)).count() == 0


# ---------------------------------------------------------------------------------------------- 6

def test_packing(docs, empty):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in _texts_of(docs).items()}
    rows = packing.pack_documents(docs, path, 1, window=256).collect()
    got, fill = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and len(ids) == r["length"]
        got[r["doc_id"]] += ids
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256 and end & (end - 1) == 0
    assert packing.pack_documents(empty, path, 1).count() == 0


def test_packing_looks_at_all_neighbours():
    # 80 neighbours resemble the seed more and are too long for the rest of its window; the last one fits
    docs = [np.arange(95)] + [np.append(np.arange(49), 200 + k) for k in range(80)] + [np.arange(900, 905)]
    pieces = packing.pack(docs, 100)
    assert [p[:3] for p in pieces if p[3] == 0] == [(0, 0, 95), (81, 0, 5)]


# ---------------------------------------------------------------------------------------------- 4

def test_mixing(spark, docs, empty):
    taken, sources = mixing.mix_sources(docs, F.array("source"))
    by = {}
    for r in taken.collect():
        assert 0 <= r["passes"] <= 3
        by[r["members"][0]] = by.get(r["members"][0], 0) + r["size"] * r["passes"]
    assert taken.count() == docs.count()
    names = [r["name"] for r in sources.collect()]
    assert names == ["a", "b", "c", None]
    largest = {}
    for r in taken.collect():
        largest[r["members"][0]] = max(largest.get(r["members"][0], 0), r["size"])
    for r in sources.collect():  # documents are taken whole, and one of them is very long
        assert abs(by[r["name"]] - r["target"]) <= max(30, largest[r["name"]] / 2)
    assert mixing.mix_sources(empty, F.array("source"))[0].count() == 0


def test_flow_prefers_first_passes():
    # the shared pattern serves the source that could only repeat otherwise
    assert mixing.min_cost_flow([100, 100], [[0], [0, 1]], [150, 50]) == [100, 100]
    assert mixing.min_cost_flow([10], [[0]], [100]) == [30]


def _cheapest(capacity, members, quota, passes):
    """Greatest flow at the least cost, by trying every way to share each pattern's words among its sources."""
    best = {tuple(quota): 0}  # room left -> least cost so far
    cost = lambda cap, sent: sum(k * (k + 1) // 2 * min(max(sent - k * cap, 0), cap) for k in range(passes))
    for cap, of in zip(capacity, members):
        step = {}
        for room, spent in best.items():
            for share in itertools.product(*(range(min(room[s], passes * cap) + 1) for s in of)):
                if sum(share) <= passes * cap:
                    left = list(room)
                    for s, x in zip(of, share):
                        left[s] -= x
                    value = spent + cost(cap, sum(share))
                    step[tuple(left)] = min(step.get(tuple(left), 1 << 60), value)
        best = step
    least = min(sum(room) for room in best)
    return sum(quota) - least, min(c for room, c in best.items() if sum(room) == least)


def test_flow_is_the_cheapest():
    rng = random.Random(5)
    for _ in range(150):
        sources = rng.randint(1, 3)
        members = [rng.sample(range(sources), rng.randint(0, sources)) for _ in range(rng.randint(1, 4))]
        capacity, quota = [rng.randint(0, 3) for _ in members], [rng.randint(0, 6) for _ in range(sources)]
        sent = mixing.min_cost_flow(capacity, members, quota)
        assert all(0 <= x <= 3 * c for x, c in zip(sent, capacity))
        cost = sum(k * (k + 1) // 2 * min(max(x - k * c, 0), c) for x, c in zip(sent, capacity) for k in range(3))
        assert (sum(sent), cost) == _cheapest(capacity, members, quota, 3)


def test_flow_of_many_patterns_ends_soon():
    rng = random.Random(6)
    members = [sorted(rng.sample(range(40), rng.randint(1, 5))) for _ in range(100_000)]
    capacity = [rng.randint(0, 10**6) for _ in members]
    total = sum(capacity)
    start = time.monotonic()
    sent = mixing.min_cost_flow(capacity, members, [total // 820 * (k + 1) for k in range(40)])
    assert sum(sent) == sum(total // 820 * (k + 1) for k in range(40)) and time.monotonic() - start < 60
    assert mixing.capped_targets([10, 100], [1, 1], 3) == [30.0, 80.0]


# ---------------------------------------------------------------------------------------------- 3

def test_lm_scores(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    rows = lm_scoring.score_documents(docs, held == 0, held == 1).collect()
    toks = {i: _lower(t).split() + [None] for i, t in _texts_of(docs).items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = Counter(w for i in toks if not out[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    for r in rows:
        words = toks[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(words), sum(c[w] > 0 for w in words), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert len(rows) == len(toks)
    assert lm_scoring.score_documents(empty, held == 0, held == 1).count() == 0


def test_expectation_maximisation_prefers_the_likelier_part():
    w = lm_scoring.expectation_maximisation(np.array([3, 3]), np.array([0.5, 0.4]), np.array([0.01, 0.02]), np.array([5.0, 5.0]), 1e-4)
    assert w[3, 0] > 0.95 and np.allclose(w.sum(1), 1)


# ---------------------------------------------------------------------------------------------- 5

def _sets(texts):
    out = {}
    for i, t in texts.items():
        w = _lower(t).split()
        out[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def _classes(sets):
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = min(label[i], label[j])
        if before == label:
            return label
    return label


def test_jaccard_classes(docs, empty):
    sets = _sets(_texts_of(docs))
    label = _classes(sets)
    rows, _ = jaccard_join.near_duplicates(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()} == {i: (len(sets[i]), label[i]) for i in sets}
    assert jaccard_join.near_duplicates(empty)[0].count() == 0


def test_jaccard_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng, base = random.Random(5), ["b%d" % k for k in range(40)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(40)] = "e%d" % rng.randrange(9)
        rows.append((i, " ".join(words)))
    sets = _sets(dict(rows))
    got, _ = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == _classes(sets)


def test_jaccard_prefixes_with_equal_low_bits():
    # 1 << 40 | 3 and 2 << 40 | 3 lie in one document each; both documents share the list of 9
    lists = [np.array([k << 40 | 3, 9, *range(100 * k, 100 * k + 6)], np.uint64) for k in (1, 2)]
    sets = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "n_shingles": [8, 8], "tokens": [x.tobytes() for x in lists],
                                       "df": [np.full(8, 2, np.uint32).tobytes()] * 2})
    prefix = next(jaccard_join._prefixes(iter([sets]))).column("prefix").to_pylist()
    table = pa.table({"token": [9, 9], "doc_id": [1, 2], "size": [8, 8], "match": [1, 1], "rest": [7, 7], "component": [1, 2], "block": [0, 0],
                      "i": [0, 0], "j": [0, 0], "prefix": prefix})
    assert jaccard_join._candidates(table).to_pylist() == [{"a": 1, "b": 2}]


def test_jaccard_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    near = lambda k: text(k) + " end"
    rows = [(None, text("a")), (None, text("b")), (None, near("b")), (None, ""), (None, " "), (None, None),
            (5, text("a")), (6, near("a")), (7, text("c")), (7, text("d")), (7, text("d")), (8, near("d")), (9, text("e")), (10, near("c"))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    kept = jaccard_join.drop_near_duplicates(docs)
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(t[:2] for _, t in got if t.strip()) == ["aw", "bw", "cw", "dw", "ew"]
    assert {(i, t[:1]) for i, t in got if t.strip()} == {(None, "a"), (None, "b"), (7, "c"), (7, "d"), (9, "e")}
    assert sorted(t for _, t in got if not t.strip()) == ["", " "]
    classes, links = jaccard_join.near_duplicates(docs)
    no = jaccard_join.NO_ID
    assert sorted((r["doc_id"], r["component_id"]) for r in classes.collect()) == sorted(
        [(no, no)] * 6 + [(5, no), (6, no), (7, 7), (7, 7), (7, 7), (8, 7), (9, 9), (10, 7)])
    assert {frozenset(r) for r in links.collect()} == {frozenset(x) for x in [(no, 6), (no, no), (7, 8), (7, 10)]}


# ---------------------------------------------------------------------------------------------- 9

def test_substrings(docs, empty):
    seen, want = set(), {}
    for i, t in sorted(_texts_of(docs).items()):
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k:k + 20])
            if x in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g))
    rows = substring_dedup.drop_repeated_substrings(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in rows} == want
    assert substring_dedup.drop_repeated_substrings(empty).count() == 0


def test_substrings_of_a_frequent_line_are_split(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 100)
    monkeypatch.setattr(substring_dedup, "SAMPLED", 1)
    rng, line = random.Random(6), ["line%d" % k for k in range(12)]
    texts = [[f"u{i}x{k}" for k in range(25)] + line + [f"v{i}x{k}" for k in range(25)] for i in range(300)]
    for i in range(0, 300, 7):  # some windows of the line are equal, too
        texts[i] = texts[i][:10] + texts[rng.randrange(300)][8:55]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    seen, want = set(), {}
    for i, w in enumerate(texts):
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k:k + 20])
            if x in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g).encode())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.drop_repeated_substrings(docs).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 0
    hot = substring_dedup._hot_minimisers(docs.select("doc_id", "text"), 16, 20, 4)
    table = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "tag": [0] * 300, "text": [" ".join(w) for w in texts]})
    windows = lambda split: Counter({r["bucket"]: int(np.frombuffer(zstandard.decompress(r["places"]), "<i8").reshape(-1, 4)[:, 3].sum())
                                     for r in substring_dedup._chunk([table], 16, 20, 4, split).to_pylist() if r["places"]})
    before, after = windows(np.empty(0, np.uint64)), windows(hot)
    assert before.total() == after.total() and max(before.values()) > 2.5 * before.total() / 16 and max(after.values()) < 1.5 * after.total() / 16


# ---------------------------------------------------------------------------------------------- 2

def test_forest_recall_and_components(spark, monkeypatch):
    monkeypatch.setattr(embedding_neardup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x[200:260] = x[0] + 0.15 * rng.standard_normal((60, 16))
    x[260:280] = x[1]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None]), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0])]
    out = {r["vec_id"]: r for r in embedding_neardup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    links = near.sum(1)
    found = np.array([out[i]["n_links"] for i in range(300)])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert out[260]["component_id"] == 1 and out[260]["n_links"] == 20 and not out[260]["kept"]
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i for i in range(300, 305))
    assert out[306]["component_id"] == 305 and len(out) == 307
    assert embedding_neardup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("size,noise", [(3000, 0.15), (3000, 0.25)])
def test_forest_finds_the_links_of_a_large_group(size, noise):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((size + 2000, 32))
    x[:size] = x[0] + noise * rng.standard_normal((size, 32))
    x = rng.permutation(x / np.linalg.norm(x, axis=1)[:, None])
    row, tree, leaf = embedding_neardup.route(embedding_neardup.fit_forest(x, len(x)), x)
    met = np.zeros((len(x), len(x)), bool)
    code = tree.astype(np.int64) << 48 | leaf
    for c in np.unique(code):
        at = row[code == c]
        met[np.ix_(at, at)] = True
    near = x @ x.T >= embedding_neardup.COSINE
    assert near.sum() > 0.5 * size ** 2 and (met & near).sum() >= 0.95 * near.sum()
    assert len(row) < 80 * len(x)


def test_large_leaves_are_split_again(spark, monkeypatch):
    for name, value in dict(SAMPLE=64, BLOCK=64, OWN_SAMPLE=128, DEALT=256).items():
        monkeypatch.setattr(embedding_neardup, name, value)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 16))
    x[:400] = x[0] + 0.1 * rng.standard_normal((400, 16))
    x[400:1200] = x[1200:] + 0.1 * rng.standard_normal((800, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(2000)] + [(2000, [1.0, 2.0]), (2001, [2.0, 4.0]), (2002, None)]
    leaves, again = [], embedding_neardup._split_again

    def watched(routed, closed, cosine):
        out = again(routed, closed, cosine)
        for table in (routed, out):
            leaves.append({(r["tree"], r["leaf"]): r["count"] for r in table.groupBy("tree", "leaf").count().collect()})
        return out

    monkeypatch.setattr(embedding_neardup, "_split_again", watched)
    out = {r["vec_id"]: r for r in embedding_neardup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([out[i]["n_links"] for i in range(2000)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.95 * near.sum()
    assert all(out[i]["component_id"] == 0 for i in range(400) if near[i, :400].sum() > 200)
    assert out[2001]["component_id"] == 2000 and out[2002]["n_links"] == 0
    before, after = ([n for (tree, _), n in sizes.items() if tree >= 0] for sizes in leaves)
    assert len(after) > 2 * len(before) and np.median(after) < 0.5 * np.median(before)


def test_links_of_a_large_group(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2500, 16))
    x[:2000] = x[0] + 0.15 * rng.standard_normal((2000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r["n_links"] for r in embedding_neardup.near_duplicate_vectors(rows).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([out[i] for i in range(2500)])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()


def test_copies_of_vectors_are_not_written(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 32))
    x[:300] = x[300:600] + 0.1 * rng.standard_normal((300, 32))
    tables, stage = [], embedding_neardup.stage

    def watched(df, name, *args):
        out = stage(df, name, *args)
        tables.append((name, [f.removeprefix("file:") for f in out.inputFiles()]))
        tables[-1] += (sum(os.path.getsize(f) for f in tables[-1][1]),)
        return out

    monkeypatch.setattr(embedding_neardup, "stage", watched)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype("f4"))], "vec_id long, embedding array<float>")
    out = embedding_neardup.near_duplicate_vectors(rows)
    assert out.where("n_links > 0").count() > 500 and out.count() == 4000
    assert sum(size for *_, size in tables) < 4 * 4000 * 32 * 4
    left = {name for name, files, _ in tables if any(map(os.path.exists, files))}
    assert not left & {"vectors", "vectors-distinct", "vectors-met", "vectors-linked"}


def test_units_blocks_and_passes_change_no_result(spark, monkeypatch):
    for name, value in dict(SAMPLE=256, BLOCK=64, OWN_SAMPLE=128).items():
        monkeypatch.setattr(embedding_neardup, name, value)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2400, 16))
    x[:900] = x[0] + 0.05 * rng.standard_normal((900, 16))
    x[1000:1300] = x[1300:1600] + 0.1 * rng.standard_normal((300, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(2400)] + [(2400 + i, [1.0 + (i > 400), 2.0, float(i % 7)]) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    answers, passes, plan = [], [], embedding_neardup._passes

    def planned(*args):
        passes.append(plan(*args))
        return passes[-1]

    monkeypatch.setattr(embedding_neardup, "_passes", planned)
    for small in ({}, dict(DEALT=128, UNIT_BYTES=1, PASS_BYTES=1, TOGETHER=100, AT_ONCE=64)):
        for name, value in small.items():
            monkeypatch.setattr(embedding_neardup, name, value)
        answers.append(sorted(map(tuple, embedding_neardup.near_duplicate_vectors(table, trees=4).collect())))
    assert answers[0] == answers[1]
    assert len(passes[0]) == 1 and len(passes[1]) > 5 and max(blocks for due in passes[1] for blocks, _ in due.values()) > 2
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([r[1] for r in answers[1][:2400]])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum() and found[:900].min() >= 800
    assert sum(r[1] > 0 for r in answers[1][2400:]) > 400


def test_split_helpers_agree_with_their_models(spark):
    ids = [0, 1, -1, 2**63 - 1, -2**63, 1234567890123]
    for tree in (0, 7):
        want = [r[0] for r in spark.createDataFrame([(i, tree) for i in ids], "i long, t int").selectExpr("xxhash64(i, t)").collect()]
        assert embedding_neardup.xxhash64(np.array(ids), tree).tolist() == want
    rng = np.random.default_rng(4)
    for n in (16, 17, 100, 383):
        p = rng.standard_normal(n)
        assert embedding_neardup._quantiles(np.sort(p), [0.42, 0.5, 0.58]) == np.quantile(p, [0.42, 0.5, 0.58]).tolist()
    x = rng.standard_normal((500, 16))
    x[250:] = x[:250] + 0.2 * rng.standard_normal((250, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for cut in (0, 250):
        near = np.triu(x @ x.T >= 0.9, 1)
        if cut:
            near[:, :cut] = near[cut:] = False
        met, label = embedding_neardup._linked(x, 0.9, cut)
        assert (met == near.any(0) | near.any(1)).all() and near.sum() > 50
        assert (label[np.nonzero(near)[0]] == label[np.nonzero(near)[1]]).all() and (label[~met] == np.flatnonzero(~met)).all()


# ---------------------------------------------------------------------------------------------- 7

def test_html_model_on_unseen_layouts(spark):
    unary, edge = html_extract.train(html_pages.labelled_pages(200), rounds=150)
    forest = html_extract.Forest([html_extract.Page(html_pages.labelled_page(9_000_000 + k)) for k in range(100)])
    p, _ = forest.marginals(unary, edge)
    runs = np.array([t is not None for t in forest.texts])
    assert ((p >= 0.5) == (forest.labels == 1))[runs].mean() > 0.97
    pages = spark.createDataFrame([(1, "u", "<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; b</h1><p>One\n two<b>three</b>.<p>Four "
                                    "<script>var p='</p>'</script>five.</article><div class=comments><p>Nice one.</p></div><footer>&copy; x</footer>"),
                                   (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in html_extract.extract_main_text(pages).collect()}
    assert rows[1]["text"] == "A & b One twothree. Four five." and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] == "" and rows[3]["text"] == ""


@pytest.mark.parametrize("raw", ["<script>for(i=0;i<n;i++){f()}</script>", "<script>if(a<b)f()</SCRIPT >", "<script><!-- f()</script>", "<style>/* <!-- a<b */</style>",
                                 "<script>s='<a title=\"'</script>", "<textarea>x<y</textarea>", "<script>'</scripts>' + a<b</script>"])
def test_html_goes_on_after_raw_elements(raw):
    texts = lambda source: [t for t in html_extract.Page(source).texts if t]
    assert texts(f"<p>One</p>{raw}<article><p>Two.</p></article>") == ["One", "Two."]
    assert texts(f"<p>One</p>{raw}{raw}<article><p>Two.</p></article><script>a<b") == ["One", "Two."]


def test_marginals_are_exact():
    page = html_extract.Page("<div><p>a</p><p class=ad>b</p></div>")
    forest = html_extract.Forest([page])
    rng = np.random.default_rng(0)
    unary, edge = rng.standard_normal(len(html_extract._FEATURES)), rng.standard_normal((len(html_extract._EDGES), 2, 2))
    p, _ = forest.marginals(unary, edge)
    n, total, on = len(page.parent), 0.0, np.zeros(len(page.parent))
    for state in range(1 << n):
        y = [state >> k & 1 for k in range(n)]
        w = math.exp(sum(y[k] * sum(unary[f] for f in page.features[k]) + (edge[page.kind[k], y[page.parent[k]], y[k]] if k else 0) for k in range(n)))
        total += w
        on += np.array(y) * w
    assert np.allclose(p, on / total)


# ---------------------------------------------------------------------------------------------- 10

def test_quality_learns(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(rng.randint(5, 40))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "***" if bad else w for w in words), int(not bad)))
    rows += [(300, None, None), (301, "", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.col("label_id") % 3 != 1)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == q for i, _, q in rows[:300] if i % 3 == 1]) > 0.95
    assert 0 < got[300] == got[301] < 1 and len(got) == 302
    one = quality.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert quality.scored(docs, one).agg(F.min("score")).first()[0] == 1.0


def test_quality_score_by_hand():
    texts = ["a rose is a rose is a rose", "", "one", "no no no yes", "Äpfel und 数据 und  mehr\tund"]
    rng = np.random.default_rng(3)
    model = {"scores": rng.normal(size=quality.TABLE).astype(np.float32), "bias": 0.25, "constant": None}
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = quality.score(model, data, offsets)
    for text, value in zip(raw, got):
        words, slots = text.split(), []
        for k, w in enumerate(words):
            slots += quality.word_features([w])[0].tolist()
            assert len(quality.word_features([w])[0]) == 1 + sum(max(len(w.decode()) + 3 - n, 0) for n in (3, 4))
            if k:
                two = span_hashes(np.frombuffer(words[k - 1] + w, np.uint8), np.array([0, len(words[k - 1])]),
                                  np.array([len(words[k - 1]), len(words[k - 1]) + len(w)]))
                slots += quality.bigram_slots(two).tolist()
                slots += [1] if words[k - 1] == w else []
        mean = sum(float(model["scores"][s]) for s in slots) / max(len(slots), 1)
        assert abs(value - 1 / (1 + math.exp(-mean - 0.25))) < 1e-9


def test_quality_tells_word_order():
    # both classes hold the same words and letters; only neighbours differ
    rng = random.Random(8)
    rows = []
    for i in range(400):
        pairs = [("red", "fox"), ("old", "oak"), ("big", "sea")] * 4
        rng.shuffle(pairs)
        rows.append((" ".join(f"{a} {b}" if i % 2 else f"{b} {a}" for a, b in pairs), i % 2))
    raw = [t.encode() for t, _ in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    marks = np.array([q for _, q in rows])
    cut = int(offsets[300])
    model = quality.train(data[:cut], offsets[:301], marks[:300])
    assert np.mean((quality.score(model, data[cut:], offsets[300:] - cut) >= 0.5) == marks[300:]) > 0.95
