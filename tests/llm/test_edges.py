"""Repeated and null ids, clashing column names, equal hashes, elements of pages that hold text: each has a defined result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import exact_dedup, html_extract, html_pages, jaccard_join, mixing, quality, substring_dedup, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")
NULL = -2 ** 63
BIG = [9007199254740993, 9007199254740995]


def _without_repeats(rows, width=20):
    """Brute force over rows in the order given: (n_words, n_removed, kept) of each."""
    seen, out = {}, []
    for k, (_, text) in enumerate(rows):
        w = (text or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            x = tuple(w[i:i + width])
            if seen.setdefault(x, (k, i)) != (k, i):
                gone[i:i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)))
    return out


def _words(rng, n, tag):
    return " ".join(f"{tag}{rng.randrange(10 ** 9)}" for _ in range(n))


@pytest.mark.parametrize("chunk", [1, 6 << 20])
def test_substrings_of_different_texts_under_one_id(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    rng = random.Random(1)
    shared = _words(rng, 30, "s")
    rows = [(5, _words(rng, 60, "a")), (5, _words(rng, 142, "b") + " " + shared), (5, _words(rng, 60, "c")), (None, shared + " x"),
            (9, "y " + shared + " z"), (BIG[0], shared), (BIG[1], shared), (5, None), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    tags = {r.text: r.tag for r in table.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")).collect()}
    rows.sort(key=lambda r: (NULL if r[0] is None else r[0], tags[r[1]]))
    want = sorted((NULL if i is None else i, *r) for (i, _), r in zip(rows, _without_repeats(rows)))
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_dedup.drop_repeated_substrings(table.repartition(4)).collect())
    assert got == want and sum(r[2] for r in want) == 120


def test_equal_rows_are_one_document(spark):
    text = _words(random.Random(2), 50, "a")
    rows = substring_dedup.drop_repeated_substrings(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 50)]


def test_windows_of_equal_hash_and_different_words(spark, monkeypatch):
    """With one hash for all words of a length every window meets every other, and only their words tell them apart."""
    def weak(data, starts, ends, seed=0):
        return (ends - starts).astype(np.uint64)
    monkeypatch.setattr(substring_dedup, "span_hashes", weak)
    rng = random.Random(3)
    pool = ["ab", "cd", "ef"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(18, 40))) for _ in range(12)]
    texts += [texts[0], texts[3] + " ab"]
    table = substring_dedup.pa.RecordBatch.from_pydict({"doc_id": list(range(14)), "tag": [0] * 14, "text": texts})
    sent = substring_dedup._chunk([table], 8, 20, 4, np.empty(0, np.uint64)).to_pylist()
    found = []
    for bucket in {r["bucket"] for r in sent}:
        group = substring_dedup.pa.Table.from_pylist([r for r in sent if r["bucket"] == bucket], schema=substring_dedup.pa.schema(
            [("bucket", "int64"), ("repeats", "binary"), ("places", "binary"), ("text", "binary")]))
        found += substring_dedup._bucket_repeats(20)(group).to_pylist()
    for k, (n, removed, _) in enumerate(_without_repeats(list(enumerate(texts)))):
        gone = set()
        for r in found:
            if r["doc_id"] == k:
                gone |= set(range(r["first"], r["end"]))
        assert len(gone) == removed


@pytest.mark.parametrize("part,text", [
    ("The area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and so on.", "The area is x=2 and so on."),
    ("As <svg><g><text>drawn here</text></g></svg> in full.", "As drawn here in full."),
    ("Before <iframe src=x></iframe>after it.", None), ("<noscript>Words of the article.</noscript>", "Words of the article."),
    ("<object>Words in its place.</object>", "Words in its place."), ("<template>Words held back.</template>", "Words held back."),
    ("<noscript>Never closed, the rest stays.", "Never closed, the rest stays.")])
def test_elements_with_text_are_nodes(part, text):
    texts = [t for t in html_extract.Page(f"<article><p>{part}</p></article><p>Last.</p>").texts if t]
    assert "Last." in texts and (text is None or text in texts)


def test_article_text_in_fallback_elements_is_kept():
    unary, edge = html_extract.train(html_pages.labelled_pages(200), rounds=150)
    body = "".join(f"<p>Sentence number {k} of the article goes on for a good while, as they do.</p>" for k in range(6))
    page = f"<nav><a href=x>Home</a></nav><article>{body}<noscript><p>A paragraph of the article within it, long enough to be read.</p></noscript>" \
           "<p>The area is <math><mi>x</mi></math> here, in one sentence of the article.</p></article>"
    text = html_extract.extract([page], unary, edge)[0]
    assert "within it" in text and "The area is x here" in text and "Home" not in text


def test_token_files_keep_large_ids_beside_a_null(spark):
    rows = [(None, "a b"), (BIG[0], "c"), (BIG[1], "d e f"), (3, None)]
    shards = token_store.write_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    assert sorted(r.doc_id for r in token_store.document_digests(shards).collect()) == [NULL, 3, *BIG]


def test_columns_of_the_user_stay(spark):
    names = ["__id", "__digest", "__N", "__members", "__passes", "score"]
    rows = [(i, f"some words of text number {i // 2}", "a", *range(len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for kept in (exact_dedup.drop_exact_duplicates(docs), jaccard_join.drop_near_duplicates(docs), mixing.mixed_documents(docs, F.array("source"))):
        assert kept.columns == docs.columns
        assert all(tuple(r)[3:] == tuple(range(len(names))) for r in kept.collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    scored = quality.scored(docs, quality.fit(docs, labels, F.lit(True)))
    assert scored.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in scored.collect())


def test_strips_of_pairs_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    n, grams = 60, 40
    prefixes = [np.unique(rng.choice(80, grams)).astype(np.uint64) for _ in range(n)]
    entries = [(int(t), d) for d, p in enumerate(prefixes) for t in p if t % 5 == 0]
    table = jaccard_join.pa.table({
        "token": np.array([t for t, _ in entries], np.int64), "doc_id": np.array([d for _, d in entries], np.int64),
        "size": np.full(len(entries), 30, np.int64), "match": np.full(len(entries), 3, np.int64), "rest": np.full(len(entries), 20, np.int64),
        "component": np.array([d for _, d in entries], np.int64), "block": np.zeros(len(entries), np.int32),
        "prefix": [prefixes[d].tobytes() for _, d in entries], "i": np.zeros(len(entries), np.int32), "j": np.zeros(len(entries), np.int32)})
    whole = jaccard_join._candidates(table).to_pylist()
    monkeypatch.setattr(jaccard_join, "CELLS", 1)
    assert jaccard_join._candidates(table).to_pylist() == whole and len(whole) > 0
    assert len({(r["a"], r["b"]) for r in whole}) == len(whole)
