"""Registered queries of the operators: each reads its whole table and returns the contract's digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (embedding_neardup, exact_dedup, html_extract, jaccard_join, lexical_search, lm_scoring, mixing, packing, periodic_runs,
               piece_codec, quality, substring_dedup, token_store)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


@register("op1_wavelet_tokens")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = token_store.write_shards(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_store.document_digests(shards)


@register("op8_content_sort", """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256 FROM t""")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact_dedup.exact_duplicates(docs, keep_largest=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op4_flow_mixing")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    taken, sources = mixing.mix_sources(docs, F.array("source"))
    one = taken.withColumn("name", F.col("members")[0])
    # the sources are as many as the mixture names
    joined = one.join(F.broadcast(sources), one["name"].eqNullSafe(sources["name"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


@register("op6_retrieval_packing")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, crc=True)


@register("op10_subword_quality")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels, learnable=crc_of_id("label_id") % 3 != 1)
    rows = quality.scored(docs, model)
    # a row without an id has no label to learn from, and is not counted as held out
    return rows.select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op3_deleted_interpolation")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_of_id() % 10
    return lm_scoring.score_documents(docs, held_out=part == 0, deleted=part == 1)


@register("op9_super_kmer_dedup")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.drop_repeated_substrings(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op5_jaccard_prefixes")
def op5(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]


@register("op2_projection_forest")
def op2(spark, sf_dir):
    return embedding_neardup.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register("op7_html_tree_model")
def op7(spark, sf_dir):
    return html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register("op11_document_fp_tree", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
         i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
         q AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY ALL),
         s AS (SELECT count(*) AS big_n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
         t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
               WHERE term IN (SELECT term FROM q) GROUP BY ALL),
         w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, big_n),
         r AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))))::BIGINT AS score
               FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
    SELECT item_id, rank::INT AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20""")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.rank_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@register("op12_piece_agenda")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.encode_pieces(docs, vocabulary("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Documents whose id hashes to a multiple of ten repeat a stretch of their words to the end; texts of words otherwise."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    docs = docs.withColumn("h", crc_of_id()).withColumn("g", F.expr("h div 10"))
    planted = docs.where("h % 10 = 0").withColumn("words", words).withColumn("n", F.size("words").cast("long"))
    planted = planted.withColumn("a", F.expr("g % greatest(n, 1)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a + p - 1) div p))), 1, int(n - a))")
    planted = planted.withColumn("text", F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " "))
    return planted.select("doc_id", "text").unionByName(docs.where("h % 10 <> 0 OR h IS NULL").select("doc_id", "text"))


@register("op13_frequency_split_runs")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(with_planted_period(docs))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.withColumn("top", longest)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
                       (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


__all__ = ["ORACLES", "QUERIES"]
