"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import (
    ann,
    bpe,
    codes,
    interactions,
    lm,
    oracles,
    packing,
    quality,
    simhash,
    substrings,
    token_counts,
    topk,
    toxicity,
    warc,
)
from tidelake.llm.workers import ready

#: Words of a text in DuckDB.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that an earlier one has, as digests."""
    kept = substrings.remove(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path).drop("ids")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count(_table(spark, sf_dir, "documents"), path)


def _is_query(step: int) -> Column:
    return F.col("vec_id") % step == 0


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth embedding, by inner product."""
    rows = _table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").cast("long"), ann.usable().alias("vector"))
    return ann.nearest(vectors, _is_query(20), 20)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every fiftieth embedding."""
    rows = _table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").cast("long"), topk.quantised().alias("vector"))
    return topk.top_k(vectors, _is_query(50), 5)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back through the capture index."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a network that held-out labels never reach."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    held_out = lm.remainder("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove from every source, in every order and step."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return interactions.text_filters(docs, labels)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of robust outlier estimates."""
    return quality.judge(_table(spark, sf_dir, "documents")).drop("distance")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding, by codebooks learned in exact integers."""
    rows = _table(spark, sf_dir, "embeddings")
    return codes.compress(rows.select("vec_id", "label", codes.finite().alias("vector")))


QUERIES = {
    q.__name__: q
    for q in (
        op1_byte_bpe,
        op2_substring_dedup,
        op3_best_fit_packing,
        op4_token_counts,
        op5_nearest_neighbours,
        op6_lm_scores,
        op7_exact_top_k,
        op8_simhash_groups,
        op9_warc_round_trip,
        op10_toxicity,
        op11_filter_interactions,
        op12_quality_rules,
        op13_vector_codes,
    )
}

ORACLES = {
    "op2_substring_dedup": f"""
        WITH words AS (
            SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, md5_number(array_to_string(list_slice(w, i, i + 49), ' ')) AS h2
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
        ), first AS (
            SELECT h2, min(doc_id) AS doc_id FROM windows GROUP BY h2
        ), hit AS (
            SELECT w.doc_id, w.i FROM windows w JOIN first f USING (h2) WHERE f.doc_id < w.doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit
        ), each AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
        ), kept AS (
            SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text
            FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
        ), removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT w.doc_id, len(w.w) AS n_words, coalesce(r.n, 0) AS n_removed,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM words w LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """,
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM s
        ) WHERE rank <= 5
    """,
    "op9_warc_round_trip": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
        ), d AS (
            SELECT page_id, last, strlen(html) AS payload_bytes,
                   sha1(html) AS hex FROM p
        ), b AS (
            SELECT *, list_reduce(list_transform(range(1, 161), lambda i: CASE WHEN
                substr('0000000100100011010001010110011110001001101010111100110111101111',
                       4 * (strpos('0123456789abcdef', substr(hex, CAST((i + 3) // 4 AS BIGINT), 1)) - 1)
                       + 1 + CAST((i - 1) % 4 AS BIGINT), 1) = '1' THEN '1' ELSE '0' END),
                lambda x, y: x || y) AS bits FROM d
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr(
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT)
                     + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
                     + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
                     + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
                     + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM b
    """,
    "op11_filter_interactions": oracles.INTERACTIONS,
    "op12_quality_rules": oracles.quality_rules(),
    "op13_vector_codes": oracles.vector_codes(),
}
