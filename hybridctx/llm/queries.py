"""The registered queries: name -> (builder over (spark, sf_dir), DuckDB text or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hybridctx.llm import exact_dedup as exact
from hybridctx.llm import (language_id, lexical_search, line_dedup, merkle, mixing, near_dup, packing, quality,
                           substring_dedup, token_counts, vector_search, warc)
from hybridctx.llm.common import table

#: Ids that end a document in a packed sequence.
END_ID = 2


def op1_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pareto_mix(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_pairwise_quality(spark, sf_dir):
    return quality.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bottom_k_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op8_pack_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"),
                        packing.document_ids(public_tokenizers.path("word_bpe_49k.json"), END_ID))


def op7_pivot_topk(spark, sf_dir):
    return vector_search.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_de_bruijn_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_bayes_language(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN g.top IS NULL OR g.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""

ENTRIES = {
    "op10_de_bruijn_dedup": (op10_de_bruijn_dedup, substring_dedup.SUBSTRING_SQL),
    "op5_bottom_k_near_dup": (op5_bottom_k_near_dup, near_dup.NEAR_SQL),
    "op4_pairwise_quality": (op4_pairwise_quality, None),
    "op7_pivot_topk": (op7_pivot_topk, TOPK_SQL),
    "op9_line_dedup": (op9_line_dedup, line_dedup.LINES_SQL),
    "op1_warc_round_trip": (op1_warc_round_trip, WARC_SQL),
    "op2_token_counts": (op2_token_counts, None),
    "op3_pareto_mix": (op3_pareto_mix, mixing.MIX_SQL),
    "op6_exact_dedup": (op6_exact_dedup, EXACT_SQL),
    "op8_pack_sequences": (op8_pack_sequences, None),
    "op11_bayes_language": (op11_bayes_language, None),
    "op12_merkle_manifest": (op12_merkle_manifest, merkle.MANIFEST_SQL),
    "op13_lexical_search": (op13_lexical_search, lexical_search.SEARCH_SQL),
}
