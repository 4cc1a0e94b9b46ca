"""Queries of the operators of this subpackage, one per operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, collocations, compression_quality, conversation_repair, hamming_search, html_text, jaccard_join, language_id, nn_descent, shard_table, source_mix, suffix_dedup, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op4_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table.place(table(spark, sf_dir, "documents").select("doc_id"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.search(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_quality.score(docs, compression_quality.fit(docs, table(spark, sf_dir, "labels")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_warc_round_trip, op3_language_id, op4_shard_table, op5_suffix_array_dedup, op6_embedding_near_dedup, op7_bpe_codec, op8_hamming_top_k,
        op9_ngram_jaccard_join, op10_html_text, op11_compression_quality, op12_conversation_repair, op13_phrase_collocations,
    )
}

#: What plain SQL can say of op2: the records that must come back.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS owner FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN owner <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN owner <> d.page_id THEN owner END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""

#: All pairs of a label, then reachability. Vectors that link with nothing are left out of the pairs.
_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT node, b FROM r JOIN links ON a = reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON a = node
"""

#: All shingles as text, all pairs that share one, then reachability.
_SHINGLES = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM p), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 75 * (na.n + nb.n - x)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT node, b FROM r JOIN links ON a = reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT node AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = node
"""

ORACLES: dict[str, str] = {
    "op1_source_mix": source_mix.oracle(),
    "op2_warc_round_trip": _WARC,
    "op4_shard_table": shard_table.oracle(),
    "op6_embedding_near_dedup": _VECTORS,
    "op8_hamming_top_k": hamming_search.ORACLE,
    "op9_ngram_jaccard_join": _SHINGLES,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_phrase_collocations": collocations.ORACLE,
}
