"""Lexical and vector retrieval, and the fusion of their ranks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import graph, ranking, search, vector_index
from tessera.plans.catalog import register

TERMS = ["the", "rights", "license", "der", "ouer", "Thnd"]

_TOKENS = (
    "tok AS (SELECT doc_id AS doc, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM documents)"
)
_POSTS = _TOKENS + ", p AS (SELECT doc, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY 1, 2)"
_BM25 = (
    "WITH " + _POSTS + ", q AS (SELECT unnest(['the', 'rights', 'license', 'der', 'ouer', 'thnd']) AS term), st AS (SELECT count(*) AS n, sum(len(ts)) AS total FROM tok), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),"
    " s AS (SELECT doc, sum(greatest(0.0::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (total::DOUBLE / n)))) AS score, count(*) AS matched"
    " FROM p JOIN q USING (term) JOIN df USING (term), st GROUP BY doc)"
)


@register("WITH " + _POSTS + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY 1")
def bm25_stats(spark, t):
    return search.postings(t("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@register(_BM25 + " SELECT doc, round(score, 6) AS score, matched FROM s")
def bm25_scores(spark, t):
    return search.bm25(t("documents"), "doc_id", "text", TERMS).select("doc", F.round("score", 6).alias("score"), "matched")


@register(_BM25 + " SELECT doc, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc LIMIT 10")
def bm25_top10(spark, t):
    s = search.bm25(t("documents"), "doc_id", "text", TERMS).select("doc", F.round("score", 6).alias("score"))
    return ranking.top(s, 10, F.desc("score"), F.col("doc"))


@register("SELECT doc, term, tf FROM (WITH " + _POSTS + " SELECT p.* FROM p) p WHERE term IN ('the', 'der', 'of')")
def posting_intersection(spark, t):
    p = search.postings(t("documents"), "doc_id", "text", ["the", "der", "of"])
    return p.select("doc", "term", "tf")


def _items(t, where=None):
    e = t("embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"), "label")
    return e.filter(where) if where else e


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"


@register(f"SELECT query, target, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query, r.vec_id AS target, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def knn_exact(spark, t):
    return search.knn(_items(t, "vec_id % 20 = 0"), _items(t), 5).select("query", "target", F.round("score", 6).alias("score"), "rank")


@register(f"SELECT a, b, round(score, 6) AS score FROM (SELECT q.label AS a, r.label AS b, max({_COS}) AS score FROM embeddings q JOIN embeddings r ON q.label < r.label WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)")
def knn_window_max(spark, t):
    return search.best_between(_items(t, "vec_id % 20 = 0"), _items(t)).select("a", "b", F.round("score", 6).alias("score"))


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_CENTROID = (
    f"WITH u AS (SELECT label, unnest({_UNIT}) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS mean FROM m GROUP BY 1)"
)


@register(_CENTROID + ", n AS (SELECT c.label, e.vec_id, list_cosine_similarity(c.mean, e.embedding::DOUBLE[]) AS s FROM c, embeddings e) SELECT label, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS r FROM n) WHERE r = 1")
def knn_centroid(spark, t):
    c = search.centroids(_items(t), "label")
    # As many rows as labels, times the table: a stated query set against all rows.
    s = c.crossJoin(_items(t).select("item", "vector")).select("label", F.col("item").alias("vec_id"), V.cosine(F.col("centroid"), F.col("vector")).alias("s"))
    w = Window.partitionBy("label").orderBy(F.desc(F.round("s", 9)), "vec_id")
    return s.withColumn("r", F.row_number().over(w)).filter("r = 1").select("label", "vec_id", F.round("s", 6).alias("score"))


@register("SELECT vec_id, round(p[1], 5) AS first, round(p[8], 5) AS last, len(p)::INTEGER AS dimensions FROM (SELECT vec_id, list_transform(h, lambda x: (x / sqrt(list_dot_product(h, h)))::FLOAT::DOUBLE) AS p FROM (SELECT vec_id, embedding[1:8]::DOUBLE[] AS h FROM embeddings))")
def prefix_projection(spark, t):
    p = t("embeddings").select("vec_id", V.project_prefix(F.col("embedding"), 8).alias("p"))
    return p.select("vec_id", F.round(F.element_at("p", 1).cast("double"), 5).alias("first"), F.round(F.element_at("p", 8).cast("double"), 5).alias("last"), F.size("p").alias("dimensions"))


@register("SELECT vec_id, len(embedding) = 64 AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 0.001 AS valid FROM embeddings")
def vector_checks(spark, t):
    return t("embeddings").select("vec_id", V.is_unit(F.col("embedding"), 64).alias("valid"))


_HEAD = "(SELECT vec_id, embedding, list_transform(h, lambda x: (x / sqrt(list_dot_product(h, h)))::FLOAT::DOUBLE) AS p FROM (SELECT *, embedding[1:16]::DOUBLE[] AS h FROM embeddings))"


@register(
    f"WITH e AS {_HEAD}, r AS (SELECT q.vec_id AS query, r.vec_id AS target, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, r.vec_id) AS a, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.p, r.p) DESC, r.vec_id) AS b"
    " FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) SELECT query, target, a::INTEGER AS rank, b <= 3 AS found FROM r WHERE a <= 3"
)
def projection_losses(spark, t):
    return search.projection_losses(_items(t, "vec_id % 20 = 0").select("item", "vector"), _items(t).select("item", "vector"), 16, 3)


@register(
    _BM25 + f", v AS (SELECT r.vec_id AS target, {_COS} AS score FROM embeddings q, embeddings r WHERE q.vec_id = 0 AND r.vec_id <> 0),"
    " sc AS (SELECT 'text' AS family, 'lexical' AS channel, doc AS target, round(score, 9) AS score FROM s UNION ALL SELECT 'text', 'length', doc_id, n_chars::DOUBLE FROM documents WHERE n_chars > 2000 UNION ALL SELECT 'vector', 'cosine', target, round(score, 9) FROM v),"
    " r1 AS (SELECT *, row_number() OVER (PARTITION BY family, channel ORDER BY score DESC, target) AS r FROM sc), fam AS (SELECT family, target, sum(1.0::DOUBLE / (60 + r)) AS s FROM r1 GROUP BY 1, 2),"
    " r2 AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(s, 12) DESC, target) AS r FROM fam) SELECT target, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM r2 GROUP BY 1"
)
def rrf_fusion(spark, t):
    """Two channels over texts and one over vectors, fused in two levels."""
    lexical = search.bm25(t("documents"), "doc_id", "text", TERMS).select(F.lit("text").alias("family"), F.lit("lexical").alias("channel"), F.col("doc").alias("target"), F.round("score", 9).alias("score"))
    length = t("documents").filter("n_chars > 2000").select(F.lit("text").alias("family"), F.lit("length").alias("channel"), F.col("doc_id").alias("target"), F.col("n_chars").cast("double").alias("score"))
    n = t("embeddings").count()
    vector = search.knn(_items(t, "vec_id = 0"), _items(t), n).select(F.lit("vector").alias("family"), F.lit("cosine").alias("channel"), "target", F.round("score", 9).alias("score"))
    scores = lexical.unionByName(length).unionByName(vector).withColumn("occurrence", F.lit(0))
    return ranking.fuse(scores).select("target", F.round("score", 9).alias("score"))


def _vector_index(spark, t):
    """An index of all vectors in the checkpoint folder, as users would write it once."""
    path = f"{graph.folder(spark.sparkContext)}/vectors-{uuid.uuid4().hex}"
    vector_index.write(_items(t).select("item", "vector"), path)
    return vector_index.Index(spark, path)


_ASKED = "vec_id % 20 = 0"


@register(f"SELECT query, target, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query, r.vec_id AS target, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10")
def knn_indexed(spark, t):
    """Nominated by the index, completed by bands of turns: exact."""
    return _vector_index(spark, t).nearest(_items(t, _ASKED).select("item", "vector"), 10, 4).select("query", "target", F.round("score", 6).alias("score"), "rank")


@register(f"SELECT q.vec_id AS query, r.vec_id AS target, round({_COS}, 6) AS score FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id AND {_COS} >= 0.3 WHERE q.vec_id % 20 = 0")
def vectors_within(spark, t):
    return _vector_index(spark, t).within(_items(t, _ASKED).select("item", "vector"), 0.3).select("query", "target", F.round("score", 6).alias("score"))


@register()
def vector_index_recall(spark, t):
    """What nominations alone find of the ten nearest of every twentieth vector, by the share of cells asked."""
    index, asked = _vector_index(spark, t), _items(t, _ASKED).select("item", "vector")
    truth = graph._cut(search.knn(asked, _items(t).select("item", "vector"), 10))
    cells = len(index.cells)
    steps = [max(1, cells // 16), max(1, cells // 4), max(1, cells // 2), max(1, cells * 7 // 8)]
    return reduce(DataFrame.union, [index.recall(asked, truth, 10, p).select(F.lit(p).alias("probes"), "recall", "cells", "rows") for p in steps])
