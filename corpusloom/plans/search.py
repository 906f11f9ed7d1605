"""Search queries: eval_items' texts as queries over documents; a stated set of vectors over all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.session import cut, read_table


def _tables(spark, sf_dir):
    return read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")


def sparse_topk(spark, sf_dir):
    docs, items = _tables(spark, sf_dir)
    return R.lexical_topk(docs, items, "doc_id", "item_id", 10).select("item_id", "doc_id", "score", "rank")


def dense_topk(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings")
    return R.dense_topk(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding").select("query_id", "vec_id", "score")


def hybrid_rrf(spark, sf_dir):
    docs, items = _tables(spark, sf_dir)
    return R.hybrid(docs, items, "doc_id", "item_id").select("item_id", "doc_id", "score", "rank")


def lexical_search(spark, sf_dir):
    """As hybrid_rrf, over the English documents (whatever the spelling of their language) and above a threshold."""
    docs, items = _tables(spark, sf_dir)
    return R.hybrid(docs, items, "doc_id", "item_id", where=F.lower(F.trim("lang")).rlike("^en([-_].*)?$"), threshold=0.25).select("item_id", "doc_id", "score", "rank")


def _dense_tables(spark, sf_dir, language=None):
    """(chunks, vectors, asked): distinct texts, newest usable vectors, and the query set, the 20 usable vectors whose ids have the smallest
    md5, each with its chunk's text; with a language, only its chunks and their vectors are searched."""
    usable = "size(dense) = 96 and forall(dense, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(dense, x -> x <> 0)"
    own = read_table(spark, sf_dir, "vectors").where("model = 'beacon-embed-96' and chunk_id is not null")
    vectors = own.groupBy("chunk_id").agg(F.max_by("dense", F.coalesce("embedded_at", F.lit(0).cast("timestamp").cast("timestamp_ntz"))).alias("dense")).where(usable)
    chunks = read_table(spark, sf_dir, "chunks").where("chunk_id is not null")
    text = F.max("text").alias("text")
    asked = cut(vectors.orderBy(F.md5("chunk_id"), "chunk_id").limit(20), "asked")
    held = chunks.join(F.broadcast(asked.select("chunk_id")), "chunk_id", "left_semi").groupBy("chunk_id").agg(text)
    asked = cut(asked.join(held, "chunk_id", "left").withColumnRenamed("chunk_id", "query_id"), "asked")
    if language:
        chunks = chunks.where(F.lower(F.trim("language")) == language)
        vectors = vectors.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return chunks.groupBy("chunk_id").agg(text), vectors, asked


def hybrid_search(spark, sf_dir):
    """Sparse and dense legs over the TypeScript chunks, fused, above a threshold."""
    return R.hybrid_dense(*_dense_tables(spark, sf_dir, "typescript"), "chunk_id", "query_id", threshold=0.25).select("query_id", "chunk_id", "score", "rank")


def quick_retrieve(spark, sf_dir):
    """Sparse and dense legs over all chunks: the five best above 0.3, without their scores."""
    return R.hybrid_dense(*_dense_tables(spark, sf_dir), "chunk_id", "query_id", k=5, threshold=0.3).select("query_id", "chunk_id", "rank")


def hybrid_dense(spark, sf_dir):
    """Sparse search over the chunks' texts fused with dense search over their vectors, for a stated query set."""
    return R.hybrid_dense(*_dense_tables(spark, sf_dir), "chunk_id", "query_id").select("query_id", "chunk_id", "score", "rank")


def score_threshold(spark, sf_dir):
    return dense_topk(spark, sf_dir).where("coalesce(score, 0) >= 0.3")


_SPARSE = """qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM eval_items) GROUP BY ALL),
dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents {where}) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM documents {where}) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM dt GROUP BY term),
sparse AS (SELECT item_id, doc_id, round(sum(tf * qf * idf), 6) AS score FROM dt JOIN idf USING (term) JOIN qt USING (term) GROUP BY ALL)"""
_FUSED = """over AS (SELECT item_id, doc_id, count(*)::DOUBLE AS score FROM dt JOIN qt USING (term) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sparse QUALIFY rank <= {two}),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM over QUALIFY rank <= {two}),
f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (1 + rank)), 6) AS score FROM (SELECT item_id, doc_id, rank FROM a UNION ALL SELECT item_id, doc_id, rank FROM b) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= {k})
SELECT item_id, doc_id, score, rank FROM r WHERE score >= {threshold}"""
_DENSE = """SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 10"""


_HYBRID_DENSE = """WITH latest AS (SELECT chunk_id, dense FROM vectors WHERE model = 'beacon-embed-96' AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST) = 1),
u AS (SELECT chunk_id, dense::DOUBLE[] AS v FROM latest WHERE len(dense) = 96 AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
every AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
q AS (SELECT chunk_id AS query_id, v, text FROM (SELECT * FROM u ORDER BY md5(chunk_id), chunk_id LIMIT 20) LEFT JOIN every USING (chunk_id)),
t AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND {where} GROUP BY chunk_id),
uu AS (SELECT * FROM u WHERE {all} OR chunk_id IN (SELECT chunk_id FROM t)),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM q) GROUP BY ALL),
dt AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM t) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM dt GROUP BY term),
sparse AS (SELECT query_id, chunk_id, round(sum(tf * qf * idf), 6) AS score FROM dt JOIN idf USING (term) JOIN qt USING (term) GROUP BY ALL),
dense AS (SELECT q.query_id, uu.chunk_id, round(list_cosine_similarity(q.v, uu.v), 6) AS score FROM q, uu),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sparse QUALIFY rank <= {two}),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense QUALIFY rank <= {two}),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (1 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM a UNION ALL SELECT query_id, chunk_id, rank FROM b) GROUP BY ALL),
r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= {k})
SELECT {columns} FROM r WHERE score >= {threshold}"""


def _dense_sql(k: int, threshold: float, language: str | None = None, columns: str = "query_id, chunk_id, score, rank") -> str:
    where = f"lower(trim(language)) = '{language}'" if language else "true"
    return _HYBRID_DENSE.format(k=k, two=2 * k, threshold=threshold, where=where, all="false" if language else "true", columns=columns)


def _fused(where: str, k: int, threshold: float) -> str:
    return "WITH " + _SPARSE.format(where=where) + ", " + _FUSED.format(two=2 * k, k=k, threshold=threshold)


QUERIES = {f.__name__: f for f in (sparse_topk, dense_topk, hybrid_rrf, lexical_search, hybrid_search, quick_retrieve, hybrid_dense, score_threshold)}
SQL = {
    "sparse_topk": "WITH " + _SPARSE.format(where="") + " SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sparse QUALIFY rank <= 10",
    "dense_topk": _DENSE,
    "score_threshold": f"SELECT * FROM ({_DENSE}) WHERE score >= 0.3",
    "hybrid_rrf": _fused("", 10, 0.0),
    "lexical_search": _fused("WHERE regexp_matches(lower(trim(lang)), '^en([-_].*)?$')", 10, 0.25),
    "hybrid_search": _dense_sql(10, 0.25, "typescript"),
    "quick_retrieve": _dense_sql(5, 0.3, columns="query_id, chunk_id, rank"),
    "hybrid_dense": _dense_sql(10, 0.0),
}
