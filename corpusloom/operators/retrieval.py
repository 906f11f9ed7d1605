"""Sparse, dense and fused top-k search."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import TOKEN, tokens

QUERY_TERMS = 20_000


def where_all(chunks: DataFrame, language: str | None = None, symbol_type: str | None = None, file_hash: str | None = None, path: str | None = None, prefix: bool = False) -> DataFrame:
    """Chunks that meet all given conditions: equal language, symbol type and file hash; path holds the text or, with prefix, begins with it.

    A search by metadata alone needs a condition: without any it raises an error.
    """
    given = {"language": language, "symbol_type": symbol_type, "file_hash": file_hash}
    tests = [F.col(c) == v for c, v in given.items() if v is not None]
    if path is not None:
        tests.append(F.col("path").startswith(path) if prefix else F.col("path").contains(path))
    if not tests:
        raise ValueError("a search by metadata needs at least one condition")
    return chunks.where(reduce(and_, tests))


def term_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, term, tf)."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def top(scored: DataFrame, by: str, id_col: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows per `by`, ranked from 1; ties by smaller id."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def sparse_scores(docs: DataFrame, queries: DataFrame, id_col: str, query_id: str, text_col: str = "text", most_terms: int = 0) -> DataFrame:
    """(query_id, id_col, score): tf x query tf x idf over the terms in common, rounded to 6 decimals.

    Only terms that a query holds are counted and shuffled: the queries' vocabulary is joined before the
    documents' term counts. Rows without text count for the size of the collection only. Up to `most_terms` terms of all
    queries are broadcast (they are counted first), so that docs partitioned by id are not shuffled by term; the result is the same.
    """
    wanted = term_table(queries, query_id, text_col).withColumnRenamed("tf", "qf")
    few = most_terms > 0 and wanted.limit(most_terms + 1).count() <= most_terms
    vocabulary = wanted.select("term").distinct()
    vocabulary = F.broadcast(vocabulary) if few else vocabulary
    occurring = docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).join(vocabulary, "term", "left_semi")
    tf = occurring.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True))
    idf = df.select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    met = tf.join(F.broadcast(wanted.join(idf, "term")), "term") if few else tf.join(idf, "term").join(wanted, "term")
    return met.groupBy(query_id, id_col).agg(F.round(F.sum(F.col("tf") * F.col("qf") * F.col("idf")), 6).alias("score"))


def overlap_scores(docs: DataFrame, queries: DataFrame, id_col: str, query_id: str, text_col: str = "text") -> DataFrame:
    """(query_id, id_col, score): how many different terms of the query the document holds."""
    wanted = term_table(queries, query_id, text_col).select(query_id, "term")
    held = docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return held.join(wanted, "term").groupBy(query_id, id_col).agg(F.count("*").cast("double").alias("score"))


def lexical_topk(docs: DataFrame, queries: DataFrame, id_col: str, query_id: str, k: int, text_col: str = "text", legs: tuple[str, ...] = ("sparse",), most_terms: int = QUERY_TERMS) -> DataFrame:
    """(leg, query_id, id_col, score, rank): the k best rows per query and leg, ties by smaller id.

    Legs: sparse (scores of sparse_scores) and overlap (of overlap_scores). Up to `most_terms` terms of all queries (they are counted
    first) go to every task with their weights: a first pass counts in how many rows each of them stands, a second one scores
    every row where it is and keeps k rows per query and task, so that only these are shuffled. With more terms, rows and terms are joined.
    """
    wanted = term_table(queries, query_id, text_col).withColumnRenamed("tf", "qf")
    if wanted.limit(most_terms + 1).count() > most_terms:
        scores = {"sparse": sparse_scores, "overlap": overlap_scores}
        ranked = [top(scores[leg](docs, queries, id_col, query_id, text_col), query_id, id_col, k).withColumn("leg", F.lit(leg)) for leg in legs]
        found = ranked[0]
        for other in ranked[1:]:
            found = found.unionByName(other)
        return found.select("leg", query_id, id_col, "score", "rank")
    vocabulary = F.broadcast(wanted.select("term").distinct())
    held = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).join(vocabulary, "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    idf = df.join(F.broadcast(n), F.lit(True)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    pairs = wanted.join(F.broadcast(idf), "term").toPandas()  # at most most_terms rows
    names = sorted(pairs[query_id].unique())
    terms = {t: i for i, t in enumerate(sorted(pairs["term"].unique()))}
    place = {q: i for i, q in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast((terms, pairs["term"].map(terms).to_numpy(int), pairs[query_id].map(place).to_numpy(int), (pairs["qf"] * pairs["idf"]).to_numpy(float), names))
    qtype, dtype = queries.schema[query_id].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()

    def local(batches):
        terms, row, column, weight, names = shared.value
        word = re.compile(TOKEN)
        block = max(1, (1 << 22) // max(1, len(terms)))  # queries whose weights are laid out at once
        for pdf in batches:
            counts = []
            for i, text in enumerate(pdf["text"]):
                for t, c in Counter(w for w in word.findall(text.lower()) if w in terms).items():
                    counts.append((i, terms[t], c))
            if not counts:
                continue
            doc, term, tf = (np.array(x) for x in zip(*counts))
            cuts = np.flatnonzero(np.diff(doc)) + 1
            ids, own = pdf["id"].to_numpy(), doc[[0, *cuts]]
            for a in range(0, len(names), block):
                some = (column >= a) & (column < a + block)
                for leg in legs:
                    q = np.zeros((len(terms), min(block, len(names) - a)))
                    q[row[some], column[some] - a] = weight[some] if leg == "sparse" else 1.0
                    score = np.array([(tf[b:c] if leg == "sparse" else np.ones(c - b)) @ q[term[b:c]] for b, c in zip([0, *cuts], [*cuts, len(doc)])])
                    score = np.round(score, 6)
                    for j in range(score.shape[1]):
                        s = score[:, j]
                        near = np.flatnonzero((s >= np.partition(s, -k)[-k] if len(s) > k else True) & (s > 0))
                        best = near[np.lexsort((ids[own[near]], -s[near]))[:k]]
                        if len(best):
                            yield pd.DataFrame({"leg": leg, "q": names[a + j], "id": ids[own[best]], "score": s[best]})

    rows = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(_together(local), f"leg string, q {qtype}, id {dtype}, score double")
    order = Window.partitionBy("leg", "q").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return ranked.withColumnsRenamed({"q": query_id, "id": id_col})


def _together(run, rows: int = 4096):
    """run, with its small frames put together."""

    def wrapped(batches):
        held, size = [], 0
        for pdf in run(batches):
            held.append(pdf)
            size += len(pdf)
            if size >= rows:
                yield pd.concat(held)
                held, size = [], 0
        if held:
            yield pd.concat(held)

    return wrapped


def dense_topk(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, block: int = 2048) -> DataFrame:
    """(query_id, id_col, score, rank): the k nearest by cosine (double precision, 6 decimals) of each query row among all rows.

    Queries are taken in blocks of a fixed size; each partition keeps its own k best per query, so only k rows a
    query and partition are shuffled. Null, empty, all-zero and non-finite vectors are left out, as are
    rows of another dimension than the query.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    rows, asked = (d.where(finite).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")) for d in (vectors, queries))
    ids = rows.schema["id"].dataType.simpleString()
    count = asked.count()
    parts = max(1, -(-count // block))
    out = None
    for part in range(parts):
        some = (asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) if parts > 1 else asked).toPandas()  # about one block
        sized = {d: g for d, g in some.groupby(some["v"].map(len))}

        def local(batches, sized=sized):
            for pdf in batches:
                sizes = pdf["v"].map(len)
                for d, q in sized.items():
                    own = pdf[sizes == d]
                    if not len(own):
                        continue
                    a, b = np.array(q["v"].tolist()), np.array(own["v"].tolist())
                    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
                    names, score = own["id"].to_numpy(), np.round(a @ b.T, 6)
                    asking, kept, scores = [], [], []
                    for i, query in enumerate(q["id"].to_numpy()):
                        near = np.flatnonzero(score[i] >= np.partition(score[i], -k)[-k]) if len(names) > k else np.arange(len(names))
                        best = near[np.lexsort((names[near], -score[i][near]))[:k]]
                        asking += [query] * len(best)
                        kept.append(names[best])
                        scores.append(score[i][best])
                    yield pd.DataFrame({"query_id": asking, "id": np.concatenate(kept), "score": np.concatenate(scores)})

        found = rows.mapInPandas(local, f"query_id {ids}, id {ids}, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, "query_id", "id", k).withColumnRenamed("id", id_col)


def rrf(first: DataFrame, second: DataFrame, by: str, id_col: str, k: int = 2, base: int = 0) -> DataFrame:
    """Reciprocal rank fusion of two ranked legs: sum of 1 / (k + rank), ranks counted from `base`; rounded to 6 decimals."""
    both = first.select(by, id_col, "rank").unionByName(second.select(by, id_col, "rank"))
    return both.groupBy(by, id_col).agg(F.round(F.sum(1.0 / (k + F.col("rank") - 1 + base)), 6).alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame, id_col: str, query_id: str, k: int = 10, threshold: float = 0.0, where: Column | None = None) -> DataFrame:
    """(query_id, id_col, score, rank): filter, both legs with 2 k rows, fusion, top k, then the threshold.

    For rows without vectors: both legs are lexical (weighted terms, and different terms in common). `hybrid_dense` has a dense leg.
    """
    pool = docs if where is None else docs.where(where)
    both = lexical_topk(pool, queries, id_col, query_id, 2 * k, legs=("sparse", "overlap"))
    fused = both.groupBy(query_id, id_col).agg(F.round(F.sum(1.0 / (1 + F.col("rank"))), 6).alias("score"))
    return top(fused, query_id, id_col, k).where(F.coalesce("score", F.lit(0.0)) >= threshold)


def hybrid_dense(docs: DataFrame, vectors: DataFrame, queries: DataFrame, id_col: str, query_id: str, text_col: str = "text", vector_col: str = "dense", k: int = 10, threshold: float = 0.0) -> DataFrame:
    """(query_id, id_col, score, rank): a sparse and a dense leg with 2 k rows each, fusion, top k, then the threshold.

    docs holds (id_col, text_col), vectors (id_col, vector_col), one row per id each; an id in one of the two only takes part in that leg.
    queries holds (query_id, text_col, vector_col); it is read several times, and a null text or vector leaves that
    leg empty. Filter docs and vectors alike before the call.
    """
    sparse = lexical_topk(docs, queries, id_col, query_id, 2 * k, text_col)
    asked = queries.select(F.col(query_id).alias(id_col), vector_col)
    dense = dense_topk(vectors, asked, id_col, vector_col, 2 * k).withColumnRenamed("query_id", query_id)
    return top(rrf(sparse, dense, query_id, id_col), query_id, id_col, k).where(F.coalesce("score", F.lit(0.0)) >= threshold)
