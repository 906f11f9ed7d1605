"""Queries of cited answers: citations, confidence, links, refinement and budgets.

A document is an answer; the symbols it names are its citations, the chunks of those symbols its evidence. A
citation's score is made from the length of its name.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evidence as E
from corpusloom.plans.evidence import _COVER, _MATCH, _matched, _sides
from corpusloom.plans.scalars import _CLAIMS, _KEYS
from corpusloom.plans.search import SQL as SEARCH_SQL
from corpusloom.plans.search import hybrid_dense
from corpusloom.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_SYMBOL = r"[A-Za-z]\w*[a-z0-9](?:[A-Z]|_[a-z])\w*"
_CITED = f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_SYMBOL}', 0)) AS symbol FROM documents"
_SCORED = f"SELECT doc_id, symbol, (length(symbol) % 10) / 10.0::DOUBLE AS score, symbol IN (SELECT symbol_name FROM chunks WHERE symbol_name IS NOT NULL) AS valid FROM ({_CITED})"


def _cited(spark, sf_dir):
    """(doc_id, symbol, score, valid), distinct."""
    own = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_SYMBOL), 0))).alias("symbol"))
    known = read_table(spark, sf_dir, "chunks").select(F.col("symbol_name").alias("symbol")).distinct().withColumn("known", F.lit(True))
    score = (F.length("symbol") % 10 / 10.0).cast("double")
    return own.join(known, "symbol", "left").select("doc_id", "symbol", score.alias("score"), F.coalesce("known", F.lit(False)).alias("valid"))


@query(f"SELECT doc_id, count(*) AS cited, count(*) FILTER (valid) AS valid, round(CASE WHEN count(*) FILTER (valid) > 0 THEN avg(score) ELSE 0 END, 6)::DOUBLE AS confidence FROM ({_SCORED}) GROUP BY doc_id")
def create_evidence(spark, sf_dir):
    """Citations of an answer, those that exist, and the mean score of all of them once one exists."""
    by = _cited(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("cited"), F.count_if("valid").alias("valid"), F.avg("score").alias("mean"))
    return by.select("doc_id", "cited", "valid", F.round(F.when(F.col("valid") > 0, F.col("mean")).otherwise(0.0), 6).alias("confidence"))


@query(f"SELECT c.doc_id, c.symbol, substr(d.text, 1, 100) AS claim, c.score AS confidence FROM ({_SCORED}) c JOIN documents d USING (doc_id) WHERE valid")
def build_evidence(spark, sf_dir):
    """A row of evidence per citation that exists: the answer's first 100 characters as the claim."""
    heads = read_table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 100).alias("claim"))
    return _cited(spark, sf_dir).where("valid").join(heads, "doc_id").select("doc_id", "symbol", "claim", F.col("score").alias("confidence"))


_FACTORS = f"""WITH s AS ({_SCORED}), a AS (SELECT doc_id, coalesce(avg(score) FILTER (valid), 0) AS retrieval, count(*) FILTER (valid) / count(*) AS covered FROM s GROUP BY doc_id),
f AS (SELECT s.doc_id, count(DISTINCT f.file_hash) AS chunks, count(DISTINCT f.path) AS paths, count(DISTINCT f.repo) AS repos FROM s JOIN chunks f ON f.symbol_name = s.symbol GROUP BY s.doc_id),
x AS (SELECT a.doc_id, round(retrieval, 6)::DOUBLE AS retrieval, round(covered, 6)::DOUBLE AS covered, coalesce(chunks, 0) AS chunks, round(CASE WHEN coalesce(chunks, 0) < 2 THEN 1 ELSE (1.0::DOUBLE / paths + CASE WHEN repos > 0 THEN 1.0::DOUBLE / repos ELSE 0 END) / 2 END, 6)::DOUBLE AS consistent FROM a LEFT JOIN f USING (doc_id))"""


@query(_FACTORS + " SELECT * FROM x")
def confidence_factors(spark, sf_dir):
    """(doc_id, retrieval, covered, chunks, consistent) of every answer with citations."""
    cited = _cited(spark, sf_dir)
    score = cited.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("valid"), F.col("score"))), F.lit(0.0)), 6).alias("retrieval"), F.round(F.count_if("valid") / F.count("*"), 6).alias("covered"))
    chunks = read_table(spark, sf_dir, "chunks").select(F.col("symbol_name").alias("symbol"), "path", "repo", "file_hash").distinct()
    found = cited.where("valid").join(chunks, "symbol").groupBy("doc_id").agg(F.countDistinct("file_hash").alias("chunks"), F.countDistinct("path").alias("paths"), F.countDistinct("repo").alias("repos"))
    chunks = F.coalesce("chunks", F.lit(0))
    spread = (1.0 / F.col("paths") + F.when(F.col("repos") > 0, 1.0 / F.col("repos")).otherwise(0.0)) / 2
    return score.join(found, "doc_id", "left").select("doc_id", "retrieval", "covered", chunks.cast("bigint").alias("chunks"), F.round(F.when(chunks < 2, 1.0).otherwise(spread), 6).alias("consistent"))


@query(_FACTORS + """, y AS (SELECT *, round(greatest(0, least(1, 0.4::DOUBLE * retrieval + 0.35::DOUBLE * covered + 0.1::DOUBLE * least(1, 0.2::DOUBLE * chunks) + 0.15::DOUBLE * consistent)), 4)::DOUBLE AS score FROM x)
SELECT doc_id, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level, concat_ws('; ', CASE WHEN retrieval < 0.5 THEN 'weak retrieval' END, CASE WHEN covered < 0.5 THEN 'few claims covered' END, CASE WHEN chunks = 0 THEN 'no source cited' END, CASE WHEN consistent < 0.3 THEN 'scattered sources' END) AS warnings FROM y""")
def confidence_score(spark, sf_dir):
    """Score, level and warnings of every answer with citations."""
    factors = [F.col(c) for c in ("retrieval", "covered", "chunks", "consistent")]
    scored = confidence_factors(spark, sf_dir).withColumn("score", F.round(E.confidence(*factors), 4))
    return scored.select("doc_id", "score", E.confidence_level(F.col("score")).alias("level"), E.confidence_warnings(*factors).alias("warnings"))


@query("WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) SELECT e.event_id, CASE WHEN (e.ts, e.event_id) = f.first THEN 'verified' ELSE 'pending' END AS status FROM events e JOIN f ON e.user_id = f.user_id AND e.event_type = f.event_type")
def mark_verified(spark, sf_dir):
    """Of the rows of one claim (user and type) the first one is verified. A min aggregate and a join: no group is sorted."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    first = rows.groupBy("user_id", "event_type").agg(F.min("at").alias("first"))
    return rows.join(first, ["user_id", "event_type"]).select("event_id", F.when(F.col("at") == F.col("first"), "verified").otherwise("pending").alias("status"))


_OWN = f"SELECT doc_id, raw, list_distinct({_KEYS.replace('text', 'claim')}) AS k, list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z0-9_]+'), lambda w: length(w) > 4)) AS g FROM ({_CLAIMS}) WHERE length(claim) > 10"


@query(f"""WITH own AS ({_OWN}), c AS (SELECT doc_id, raw, CASE WHEN len(k) >= 2 THEN k ELSE g END AS terms FROM own WHERE raw % 2 = 0), e AS (SELECT doc_id, raw, list_concat(k, g) AS terms FROM own WHERE raw % 2 = 1),
p AS (SELECT c.doc_id, c.raw AS pos, e.raw AS epos, len(c.terms) AS n, len(list_filter(c.terms, lambda w: list_contains(e.terms, w))) AS shared FROM c JOIN e USING (doc_id))
SELECT doc_id, pos, epos, shared FROM p WHERE shared > 0 AND (shared >= 2 OR shared * 2 >= n)""")
def claim_chunk_links(spark, sf_dir):
    claims, evidence = _sides(spark, sf_dir)
    return E.claim_links(claims, evidence, "doc_id")


_FILE = r"(?i)(?:file|in|from)\s+[`\"']?([a-zA-Z0-9_\-./]+\.[a-zA-Z]+)"
_FILE_SQL = _FILE.replace("'", "''")


@query(_MATCH + f""", r AS (SELECT *, regexp_extract(claim, '{_FILE_SQL}', 1) AS file FROM gaps WHERE reason IS NOT NULL),
g AS (SELECT doc_id, count(*) AS gaps, count(*) FILTER (reason = 'No evidence found') AS missing, count(*) FILTER (reason = 'Low confidence evidence') AS low, count(*) FILTER (reason = 'Evidence has no source chunks') AS bare FROM r GROUP BY doc_id),
w AS (SELECT doc_id, pos, unnest({_KEYS.replace('text', 'claim')}) AS word FROM r), o AS (SELECT doc_id, word, min(pos) AS first_at FROM w GROUP BY ALL),
named AS (SELECT doc_id, string_agg(word, ', ' ORDER BY first_at, word) AS concepts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_at, word) AS n FROM o) WHERE n <= 5 GROUP BY doc_id),
files AS (SELECT doc_id, string_agg(file, ', ' ORDER BY first_at, file) AS files FROM (SELECT doc_id, file, min(pos) AS first_at, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos), file) AS n FROM r WHERE file <> '' GROUP BY doc_id, file) WHERE n <= 3 GROUP BY doc_id)
SELECT doc_id, gaps, missing, concat_ws('; ', 'Need more context from: ' || files, CASE WHEN missing * 2 > gaps THEN 'Clarify: ' || concepts END, CASE WHEN low > 0 THEN 'Find more specific code references' END, CASE WHEN bare > 0 THEN 'Provide code examples for claims' END) AS refinement FROM g LEFT JOIN named USING (doc_id) LEFT JOIN files USING (doc_id)""")
def refinement_query(spark, sf_dir):
    """What to ask for next, by the reasons of the gaps: up to three files that their claims name, up to five of their keywords in the order in which they occur."""
    reason = E.gap_reason(F.col("epos"), F.col("sources"), F.col("confidence"))
    gaps = _matched(spark, sf_dir).withColumn("reason", reason).where("reason is not null").withColumn("file", F.regexp_extract("claim", _FILE, 1))
    count = lambda text: F.count_if(F.col("reason") == text)
    counted = gaps.groupBy("doc_id").agg(F.count("*").alias("gaps"), count("No evidence found").alias("missing"), count("Low confidence evidence").alias("low"), count("Evidence has no source chunks").alias("bare"))

    def first(rows, name, most):
        ranked = rows.groupBy("doc_id", name).agg(F.min("pos").alias("at")).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", name))).where(F.col("n") <= most)
        return ranked.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", name))), lambda x: x[name]), ", ").alias(name + "s"))

    words = first(gaps.select("doc_id", "pos", F.explode(T.keywords(F.col("claim"))).alias("word")), "word", 5)
    files = first(gaps.where("file <> ''"), "file", 3)
    text = F.concat_ws(
        "; ", F.concat(F.lit("Need more context from: "), "files"), F.when(F.col("missing") * 2 > F.col("gaps"), F.concat(F.lit("Clarify: "), "words")),
        F.when(F.col("low") > 0, "Find more specific code references"), F.when(F.col("bare") > 0, "Provide code examples for claims"),
    )
    return counted.join(words, "doc_id", "left").join(files, "doc_id", "left").select("doc_id", "gaps", "missing", text.alias("refinement"))


@query(_MATCH + _COVER + " SELECT doc_id, total, covered, ratio >= 0.7 AS passed, concat_ws('; ', CASE WHEN average < 0.5 THEN 'find stronger evidence' END, CASE WHEN ratio < 0.5 THEN 'support more claims' END, CASE WHEN sources = 0 THEN 'cite sources' END) AS notes FROM cover")
def refined_query(spark, sf_dir):
    """Which answers pass, and the notes that go with the next round's query."""
    notes = F.concat_ws("; ", F.when(F.col("average") < 0.5, "find stronger evidence"), F.when(F.col("ratio") < 0.5, "support more claims"), F.when(F.col("sources") == 0, "cite sources"))
    return E.coverage(_matched(spark, sf_dir), "doc_id").select("doc_id", "total", "covered", (F.col("ratio") >= 0.7).alias("passed"), notes.alias("notes"))


@query(_MATCH + _COVER + f""", f AS (SELECT doc_id, count(*) AS checks, count(*) FILTER (NOT valid) AS failed FROM ({_SCORED}) GROUP BY doc_id),
v AS (SELECT doc_id, ratio, coalesce(checks, 0) AS checks, coalesce(failed, 0) AS failed FROM cover LEFT JOIN f USING (doc_id))
SELECT doc_id, checks, failed, ratio >= 0.7 AND failed = 0 AS verified, round(greatest(0, least(1, ratio - 0.2::DOUBLE * failed + CASE WHEN checks > 0 AND failed = 0 THEN 0.1::DOUBLE ELSE 0 END)), 6)::DOUBLE AS confidence FROM v""")
def verify_answers(spark, sf_dir):
    """Claims, coverage and checks together: a check per cited symbol, failed if no chunk has it."""
    cover = E.coverage(_matched(spark, sf_dir), "doc_id").select("doc_id", "ratio")
    checks = _cited(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("valid")).alias("failed"))
    both = cover.join(checks, "doc_id", "left").fillna(0, ["checks", "failed"])
    score = F.col("ratio") - 0.2 * F.col("failed") + F.when((F.col("checks") > 0) & (F.col("failed") == 0), 0.1).otherwise(0.0)
    return both.select("doc_id", "checks", "failed", ((F.col("ratio") >= 0.7) & (F.col("failed") == 0)).alias("verified"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("confidence"))


@query("SELECT file_hash, chunk_id, tokens, sum(tokens) OVER (PARTITION BY file_hash ORDER BY start_line, chunk_id)::BIGINT AS used, sum(tokens) OVER (PARTITION BY file_hash ORDER BY start_line, chunk_id) < 1000 AS fits FROM (SELECT file_hash, chunk_id, min(start_line) AS start_line, max(ceil(length(text) / 4.0))::BIGINT AS tokens FROM chunks WHERE text IS NOT NULL AND file_hash IS NOT NULL GROUP BY ALL)")
def budget_guard(spark, sf_dir):
    """How far a file's chunks, in order, fit into a budget of 1,000 estimated tokens. Windows are as long as one file."""
    own = read_table(spark, sf_dir, "chunks").where("text is not null and file_hash is not null").groupBy("file_hash", "chunk_id").agg(F.min("start_line").alias("start_line"), F.max(F.ceil(F.length("text") / 4)).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("file_hash").orderBy("start_line", "chunk_id"))
    return own.select("file_hash", "chunk_id", "tokens", used.alias("used"), (used < 1000).alias("fits"))


@query(f"SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS evidence, round(max(score), 6) AS confidence FROM ({SEARCH_SQL['hybrid_dense']}) WHERE rank <= 3 GROUP BY query_id")
def answer_extractive(spark, sf_dir):
    """An answer without a model: the ids of the three best chunks of each query as its evidence."""
    best = hybrid_dense(spark, sf_dir).where("rank <= 3").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"), F.max("score").alias("confidence"))
    return best.select("query_id", F.array_join(F.transform("r", lambda x: x["chunk_id"]), ",").alias("evidence"), F.round("confidence", 6).alias("confidence"))
