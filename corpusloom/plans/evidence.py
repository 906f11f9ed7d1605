"""Evidence queries: sentences of a document are claims; the chunks' first lines and the repository's documents are evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evidence as E
from corpusloom.operators.sequences import previous
from corpusloom.plans.scalars import _CLAIMS, _KEYS, _claims
from corpusloom.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _sides(spark, sf_dir):
    """Even sentences of a document claim, odd ones (of at least 10 characters) are its evidence, with a made confidence."""
    own = _claims(spark, sf_dir).where("length(claim) > 10")
    claims = own.where("raw % 2 = 0").select("doc_id", F.col("raw").cast("bigint").alias("pos"), "claim")
    evidence = own.where("raw % 2 = 1").select("doc_id", F.col("raw").cast("bigint").alias("epos"), F.col("claim").alias("evidence"), (F.length("claim") % 3).cast("bigint").alias("sources"), (F.length("claim") % 10 / 10.0).cast("double").alias("confidence"))
    return claims, evidence


def _matched(spark, sf_dir):
    return E.match_evidence(*_sides(spark, sf_dir), "doc_id")


_WORDS = _KEYS.replace("text", "claim")
_MATCH = f"""WITH own AS (SELECT doc_id, raw, claim, lower(claim) AS low, {_WORDS} AS words FROM ({_CLAIMS}) WHERE length(claim) > 10),
c AS (SELECT * FROM own WHERE raw % 2 = 0), e AS (SELECT *, length(claim) % 3 AS sources, (length(claim) % 10) / 10.0::DOUBLE AS confidence FROM own WHERE raw % 2 = 1),
m AS (SELECT c.doc_id, c.raw AS pos, min(e.raw) AS epos FROM c JOIN e ON c.doc_id = e.doc_id AND (contains(c.low, e.low) OR contains(e.low, c.low) OR len(list_filter(c.words, lambda w: list_contains(e.words, w))) >= ceil(len(c.words) / 2.0)) GROUP BY ALL),
matched AS (SELECT c.doc_id, c.raw AS pos, c.claim, m.epos, e.sources, e.confidence FROM c LEFT JOIN m ON c.doc_id = m.doc_id AND c.raw = m.pos LEFT JOIN e ON e.doc_id = m.doc_id AND e.raw = m.epos),
gaps AS (SELECT *, CASE WHEN epos IS NULL THEN 'No evidence found' WHEN coalesce(sources, 0) = 0 THEN 'Evidence has no source chunks' WHEN coalesce(confidence, 0) < 0.3 THEN 'Low confidence evidence' END AS reason FROM matched)"""
_COVER = """, cover AS (SELECT doc_id, count(pos) AS total, count(*) FILTER (reason IS NULL) AS covered, coalesce(avg(CASE WHEN sources > 0 THEN confidence END), 0) AS average, count(DISTINCT epos) AS sources, count(*) FILTER (reason IS NULL) / count(pos) AS ratio FROM gaps GROUP BY doc_id)"""


@query(_MATCH + " SELECT doc_id, pos, claim, coalesce(epos, -1) AS epos, coalesce(sources, 0) AS sources, coalesce(confidence, 0) AS confidence FROM matched")
def match_evidence(spark, sf_dir):
    """Claims with their first evidence; -1 and 0 where there is none."""
    return _matched(spark, sf_dir).fillna({"epos": -1, "sources": 0, "confidence": 0.0})


@query(_MATCH + " SELECT doc_id, pos, reason FROM gaps WHERE reason IS NOT NULL")
def coverage_gaps(spark, sf_dir):
    reason = E.gap_reason(F.col("epos"), F.col("sources"), F.col("confidence"))
    return _matched(spark, sf_dir).select("doc_id", "pos", reason.alias("reason")).where("reason is not null")


@query(_MATCH + " SELECT doc_id, reason, count(*) AS n FROM gaps WHERE reason IS NOT NULL GROUP BY ALL")
def gap_reasons(spark, sf_dir):
    return coverage_gaps(spark, sf_dir).groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


@query(_MATCH + " SELECT doc_id, pos, claim FROM matched WHERE epos IS NULL")
def uncovered_claims(spark, sf_dir):
    return _matched(spark, sf_dir).where("epos is null").select("doc_id", "pos", "claim")


@query(_MATCH + _COVER + " SELECT doc_id, total, covered, round(ratio, 6) AS ratio FROM cover")
def evidence_coverage(spark, sf_dir):
    return E.coverage(_matched(spark, sf_dir), "doc_id").select("doc_id", "total", "covered", F.round("ratio", 6).alias("ratio"))


@query(_MATCH + _COVER + """, s AS (SELECT doc_id, round(greatest(0, least(1, 0.4::DOUBLE * average + 0.35::DOUBLE * ratio + 0.1::DOUBLE * least(1, 0.2::DOUBLE * sources) + 0.15::DOUBLE)), 6) AS score FROM cover)
SELECT doc_id, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM s""")
def confidence_report(spark, sf_dir):
    scored = E.coverage(_matched(spark, sf_dir), "doc_id").select("doc_id", F.round(E.confidence(F.col("average"), F.col("ratio"), F.col("sources"), F.lit(1.0)), 6).alias("score"))
    return scored.withColumn("level", E.confidence_level(F.col("score")))


@query("""WITH c AS (SELECT DISTINCT file_hash, nullif(path, '') AS path, nullif(symbol_name, '') AS symbol FROM chunks WHERE file_hash IS NOT NULL), n AS (SELECT file_hash, count(*) AS n, count(DISTINCT path) AS p, count(DISTINCT symbol) AS s FROM c GROUP BY file_hash)
SELECT file_hash, round(CASE WHEN n < 2 THEN 1.0 ELSE (CASE WHEN p > 0 THEN 1.0::DOUBLE / p ELSE 0 END + CASE WHEN s > 0 THEN 1.0::DOUBLE / s ELSE 0 END) / 2 END, 6)::DOUBLE AS consistency FROM n""")
def consistency(spark, sf_dir):
    blank = F.lit("")
    cited = read_table(spark, sf_dir, "chunks").where("file_hash is not null").select("file_hash", F.nullif(F.col("path"), blank).alias("path"), F.nullif(F.col("symbol_name"), blank).alias("symbol")).distinct()
    return E.consistency(cited, "file_hash").withColumn("consistency", F.round("consistency", 6))


@query("SELECT DISTINCT v.chunk_id, v.model FROM vectors v WHERE v.chunk_id IN (SELECT chunk_id FROM chunks)")
def valid_citations(spark, sf_dir):
    """Vectors that cite a chunk of the store."""
    return read_table(spark, sf_dir, "vectors").select("chunk_id", "model").join(read_table(spark, sf_dir, "chunks").select("chunk_id"), "chunk_id", "left_semi").distinct()


@query("SELECT user_id, event_id, value, coalesce(value, 0) < 50 AND (before IS NULL OR value - before >= 5) AS recurse FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)")
def recurse_decision(spark, sf_dir):
    runs = read_table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return E.recurse_decision(runs, "user_id", "event_id", "value", 50.0, 5.0)


@query("WITH t AS (SELECT doc_id, repo, list_distinct(string_split(text, chr(10))) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, lag(ls) OVER (PARTITION BY repo ORDER BY doc_id) AS before, ls FROM t) SELECT doc_id, len(list_intersect(ls, before)) AS shared, len(list_intersect(ls, before)) > 0.5 * len(ls) AS repeats FROM l WHERE before IS NOT NULL")
def error_repeat(spark, sf_dir):
    """Lines that a document of the repository repeats from the one before it, and whether they are more than half."""
    hashes = F.array_distinct(F.transform(T.lines(F.col("text")), lambda line: F.xxhash64(line)))
    own = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "repo", hashes.alias("ls"))
    before = previous(own, "repo", ["doc_id"], F.col("ls"), F.floor(F.col("doc_id") / 1024)).where("before is not null")
    n = F.size(F.array_intersect("ls", "before"))
    return before.select("doc_id", n.cast("bigint").alias("shared"), (n > 0.5 * F.size("ls")).alias("repeats"))
