"""Queries of the llm operators (pN_...) over the project's tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.code_docs import documented_functions
from corpusloom.llm.leakage import leaks
from corpusloom.llm.mixing import mixture
from corpusloom.llm.provenance import provenance
from corpusloom.llm.shared_spans import fuzzy_passages, shared_share, shared_spans
from corpusloom.llm.similar_vectors import search_vectors, similar_pairs, similar_vectors
from corpusloom.llm.splitting import split_oversized
from corpusloom.llm.syntax_check import checked_files, invalid_rates
from corpusloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(read_table(spark, sf_dir, "vectors"))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every usable vector, without a threshold."""
    return similar_vectors(read_table(spark, sf_dir, "vectors"))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the true 10 nearest (by a scan of all codes, for the query set of p1_search) p1_nearest finds: (asked, true, found)."""
    truth = p1_search(spark, sf_dir).select("id", "neighbour").withColumn("wanted", F.lit(1))
    both = truth.join(p1_nearest(spark, sf_dir).select("id", "neighbour", F.lit(1).alias("got")), ["id", "neighbour"], "left")
    return both.agg(F.countDistinct("id").alias("asked"), F.count("wanted").alias("true"), F.count("got").alias("found"))


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of about one in 85 vectors (a stated query set) among all of the model."""
    vectors = read_table(spark, sf_dir, "vectors")
    asked = vectors.select(F.col("chunk_id").alias("id")).where(F.substring(F.md5("id"), 1, 2) < "03")
    return search_vectors(vectors, asked)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_files(read_table(spark, sf_dir, "source_files")).where("not valid").select("file_id")


def p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_files(read_table(spark, sf_dir, "source_files"))


def p2_invalid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(read_table(spark, sf_dir, "source_files"))


def p2_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of p2_found that are JSON files; SQL can state this part."""
    return checked_files(read_table(spark, sf_dir, "source_files")).where("language = 'json' and not valid").select("file_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_provenance(spark, sf_dir).where("not by_hand").select("file_id")


def p3_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(read_table(spark, sf_dir, "source_files"), read_table(spark, sf_dir, "packages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read_table(spark, sf_dir, "chunks"))


def p4_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split text put together again from its pieces, as a hash, with the pieces' greatest length and smallest overlap of neighbours."""
    pieces = p4_pieces(spark, sf_dir).select("chunk_id", F.struct("piece", "char_start", "char_end", "text").alias("p")).distinct()
    listed = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # one text's pieces
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("until"), F.lit(300).alias("overlap"))
    joined = F.aggregate(
        "p", start,
        lambda state, p: F.struct(
            F.concat(state["text"], F.substring(p["text"], state["until"] - p["char_start"] + 1, F.length(p["text"]))).alias("text"),
            p["char_end"].alias("until"), F.when(p["piece"] == 0, state["overlap"]).otherwise(F.least(state["overlap"], state["until"] - p["char_start"])).alias("overlap"),
        ),
    )
    longest = F.array_max(F.transform("p", lambda p: F.length(p["text"])))
    return listed.select("chunk_id", F.md5(joined["text"]).alias("whole"), (longest <= 2000).alias("fits"), (joined["overlap"] == 300).alias("overlaps"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("chunk_id").distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(read_table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p6_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items of which at least half is covered by tiles, in whatever order."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), threshold=0.5)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


def p7_within_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the targets, whether no record was used more often than allowed and the sizes add up."""
    picked, report = mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))
    used = picked.groupBy("source").agg(F.max("copies").alias("most"), F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"))
    kept = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("rows", F.lit(0)) == F.coalesce("docs", F.lit(0)))
    return report.join(used, "source", "left").select("source", "max_repeats", kept.alias("kept"), (F.col("mixed_tokens") <= F.col("available_tokens") * F.col("max_repeats")).alias("covered"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(read_table(spark, sf_dir, "documents"))


def p8_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(read_table(spark, sf_dir, "documents"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


_P1 = """WITH latest AS (SELECT chunk_id, dense FROM vectors WHERE model = 'beacon-embed-96' AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST) = 1),
u AS (SELECT chunk_id, dense::DOUBLE[] AS v FROM latest WHERE len(dense) = 96 AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
near AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.chunk_id <> b.chunk_id QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY c DESC, b.chunk_id) <= 10)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM near WHERE c >= 0.8"""
_P6 = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)), ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
_P8 = """WITH w AS (SELECT doc_id, p, hash(substr(text, p + 1, 400)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 399)) AS p FROM documents WHERE length(text) >= 400)),
shared AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, true) AS fresh FROM w WHERE h IN (SELECT h FROM shared)),
island AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit)
SELECT doc_id, min(p) AS span_start, max(p) + 400 AS span_end FROM island GROUP BY doc_id, k"""


_SEARCH = _P1.split("near AS")[0].rstrip().rstrip(",") + """
SELECT a.chunk_id AS id, b.chunk_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.chunk_id <> b.chunk_id WHERE substr(md5(a.chunk_id), 1, 2) < '03'
QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY cosine DESC, b.chunk_id) <= 10"""


def oracle_sql() -> dict[str, str]:
    """For those that SQL can state; the other operators are tested against brute force or by round trips."""
    return {
        "p1_found": _P1,
        "p1_search": _SEARCH,
        "p2_json": "SELECT file_id FROM source_files WHERE text IS NOT NULL AND coalesce(nullif(lower(trim(language)), ''), CASE WHEN lower(path) LIKE '%.json' THEN 'json' END) = 'json' AND NOT json_valid(text)",
        "p4_rebuilt": "SELECT DISTINCT chunk_id, md5(text) AS whole, true AS fits, true AS overlaps FROM chunks WHERE length(text) > 2000",
        "p7_within_limits": "SELECT source, max(coalesce(max_repeats, 0)) AS max_repeats, true AS kept, true AS covered FROM mix_targets WHERE source IS NOT NULL GROUP BY source",
        "p4_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2000",
        "p6_found": _P6,
        "p8_found": _P8,
        "p8_shared_share": f"WITH s AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS n FROM ({_P8}) GROUP BY doc_id) SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS shared_chars, coalesce(coalesce(n, 0) / nullif(length(text), 0), 0)::DOUBLE AS shared_ratio FROM documents LEFT JOIN s USING (doc_id)",
    }
