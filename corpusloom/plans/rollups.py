"""Joins, roll-ups and small rules over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import code as C
from corpusloom.operators import store as S
from corpusloom.plans.scalars import _CLAIMS, _HASHED, _KEYS, _WORDS, _claims
from corpusloom.plans.scans import _EXPORT
from corpusloom.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT v.chunk_id, c.path, c.text FROM (SELECT DISTINCT chunk_id FROM vectors WHERE model = 'beacon-embed-48') v LEFT JOIN (SELECT chunk_id, path, text FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, path DESC NULLS LAST, text DESC NULLS LAST) = 1) c USING (chunk_id)")
def get_chunk(spark, sf_dir):
    """Chunks looked up by id (those with a vector of the second model): path and text of the newest row, null where the store has none."""
    asked = read_table(spark, sf_dir, "vectors").where("model = 'beacon-embed-48'").select("chunk_id").distinct()
    store = read_table(spark, sf_dir, "chunks").select("chunk_id", "path", "text", "indexed_at").join(asked, "chunk_id", "left_semi")
    return asked.join(S.latest(store, ["chunk_id"], "indexed_at", "path", "text"), "chunk_id", "left").select("chunk_id", "path", "text")


_NODE = """CASE WHEN regexp_matches(line, '^export\\b') THEN 'export_statement' WHEN regexp_matches(line, '^(?:async\\s+)?function\\b') THEN 'function_declaration' WHEN regexp_matches(line, '^class\\b') THEN 'class_declaration' WHEN regexp_matches(line, '^(?:const|let)\\b') THEN 'lexical_declaration' WHEN regexp_matches(line, '^var\\b') THEN 'variable_declaration' WHEN symbol_type = 'method' THEN 'method_definition' ELSE 'expression_statement' END"""


@query(f"SELECT DISTINCT chunk_id, node, CASE WHEN contains(node, 'function') THEN 'function' WHEN contains(node, 'class') THEN 'class' WHEN node = 'method_definition' THEN 'method' WHEN contains(node, 'declaration') THEN 'module' ELSE 'other' END AS mapped FROM (SELECT chunk_id, {_NODE} AS node FROM (SELECT chunk_id, symbol_type, trim(regexp_extract(text, '(?m)^\\s*(?:export|async|function|class|const|let|var)\\b.*$', 0), ' ' || chr(9) || chr(10) || chr(13)) AS line FROM chunks WHERE text IS NOT NULL))")
def symbol_type_map(spark, sf_dir):
    """The syntax node that a chunk's first declaration begins, and its symbol type."""
    line = F.btrim(F.regexp_extract("text", r"(?m)^\s*(?:export|async|function|class|const|let|var)\b[^\n]*", 0), F.lit(" \t\n\r"))
    own = read_table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", "symbol_type", line.alias("line"))
    begins = lambda pattern: F.col("line").rlike(pattern)
    node = F.when(begins(r"^export\b"), "export_statement").when(begins(r"^(?:async\s+)?function\b"), "function_declaration").when(begins(r"^class\b"), "class_declaration")
    node = node.when(begins(r"^(?:const|let)\b"), "lexical_declaration").when(begins(r"^var\b"), "variable_declaration").when(F.col("symbol_type") == "method", "method_definition").otherwise("expression_statement")
    return own.select("chunk_id", node.alias("node")).distinct().withColumn("mapped", C.node_symbol_type(F.col("node")))


@query("SELECT c.chunk_id, c.path, v.model, max(len(v.dense)) AS dim FROM (SELECT DISTINCT chunk_id, path FROM chunks) c JOIN vectors v USING (chunk_id) WHERE v.dense IS NOT NULL GROUP BY ALL")
def zip_scores(spark, sf_dir):
    """Chunks with their vectors, joined by id instead of by position."""
    c = read_table(spark, sf_dir, "chunks").select("chunk_id", "path").distinct()
    v = read_table(spark, sf_dir, "vectors").where("dense is not null").select("chunk_id", "model", F.size("dense").alias("d"))
    return c.join(v, "chunk_id").groupBy("chunk_id", "path", "model").agg(F.max("d").cast("bigint").alias("dim"))


@query("SELECT DISTINCT d.doc_id, c.chunk_id FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]\\w+', 0)) AS symbol FROM documents) d JOIN (SELECT DISTINCT chunk_id, symbol_name AS symbol FROM chunks) c USING (symbol) WHERE length(symbol) > 12")
def evidence_chunks(spark, sf_dir):
    """Chunks of the symbols (of more than 12 characters) that a document names."""
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w+"), 0))
    cited = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(named, lambda s: F.length(s) > 12)).alias("symbol"))
    return cited.join(read_table(spark, sf_dir, "chunks").select("chunk_id", F.col("symbol_name").alias("symbol")).distinct(), "symbol").select("doc_id", "chunk_id").distinct()


@query(f"WITH k AS (SELECT doc_id, {_KEYS} AS ws FROM documents WHERE text IS NOT NULL), p AS (SELECT a.doc_id, len(list_filter(a.ws, lambda w: list_contains(b.ws, w))) AS overlap, len(a.ws) AS words FROM k a JOIN k b ON b.doc_id = a.doc_id + 1) SELECT doc_id, overlap, overlap >= ceil(words / 2.0) AS matches FROM p")
def keyword_overlap(spark, sf_dir):
    """How many keywords of a document (repeated ones count) the next document holds."""
    k = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.keywords(F.col("text")).alias("ws"))
    after = k.select((F.col("doc_id") - 1).alias("doc_id"), F.map_from_arrays(F.array_distinct("ws"), F.array_distinct("ws")).alias("own"))
    n = F.size(F.filter("ws", lambda w: F.map_contains_key("own", w)))
    return k.join(after, "doc_id").select("doc_id", n.cast("bigint").alias("overlap"), (n >= F.ceil(F.size("ws") / 2.0)).alias("matches"))


@query(f"WITH c AS (SELECT doc_id, raw, claim FROM ({_CLAIMS}) WHERE length(claim) > 10), n AS (SELECT claim FROM c GROUP BY claim HAVING count(DISTINCT doc_id) > 1) SELECT doc_id, count(*) AS total, count(n.claim) AS covered, round(count(n.claim) / count(*), 6) AS ratio FROM c LEFT JOIN n USING (claim) GROUP BY doc_id")
def tracker_coverage(spark, sf_dir):
    """Which share of a document's claims stands word for word in another document."""
    c = _claims(spark, sf_dir).where("length(claim) > 10").select("doc_id", "claim")
    known = c.groupBy("claim").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("claim", F.lit(1).alias("known"))
    done = c.join(known, "claim", "left").groupBy("doc_id").agg(F.count("*").alias("total"), F.count("known").alias("covered"))
    return done.withColumn("ratio", F.round(F.col("covered") / F.col("total"), 6))


_BY_USER = "SELECT user_id, count(*) AS checks, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value >= 50) / count(*) AS coverage FROM events GROUP BY user_id"


@query(f"SELECT user_id, failed = 0 AS passed, round(greatest(0, least(1, coverage - 0.2::DOUBLE * failed + CASE WHEN checks > 0 AND failed = 0 THEN 0.1::DOUBLE ELSE 0 END)), 6)::DOUBLE AS confidence FROM ({_BY_USER})")
def verifier_confidence(spark, sf_dir):
    by = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("checks"), F.count_if(F.col("event_type") == "error").alias("failed"), (F.count_if(F.col("value") >= 50) / F.count("*")).alias("coverage"))
    score = F.col("coverage") - 0.2 * F.col("failed") + F.when((F.col("checks") > 0) & (F.col("failed") == 0), 0.1).otherwise(0.0)
    return by.select("user_id", (F.col("failed") == 0).alias("passed"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("confidence"))


@query("SELECT user_id, count(*) FILTER (value >= 70) AS verified, count(*) FILTER (value >= 40 AND value < 70) AS pending, count(*) FILTER (value < 40) AS failed, count(*) AS total FROM events GROUP BY user_id")
def verification_summary(spark, sf_dir):
    v = F.col("value")
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(v >= 70).alias("verified"), F.count_if((v >= 40) & (v < 70)).alias("pending"), F.count_if(v < 40).alias("failed"), F.count("*").alias("total"))


@query(f"WITH h AS ({_HASHED}), t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL), d AS (SELECT doc_id, abs(hash) % 64 AS dim, sum(tf)::DOUBLE AS v FROM t JOIN h USING (term) GROUP BY ALL) SELECT doc_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM d")
def embed_text(spark, sf_dir):
    """The default embedding: hashed term counts in 64 dimensions, scaled to length 1, in long form."""
    words = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    d = words.groupBy("doc_id", (F.abs(T.term_hash(F.col("term"))) % 64).alias("dim")).agg(F.sum("tf").cast("double").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    return d.select("doc_id", "dim", F.round(F.col("v") / norm, 6).alias("value"))


@query("WITH l AS (SELECT file_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM source_files WHERE text IS NOT NULL), w AS (SELECT *, max(regexp_matches(content, 'await |console\\.')::INT) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS near FROM l) SELECT file_id, count(*) AS returns, count(*) FILTER (near = 1) AS wired, CASE WHEN count(*) FILTER (near = 1) = count(*) THEN 'WIRED' WHEN count(*) FILTER (near = 1) > 0 THEN 'PARTIAL' ELSE 'NOT_WIRED' END AS status FROM w WHERE regexp_matches(content, '\\breturn ') GROUP BY file_id")
def link_wiring(spark, sf_dir):
    """Whether each return has a call of interest within the five lines before it: a fold over a file's lines."""
    start = F.struct(F.lit(99).alias("since"), F.lit(0).alias("returns"), F.lit(0).alias("wired"))

    def step(s, line):
        since = F.when(line.rlike(r"await |console\."), 0).otherwise(s["since"] + 1)
        returns = line.rlike(r"\breturn ")
        return F.struct(since.alias("since"), (s["returns"] + returns.cast("int")).alias("returns"), (s["wired"] + (returns & (since <= 5)).cast("int")).alias("wired"))

    own = read_table(spark, sf_dir, "source_files").where("text is not null").select("file_id", F.aggregate(F.split("text", "\n", -1), start, step).alias("s"))
    by = own.select("file_id", F.col("s.returns").cast("bigint").alias("returns"), F.col("s.wired").cast("bigint").alias("wired")).where("returns > 0")
    return by.withColumn("status", F.when(F.col("wired") == F.col("returns"), "WIRED").when(F.col("wired") > 0, "PARTIAL").otherwise("NOT_WIRED"))


_IDENTIFIER = r"[A-Za-z_]\w+"


@query(f"WITH x AS (SELECT DISTINCT repo AS producer, unnest(regexp_extract_all(text, '{_EXPORT}', 1)) AS symbol FROM source_files), i AS (SELECT DISTINCT repo AS consumer, unnest(regexp_extract_all(text, '{_IDENTIFIER}', 0)) AS symbol FROM documents) SELECT symbol, producer, consumer FROM x JOIN i USING (symbol) WHERE producer IS NOT NULL AND consumer IS NOT NULL")
def provides_consumes(spark, sf_dir):
    """Which repository exports a symbol that the documents of which repository name."""
    x = read_table(spark, sf_dir, "source_files").where("repo is not null").select(F.col("repo").alias("producer"), F.explode(F.regexp_extract_all("text", F.lit(_EXPORT), 1)).alias("symbol")).distinct()
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(_IDENTIFIER), 0))
    i = read_table(spark, sf_dir, "documents").where("repo is not null").select(F.col("repo").alias("consumer"), F.explode(named).alias("symbol")).distinct()
    return x.join(i, "symbol").select("symbol", "producer", "consumer")


@query("SELECT c_custkey, count(o_orderkey) AS plans, CASE WHEN count(o_orderkey) > 0 THEN 'COVERED' ELSE 'MISSING' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def requirement_coverage(spark, sf_dir):
    plans = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return read_table(spark, sf_dir, "customer").join(plans, "c_custkey", "left").select("c_custkey", n.alias("plans"), F.when(n > 0, "COVERED").otherwise("MISSING").alias("status"))


@query("SELECT o_custkey, count(*) AS plans, count(*) FILTER (done > 0) AS summaries, count(*) = count(*) FILTER (done > 0) AS complete FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) FILTER (l_linestatus = 'F') AS done FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey")
def phase_complete(spark, sf_dir):
    """Customers (phases) whose every order (plan) has a finished line item (summary)."""
    done = read_table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(1))
    by = read_table(spark, sf_dir, "orders").join(done, "o_orderkey", "left").groupBy("o_custkey").agg(F.count("*").alias("plans"), F.count("done").alias("summaries"))
    return by.withColumn("complete", F.col("plans") == F.col("summaries"))


@query("SELECT doc_id, repo, created_at FROM documents WHERE created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, doc_id) <= 3")
def recent_work(spark, sf_dir):
    own = read_table(spark, sf_dir, "documents").where("created_at is not null").select("doc_id", "repo", "created_at")
    return own.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("created_at").desc(), "doc_id"))).where("n <= 3").drop("n")


@query("WITH d AS (SELECT repo, count(*) AS docs, sum(length(text))::BIGINT AS doc_chars FROM documents WHERE repo IS NOT NULL GROUP BY repo), f AS (SELECT repo, count(*) AS files, count(DISTINCT path) AS paths FROM source_files WHERE repo IS NOT NULL GROUP BY repo) SELECT r.repo, coalesce(docs, 0) AS docs, coalesce(doc_chars, 0) AS doc_chars, coalesce(files, 0) AS files, coalesce(paths, 0) AS paths FROM repos r LEFT JOIN d ON d.repo = r.repo LEFT JOIN f ON f.repo = r.repo")
def milestone_stats(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").groupBy("repo").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("doc_chars"))
    f = read_table(spark, sf_dir, "source_files").groupBy("repo").agg(F.count("*").alias("files"), F.countDistinct("path").alias("paths"))
    return read_table(spark, sf_dir, "repos").select("repo").join(d, "repo", "left").join(f, "repo", "left").fillna(0)


@query("SELECT pkg_name, pkg_version FROM (SELECT *, list_transform(string_split(pkg_version, '.'), lambda x: x::INTEGER) AS v FROM packages) WHERE v[1] * 1000000 + v[2] * 1000 + v[3] > 3000000 AND v[1] * 1000000 + v[2] * 1000 + v[3] <= 7000000")
def version_range(spark, sf_dir):
    key = F.transform(F.split("pkg_version", r"\."), lambda x: x.cast("int"))
    bound = lambda *v: F.array(*[F.lit(x) for x in v])
    return read_table(spark, sf_dir, "packages").where((key > bound(3, 0, 0)) & (key <= bound(7, 0, 0))).select("pkg_name", "pkg_version")


@query("SELECT event_id, CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS label FROM (SELECT event_id, floor(abs(value) * 100 / 60)::BIGINT AS m FROM events WHERE value IS NOT NULL)")
def duration_label(spark, sf_dir):
    m = F.floor(F.abs("value") * 100 / 60)
    own = read_table(spark, sf_dir, "events").where("value is not null").select("event_id", m.alias("m"))
    text = F.when(F.col("m") < 60, F.concat(F.col("m").cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(F.col("m") / 60).cast("string"), F.lit("h "), (F.col("m") % 60).cast("string"), F.lit("m")))
    return own.select("event_id", text.alias("label"))


@query("SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    """Texts that occur more than once."""
    own = read_table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("text_hash"), "doc_id")
    return own.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("copies > 1")


@query("SELECT DISTINCT repo, lower(trim(language)) AS tech FROM source_files WHERE language IS NOT NULL")
def tech_union(spark, sf_dir):
    return read_table(spark, sf_dir, "source_files").where("language is not null").select("repo", F.lower(F.trim("language")).alias("tech")).distinct()


_NEEDED = (("phase", "(?m)^phase: "), ("checkbox", r"(?m)^- \[[ x]\] "), ("heading", "(?m)^#{1,6} "), ("path", r"`[\w./-]+\.[a-z]+`"))


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _NEEDED) + ") AS missing FROM documents WHERE text IS NOT NULL")
def task_completeness(spark, sf_dir):
    """Which of the elements of a plan a document lacks."""
    missing = F.concat_ws(",", *[F.when(~F.col("text").rlike(p), n) for n, p in _NEEDED])
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", missing.alias("missing"))
