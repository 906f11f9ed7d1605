"""Queries of the chunk store, caches, Markdown sections and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import code as C
from corpusloom.operators import markdown as M
from corpusloom.operators import store as S
from corpusloom.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _split_chunks(spark, sf_dir):
    own = read_table(spark, sf_dir, "chunks").select("chunk_id", "repo", "path", "file_hash", "indexed_at", "end_line")
    return own.where("indexed_at < timestamp_ntz'2024-07-01'"), own.where("indexed_at >= timestamp_ntz'2024-07-01'")


_LATEST = "SELECT chunk_id, repo, path, file_hash, indexed_at, end_line FROM chunks WHERE {} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, path DESC NULLS LAST, repo DESC NULLS LAST, end_line DESC NULLS LAST) = 1"
_OLD, _NEW = _LATEST.format("indexed_at < TIMESTAMP '2024-07-01'"), _LATEST.format("indexed_at >= TIMESTAMP '2024-07-01'")


@query(f"WITH n AS ({_NEW}), o AS ({_OLD}) SELECT * REPLACE (coalesce(end_line, -1) AS end_line) FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n))")
def upsert_points(spark, sf_dir):
    """Chunks indexed later replace those of the same id indexed before the middle of the year."""
    old, new = (S.latest(x, ["chunk_id"], "indexed_at", "path", "repo", "end_line") for x in _split_chunks(spark, sf_dir))
    return S.upsert(old, new, "chunk_id").select("chunk_id", "repo", "path", "file_hash", "indexed_at", F.coalesce("end_line", F.lit(-1)).alias("end_line"))


_GONE = "SELECT file_hash FROM manifest WHERE file_hash NOT IN (SELECT file_hash FROM source_files WHERE file_hash IS NOT NULL)"


@query(f"SELECT DISTINCT chunk_id, file_hash FROM chunks WHERE file_hash IS NULL OR file_hash NOT IN ({_GONE} AND file_hash IS NOT NULL)")
def delete_by_hash(spark, sf_dir):
    """Chunks left after those of files that no longer exist in any version are deleted."""
    files, manifest = read_table(spark, sf_dir, "source_files"), read_table(spark, sf_dir, "manifest")
    gone = S.delete_matching(manifest, files, "file_hash")
    return S.delete_matching(read_table(spark, sf_dir, "chunks"), gone, "file_hash").select("chunk_id", "file_hash").distinct()


_SEEN = "SELECT repo, path, file_hash FROM manifest QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC NULLS LAST, file_hash DESC NULLS LAST) = 1"


@query(f"SELECT file_id, repo, path, file_hash FROM source_files f WHERE NOT EXISTS (SELECT 1 FROM ({_SEEN}) m WHERE m.repo IS NOT DISTINCT FROM f.repo AND m.path = f.path AND m.file_hash = f.file_hash)")
def incremental_skip(spark, sf_dir):
    """Files that must be indexed again."""
    return S.changed_files(read_table(spark, sf_dir, "source_files"), read_table(spark, sf_dir, "manifest")).select("file_id", "repo", "path", "file_hash")


@query("SELECT DISTINCT repo, path FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM source_files f WHERE m.repo IS NOT DISTINCT FROM f.repo AND m.path = f.path)")
def removed_files(spark, sf_dir):
    return S.removed_files(read_table(spark, sf_dir, "source_files"), read_table(spark, sf_dir, "manifest"))


@query(f"WITH again AS (SELECT file_id FROM source_files f WHERE NOT EXISTS (SELECT 1 FROM ({_SEEN}) m WHERE m.repo IS NOT DISTINCT FROM f.repo AND m.path = f.path AND m.file_hash = f.file_hash)) SELECT f.repo, count(*) AS files, count(a.file_id) AS indexed, count(*) - count(a.file_id) AS skipped FROM source_files f LEFT JOIN again a USING (file_id) GROUP BY f.repo")
def index_summary(spark, sf_dir):
    files = read_table(spark, sf_dir, "source_files")
    again = S.changed_files(files, read_table(spark, sf_dir, "manifest")).select("file_id", F.lit(1).alias("again"))
    done = files.select("file_id", "repo").join(again, "file_id", "left").groupBy("repo").agg(F.count("*").alias("files"), F.count("again").alias("indexed"))
    return done.withColumn("skipped", F.col("files") - F.col("indexed"))


@query("SELECT model, count(*) AS points, count(dense) AS with_vector, count(DISTINCT chunk_id) AS chunks FROM vectors GROUP BY model")
def collection_info(spark, sf_dir):
    return read_table(spark, sf_dir, "vectors").groupBy("model").agg(F.count("*").alias("points"), F.count("dense").alias("with_vector"), F.countDistinct("chunk_id").alias("chunks"))


_CACHED = "SELECT substr(sha256(c.text), 1, 16) AS hash, min(v.chunk_id) AS source FROM vectors v JOIN chunks c ON c.chunk_id = v.chunk_id WHERE v.model = 'beacon-embed-96' AND v.dense IS NOT NULL AND c.text IS NOT NULL GROUP BY ALL"


@query(f"""WITH cached AS ({_CACHED}), own AS (SELECT DISTINCT chunk_id, text, substr(sha256(text), 1, 16) AS hash FROM chunks WHERE text IS NOT NULL),
todo AS (SELECT hash, min(text) AS text FROM own WHERE hash NOT IN (SELECT hash FROM cached) GROUP BY hash),
words AS (SELECT hash, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM todo)
SELECT chunk_id, hash, CASE WHEN cached.hash IS NOT NULL THEN 'cached' ELSE 'embedded' END AS origin, cached.source AS source, coalesce(words.n, 0) AS n_words FROM own LEFT JOIN cached USING (hash) LEFT JOIN words USING (hash)""")
def embed_batch(spark, sf_dir):
    """Every chunk with its vector's origin: the cache (under the hash of the text), or the embedder, which sees each missing text once.

    The vectors stay behind; n_words tells how many words the embedded text has."""
    chunks = read_table(spark, sf_dir, "chunks").select("chunk_id", "text")
    kept = read_table(spark, sf_dir, "vectors").where("model = 'beacon-embed-96' and dense is not null").select("chunk_id", F.col("dense").cast("array<double>").alias("vector"))
    done = S.embed_batch(chunks, kept, "chunk_id", "text", T.hashed_embedding)
    words = F.when(F.col("origin") == "embedded", F.size(T.tokens(F.col("text")))).otherwise(0).cast("bigint")
    return done.select("chunk_id", "hash", "origin", "source", words.alias("n_words")).distinct()


_HITS = "SELECT user_id, event_type, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 24 HOURS >= ts, false) AS hit FROM events"


def _hits(spark, sf_dir):
    return S.cache_hits(read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts")


@query(f"SELECT event_type, count(*) AS lookups, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM ({_HITS}) GROUP BY event_type")
def cache_stats(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(f"SELECT user_id, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM ({_HITS}) GROUP BY user_id")
def cache_hit_rate(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("user_id").agg(F.round(100.0 * F.count_if("hit") / F.count("*"), 6).alias("hit_rate"))


@query("SELECT user_id, last_access, bytes, sum(bytes) OVER w <= 4000 AND row_number() OVER w <= 100 AS keep FROM (SELECT user_id, max(ts) AS last_access, max(length(coalesce(props, ''))) AS bytes FROM events GROUP BY user_id) WINDOW w AS (ORDER BY last_access DESC, user_id)")
def cache_evict(spark, sf_dir):
    log = read_table(spark, sf_dir, "events").select("user_id", "ts", F.length(F.coalesce("props", F.lit(""))).cast("bigint").alias("size"))
    return S.cache_keep(log, "user_id", "ts", "size", 4000, 100)


@query("WITH b AS (SELECT round(quantile_cont(abs(x::DOUBLE), 0.99), 9) AS bound FROM (SELECT unnest(embedding) AS x FROM embeddings)), c AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) SELECT vec_id, i, greatest(-127, least(127, floor(x::DOUBLE / bound * 127 + 0.5)))::INTEGER AS code FROM c, b")
def quantize_int8(spark, sf_dir):
    codes = S.quantize_int8(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return codes.select("vec_id", F.posexplode("codes").alias("i", "code")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.col("code").cast("int").alias("code"))


_HEAD = r"^(#{1,6})\s+([^\n\r\x{2028}\x{2029}]+)\z"
_TRIM = r"^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$"
_SECTIONS = f"""SELECT doc_id, section, title, level, start_line, end_line, content FROM (SELECT doc_id, section, coalesce(max(CASE WHEN head THEN regexp_replace(regexp_extract(line_text, '{_HEAD}', 2), '{_TRIM}', '', 'g') END), '(document start)') AS title,
coalesce(max(CASE WHEN head THEN length(regexp_extract(line_text, '{_HEAD}', 1)) END), 0)::INTEGER AS level, min(line)::INTEGER AS start_line, max(line)::INTEGER AS end_line,
regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line_text END, chr(10) ORDER BY line), ''), '{_TRIM}', '', 'g') AS content
FROM (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line)::INTEGER AS section FROM (SELECT doc_id, line, line_text, regexp_matches(line_text, '{_HEAD}') AS head FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS line_text FROM documents WHERE text IS NOT NULL))) GROUP BY doc_id, section) WHERE content <> ''"""


@query(_SECTIONS)
def md_sections(spark, sf_dir):
    return M.sections(read_table(spark, sf_dir, "documents"), "doc_id")


@query(f"SELECT doc_id, section, CASE WHEN level > 0 THEN repeat('#', level) || ' ' || title || chr(10) || chr(10) ELSE '' END || content AS chunk FROM ({_SECTIONS})")
def md_section_chunks(spark, sf_dir):
    return M.with_header(M.sections(read_table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", "section", "chunk")


_HEADED = f"SELECT *, CASE WHEN level > 0 THEN repeat('#', level) || ' ' || title || chr(10) || chr(10) ELSE '' END AS header FROM ({_SECTIONS})"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)"


@query(f"""WITH RECURSIVE s AS ({_HEADED}), long AS (SELECT *, regexp_split_to_array(content, '\\n\\n+') AS ps FROM s WHERE length(header || content) > 1500),
f AS (SELECT doc_id, section, title, level, start_line, end_line, header, ps, 0 AS i, header AS text, 0 AS done, 0 AS offs, 0 AS went, NULL::VARCHAR AS out, 0 AS a, 0 AS b FROM long
UNION ALL SELECT doc_id, section, title, level, start_line, end_line, header, ps, i + 1, CASE WHEN is_full THEN header ELSE text END || p || chr(10) || chr(10), done + is_full::INT, CASE WHEN is_full THEN n ELSE offs + n + 1 END, CASE WHEN is_full THEN offs ELSE went END, CASE WHEN is_full THEN trim(text, {_BLANK}) END, start_line + went, start_line + went + offs
FROM (SELECT *, ps[i + 1] AS p, len(string_split(ps[i + 1], chr(10))) AS n, length(text) + length(ps[i + 1]) + 2 > 1500 AND length(text) > 100 AS is_full FROM f WHERE i < len(ps))),
parts AS (SELECT doc_id, section, title, level, done - 1 AS part, a AS start_line, b AS end_line, out AS chunk FROM f WHERE out IS NOT NULL UNION ALL SELECT doc_id, section, title, level, done, start_line + went, end_line, trim(text, {_BLANK}) FROM f WHERE i = len(ps) AND length(trim(text, {_BLANK})) > 100 UNION ALL SELECT doc_id, section, title, level, 0, start_line, end_line, header || content FROM s WHERE length(header || content) <= 1500)
SELECT doc_id, section, title, level, part::INTEGER AS part, CASE WHEN part > 0 THEN title || ' (cont.)' ELSE title END AS name, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, chunk FROM parts""")
def chunk_markdown(spark, sf_dir):
    return M.pack_paragraphs(M.sections(read_table(spark, sf_dir, "documents"), "doc_id"))


@query(f"""WITH s AS (SELECT *, header || content AS whole FROM ({_HEADED})), k AS (SELECT *, unnest(range(0, CASE WHEN length(whole) <= 1500 THEN 1 ELSE (greatest(0, floor((length(whole) - 450.0) / 1275)) + 1)::BIGINT END)) AS part FROM s)
SELECT doc_id, section, title, level, part::INTEGER AS part, CASE WHEN part > 0 THEN title || ' (cont.)' ELSE title END AS name, start_line, end_line, substr(whole, (part * 1275 + 1)::BIGINT, 1500) AS chunk FROM k""")
def chunk_markdown_by_size(spark, sf_dir):
    return M.split_sections(M.sections(read_table(spark, sf_dir, "documents"), "doc_id"))


_PARTS = f"""SELECT file_id, hash || '-' || start_line || '-' || symbol_name AS chunk_id, symbol_type, symbol_name, start_line, end_line, chunk FROM (SELECT file_id, hash, min(line)::INTEGER AS start_line, max(line)::INTEGER AS end_line, string_agg(content, chr(10) ORDER BY line) AS chunk, max(CASE WHEN head THEN content END) AS f,
CASE WHEN f IS NULL THEN '<module>' ELSE coalesce(nullif(regexp_extract(f, '{C.NAME}', 1), ''), '<anonymous>') END AS symbol_name,
CASE WHEN f IS NULL THEN 'module' WHEN regexp_matches(f, '\\b(?:function|def)\\b|=\\s*(?:async\\s*)?\\(') THEN 'function' WHEN regexp_matches(f, '\\bclass\\b') THEN 'class' WHEN regexp_matches(f, '\\b(?:interface|enum|type)\\b') THEN 'other' ELSE 'module' END AS symbol_type
FROM (SELECT *, sum(head::INT) OVER (PARTITION BY file_id ORDER BY line) AS part FROM (SELECT file_id, hash, line, content, regexp_matches(content, '^{C.BOUNDARY}') AS head FROM (SELECT file_id, substr(sha256(text), 1, 16) AS hash, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM source_files WHERE text IS NOT NULL AND NOT ends_with(path, '.md') AND NOT ends_with(path, '.json')))) GROUP BY file_id, hash, part) WHERE regexp_matches(chunk, '\\S')"""


def _code(spark, sf_dir):
    files = read_table(spark, sf_dir, "source_files")
    return C.chunk_code(files.where(~F.col("path").endswith(".md") & ~F.col("path").endswith(".json")))


@query(_PARTS)
def chunk_code(spark, sf_dir):
    return _code(spark, sf_dir)


@query(f"SELECT file_id, count(*) AS chunks, count(DISTINCT symbol_name) AS symbols, sum(length(chunk))::BIGINT AS chars FROM ({_PARTS}) GROUP BY file_id")
def index_single(spark, sf_dir):
    """What indexing a file yields."""
    return _code(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("chunks"), F.countDistinct("symbol_name").alias("symbols"), F.sum(F.length("chunk")).alias("chars"))


_METHOD_LINE = C.METHOD.replace(r"(?:\n|\z)", "$")
_KIND = "CASE WHEN regexp_matches({0}, '\\b(?:function|def)\\b|=\\s*(?:async\\s*)?\\(') THEN 'function' WHEN regexp_matches({0}, '\\bclass\\b') THEN 'class' WHEN regexp_matches({0}, '\\b(?:interface|enum|type)\\b') THEN 'other' ELSE 'module' END"


@query(f"""WITH src AS (SELECT file_id, text, substr(sha256(text), 1, 16) AS hash, array_to_string(regexp_extract_all(text, '{C.IMPORT.replace(chr(39), chr(39) * 2)}', 0), chr(10)) AS prefix FROM source_files WHERE text IS NOT NULL),
l AS (SELECT file_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM src),
t AS (SELECT *, sum(head::INT) OVER (PARTITION BY file_id ORDER BY line) AS part FROM (SELECT *, regexp_matches(content, '^{C.BOUNDARY}') AS head FROM l)),
tu AS (SELECT *, coalesce(min(line) FILTER (NOT (head OR content = '' OR regexp_matches(content, '^(?:\\s|[}}\\])])'))) OVER (PARTITION BY file_id, part), 1000000000) AS stop FROM t WHERE part > 0),
tl AS (SELECT *, max(line) FILTER (line < stop AND regexp_matches(content, '\\S')) OVER (PARTITION BY file_id, part) AS last FROM tu),
d AS (SELECT file_id, part, min(line) AS a, max(line) AS b, max(CASE WHEN head THEN content END) AS first, regexp_replace(string_agg(content, chr(10) ORDER BY line), '\\s+$', '') AS unit FROM tl WHERE line <= last GROUP BY file_id, part),
dn AS (SELECT file_id, a, b, {_KIND.format('first')} AS kind, coalesce(nullif(regexp_extract(first, '{C.NAME}', 1), ''), '<anonymous>') AS name, unit FROM d),
m AS (SELECT *, sum(head::INT) OVER (PARTITION BY file_id, a ORDER BY line) AS part FROM (SELECT dn.file_id, dn.a, tl.line, CASE WHEN tl.line = dn.b THEN regexp_replace(tl.content, '\\s+$', '') ELSE tl.content END AS content, regexp_matches(tl.content, '^(?:{_METHOD_LINE})') AS head FROM dn JOIN tl ON tl.file_id = dn.file_id AND tl.line BETWEEN dn.a AND dn.b WHERE kind = 'class')),
mu AS (SELECT *, coalesce(min(line) FILTER (NOT (head OR content = '' OR regexp_matches(content, '^(?:(?:  |\\t)(?:  )?[}}\\])]|(?:  |\\t)\\s)'))) OVER (PARTITION BY file_id, a, part), 1000000000) AS stop FROM m WHERE part > 0),
ml AS (SELECT *, max(line) FILTER (line < stop AND regexp_matches(content, '\\S')) OVER (PARTITION BY file_id, a, part) AS last FROM mu),
mn AS (SELECT file_id, min(line) AS a, max(line) AS b, max(CASE WHEN head THEN content END) AS first, regexp_replace(string_agg(content, chr(10) ORDER BY line), '\\s+$', '') AS unit FROM ml WHERE line <= last GROUP BY file_id, a, part),
u AS (SELECT file_id, a, b, kind, name, unit FROM dn UNION ALL SELECT file_id, a, b, 'method', coalesce(nullif(regexp_extract(first, '{C.METHOD_NAME}', 1), ''), '<anonymous>'), unit FROM mn WHERE NOT regexp_matches(first, '{C._NO_METHOD}')),
w AS (SELECT u.file_id, hash || '-' || a || '-' || name AS id, kind, name, a, b, CASE WHEN prefix <> '' THEN prefix || chr(10) || chr(10) || unit ELSE unit END AS whole FROM u JOIN src USING (file_id)),
k AS (SELECT *, unnest(range(0, CASE WHEN length(whole) <= 2000 THEN 1 ELSE (greatest(0, floor((length(whole) - 600.0) / 1700)) + 1)::BIGINT END)) AS part FROM w)
SELECT file_id, CASE WHEN length(whole) > 2000 THEN id || '-part' || part ELSE id END AS chunk_id, kind AS symbol_type, CASE WHEN length(whole) > 2000 THEN name || ' (part ' || (part + 1) || ')' ELSE name END AS symbol_name, a::INTEGER AS start_line, b::INTEGER AS end_line, substr(whole, (part * 1700 + 1)::BIGINT, 2000) AS chunk FROM k""")
def chunk_code_units(spark, sf_dir):
    """Declarations and methods as chunks, under the file's imports, large ones in parts."""
    return C.code_units(read_table(spark, sf_dir, "source_files"))
