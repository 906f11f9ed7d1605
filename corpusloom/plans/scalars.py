"""Queries of scalar text functions, filters and formatters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.paths import extension
from corpusloom.operators import code as C
from corpusloom.operators.retrieval import term_table, where_all
from corpusloom.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query(f"SELECT doc_id, len({_WORDS}) AS n_tokens, len(list_distinct({_WORDS})) AS n_terms FROM documents WHERE text IS NOT NULL")
def tokenize(spark, sf_dir):
    words = T.tokens(F.col("text"))
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_terms"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL")
def term_freq(spark, sf_dir):
    return term_table(read_table(spark, sf_dir, "documents"), "doc_id", "text")


_HASH = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(term, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296)"
_TERMS = f"SELECT DISTINCT unnest({_WORDS}) AS term FROM documents"
_HASHED = f"SELECT term, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::BIGINT AS hash FROM (SELECT term, {_HASH} AS h FROM ({_TERMS}))"


@query(f"SELECT term, hash, abs(hash) % 30000 AS bucket FROM ({_HASHED})")
def term_hash(spark, sf_dir):
    terms = read_table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", T.term_hash(F.col("term")).alias("hash")).withColumn("bucket", F.abs("hash") % T.BUCKETS)


@query(f"WITH h AS ({_HASHED}), t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL) SELECT doc_id, abs(hash) % 30000 AS idx, sum(tf)::BIGINT AS value FROM t JOIN h USING (term) GROUP BY ALL")
def sparse_vector(spark, sf_dir):
    """Long form of the hashed term vectors; terms that fall into one bucket are added up."""
    words = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    counted = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).withColumn("idx", T.bucket(F.col("term")))
    return counted.groupBy("doc_id", "idx").agg(F.sum("tf").alias("value"))


@query("SELECT file_id, substr(sha256(text), 1, 16) AS hash, substr(sha256(text), 1, 16) = file_hash AS same FROM source_files")
def content_hash(spark, sf_dir):
    h = T.content_hash(F.col("text"))
    return read_table(spark, sf_dir, "source_files").select("file_id", h.alias("hash"), (h == F.col("file_hash")).alias("same"))


@query("SELECT DISTINCT symbol_name, substr(regexp_replace(regexp_replace(regexp_replace(lower(symbol_name), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', ''), 1, 30) AS slug FROM chunks")
def slugify(spark, sf_dir):
    return read_table(spark, sf_dir, "chunks").select("symbol_name").distinct().withColumn("slug", T.slugify(F.col("symbol_name")))


_LANG = "CASE WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('ts', 'tsx', 'mts', 'cts') THEN 'typescript' END"


def _language(path):
    ext = extension(path)
    return F.when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript").when(ext.isin("ts", "tsx", "mts", "cts"), "typescript")


@query(f"SELECT file_id, {_LANG} AS detected FROM source_files")
def detect_language(spark, sf_dir):
    return read_table(spark, sf_dir, "source_files").select("file_id", _language(F.col("path")).alias("detected"))


@query(f"SELECT CASE WHEN {_LANG} IS NOT NULL THEN 'code' WHEN path LIKE '%.md' THEN 'markdown' ELSE 'skip' END AS handler, repo, count(*) AS files FROM source_files GROUP BY ALL")
def index_dispatch(spark, sf_dir):
    handler = F.when(_language(F.col("path")).isNotNull(), "code").when(F.col("path").endswith(".md"), "markdown").otherwise("skip")
    return read_table(spark, sf_dir, "source_files").groupBy(handler.alias("handler"), "repo").agg(F.count("*").alias("files"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT repo, count(*) AS chunks, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM chunks WHERE text IS NOT NULL GROUP BY repo")
def context_totals(spark, sf_dir):
    own = read_table(spark, sf_dir, "chunks").where("text is not null")
    return own.groupBy("repo").agg(F.count("*").alias("chunks"), F.sum(F.size(T.lines(F.col("text")))).alias("n_lines"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


_CUT = "CASE WHEN len(string_split(text, chr(10))) > {n} THEN array_to_string(string_split(text, chr(10))[1:{n}], chr(10)) || chr(10) || '... (truncated, ' || (len(string_split(text, chr(10))) - {n}) || ' more lines)' ELSE text END"


@query(f"SELECT doc_id, {_CUT.format(n=5)} AS head FROM documents")
def truncate_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.truncate_lines(F.col("text"), 5).alias("head"))


_CHUNK = "SELECT DISTINCT chunk_id, repo, path, language, symbol_name, start_line, coalesce(end_line, start_line) AS end_line, text FROM chunks WHERE text IS NOT NULL AND path IS NOT NULL"
_SCORE = "(length(text) % 101) / 100.0::DOUBLE"
_PLACE = "path || ':' || start_line || '-' || end_line"
_TEXT = f"'### ' || {_PLACE} || chr(10) || '```' || coalesce(language, '') || chr(10) || {_CUT.format(n=50)} || chr(10) || '```' || chr(10) || '*Relevance: ' || floor({_SCORE} * 100 + 0.5)::INTEGER || '%*'"
_PLAIN = f"'--- ' || {_PLACE} || ' ---' || chr(10) || {_CUT.format(n=50)} || chr(10) || '[Relevance: ' || floor({_SCORE} * 100 + 0.5)::INTEGER || '%]'"


def _scored_chunks(spark, sf_dir):
    """Distinct chunks with a relevance made from the length of their text."""
    end = F.coalesce("end_line", "start_line").alias("end_line")
    own = read_table(spark, sf_dir, "chunks").where("text is not null and path is not null").select("chunk_id", "repo", "path", "language", "symbol_name", "start_line", end, "text").distinct()
    return own.withColumn("score", (F.length("text") % 101 / 100.0).cast("double"))


@query(f"SELECT DISTINCT chunk_id, repo, path, start_line, {_TEXT} AS formatted, {_PLAIN} AS plain FROM ({_CHUNK})")
def format_chunk(spark, sf_dir):
    """A chunk under a header with its place, as Markdown and as plain text, with its relevance."""
    formats = [T.format_chunk(*[F.col(c) for c in ("path", "start_line", "end_line", "language", "text", "score")], markdown=m) for m in (True, False)]
    return _scored_chunks(spark, sf_dir).select("chunk_id", "repo", "path", "start_line", formats[0].alias("formatted"), formats[1].alias("plain")).distinct()


@query(f"SELECT repo, path, string_agg(formatted, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT repo, path, {_TEXT} AS formatted, row_number() OVER (PARTITION BY repo, path ORDER BY start_line, chunk_id, text, language, symbol_name, end_line) AS n FROM ({_CHUNK}) QUALIFY n <= 5) GROUP BY repo, path")
def format_context(spark, sf_dir):
    """The first five chunks of each file as one context."""
    order = Window.partitionBy("repo", "path").orderBy("start_line", "chunk_id", "text", F.col("language").asc_nulls_last(), F.col("symbol_name").asc_nulls_last(), "end_line")
    some = _scored_chunks(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 5")
    one = T.format_chunk(*[F.col(c) for c in ("path", "start_line", "end_line", "language", "text", "score")])
    return some.groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("f")))), lambda x: x["f"]), "\n\n---\n\n").alias("context"))


_TOP = f"SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY repo, path ORDER BY {_SCORE} DESC, chunk_id, text, language, symbol_name, end_line) AS n, count(*) OVER (PARTITION BY repo, path) AS c, sum(len(string_split(text, chr(10)))) OVER (PARTITION BY repo, path) AS total FROM ({_CHUNK})"


def _top_chunks(spark, sf_dir, most):
    """The most relevant chunks of each file, with the number of all and of their lines."""
    order = Window.partitionBy("repo", "path").orderBy(F.col("score").desc(), "chunk_id", "text", F.col("language").asc_nulls_last(), F.col("symbol_name").asc_nulls_last(), "end_line")
    own = _scored_chunks(spark, sf_dir)
    totals = own.groupBy(F.col("repo").alias("r"), F.col("path").alias("p")).agg(F.count("*").alias("c"), F.sum(F.size(T.lines(F.col("text")))).alias("total"))
    best = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return best.join(totals, F.col("repo").eqNullSafe(F.col("r")) & (F.col("path") == F.col("p"))).drop("r", "p")


def _listed(line):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n")


@query(f"SELECT repo, path, any_value(c) || ' chunk(s):' || chr(10) || string_agg('  ' || n || '. ' || {_PLACE} || coalesce(' - ' || nullif(symbol_name, ''), '') || ' (' || floor(score * 100 + 0.5)::INTEGER || '%)', chr(10) ORDER BY n) || CASE WHEN any_value(c) > 5 THEN chr(10) || '  ... and ' || (any_value(c) - 5) || ' more' ELSE '' END AS summary FROM ({_TOP}) WHERE n <= 5 GROUP BY repo, path")
def summarize_chunks(spark, sf_dir):
    """How many chunks a file has, and the five most relevant ones with place, symbol and relevance."""
    symbol = F.coalesce(F.concat(F.lit(" - "), F.nullif(F.col("symbol_name"), F.lit(""))), F.lit(""))
    line = F.concat(F.lit("  "), F.col("n").cast("string"), F.lit(". "), T.place(F.col("path"), F.col("start_line"), F.col("end_line")), symbol, F.lit(" ("), T.percent(F.col("score")), F.lit(")"))
    by = _top_chunks(spark, sf_dir, 5).groupBy("repo", "path").agg(F.max("c").alias("c"), _listed(line).alias("listed"))
    more = F.when(F.col("c") > 5, F.concat(F.lit("\n  ... and "), (F.col("c") - 5).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return by.select("repo", "path", F.concat(F.col("c").cast("string"), F.lit(" chunk(s):\n"), "listed", more).alias("summary"))


@query(f"SELECT repo, path, 'Context: ' || any_value(c) || ' chunks retrieved' || chr(10) || 'Total lines: ' || any_value(total) || chr(10) || chr(10) || 'Available chunks:' || chr(10) || string_agg('  [' || chunk_id || '] ' || {_PLACE} || ' (' || coalesce(symbol_name, '') || ', score: ' || printf('%.2f', score) || ')', chr(10) ORDER BY n) AS summary FROM ({_TOP}) WHERE n <= 20 GROUP BY repo, path")
def context_summary(spark, sf_dir):
    """What a context holds, without its text: totals, and a line for each of the 20 most relevant chunks of a file."""
    line = F.concat(F.lit("  ["), "chunk_id", F.lit("] "), T.place(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit(" ("), F.coalesce("symbol_name", F.lit("")), F.lit(", score: "), F.format_string("%.2f", "score"), F.lit(")"))
    by = _top_chunks(spark, sf_dir, 20).groupBy("repo", "path").agg(F.max("c").alias("c"), F.max("total").alias("total"), _listed(line).alias("listed"))
    return by.select("repo", "path", F.concat(F.lit("Context: "), F.col("c").cast("string"), F.lit(" chunks retrieved\nTotal lines: "), F.col("total").cast("string"), F.lit("\n\nAvailable chunks:\n"), "listed").alias("summary"))


_FULL = f"SELECT repo, path, string_agg('--- ' || chunk_id || ' (' || path || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS whole FROM ({_TOP}) WHERE n <= 5 GROUP BY repo, path"


@query(f"SELECT repo, path, md5(whole) AS whole, array_to_string(string_split(whole, chr(10))[3:7], chr(10)) AS peek FROM ({_FULL})")
def full_context(spark, sf_dir):
    """The whole text of a context (as a hash), and its lines 2 to 6."""
    one = F.concat(F.lit("--- "), "chunk_id", F.lit(" ("), "path", F.lit(") ---\n"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"]), "\n\n")
    by = _top_chunks(spark, sf_dir, 5).groupBy("repo", "path").agg(joined.alias("t"))
    return by.select("repo", "path", F.md5("t").alias("whole"), F.array_join(F.slice(T.lines(F.col("t")), 3, 5), "\n").alias("peek"))


@query("SELECT doc_id, line, string_split(text, chr(10))[line + 1] AS content FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents) WHERE regexp_matches(content, '(?i)fallback|falls back') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) <= 20")
def search_context(spark, sf_dir):
    """Lines that match a regular expression in any case, at most 20 a document, in order."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line", "content")).where(F.col("content").rlike("(?i)fallback|falls back"))
    return rows.withColumn("line", F.col("line").cast("bigint")).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).where("n <= 20").drop("n")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[3:7], chr(10)) AS peek FROM documents WHERE text IS NOT NULL")
def peek_context(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(T.lines(F.col("text")), 3, 5), "\n").alias("peek"))


@query("SELECT DISTINCT chunk_id, path, language, symbol_type FROM chunks WHERE language = 'typescript' AND symbol_type = 'method' AND contains(path, 'src/')")
def filter_chunks(spark, sf_dir):
    own = read_table(spark, sf_dir, "chunks")
    return where_all(own, language="typescript", symbol_type="method", path="src/").select("chunk_id", "path", "language", "symbol_type").distinct()


@query("SELECT DISTINCT chunk_id, path, contains(path, 'lib/') AS anywhere, starts_with(path, 'lib/') AS prefix FROM chunks WHERE contains(path, 'lib/')")
def filter_path(spark, sf_dir):
    path = F.col("path")
    return read_table(spark, sf_dir, "chunks").where(path.contains("lib/")).select("chunk_id", "path", path.contains("lib/").alias("anywhere"), path.startswith("lib/").alias("prefix")).distinct()


@query("SELECT repo, chunk_id FROM (SELECT DISTINCT repo, chunk_id FROM chunks WHERE symbol_type = 'class') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY chunk_id) <= 100")
def search_by_metadata(spark, sf_dir):
    own = where_all(read_table(spark, sf_dir, "chunks"), symbol_type="class").select("repo", "chunk_id").distinct()
    return own.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("chunk_id"))).where("n <= 100").drop("n")


@query("SELECT DISTINCT chunk_id, coalesce(path, '') AS path, coalesce(language, '') AS language, coalesce(nullif(symbol_type, ''), 'other') AS symbol_type, coalesce(symbol_name, '') AS symbol_name, coalesce(end_line, 0) AS end_line FROM chunks")
def payload_to_chunk(spark, sf_dir):
    blank = F.lit("")
    return read_table(spark, sf_dir, "chunks").select(
        "chunk_id", F.coalesce("path", blank).alias("path"), F.coalesce("language", blank).alias("language"), F.coalesce(F.nullif(F.col("symbol_type"), blank), F.lit("other")).alias("symbol_type"),
        F.coalesce("symbol_name", blank).alias("symbol_name"), F.coalesce("end_line", F.lit(0)).alias("end_line"),
    ).distinct()


@query("SELECT chunk_id, repo, path, start_line, end_line, len(string_split(text, chr(10))) AS n FROM (SELECT DISTINCT chunk_id, repo, path, start_line, end_line, text FROM chunks) WHERE end_line - start_line + 1 = len(string_split(text, chr(10)))")
def zip_lines(spark, sf_dir):
    """Chunks whose line numbers agree with their text."""
    n = F.size(T.lines(F.col("text")))
    own = read_table(spark, sf_dir, "chunks").select("chunk_id", "repo", "path", "start_line", "end_line", "text").distinct()
    return own.where(F.col("end_line") - F.col("start_line") + 1 == n).select("chunk_id", "repo", "path", "start_line", "end_line", n.cast("bigint").alias("n"))


_SENT = "regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g')"
_CLAIMS = f"SELECT doc_id, k AS raw, trim(parts[k + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)) AS claim FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS k FROM (SELECT doc_id, string_split({_SENT}, chr(1)) AS parts FROM documents WHERE text IS NOT NULL))"


def _claims(spark, sf_dir):
    own = read_table(spark, sf_dir, "documents").where("text is not null")
    return own.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("raw", "claim")).withColumn("claim", T.trim_blank(F.col("claim")))


def _trimmed(text):
    return F.transform(T.sentences(text), T.trim_blank)


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS pos, claim FROM ({_CLAIMS}) WHERE length(claim) > 10")
def extract_claims(spark, sf_dir):
    """Sentences of more than 10 characters, numbered in the row."""
    long = F.filter(_trimmed(F.col("text")), lambda c: F.length(c) > 10)
    own = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(long).alias("pos", "claim"))
    return own.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "claim")


@query(f"SELECT doc_id, raw AS pos, claim, trim(concat_ws(' ', before, after)) AS context FROM (SELECT *, lag(claim) OVER w AS before, lead(claim) OVER w AS after FROM ({_CLAIMS}) WINDOW w AS (PARTITION BY doc_id ORDER BY raw)) WHERE length(claim) >= 10")
def atomic_claims(spark, sf_dir):
    """Sentences of at least 10 characters with their neighbours as context; positions are those of the sentences."""
    near = lambda x: F.transform(x, lambda c, i: F.struct(i.cast("bigint").alias("pos"), c.alias("claim"), F.trim(F.concat_ws(" ", F.get(x, i - 1), F.get(x, i + 1))).alias("context")))
    claims = F.filter(T.bound(_trimmed(F.col("text")), near), lambda c: F.length(c["claim"]) >= 10)
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.inline(claims))


@query(f"SELECT doc_id, raw AS pos, claim FROM ({_CLAIMS}) WHERE length(claim) >= 10 AND NOT (claim LIKE '%?' OR regexp_matches(claim, '{T.OPINION}') OR regexp_matches(claim, '{T.META.replace(chr(39), chr(39) * 2)}'))")
def verifiable_claims(spark, sf_dir):
    return _claims(spark, sf_dir).where((F.length("claim") >= 10) & T.is_verifiable(F.col("claim"))).select("doc_id", F.col("raw").cast("bigint").alias("pos"), "claim")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_KEYS = f"list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


@query(f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_KEYS}) AS word FROM documents) GROUP BY ALL")
def extract_keywords(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.explode(T.keywords(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def _split_sql(table, id_col, size, ratio, where, last="floor((length(text) - 0.3 * {size}) / {step})"):
    ov = int(size * ratio)
    step = size - ov
    return f"SELECT {id_col}, k AS part, substr(text, (k * {step} + 1)::BIGINT, {size}) AS piece FROM (SELECT {id_col}, text, unnest(range(0, (greatest(0, {last.format(size=size, step=step)}) + 1)::BIGINT)) AS k FROM {table} WHERE {where})"


def _split(df, id_col, size, ratio, whole=False):
    starts = T.split_positions(F.length("text"), size, ratio, whole)
    rows = df.select(id_col, "text", F.posexplode(starts).alias("part", "start"))
    return rows.select(id_col, F.col("part").cast("bigint").alias("part"), F.expr(f"substring(text, start + 1, {size})").alias("piece"))


@query(_split_sql("documents", "doc_id", 1500, 0.15, "length(text) > 1500"))
def split_by_size(spark, sf_dir):
    return _split(read_table(spark, sf_dir, "documents").where("length(text) > 1500"), "doc_id", 1500, 0.15)


@query("SELECT chunk_id || '-part' || part AS part_id, coalesce(symbol_name, '') || ' (part ' || (part + 1) || ')' AS name, part, piece FROM (" + _split_sql("(SELECT DISTINCT chunk_id, symbol_name, text FROM chunks)", "chunk_id, symbol_name", 2000, 0.15, "length(text) > 2000") + ")")
def split_large_code(spark, sf_dir):
    """Parts of large chunks under ids and names of their own."""
    own = read_table(spark, sf_dir, "chunks").where("length(text) > 2000").select("chunk_id", "symbol_name", "text").distinct().withColumn("chunk", F.struct("chunk_id", "symbol_name"))
    parts = _split(own, "chunk", 2000, 0.15)
    part = F.col("part").cast("string")
    name = F.concat(F.coalesce("chunk.symbol_name", F.lit("")), F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))
    return parts.select(F.concat("chunk.chunk_id", F.lit("-part"), part).alias("part_id"), name.alias("name"), "part", "piece")


@query(_split_sql("documents", "doc_id", 1500, 0.15, "length(text) > 1500", "ceil((length(text) - {size}) / {step})"))
def split_whole_documents(spark, sf_dir):
    """As split_by_size, with a last piece where the end of a text would be in none."""
    return _split(read_table(spark, sf_dir, "documents").where("length(text) > 1500"), "doc_id", 1500, 0.15, whole=True)


@query(_split_sql("(SELECT DISTINCT chunk_id, text FROM chunks)", "chunk_id", 2000, 0.15, "length(text) > 2000", "ceil((length(text) - {size}) / {step})"))
def split_whole_code(spark, sf_dir):
    """As split_large_code, with a last piece where the end of a text would be in none."""
    return _split(read_table(spark, sf_dir, "chunks").where("length(text) > 2000").select("chunk_id", "text").distinct(), "chunk_id", 2000, 0.15, whole=True)


@query(f"SELECT file_id, k AS place, list[k + 1] AS import_text FROM (SELECT file_id, list, unnest(range(0, len(list))) AS k FROM (SELECT file_id, regexp_extract_all(text, '{C.IMPORT.replace(chr(39), chr(39) * 2)}', 0) AS list FROM source_files WHERE path NOT LIKE '%.py'))")
def collect_imports(spark, sf_dir):
    """Whole import statements, over several lines or one, in order."""
    own = read_table(spark, sf_dir, "source_files").where("path not like '%.py'")
    found = own.select("file_id", F.posexplode(F.regexp_extract_all("text", F.lit(C.IMPORT), 0)).alias("place", "import_text"))
    return found.withColumn("place", F.col("place").cast("bigint"))
