"""Queries over what a corpus holds and how its parts depend on one another: plans, modules, artifacts, references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.scans import _EXPORT, _PATTERNS, _STEM, _STEM_SQL, antipattern_scan
from corpusloom.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_LISTED = r"\.(?:[cm]?[jt]sx?|md)$"
_SKIPPED = r"(?:^|/)(?:node_modules|dist|\.[^/]*)(?:/|$)"


@query(f"SELECT file_id, path FROM source_files WHERE regexp_matches(path, '{_LISTED}') AND NOT regexp_matches(path, '{_SKIPPED}')")
def scan_files(spark, sf_dir):
    """Files that an index takes in: by ending, without built, installed and hidden ones."""
    path = F.col("path")
    return read_table(spark, sf_dir, "source_files").where(path.rlike(_LISTED) & ~path.rlike(_SKIPPED)).select("file_id", "path")


_PLANS = "SELECT doc_id, repo, source, nullif(regexp_extract(text, '(?m)^phase: *(.*)$', 1), '') AS phase, nullif(regexp_extract(text, '(?m)^plan: *(.*)$', 1), '') AS plan, nullif(regexp_extract(text, '(?m)^wave: *(.*)$', 1), '') AS wave, text FROM documents WHERE starts_with(text, '---' || chr(10))"


def _plans(spark, sf_dir):
    own = read_table(spark, sf_dir, "documents").where(F.col("text").startswith("---\n"))
    return own.select("doc_id", "repo", F.lower(F.trim("source")).alias("source"), *[F.nullif(F.regexp_extract("text", rf"(?m)^{k}: *([^\n\r]*)$", 1), F.lit("")).alias(k) for k in ("phase", "plan", "wave")], "text")


@query(f"WITH p AS ({_PLANS}), s AS (SELECT DISTINCT phase, plan FROM p WHERE lower(trim(source)) = 'summaries' AND phase IS NOT NULL AND plan IS NOT NULL) SELECT doc_id, p.phase, p.plan, p.wave, s.phase IS NOT NULL AS done FROM p LEFT JOIN s ON p.phase = s.phase AND p.plan = s.plan WHERE lower(trim(source)) = 'plans'")
def plan_inventory(spark, sf_dir):
    """Plans with their phase and wave, and whether a summary of the same phase and plan exists."""
    own = _plans(spark, sf_dir)
    done = own.where("source = 'summaries'").select("phase", "plan").distinct().dropna().withColumn("done", F.lit(True))
    return own.where("source = 'plans'").join(done, ["phase", "plan"], "left").select("doc_id", "phase", "plan", "wave", F.coalesce("done", F.lit(False)).alias("done"))


@query(f"WITH p AS ({_PLANS}), d AS (SELECT DISTINCT doc_id, unnest(list_filter(list_transform(string_split(regexp_extract(text, '(?m)^depends_on: *\\[([^\\]\\n]*)\\]', 1), ','), lambda x: trim(x)), lambda x: x <> '')) AS needs FROM p), x AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_EXPORT}', 1)) AS symbol FROM source_files) SELECT doc_id, needs, symbol IS NOT NULL AS known FROM d LEFT JOIN x ON symbol = needs")
def plan_dependencies(spark, sf_dir):
    """What each plan depends on, and whether some source file exports it."""
    needs = F.filter(F.transform(F.split(F.regexp_extract("text", r"(?m)^depends_on: *\[([^\]\n]*)\]", 1), ","), F.trim), lambda x: x != "")
    wanted = _plans(spark, sf_dir).select("doc_id", F.explode(needs).alias("needs")).distinct()
    exported = read_table(spark, sf_dir, "source_files").select(F.explode(F.regexp_extract_all("text", F.lit(_EXPORT), 1)).alias("needs")).distinct().withColumn("known", F.lit(True))
    return wanted.join(exported, "needs", "left").select("doc_id", "needs", F.coalesce("known", F.lit(False)).alias("known"))


_REQUIREMENT = r"\b(RQ-\d+)\b"
_NAMED = f"SELECT DISTINCT doc_id, lower(trim(source)) AS source, unnest(regexp_extract_all(text, '{_REQUIREMENT}', 1)) AS requirement FROM documents"


def _requirements(spark, sf_dir):
    own = read_table(spark, sf_dir, "documents")
    return own.select("doc_id", F.lower(F.trim("source")).alias("source"), F.explode(F.regexp_extract_all("text", F.lit(_REQUIREMENT), 1)).alias("requirement")).distinct()


@query(f"SELECT requirement, count(*) AS documents FROM ({_NAMED}) GROUP BY requirement HAVING count(*) FILTER (source = 'plans') = 0")
def orphan_requirements(spark, sf_dir):
    """Requirements that no plan names."""
    return _requirements(spark, sf_dir).groupBy("requirement").agg(F.count("*").alias("documents"), F.count_if(F.col("source") == "plans").alias("plans")).where("plans = 0").drop("plans")


@query(f"SELECT requirement, count(*) AS plans, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({_NAMED}) WHERE source = 'plans' GROUP BY requirement HAVING count(*) > 1")
def duplicate_requirements(spark, sf_dir):
    """Requirements that several plans name."""
    named = _requirements(spark, sf_dir).where("source = 'plans'").groupBy("requirement")
    return named.agg(F.count("*").alias("plans"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("plans > 1")


_EDGES = f"""x AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(text, '{_EXPORT}', 1)) AS symbol FROM source_files WHERE path IS NOT NULL), i AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(text, '[A-Za-z_]\\w+', 0)) AS symbol FROM source_files WHERE path IS NOT NULL),
s AS (SELECT symbol, min(path) AS lo, max(path) AS hi FROM x GROUP BY ALL), hit AS (SELECT i.repo, i.symbol, i.path FROM i JOIN s ON s.symbol = i.symbol WHERE NOT (lo = hi AND lo = i.path))"""


def _impacted(spark, sf_dir):
    """(repo, symbol, path): files that name a symbol which another path exports.

    Exporters are folded to their smallest and largest path, so no pair of files is ever built.
    """
    files = read_table(spark, sf_dir, "source_files").where("path is not null").select("repo", "path", "text")
    exports = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(_EXPORT), 1)).alias("symbol")).groupBy("symbol").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    named = files.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w+"), 0))).alias("symbol")).distinct()
    return named.join(exports, "symbol").where("not (lo = hi and lo = path)").select("repo", "symbol", "path")


@query(f"WITH {_EDGES} SELECT repo, symbol, count(*) AS files FROM hit GROUP BY ALL")
def impact_scan(spark, sf_dir):
    """How many files a change of an exported symbol touches."""
    return _impacted(spark, sf_dir).groupBy("repo", "symbol").agg(F.count("*").alias("files"))


_TEST = r"\.(?:test|spec)\.|^test/"


@query(f"WITH {_EDGES} SELECT DISTINCT repo, path FROM hit WHERE regexp_matches(path, '{_TEST}')")
def affected_tests(spark, sf_dir):
    """Tests among the files that changes of exported symbols touch."""
    return _impacted(spark, sf_dir).where(F.col("path").rlike(_TEST)).select("repo", "path").distinct()


_CITED_PATH = r"`([\w./-]+\.[a-z]+)`"


@query(f"""WITH m AS (SELECT DISTINCT path, regexp_extract(path, '([\\w-]+)\\.[^/]*$', 1) AS stem FROM source_files WHERE path IS NOT NULL), i AS (SELECT DISTINCT path AS user_path, unnest(regexp_extract_all(text, '{_STEM_SQL}', 1)) AS stem FROM source_files), n AS (SELECT stem, count(DISTINCT user_path) AS users FROM i GROUP BY stem)
SELECT path, coalesce(users, 0) AS users, CASE WHEN users > 0 THEN 'CONSUMED' ELSE 'ORPHANED' END AS status FROM m LEFT JOIN n USING (stem)""")
def route_consumption(spark, sf_dir):
    """Modules by how many files import from a module of that name."""
    files = read_table(spark, sf_dir, "source_files").select("path", "text")
    modules = files.where("path is not null").select("path", F.regexp_extract("path", r"([\w-]+)\.[^/]*$", 1).alias("stem")).distinct()
    used = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(_STEM), 1)).alias("stem")).groupBy("stem").agg(F.countDistinct("path").alias("users"))
    n = F.coalesce("users", F.lit(0))
    return modules.join(used, "stem", "left").select("path", n.cast("bigint").alias("users"), F.when(n > 0, "CONSUMED").otherwise("ORPHANED").alias("status"))


_STUB = r"(?i)\b(?:TODO|FIXME|placeholder|not implemented)\b"
_EXPORTS = r"(?m)^(?:export\b|module\.exports|def |class )"


@query(f"""WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_CITED_PATH}', 1)) AS path FROM documents), f AS (SELECT path, max(len(string_split(text, chr(10))))::BIGINT AS n_lines, bool_or(regexp_matches(text, '{_STUB}')) AS stub, bool_or(regexp_matches(text, '{_EXPORTS}')) AS exports FROM source_files WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY path)
SELECT doc_id, c.path, CASE WHEN f.path IS NULL THEN 'MISSING' WHEN n_lines < 10 OR stub OR NOT exports THEN 'STUB' ELSE 'SUBSTANTIVE' END AS status FROM c LEFT JOIN f ON f.path = c.path""")
def artifact_status(spark, sf_dir):
    """Whether what a document cites exists and has substance: ten lines, no stub marks, something exported."""
    cited = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_CITED_PATH), 1)).alias("path")).distinct()
    text = F.col("text")
    found = read_table(spark, sf_dir, "source_files").where("path is not null and text is not null").groupBy("path").agg(F.max(F.size(F.split(text, "\n", -1))).alias("n_lines"), F.bool_or(text.rlike(_STUB)).alias("stub"), F.bool_or(text.rlike(_EXPORTS)).alias("exports"))
    status = F.when(F.col("n_lines").isNull(), "MISSING").when((F.col("n_lines") < 10) | F.col("stub") | ~F.col("exports"), "STUB").otherwise("SUBSTANTIVE")
    return cited.join(found, "path", "left").select("doc_id", "path", status.alias("status"))


_GUARDS = (("checked", r"(?i)\b(?:authori[sz]e|requireAuth|isAuthenticated|session\.user)\b"), ("redirected", r"(?i)\b(?:redirect|throw new Error)\b"))


@query("SELECT file_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in _GUARDS) + ", CASE WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for _, p in _GUARDS) + " THEN 'PROTECTED' ELSE 'UNPROTECTED' END AS status FROM source_files WHERE text IS NOT NULL")
def auth_protection(spark, sf_dir):
    """Files by whether they hold a guard of either kind."""
    marks = [F.col("text").rlike(p).alias(n) for n, p in _GUARDS]
    return read_table(spark, sf_dir, "source_files").where("text is not null").select("file_id", *marks).withColumn("status", F.when(F.col("checked") | F.col("redirected"), "PROTECTED").otherwise("UNPROTECTED"))


_STEPS = (("defines", r"(?m)^export (?:async )?function "), ("awaits", r"\bawait \w+\("), ("fails", r"throw new Error"), ("logs", r"console\.(?:log|debug)\("))


@query("SELECT repo, " + ", ".join(f"min(path) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p in _STEPS) + ", " + " + ".join(f"(count(*) FILTER (regexp_matches(text, '{p}')) > 0)::INTEGER" for _, p in _STEPS) + " AS reached FROM source_files WHERE text IS NOT NULL GROUP BY repo")
def flow_steps(spark, sf_dir):
    """The first file of each step of a flow in every repository, and how many steps there are."""
    firsts = [F.min(F.when(F.col("text").rlike(p), F.col("path"))).alias(n) for n, p in _STEPS]
    reached = [F.max(F.col("text").rlike(p).cast("int")) for _, p in _STEPS]
    return read_table(spark, sf_dir, "source_files").where("text is not null").groupBy("repo").agg(*firsts, (reached[0] + reached[1] + reached[2] + reached[3]).alias("reached"))


_HITS = "WITH l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS content FROM source_files WHERE text IS NOT NULL), h AS (" + " UNION ALL ".join(f"SELECT file_id, '{level}' AS severity FROM l WHERE regexp_matches(content, '{pattern}')" for _, pattern, level in _PATTERNS) + "), f AS (SELECT file_id, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'warning') AS warnings FROM h GROUP BY file_id)"


@query(_HITS + " SELECT file_id, coalesce(blockers, 0) AS blockers, coalesce(warnings, 0) AS warnings, coalesce(blockers, 0) = 0 AS passed FROM source_files LEFT JOIN f USING (file_id)")
def check_rollup(spark, sf_dir):
    """Every file with its findings; it passes if none of them blocks."""
    found = antipattern_scan(spark, sf_dir).groupBy("file_id").agg(F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    files = read_table(spark, sf_dir, "source_files").select("file_id").join(found, "file_id", "left").fillna(0)
    return files.withColumn("passed", F.col("blockers") == 0)


@query(_HITS + " SELECT repo, count(*) AS files, count(*) FILTER (coalesce(blockers, 0) = 0) AS passed, CASE WHEN count(*) FILTER (blockers > 0) > 0 THEN 'gaps_found' WHEN count(*) FILTER (warnings > 0) > 0 THEN 'human_needed' ELSE 'passed' END AS status FROM source_files LEFT JOIN f USING (file_id) GROUP BY repo")
def verification_status(spark, sf_dir):
    """Repositories by the worst finding in their files."""
    repos = read_table(spark, sf_dir, "source_files").select("file_id", "repo").join(check_rollup(spark, sf_dir), "file_id")
    by = repos.groupBy("repo").agg(F.count("*").alias("files"), F.count_if("passed").alias("passed"), F.max(F.col("warnings") > 0).alias("warned"))
    status = F.when(F.col("passed") < F.col("files"), "gaps_found").when(F.col("warned"), "human_needed").otherwise("passed")
    return by.select("repo", "files", "passed", status.alias("status"))


@query("SELECT user_id, max(ts) AS latest, max_by(value, (ts, event_id)) AS used, repeat('#', least(10, floor(max_by(value, (ts, event_id)) / 10))::INTEGER) AS bar, CASE WHEN max_by(value, (ts, event_id)) < 50 THEN 'low' WHEN max_by(value, (ts, event_id)) < 65 THEN 'middle' WHEN max_by(value, (ts, event_id)) < 80 THEN 'high' ELSE 'full' END AS band FROM events WHERE value >= 0 GROUP BY user_id")
def usage_bands(spark, sf_dir):
    """The latest value of each user as a bar of ten and a band."""
    last = read_table(spark, sf_dir, "events").where("value >= 0").groupBy("user_id").agg(F.max("ts").alias("latest"), F.max_by("value", F.struct("ts", "event_id")).alias("used"))
    v = F.col("used")
    return last.withColumn("bar", F.repeat(F.lit("#"), F.least(F.lit(10), F.floor(v / 10)).cast("int"))).withColumn("band", F.when(v < 50, "low").when(v < 65, "middle").when(v < 80, "high").otherwise("full"))


_ITEMS = "SELECT doc_id, repo, created_at, line, substr(content, 7) AS item FROM (SELECT doc_id, repo, created_at, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL) WHERE starts_with(content, '- [ ] ')"
_NOW = "2026-01-01 00:00:00"


def _items(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "repo", "created_at", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    return rows.where(F.col("content").startswith("- [ ] ")).select("doc_id", "repo", "created_at", F.col("line").cast("bigint").alias("line"), F.expr("substring(content, 7)").alias("item"))


@query(f"SELECT doc_id, repo, line, item, date_diff('day', created_at::DATE, DATE '2026-01-01') AS age_days, row_number() OVER (PARTITION BY repo ORDER BY created_at, doc_id, line) AS place FROM ({_ITEMS}) QUALIFY place <= 50")
def todo_list(spark, sf_dir):
    """The 50 oldest open items of each repository, with their age on a stated day."""
    order = Window.partitionBy("repo").orderBy(F.col("created_at").asc_nulls_last(), "doc_id", "line")
    age = F.date_diff(F.to_date(F.lit(_NOW)), F.to_date("created_at")).cast("bigint")
    return _items(spark, sf_dir).select("doc_id", "repo", "line", "item", age.alias("age_days"), F.row_number().over(order).cast("bigint").alias("place")).where("place <= 50")


_TODO_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(item), '[a-z0-9_]+'), lambda w: length(w) > 8))"


@query(f"WITH i AS (SELECT doc_id, repo, line, {_TODO_WORDS} AS ws FROM ({_ITEMS})), w AS (SELECT doc_id, repo, line, unnest(ws) AS w FROM i), k AS (SELECT repo, w, min((doc_id, line)) AS first, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1) SELECT w.doc_id, w.line, count(*) AS shared_words, min(first)[1] AS first_id FROM w JOIN k ON k.repo IS NOT DISTINCT FROM w.repo AND k.w = w.w AND (w.doc_id, w.line) <> k.first GROUP BY ALL")
def todo_duplicates(spark, sf_dir):
    """Open items whose long words an earlier item of the repository holds too: how many of them, and the first document that does.

    Each word is linked to its first item only, so no pair of items is built.
    """
    words = F.array_distinct(F.filter(T.tokens(F.col("item")), lambda w: F.length(w) > 8))
    own = _items(spark, sf_dir).select("repo", F.struct("doc_id", "line").alias("at"), F.explode(words).alias("w"))
    firsts = own.groupBy(F.col("repo").alias("r"), F.col("w").alias("v")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = own.join(firsts, F.col("repo").eqNullSafe(F.col("r")) & (F.col("w") == F.col("v"))).where("at <> first")
    return met.groupBy("at").agg(F.count("*").alias("shared_words"), F.min("first.doc_id").alias("first_id")).select("at.doc_id", "at.line", "shared_words", "first_id")


@query("WITH l AS (SELECT file_id, path, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM source_files WHERE text IS NOT NULL) " + " UNION ALL ".join(f"SELECT path AS file, line + 1 AS line, 'scan' AS type, '{name}: ' || trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)) AS message, CASE WHEN '{level}' = 'blocker' THEN 'error' ELSE 'warning' END AS severity FROM l WHERE regexp_matches(content, '{pattern}')" for name, pattern, level in _PATTERNS if level != "info"))
def verifier_errors(spark, sf_dir):
    """The findings of all checks as one list of errors: file, line (from 1), type of check, message and severity."""
    rows = read_table(spark, sf_dir, "source_files").where("text is not null").select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    hits = F.array(*[F.when(F.col("content").rlike(pattern), F.struct(F.lit(name + ": ").alias("name"), F.lit("error" if level == "blocker" else "warning").alias("severity"))) for name, pattern, level in _PATTERNS if level != "info"])
    found = rows.select("path", "line", "content", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return found.select(F.col("path").alias("file"), (F.col("line") + 1).cast("bigint").alias("line"), F.lit("scan").alias("type"), F.concat("h.name", T.trim_blank(F.col("content"))).alias("message"), "h.severity")
