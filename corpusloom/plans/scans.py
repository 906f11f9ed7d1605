"""Scans over code, plans and versions: dependency levels, anti-joins, patterns, inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import code as C
from corpusloom.operators import graph as G
from corpusloom.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_HEADS = "SELECT doc_id, repo, lower(trim(source)) AS source, nullif(trim(regexp_extract(text, '(?m)^phase: *(.*)$', 1)), '') AS phase, nullif(trim(regexp_extract(text, '(?m)^plan: *(.*)$', 1)), '') AS plan, try_cast(nullif(trim(regexp_extract(text, '(?m)^wave: *(.*)$', 1)), '') AS INTEGER) AS wave, text FROM documents WHERE starts_with(text, '---' || chr(10))"


def _heads(spark, sf_dir):
    """Plans and summaries by their front matter: (doc_id, repo, source, phase, plan, wave, text)."""
    own = read_table(spark, sf_dir, "documents").where(F.col("text").startswith("---\n"))
    field = lambda k: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{k}: *([^\n\r]*)$", 1)), F.lit(""))
    return own.select("doc_id", "repo", F.lower(F.trim("source")).alias("source"), field("phase").alias("phase"), field("plan").alias("plan"), field("wave").try_cast("int").alias("wave"), "text")


@query(f"WITH h AS ({_HEADS}) SELECT doc_id, repo, phase, plan FROM h WHERE source = 'plans' AND NOT EXISTS (SELECT 1 FROM h s WHERE s.source = 'summaries' AND s.repo = h.repo AND s.phase = h.phase AND s.plan = h.plan)")
def incomplete_plans(spark, sf_dir):
    """Plans without a summary of the same repository, phase and plan."""
    own = _heads(spark, sf_dir)
    done = own.where("source = 'summaries'").select("repo", "phase", "plan")
    return own.where("source = 'plans'").select("doc_id", "repo", "phase", "plan").join(done, ["repo", "phase", "plan"], "left_anti").select("doc_id", "repo", "phase", "plan")


@query(f"SELECT phase, wave, count(*) AS plans, count(DISTINCT repo) AS repos, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({_HEADS}) WHERE source = 'plans' GROUP BY phase, wave")
def plans_by_wave(spark, sf_dir):
    own = _heads(spark, sf_dir).where("source = 'plans'")
    return own.groupBy("phase", "wave").agg(F.count("*").alias("plans"), F.countDistinct("repo").alias("repos"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


_STEM = r"from ['\"][^'\"\n]*?([\w-]+)(?:\.[cm]?[jt]s)?['\"]"
_STEM_SQL = _STEM.replace("'", "''")
_BARE = "lower(regexp_replace(regexp_replace(path, '^.*/', ''), '(\\.[^.]*$|[-_])', '', 'g'))"
_MODULES = f"m AS (SELECT {_BARE} AS node, min(committed_at) AS since FROM source_files WHERE path IS NOT NULL GROUP BY ALL), i AS (SELECT DISTINCT {_BARE} AS node, lower(regexp_replace(unnest(regexp_extract_all(text, '{_STEM_SQL}', 1)), '[-_]', '', 'g')) AS needs FROM source_files WHERE path IS NOT NULL), e AS (SELECT * FROM i WHERE needs IN (SELECT node FROM m))"


def _modules(spark, sf_dir):
    """(node, since) of all modules, files by their names without folders, ending, hyphens and case, and (node, needs), which one imports which name."""
    files = read_table(spark, sf_dir, "source_files").where("path is not null").select(F.lower(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"(\.[^.]*$|[-_])", "")).alias("node"), "committed_at", "text")
    needs = F.lower(F.regexp_replace("needs", "[-_]", ""))
    imports = files.select("node", F.explode(F.regexp_extract_all("text", F.lit(_STEM), 1)).alias("needs")).select("node", needs.alias("needs")).distinct()
    return files.groupBy("node").agg(F.min("committed_at").alias("since")), imports


def _known(nodes, imports):
    return imports.join(nodes.select(F.col("node").alias("needs")), "needs", "left_semi").select("node", "needs")


@query(f"""WITH RECURSIVE {_MODULES}, back AS (SELECT node, needs FROM e UNION SELECT back.node, e.needs FROM back JOIN e ON e.node = back.needs), bad AS (SELECT node FROM back WHERE node = needs), stuck AS (SELECT node FROM bad UNION SELECT back.node FROM back JOIN bad ON back.needs = bad.node),
walk AS (SELECT node, 1 AS level FROM m WHERE node NOT IN (SELECT node FROM e) UNION SELECT e.node, walk.level + 1 FROM walk JOIN e ON e.needs = walk.node WHERE e.node NOT IN (SELECT node FROM stuck))
SELECT node, max(level)::INTEGER AS level FROM walk GROUP BY node""")
def wave_levels(spark, sf_dir):
    """Modules by the level at which they can be built: 1 without imports of known modules."""
    nodes, imports = _modules(spark, sf_dir)
    return G.levels(nodes, _known(nodes, imports))


@query(f"WITH {_MODULES} SELECT node, needs FROM i WHERE needs NOT IN (SELECT node FROM m)")
def dag_missing_refs(spark, sf_dir):
    """Imports of modules that no repository has."""
    return G.missing_references(*_modules(spark, sf_dir))


_PART = "lower(regexp_extract({}, '^[A-Za-z][a-z]*', 0))"


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT {_PART.format('name')} AS node, {_PART.format('stem')} AS needs FROM (SELECT regexp_replace(path, '^.*/', '') AS name, unnest(regexp_extract_all(text, '{_STEM_SQL}', 1)) AS stem FROM source_files WHERE path IS NOT NULL) WHERE {_PART.format('name')} <> {_PART.format('stem')}), back AS (SELECT node, needs FROM e UNION SELECT back.node, e.needs FROM back JOIN e ON e.node = back.needs) SELECT DISTINCT node FROM back WHERE node = needs AND node <> ''")
def dag_cycles(spark, sf_dir):
    """Components (the first words of the modules' names) that need one another in a circle."""
    part = lambda c: F.lower(F.regexp_extract(c, "^[A-Za-z][a-z]*", 0))
    files = read_table(spark, sf_dir, "source_files").where("path is not null").select(part(F.regexp_replace("path", "^.*/", "")).alias("node"), F.explode(F.regexp_extract_all("text", F.lit(_STEM), 1)).alias("stem"))
    edges = files.select("node", part(F.col("stem")).alias("needs")).where("node <> needs").distinct()
    return G.on_cycles(edges.select("node"), edges).where("node <> ''")


@query(f"WITH {_MODULES} SELECT e.node, e.needs FROM e JOIN m a ON a.node = e.node JOIN m b ON b.node = e.needs WHERE b.since > a.since")
def dag_forward_refs(spark, sf_dir):
    """Imports of a module that came later than the one that imports it."""
    nodes, imports = _modules(spark, sf_dir)
    later = _known(nodes, imports).join(nodes.withColumnRenamed("since", "own"), "node").join(nodes.select(F.col("node").alias("needs"), "since"), "needs")
    return later.where("since > own").select("node", "needs")


_PLAN_EDGES = f"""h AS ({_HEADS}), d AS (SELECT DISTINCT doc_id, trim(unnest(string_split(regexp_extract(text, '(?m)^depends_on: *\\[([^\\]\\n]*)\\]', 1), ','))) AS symbol FROM h), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]\\w+')) AS symbol FROM h),
p AS (SELECT symbol, min(doc_id) AS lo, max(doc_id) AS hi FROM w GROUP BY symbol), e AS (SELECT DISTINCT d.doc_id AS node, CASE WHEN lo <> d.doc_id THEN lo ELSE hi END AS needs FROM d JOIN p USING (symbol) WHERE NOT (lo = hi AND lo = d.doc_id))"""


def _plan_edges(heads):
    """(node, needs): a plan needs the plan that names what it depends on; of several the one with the smallest, or else the greatest, other id."""
    listed = F.transform(F.split(F.regexp_extract("text", r"(?m)^depends_on: *\[([^\]\n]*)\]", 1), ","), F.trim)
    wanted = heads.select("doc_id", F.explode(listed).alias("symbol")).distinct()
    named = heads.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w+"), 0))).alias("symbol")).groupBy("symbol").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    met = wanted.join(named, "symbol").where("not (lo = hi and lo = doc_id)")
    return met.select(F.col("doc_id").alias("node"), F.when(F.col("lo") != F.col("doc_id"), F.col("lo")).otherwise(F.col("hi")).alias("needs")).distinct()


@query(f"""WITH RECURSIVE {_PLAN_EDGES}, back AS (SELECT node, needs FROM e UNION SELECT back.node, e.needs FROM back JOIN e ON e.node = back.needs), bad AS (SELECT node FROM back WHERE node = needs), stuck AS (SELECT node FROM bad UNION SELECT back.node FROM back JOIN bad ON back.needs = bad.node),
walk AS (SELECT doc_id AS node, 1 AS level FROM h WHERE doc_id NOT IN (SELECT node FROM e) UNION SELECT e.node, walk.level + 1 FROM walk JOIN e ON e.needs = walk.node WHERE e.node NOT IN (SELECT node FROM stuck))
SELECT walk.node, max(level)::INTEGER AS level, any_value(wave) AS stated FROM walk JOIN h ON h.doc_id = walk.node WHERE wave IS NOT NULL GROUP BY walk.node HAVING max(level) <> any_value(wave)""")
def dag_wave_mismatch(spark, sf_dir):
    """Plans whose stated wave isn't the level that follows from what they depend on."""
    heads = _heads(spark, sf_dir)
    nodes = heads.select(F.col("doc_id").alias("node"), F.col("wave").alias("stated"))
    return G.levels(nodes, _plan_edges(heads)).join(nodes, "node").where("level <> stated").select("node", "level", "stated")


@query(f"""WITH RECURSIVE {_MODULES}, walk AS (SELECT needs AS node FROM e WHERE node LIKE '%a' UNION SELECT e.needs FROM walk JOIN e ON e.node = walk.node)
SELECT DISTINCT node FROM walk""")
def relevant_phases(spark, sf_dir):
    """Everything that the modules whose names end in `a` need, directly or through others."""
    nodes, imports = _modules(spark, sf_dir)
    return G.reachable(_known(nodes, imports), nodes.where("node like '%a'"))


@query(f"WITH h AS ({_HEADS}) SELECT phase, wave, path, count(DISTINCT doc_id) AS plans, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT phase, wave, doc_id, unnest(regexp_extract_all(text, '`([\\w./-]+\\.[a-z]+)`', 1)) AS path FROM h) GROUP BY ALL HAVING count(DISTINCT doc_id) > 1")
def file_conflicts(spark, sf_dir):
    """Files that several plans of one phase and wave name: folded to the first and last plan, no pair is built."""
    cited = _heads(spark, sf_dir).select("phase", "wave", "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([\w./-]+\.[a-z]+)`"), 1)).alias("path"))
    by = cited.groupBy("phase", "wave", "path").agg(F.countDistinct("doc_id").alias("plans"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return by.where("plans > 1")


@query("SELECT repo, path, count(DISTINCT file_hash) AS versions, max(committed_at) AS latest FROM source_files GROUP BY repo, path HAVING count(DISTINCT file_hash) > 1")
def path_versions(spark, sf_dir):
    """Paths with several contents."""
    return read_table(spark, sf_dir, "source_files").groupBy("repo", "path").agg(F.countDistinct("file_hash").alias("versions"), F.max("committed_at").alias("latest")).where("versions > 1")


#: What marks unfinished or suspicious code.
_PATTERNS = (("todo", r"\b(TODO|FIXME|XXX|HACK)\b", "warning"), ("placeholder", r"(?i)placeholder|coming soon|lorem ipsum", "blocker"), ("empty", r"return null|return \{\}|return \[\]|=> \{\}", "warning"), ("log", r"console\.(log|debug)", "info"))


@query("WITH l AS (SELECT file_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM source_files WHERE text IS NOT NULL) " + " UNION ALL ".join(f"SELECT file_id, line, '{name}' AS kind, '{level}' AS severity FROM l WHERE regexp_matches(content, '{pattern}')" for name, pattern, level in _PATTERNS))
def antipattern_scan(spark, sf_dir):
    """(file, line, kind, severity) of lines that match a pattern of suspicious code."""
    rows = read_table(spark, sf_dir, "source_files").where("text is not null").select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    hits = F.array(*[F.when(F.col("content").rlike(pattern), F.struct(F.lit(name).alias("kind"), F.lit(level).alias("severity"))) for name, pattern, level in _PATTERNS])
    found = rows.select("file_id", F.col("line").cast("bigint").alias("line"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return found.select("file_id", "line", "h.kind", "h.severity")


@query("SELECT pkg_name, pkg_version, row_number() OVER (ORDER BY list_transform(string_split(pkg_version, '.'), lambda x: x::INTEGER), pkg_name) AS place FROM packages")
def version_sort(spark, sf_dir):
    """The place of every package by version: sorted within major versions, each of which begins where the smaller ones end."""
    key = F.transform(F.split("pkg_version", r"\."), lambda x: x.cast("int"))
    own = read_table(spark, sf_dir, "packages").select("pkg_name", "pkg_version", key.alias("key"), key[0].alias("major"))
    sizes = own.groupBy("major").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("major").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per major version
    inner = own.withColumn("own", F.row_number().over(Window.partitionBy("major").orderBy("key", "pkg_name")))
    return inner.join(before.select("major", "before"), "major").select("pkg_name", "pkg_version", (F.col("own") + F.col("before")).cast("bigint").alias("place"))


@query("SELECT repo, file_id, n_lines FROM (SELECT repo, file_id, len(string_split(text, chr(10))) AS n_lines FROM source_files WHERE text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n_lines DESC, file_id) <= 20")
def largest_files(spark, sf_dir):
    own = read_table(spark, sf_dir, "source_files").where("text is not null").select("repo", "file_id", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"))
    return own.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.col("n_lines").desc(), "file_id"))).where("n <= 20").drop("n")


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([\\w./-]+\\.[a-z]+)`', 1)) AS path FROM documents")
def modified_files(spark, sf_dir):
    """File paths in backticks."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([\w./-]+\.[a-z]+)`"), 1)).alias("path")).distinct()


_META = ("phase", "plan", "wave", "subsystem")


@query("SELECT doc_id, " + ", ".join(f"nullif(regexp_extract(text, '(?m)^{k}: *(.*)$', 1), '') AS {k}" for k in _META) + " FROM documents WHERE starts_with(text, '---' || chr(10))")
def frontmatter_scan(spark, sf_dir):
    own = read_table(spark, sf_dir, "documents").where(F.col("text").startswith("---\n"))
    return own.select("doc_id", *[F.nullif(F.regexp_extract("text", rf"(?m)^{k}: *([^\n\r]*)$", 1), F.lit("")).alias(k) for k in _META])


_EXPORT = r"(?m)^export (?:async )?(?:function|class|const|interface) (\w+)"
_IMPORTED = f"SELECT file_id, repo, path, regexp_extract(part, '^\\s*(?:type\\s+)?(\\w+)(?:\\s+as\\s+\\w+)?\\s*$', 1) AS symbol FROM (SELECT file_id, repo, path, unnest(string_split(list, ',')) AS part FROM (SELECT file_id, repo, path, unnest(regexp_extract_all(text, '{C.IMPORTED}', 1)) AS list FROM source_files))"


@query(f"WITH x AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_EXPORT}', 1)) AS symbol FROM source_files), i AS (SELECT symbol, file_id FROM ({_IMPORTED}) WHERE symbol <> ''), n AS (SELECT symbol, count(DISTINCT file_id) AS importers FROM i GROUP BY symbol) SELECT x.symbol, coalesce(importers, 0) AS importers, CASE WHEN importers > 0 THEN 'CONNECTED' ELSE 'ORPHANED' END AS status FROM x LEFT JOIN n USING (symbol)")
def export_usage(spark, sf_dir):
    files = read_table(spark, sf_dir, "source_files")
    exports = files.select(F.explode(F.regexp_extract_all("text", F.lit(_EXPORT), 1)).alias("symbol")).distinct()
    imports = files.select("file_id", F.explode(C.imported_names(F.col("text"))).alias("symbol")).groupBy("symbol").agg(F.countDistinct("file_id").alias("importers"))
    n = F.coalesce("importers", F.lit(0))
    return exports.join(imports, "symbol", "left").select("symbol", n.cast("bigint").alias("importers"), F.when(n > 0, "CONNECTED").otherwise("ORPHANED").alias("status"))


_CANDIDATES = ("{dir}{stem}.test.ts", "{dir}{stem}.spec.ts", "{dir}__tests__/{stem}.test.ts", "{dir}__tests__/{stem}.spec.ts")


@query("WITH f AS (SELECT DISTINCT file_id, repo, path, regexp_extract(path, '^(.*/)?', 0) AS dir, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]+$', '') AS stem FROM source_files WHERE path IS NOT NULL), c AS (" + " UNION ALL ".join("SELECT file_id, repo, " + x.replace("{dir}", "dir || '").replace("{stem}", "' || stem || '") + "' AS candidate FROM f WHERE NOT contains(path, '.test.') AND NOT contains(path, '.spec.')" for x in _CANDIDATES) + " UNION ALL SELECT file_id, repo, path FROM f WHERE contains(path, '.test.') OR contains(path, '.spec.')) SELECT DISTINCT c.file_id, c.candidate, t.path IS NOT NULL AS present FROM c LEFT JOIN (SELECT DISTINCT repo, path FROM source_files) t ON t.repo IS NOT DISTINCT FROM c.repo AND t.path = c.candidate")
def test_candidates(spark, sf_dir):
    """Where the tests of a file may lie, and whether they do; a test is its own."""
    files = read_table(spark, sf_dir, "source_files").where("path is not null").select("file_id", "repo", "path").distinct()
    folder, stem = F.regexp_extract("path", "^(.*/)?", 0), F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]+$", "")
    listed = F.array(*[F.concat(folder, F.lit(x[5 : x.index("{stem}")]), stem, F.lit(x[x.index("{stem}") + 6 :])) for x in _CANDIDATES])
    own = F.when(F.col("path").contains(".test.") | F.col("path").contains(".spec."), F.array("path")).otherwise(listed)
    wanted = files.select("file_id", "repo", F.explode(own).alias("candidate"))
    have = files.select(F.col("repo").alias("r"), F.col("path").alias("p")).distinct().withColumn("have", F.lit(True))
    met = wanted.join(have, F.col("repo").eqNullSafe(F.col("r")) & (F.col("candidate") == F.col("p")), "left")
    return met.select("file_id", "candidate", F.coalesce("have", F.lit(False)).alias("present")).distinct()


@query("SELECT repo, date_trunc('month', committed_at) AS month, count(*) AS files, count(DISTINCT path) AS paths, sum(length(text))::BIGINT AS chars FROM source_files WHERE committed_at IS NOT NULL GROUP BY ALL")
def velocity(spark, sf_dir):
    month = F.date_trunc("month", "committed_at").cast("timestamp_ntz")
    return read_table(spark, sf_dir, "source_files").where("committed_at is not null").groupBy("repo", month.alias("month")).agg(F.count("*").alias("files"), F.countDistinct("path").alias("paths"), F.sum(F.length("text")).alias("chars"))
