"""Core operators on small fixtures: golden cases, odd rows, empty tables, streams."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.paths import code_language
from corpusloom.operators import code as C
from corpusloom.operators import evidence as E
from corpusloom.operators import graph as G
from corpusloom.operators import markdown as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import store as S
from corpusloom.sources.files import scan_files
from corpusloom.streaming import ingest


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_hashes_and_tokens(spark):
    for term, h, b in (("a", 97, 97), ("the", 114801, 24801), ("function", 1380938712, 8712), ("the_function", -1307192346, 2346)):
        assert one(spark, T.term_hash, term) == h and one(spark, T.bucket, term) == b
    assert one(spark, T.tokens, "éclair_9 a İX naïve") == ["clair_9", "a", "i", "x", "na", "ve"]
    assert one(spark, T.tokens, None) == [] and one(spark, T.content_hash, "abc") == "ba7816bf8f01cfea"
    assert one(spark, T.slugify, "Hello, World!") == "hello-world" and one(spark, T.slugify, "  --A__B--  ") == "a-b" and one(spark, T.slugify, "x" * 40) == "x" * 30


@pytest.mark.parametrize("size,ratio,length,starts", [(1500, 0.15, 1724, [0]), (1500, 0.15, 1725, [0, 1275]), (1500, 0.15, 3001, [0, 1275, 2550]), (2000, 0.15, 2299, [0]), (2000, 0.15, 4100, [0, 1700, 3400])])
def test_fixed_split(spark, size, ratio, length, starts):
    assert spark.range(1).select(T.split_positions(F.lit(length), size, ratio)).first()[0] == starts
    with pytest.raises(ValueError):
        T.split_positions(F.lit(10), 100, 0.3)


@pytest.mark.parametrize("size,step", [(1500, 1275), (2000, 1700), (100, 85)])
def test_whole_split_covers_the_text(spark, size, step):
    rows = spark.range(0, 3 * size).select("id", T.split_positions(F.col("id"), size, 0.15).alias("a"), T.split_positions(F.col("id"), size, 0.15, whole=True).alias("b")).collect()
    for length, a, b in rows:
        assert b[: len(a)] == a and len(b) <= len(a) + 1 and b == list(range(0, b[-1] + 1, step)) and b[-1] + size >= length
    assert any(a[-1] + size < length for length, a, _ in rows)


def test_claims(spark):
    text = "Too short. This one is long enough! Is it? Yes it really is so."
    assert one(spark, T.sentences, text) == ["Too short.", "This one is long enough!", "Is it?", "Yes it really is so."]
    assert not one(spark, T.is_verifiable, "A shoulder joint moves.") and one(spark, T.is_verifiable, "The parser caches files.")


def test_sections_and_packing(spark):
    doc = "intro\n\n# One\n\nalpha\nbeta\n\n## Empty\n\n## Two\ngamma\n"
    df = spark.createDataFrame([(1, doc, 5), (2, None, 5), (3, "## T\r\nx", 5), (4, "", 5)], "doc_id int, text string, title int")
    got = [tuple(r)[2:] for r in M.sections(df, "doc_id").where("doc_id = 1").orderBy("section").collect()]
    assert got == [("(document start)", 0, 0, 1, "intro"), ("One", 1, 2, 6, "alpha\nbeta"), ("Two", 2, 9, 11, "gamma")]
    assert [r["title"] for r in M.sections(df, "doc_id").where("doc_id <> 1").collect()] == ["(document start)"]
    packed = spark.createDataFrame([(1, "# T\n\n" + "\n\n".join("x" * 30 for _ in range(5)))], "doc_id int, text string")
    for least, lengths in ((10, [67, 67, 35]), (40, [67, 67])):
        parts = M.pack_paragraphs(M.sections(packed, "doc_id"), 80, least).orderBy("part").collect()
        assert [len(r["chunk"]) for r in parts] == lengths


def test_fusion(spark):
    leg = lambda names: spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(names)], "q int, id string, rank bigint")
    got = {r["id"]: r["score"] for r in R.rrf(leg("abcd"), leg("cae"), "q", "id").collect()}
    assert got == {"a": 0.833333, "c": 0.75, "b": 0.333333, "e": 0.25, "d": 0.2}


def test_search_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "red green", "x"), (2, "red red", "x"), (3, None, "x"), (4, "", None)], "doc_id int, text string, term string")
    items = spark.createDataFrame([(7, "Red!"), (8, None), (9, "zzz")], "item_id int, text string")
    got = [tuple(r) for r in R.top(R.sparse_scores(docs, items, "doc_id", "item_id"), "item_id", "doc_id", 5).orderBy("rank").collect()]
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    assert got == [(7, 2, round(2 * idf, 6), 1), (7, 1, round(idf, 6), 2)]
    assert R.hybrid(docs.limit(0), items, "doc_id", "item_id").count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0])], "id int, v array<float>")
    got = [(r["query_id"], r["id"], r["score"]) for r in R.dense_topk(v, v.where("id = 1"), "id", "v", 2).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (1, 2, 1.0)]
    assert R.dense_topk(v.limit(0), v.limit(0), "id", "v").count() == 0


def test_hybrid_with_a_dense_leg(spark):
    """A row that is near by vector but shares no word comes out, and so does one that shares words but has no vector."""
    docs = spark.createDataFrame([("near", "blue"), ("words", "red"), ("far", "green"), ("silent", None)], "id string, text string")
    vectors = spark.createDataFrame([("near", [1.0, 0.1]), ("far", [-1.0, 0.0]), ("bad", [0.0, 0.0]), ("alone", [1.0, 0.5])], "id string, dense array<float>")
    asked = spark.createDataFrame([("q", "red", [2.0, 0.0]), ("none", None, None)], "q string, text string, dense array<float>")
    got = [tuple(r) for r in R.hybrid_dense(docs, vectors, asked, "id", "q", k=3).orderBy("rank").select("q", "id", "score", "rank").collect()]
    assert got == [("q", "near", 0.5, 1), ("q", "words", 0.5, 2), ("q", "alone", 0.333333, 3)]
    assert [r["id"] for r in R.hybrid(docs, asked, "id", "q").collect()] == ["words"]
    scores = [{tuple(r) for r in R.sparse_scores(docs, asked, "id", "q", most_terms=n).collect()} for n in (0, 1)]
    assert scores[0] == scores[1] and {r[:2] for r in scores[0]} == {("q", "words")}
    assert R.hybrid_dense(docs, vectors, asked, "id", "q", k=3, threshold=0.4).count() == 2
    assert R.hybrid_dense(docs.limit(0), vectors.limit(0), asked, "id", "q").count() == 0


def test_store(spark):
    at = datetime.datetime(2024, 1, 1)
    files = spark.createDataFrame([("r", "a", "h1"), (None, "b", "h2"), ("r", "c", "h3")], "repo string, path string, file_hash string")
    log = spark.createDataFrame([("r", "a", "h1", at), (None, "b", "old", at), (None, "b", "h2", None), ("r", "gone", "h9", at)], "repo string, path string, file_hash string, indexed_at timestamp_ntz")
    assert {r["path"] for r in S.changed_files(files, log).collect()} == {"b", "c"}
    assert {r["path"] for r in S.removed_files(files, log).collect()} == {"gone"}
    assert S.changed_files(files, log.limit(0)).count() == 3
    kept = S.upsert(files, files.where("path = 'a'").withColumn("file_hash", F.lit("new")), "path")
    assert {tuple(r) for r in kept.select("path", "file_hash").collect()} == {("a", "new"), ("b", "h2"), ("c", "h3")}
    assert S.delete_matching(files, files.where("file_hash = 'h1'"), "file_hash").count() == 2
    v = spark.createDataFrame([(1, [1.0, -0.5, float("nan")]), (2, None)], "id int, v array<float>")
    assert {r["id"]: r["codes"] and list(r["codes"]) for r in S.quantize_int8(v, "id", "v", 1.0).collect()} == {1: [127, -63, 0], 2: None}


def test_levels(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "nowhere"), ("a", None)], "node string, needs string")
    nodes = edges.select("node").distinct()
    assert {tuple(r) for r in G.levels(nodes, edges).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert [tuple(r) for r in G.missing_references(nodes, edges).collect()] == [("z", "nowhere")]
    assert G.levels(nodes.limit(0), edges.limit(0)).count() == 0


def test_bounded_walks_are_whole_or_an_error(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "node string, needs string")
    nodes, start = spark.createDataFrame([(n,) for n in "abcd"], "node string"), spark.createDataFrame([("d",)], "node string")
    for most in (None, 4):
        assert {tuple(r) for r in G.levels(nodes, edges, most=most).collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 4)}
    for most in (None, 3):
        assert {r["node"] for r in G.reachable(edges, start, most=most).collect()} == set("abc")
    with pytest.raises(ValueError):
        G.levels(nodes, edges, most=3)
    with pytest.raises(ValueError):
        G.reachable(edges, start, most=2)


def test_evidence(spark):
    claims = spark.createDataFrame([(1, 0, "It is on."), (1, 1, "parser caches grammar files"), (1, 2, "unrelated words altogether")], "d int, pos int, claim string")
    proof = spark.createDataFrame([(1, 5, "grammar files are loaded", 1, 0.9), (1, 6, "grammar files again", 0, 0.1)], "d int, epos int, evidence string, sources int, confidence double")
    got = {r["pos"]: r["epos"] for r in E.match_evidence(claims, proof, "d").collect()}
    assert got == {0: 5, 1: 5, 2: None}
    cover = E.coverage(E.match_evidence(claims, proof, "d"), "d").first()
    assert (cover["total"], cover["covered"], cover["average"]) == (3, 2, 0.9)
    for (a, b, c, d), want, level in (((0.8, 1.0, 3, 0.5), 0.805, "high"), ((0.3, 1.0, 2, 1.0), 0.66, "medium"), ((0.0, 0.0, 0, 0.0), 0.0, "low"), ((1.0, 3.0, 10, 1.0), 1.0, "high")):
        row = spark.range(1).select(E.confidence(F.lit(a), F.lit(b), F.lit(c), F.lit(d)).alias("s")).withColumn("l", E.confidence_level(F.col("s"))).first()
        assert abs(row["s"] - want) < 1e-9 and row["l"] == level


def test_languages(spark):
    df = spark.createDataFrame([("TypeScript", "a.py"), (None, "a.PY"), (" ", "x/y.mts"), (None, "Makefile"), (None, None)], "l string, p string")
    assert [r[0] for r in df.select(code_language(F.col("l"), F.col("p"))).collect()] == ["typescript", "python", "typescript", None, None]


def test_streams(spark, tmp_path):
    at = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    schema = "chunk_id string, indexed_at timestamp_ntz, text string"
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    for k, rows in enumerate(([("a", at[0], "1"), ("b", at[0], "1"), (None, at[0], "1")], [("a", at[2], "3"), ("a", at[1], "2")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.follow_chunks(spark, source, store, f"{tmp_path}/check").awaitTermination()
    kept = ingest.read_store(spark, store, spark.read.parquet(source).schema)
    assert {tuple(r) for r in kept.select("chunk_id", "text").collect()} == {("a", "3"), ("b", "1")}
    assert [r["chunk_id"] for r in spark.read.parquet(f"{store}/v=1").collect()] == ["a"]  # the bucket of b is left as it was
    stream = spark.readStream.schema(schema).parquet(source)
    for name, df, mode in (("lookups", ingest.count_lookups(stream, "indexed_at", "chunk_id"), "complete"), ("hits", ingest.cached_lookups(stream, "chunk_id", "indexed_at", 90_000), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("lookups").agg(F.sum("lookups")).first()[0] == 5
    assert {tuple(r) for r in spark.table("hits").where("key = 'a'").groupBy().sum("hits", "misses").collect()} == {(2, 1)}


def test_code_chunks(spark):
    text = "import a from 'a';\n\nexport class K {\n  m() {}\n}\nconst f = async (x) => {\n  return x;\n};\n"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, " \n", "x")], "file_id int, text string, line string")
    got = [(r["symbol_type"], r["symbol_name"], r["start_line"], r["end_line"]) for r in C.chunk_code(df).orderBy("start_line").collect()]
    assert got == [("module", "<module>", 0, 1), ("class", "K", 2, 4), ("function", "f", 5, 8)]


def test_code_units(spark):
    text = 'import a from "a";\nimport {\n  b as c,\n} from "b";\n\n// note\nexport class Foo {\n  x = 1;\n\n  constructor(a) {\n    if (a) {\n      b();\n    }\n  }\n}\n\nconst f = (x) => {\n  return x;\n};\nlog(1);\nfunction g(\n  a,\n) {\n  return a;\n}\n'
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "class A:\n    def m(self):\n        return 1\n\nx = 1\n", "x"), (5, "const f = (\n" + "  a,\n" * 600 + ") => 1;", "x")], "file_id int, text string, chunk_id string")
    rows = C.code_units(df).orderBy("file_id", "start_line", "symbol_type").collect()
    got = [(r["symbol_type"], r["symbol_name"], r["start_line"], r["end_line"]) for r in rows if r["file_id"] != 5]
    assert got == [("class", "Foo", 6, 14), ("method", "constructor", 9, 13), ("function", "f", 16, 18), ("function", "g", 20, 24), ("class", "A", 0, 2), ("method", "m", 1, 2)]
    assert rows[1]["chunk"].startswith('import a from "a"\nimport {') and rows[1]["chunk"].endswith("\n  }")
    assert [r["symbol_name"] for r in rows if r["file_id"] == 5] == ["f (part 1)", "f (part 2)"]
    names = spark.createDataFrame([("import { a, b as c,\n  type D } from 'x'; import e, { f } from 'y'; import {} from 'z'",)], "t string").select(C.imported_names(F.col("t"))).first()[0]
    assert names == ["a", "b", "D", "f"]


def test_quantile_bounds(spark):
    rng = random.Random(3)
    for values in ([1.0], [2.0] * 50, [0.0, 1e9], [rng.gauss(0, 1) for _ in range(1500)], [rng.choice((1.0, 1.0000000000000002)) for _ in range(99)], []):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        for quantile in (0.0, 0.5, 0.99, 1.0):
            want = None if not values else round(float(np.quantile(values, quantile)), 9)
            for most in (5, 100_000):
                got = S._quantile(df, quantile, most, 16)
                assert got == want or abs(got - want) < 1e-8 * max(1, abs(want)), (values[:3], quantile, most)


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 1), (7, 7), (8, 9), (9, 8), (5, 8), (None, 1), (2, None), (1, 2)], "node int, needs int")
    assert {r[0] for r in G.on_cycles(edges.select("node"), edges).collect()} == {1, 2, 3, 7, 8, 9}
    assert G.on_cycles(edges.select("node"), edges.limit(0)).count() == 0


def test_matching_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 4)
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta the of in concatenated cat".split()
    say = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    claims = [(g, p, say(7)) for g in range(6) for p in range(14)] + [(None, 0, "alpha beta")]
    evidence = [(g, p, say(9)[rng.randint(0, 2):], p % 3, p / 20) for g in range(6) for p in range(14)] + [(0, 2, "alpha beta gamma", 9, 0.9), (None, 0, "alpha beta", 1, 0.5)]
    keys = lambda t: [w for w in t.lower().split() if len(w) > 2 and w not in T.STOP_WORDS]

    def match(c, e):
        return c.lower() in e.lower() or e.lower() in c.lower() or sum(w in keys(e) for w in keys(c)) >= math.ceil(len(keys(c)) / 2)

    want = {}
    for g, p, c in claims:
        met = [(q, e, s, f) for h, q, e, s, f in evidence if h == g and g is not None and match(c, e)]
        least = min((q for q, *_ in met), default=None)
        want[g, p] = min(((e, s, f) for h, q, e, s, f in evidence if h == g and q == least), default=None)
        want[g, p] = (least, *want[g, p][1:]) if least is not None else (None, None, None)
    a, b = spark.createDataFrame(claims, "g int, pos bigint, claim string"), spark.createDataFrame(evidence, "g int, epos bigint, evidence string, sources int, confidence double")
    got = {(r["g"], r["pos"]): (r["epos"], r["sources"], r["confidence"]) for r in E.match_evidence(a, b, "g").collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 30
    assert E.match_evidence(a.limit(0), b, "g").count() == 0 and E.match_evidence(a, b.limit(0), "g").where("epos is not null").count() == 0
    links = {(r["g"], r["pos"], r["epos"]) for r in E.claim_links(a, b, "g").where("g is not null").collect()}
    monkeypatch.setattr(E, "BLOCK", 512)
    assert links == {(r["g"], r["pos"], r["epos"]) for r in E.claim_links(a, b, "g").where("g is not null").collect()} and links


def test_lexical_search_either_way(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None), (501, "")], "d int, text string")
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choice([*words, "other"]) for _ in range(4))) for i in range(9)] + [("none", None)], "q string, text string")
    few, many = ({tuple(r) for r in R.lexical_topk(docs, asked, "d", "q", 5, legs=("sparse", "overlap"), most_terms=m).collect()} for m in (1000, 0))
    assert few == many and len(few) == 90
    assert R.lexical_topk(docs.limit(0), asked, "d", "q", 5).count() == 0 == R.lexical_topk(docs, asked.limit(0), "d", "q", 5).count()
    with pytest.raises(ValueError):
        R.where_all(docs)


def test_each_text_is_embedded_once(spark):
    rows = spark.createDataFrame([("a", "x y", 1), ("b", "x y", 1), ("c", "z", 1), ("d", None, 1), ("e", "", 1), ("f", "z", 1)], "id string, text string, hash int")
    cache = spark.createDataFrame([("b", [1.0]), ("a", [2.0]), ("c", None)], "id string, vector array<double>")
    got = {r["id"]: (r["origin"], r["source"], r["vector"]) for r in S.embed_batch(rows, cache, "id", "text", lambda t: F.array(F.length(t).cast("double"))).collect()}
    assert got == {"a": ("cached", "a", [2.0]), "b": ("cached", "a", [2.0]), "c": ("embedded", None, [1.0]), "f": ("embedded", None, [1.0]), "e": ("embedded", None, [0.0])}
    (vector,) = rows.where("id = 'a'").select(T.hashed_embedding(F.col("text"), 8)).first()
    assert abs(sum(x * x for x in vector) - 1) < 1e-9


def test_file_scan(spark, tmp_path):
    for path, text in (("a.ts", "x"), ("b/c.md", "é"), ("node_modules/d.js", "x"), ("e.txt", "x"), (".git/f.js", "x")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    assert {(r["path"], r["text"]) for r in scan_files(spark, str(tmp_path)).collect()} == {("a.ts", "x"), ("b/c.md", "é")}
