from __future__ import annotations

import random

from corpusloom.llm.provenance import has_notice, path_reason, provenance, similar_sets

PACKAGE = "/*! lib v1 */\n" + "\n".join(f"export function part{i}(alpha{i}, beta{i}) {{ return alpha{i} * {i} + beta{i}; }}" for i in range(20))
HAND = "import { a } from './a';\n\n// Adds one to what it gets.\nexport function plusOne(x) {\n  return x + 1;\n}\n"


def test_notices():
    for line in ("// Code generated by protoc v3. DO NOT EDIT.", "# @generated by tool", " * This file was automatically created by x; changes will be overwritten.", "/* AUTOGENERATED from a.yaml -- do not modify by hand */", "# Diese Datei wurde automatisch erzeugt (x)."):
        assert has_notice(line + "\n" + HAND) and has_notice(HAND + line)
    for line in ("// Generates the report; do not edit rows while it runs.", "const a = '// Code generated by x. DO NOT EDIT.';", "// Keep in sync with the generated docs.", "// Vendored builds are checked elsewhere."):
        assert not has_notice(line + "\n" + HAND)


def test_notices_of_public_tools():
    for line in ("// Generated from Foo.g4 by ANTLR 4.9", "# AUTO GENERATED FILE", "/* Generated with openapi-generator */", "// Auto generated. Please do not touch.", "# Generated by Django 3.2 on 2021-01-01 10:00"):
        assert has_notice(line + "\n" + HAND) and has_notice("#!/usr/bin/env node\n'use strict';\nimport x from 'y';\n/*\n * License\n */\n" + line + "\n" + HAND), line
        assert not has_notice(HAND + line + "\n" + HAND), line  # in the middle of a file it speaks of something else
    for line in ("// hand-written; generates reports from rows", "// The rows are generated from the plan and merged", "# this module explains how auto generated keys are stored", "// helpers generated with care and love"):
        assert not has_notice(line + "\n" + HAND), line


def test_paths():
    assert path_reason("vendor/x/a.js") == path_reason("a/node_modules/x/b.js") == path_reason("Vendor/x/a.py") == "vendored"
    assert path_reason("src/a.min.js") == path_reason("a_pb2.py") == path_reason("public/a.0b0f8abd.js") == path_reason("app/dist/x/y.js") == "built"
    assert path_reason("app/__generated__/a.ts") == "generated"
    assert path_reason("vendor/jquery.js") == path_reason("lib/jquery-3.6.0.js") == path_reason("external/x/a.js") == "vendored"
    assert path_reason("external/adapter.ts") is path_reason("src/step-2.js") is None
    assert path_reason("src/vendors/a.js") is path_reason("src/generated-viewer/a.ts") is path_reason(None) is None


def test_rows(spark):
    minified = "".join(f"var a{i}=function(b){{return b.c{i}||{i}}};" for i in range(40))
    data = "export const rows = [\n" + "  [0.5, -1, 'x'],\n" * 40 + "];\n"
    moved = PACKAGE.replace("/*! lib v1 */", "// our own words").replace("{ return", "{\n    return").replace("; }", ";\n}")
    rows = [(1, None, "src/a.js", None, HAND, ""), (2, "r", "src/a.js", "javascript", minified, ""), (3, "r", "b.ts", None, data, ""), (4, "r", "src/c.js", None, moved, ""), (5, "r", "vendor/x/d.js", None, HAND + "}", ""), (6, "r", "vendor/x/d.json", None, "{}", ""), (7, "r", "vendor/x/e.js", None, HAND, ""), (8, "r", None, None, None, ""), (9, "r", "vendor/x/e.js", None, "", "")]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, path string, language string, text string, reason string")
    packages = spark.createDataFrame([("lib", "1", "MIT", "javascript", PACKAGE), (None, None, None, None, None)], "pkg_name string, pkg_version string, license_tag string, language string, release_text string")
    joined = {r["file_id"]: (r["reason"], r["by_hand"]) for r in provenance(files, packages, most_broadcast=0).collect()}
    got = {r["file_id"]: (r["reason"], r["by_hand"]) for r in provenance(files, packages).collect()}
    assert got == joined == {1: (None, True), 2: ("minified", False), 3: ("data", False), 4: ("package", False), 5: ("unparsed", True), 6: (None, True), 7: ("vendored", False), 9: (None, True)}
    assert provenance(files, packages.limit(0)).where("reason = 'package'").count() == 0 and provenance(files.limit(0), packages).count() == 0


def test_python_data_with_continued_and_prefixed_strings(spark):
    """String blobs continued by a backslash, and literals with a prefix; an f-string or a call is code."""
    blob = lambda prefix, mark: "BLOB = (" + f" {mark}\n  ".join(f'{prefix}"{k}oGjsIoKqwvoccf3H7IwQ+/"' for k in range(20)) + ")\n"
    texts = [blob("", "\\"), blob("", "\\").replace("\n", "\r\n"), blob("b", ""), blob("Rb", "\\"), "A = \\\n  'x' \\\n  u'y'\nB = [r'z', 1]\n", blob("f", "\\"), "A = decode(b'x')\n", "A = b\n"]
    files = spark.createDataFrame([(k, "r", "src/a.py", "python", t) for k, t in enumerate(texts)] + [(90, "r", "src/a.js", "javascript", "const a = b`x`;\n")], "file_id bigint, repo string, path string, language string, text string")
    packages = spark.createDataFrame([], "pkg_name string, language string, release_text string")
    got = {r["file_id"]: (r["reason"], r["by_hand"]) for r in provenance(files, packages).collect()}
    assert got == {**{k: ("data", False) for k in range(5)}, **{k: (None, True) for k in (5, 6, 7, 90)}}


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(3)
    right = {f"p{i}": sorted(rng.sample(range(200), rng.randint(1, 40))) for i in range(15)}
    right["p90"] = right["p3"]
    left = {i: sorted(rng.sample(range(200), 20)) for i in range(20)} | {i: sorted(set(right[f"p{i % 15}"]) ^ set(rng.sample(range(200), i % 5))) for i in range(20, 60)} | {99: []}
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {}
    for i, a in left.items():
        best = min(((-alike(a, b), n) for n, b in right.items() if a and alike(a, b) >= 0.8), default=None)
        if best:
            want[i] = best[1]
    a = spark.createDataFrame(list(left.items()), "id bigint, shingles array<bigint>")
    b = spark.createDataFrame(list(right.items()), "package string, shingles array<bigint>")
    assert {r["id"]: r["package"] for r in similar_sets(a, b).collect()} == want and len(want) > 10
