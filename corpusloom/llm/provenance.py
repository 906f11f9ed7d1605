"""Generated, minified or vendored source files.

Method: generation notices are found by a multi-pattern automaton over the comments at the head and at the foot of a file and
confirmed on the comment line they stand in; path rules name vendored and generated directories, lockfiles and suffixes of built files. Three
looks at the code itself complete them: too little white space (minified), nothing but literals (data saved as
code), and the five-token shingles of the known packages (vendored copies under any name, layout or banner).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import code_language
from corpusloom.llm.rolling import window_hashes
from corpusloom.llm.skew import by_group
from corpusloom.llm.syntax_check import valid_for
from corpusloom.session import cut

# Words that generation notices contain, each with what the comment line must look like.
NOTICES = {
    "generated by": r"\b(?:code|file|auto[- ]?)?\s*generated by \S+.*(?:do not edit|don't edit|v?\d)|@generated\b|automatically generated by|generated by .* compiler",
    "@generated": r"@generated\b",
    "generated from": r"^\W*(?:this (?:file|code|module) (?:is|was) )?(?:auto[- ]?)?generated from \S+(?:\.\w+)?.*(?:\b(?:by|with|using|via|do not)\b|\bv?\d+\.\d)",
    "generated with": r"^\W*(?:this (?:file|code|module) (?:is|was) )?(?:auto[- ]?)?generated with \S*(?:gen|protoc|swagger|openapi|antlr|bison|flex|thrift|sqlc|kit|\d\.\d)\S*",
    "auto generated": r"^\W*(?:this (?:file|code|module) (?:is|was) )?auto generated(?: (?:file|code|by|from|with)\b|\W*(?:please )?(?:do not|don't|never)\b|\W*$)|\bis auto generated\b",
    "do not touch": r"\b(?:auto[- ]?)?(?:generated|created|produced)\b.*do not touch|do not touch\b.*\b(?:generated|produced)",
    "auto-generated": r"<auto-?generated\b|this (?:file|code|module) (?:is|was) auto-?generated|auto-?generated (?:file|code|by|from)",
    "autogenerated": r"autogenerated (?:from|by|file|stub|code)|this (?:file|code|module) (?:is|was) autogenerated",
    "automatically created": r"automatically (?:created|generated) by\b",
    "automatically generated": r"(?:file|code|module).*automatically generated|automatically generated (?:file|by|from)",
    "do not edit": r"(?:generated|produced by|emitted by|output of|built by)\b.*do not edit|do not edit\b.*(?:generated|produced by|emitted by|overwritten|by hand\W*$)",
    "do not modify": r"(?:generated|produced|from)\b.*do not modify|do not modify\b.*(?:generated|produced)",
    "machine-made": r"machine-made output",
    "machine generated": r"machine[- ]generated (?:file|code|output|by|from)",
    "compiled from": r"compiled from \S+\.\w+ (?:by|with|using) \S+",
    "source of truth": r"(?:built|generated|made) with \S+.*source of truth",
    "generated file": r"(?:^|this is an? (?:auto-?)?)\W*generated file\b",
    "manual changes": r"manual (?:changes|edits)\b.*(?:lost|overwritten)",
    "will be overwritten": r"(?:changes|edits)\b.*will be overwritten",
    "automatisch": r"automatisch (?:erzeugt|generiert|erstellt)",
    "automatiquement": r"(?:produit|généré|genere|créé) automatiquement",
    "automáticamente": r"(?:generado|creado|producido) automáticamente",
    "sourcemappingurl": r"[#@]\s*sourcemappingurl=",
}
VENDORED = re.compile(
    r"(?:^|/)(?:(?:vendor|node_modules|third_party|third-party|thirdparty|3rdparty|bower_components|site-packages|jspm_packages)/|(?:external|deps)/[^/]+/)"
    r"|[-.]v?\d+\.\d+\.\d+(?:[-.]\w+)*\.[cm]?js$",
    re.I,
)
GENERATED = re.compile(r"(?:^|/)(?:generated|__generated__|gen|autogen|codegen_out)/", re.I)
BUILT = re.compile(r"(?:^|/)dist/(?:[^/]+/)*[^/]+\.[cm]?js$|[.-]min\.[cm]?[jt]sx?$|\.(?:gen|g|pb|generated|bundle|chunk)\.(?:[cm]?[jt]sx?|py)$|_pb2(?:_grpc)?\.pyi?$|\.[0-9a-f]{8,20}\.[cm]?js$|(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Pipfile\.lock|Cargo\.lock)$")
_SCRIPT_TEXT = re.compile(r"(//[^\n]*|/\*.*?(?:\*/|\Z))|(?<=[(,=:\[!&|?{};+\n])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S)
_PYTHON_TEXT = re.compile(r"(#[^\n]*)|'''(?:\\.|.)*?(?:'''|\Z)|\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S)
_NAMED = r"(?:(?:export\s+(?:default\s+)?)?(?:const|let|var)\s+[\w$]+\s*(?::[\w<>\[\], |{};.]+?)?=|(?:module\.)?exports(?:\.[\w$]+)?\s*=|export\s+default\b|[\w$]+\s*(?::\s*[\w\[\], .|]+)?=(?!=))"
_LITERALS = rf"(?:\s*['\"]use strict['\"];?)?(?:\s*{_NAMED}(?:[\s\[\]{{}},:+\-.()]|@MORE@\"\"|'(?=\s*:)|[\w$]+\s*(?=:)|\d[\w.]*|\b(?:true|false|null|undefined|None|True|False|as|const|satisfies)\b)+;?)+\s*;?\s*"
#: By whether the file is Python, where a backslash may end a line and a string may have a prefix (f-strings are no literals).
_DATA = {python: re.compile(_LITERALS.replace("@MORE@", r"\\\r?\n|(?:[rR][bB]?|[bB][rR]?|[uU])\"\"|" if python else ""), re.S) for python in (False, True)}
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PREAMBLE = re.compile(r"['\"]use strict['\"];?$|import\b|from\s+\S+\s+import\b|(?:const|var|let)\s.*=\s*require\(")
SHINGLE = 5
SIMILAR = 0.8
LEAST_SPACE = 0.065


@lru_cache(1)
def _automaton() -> tuple[ahocorasick.Automaton, dict[str, re.Pattern]]:
    a = ahocorasick.Automaton()
    for needle in NOTICES:
        a.add_word(needle, needle)
    a.make_automaton()
    return a, {k: re.compile(v, re.I) for k, v in NOTICES.items()}


def _is_comment(line: str) -> bool:
    return line.startswith(("//", "#", "/*", "*", "<!--", '"""', "'''"))


def comment_ends(text: str) -> str:
    """The comment lines at the head and at the foot of a text, a blank line between; directives such as 'use strict' and imports may stand among them."""
    lines = text.split("\n")
    head, block = 0, ""
    for line in lines:
        bare = line.strip("\ufeff \t\r")
        if block:
            block = "" if block in bare else block
        elif bare.startswith("/*"):
            block = "" if "*/" in bare[2:] else "*/"
        elif bare[:3] in ('"""', "'''"):
            block = "" if bare[:3] in bare[3:] else bare[:3]
        elif bare and not _is_comment(bare) and not _PREAMBLE.match(bare):
            break
        head += 1
    foot = len(lines)
    while foot > head and ((bare := lines[foot - 1].strip("\ufeff \t\r")) == "" or _is_comment(bare) or bare.endswith("*/")):
        foot -= 1
    return "\n".join([*lines[:head], "", *lines[foot:]])


def has_notice(text: str) -> bool:
    """Whether a comment line at the head or the foot of the text says that a tool made the file."""
    automaton, confirm = _automaton()
    low = comment_ends(text).lower()
    if not low.isascii():
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in comment_ends(text))
    for end, needle in automaton.iter(low):
        a, b = low.rfind("\n", 0, end) + 1, low.find("\n", end)
        line = low[a : b if b >= 0 else len(low)].strip("\ufeff \t\r")
        if _is_comment(line) and confirm[needle].search(re.sub(r"^[/*#!<>\-\s\"']+", "", line) if needle == "generated file" else line):
            return True
    return False


def path_reason(path: str | None) -> str | None:
    path = path or ""
    return "vendored" if VENDORED.search(path) else "generated" if GENERATED.search(path) else "built" if BUILT.search(path) else None


def code_only(text: str, python: bool) -> str:
    """The text without comments and with every string (and regular expression) as an empty one."""
    return (_PYTHON_TEXT if python else _SCRIPT_TEXT).sub(lambda m: "" if m[1] is not None else '""', text.removeprefix("﻿"))


class _TokenIds(dict):
    """64-bit ids of tokens; forgets all once there are too many."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = i = xxhash.xxh3_64_intdigest(token)
        return i


_token_ids = _TokenIds()


def shingles(bare: str) -> np.ndarray:
    """Hashes of the runs of five tokens of code without comments and string contents."""
    ids = np.array([_token_ids[t] for t in _TOKEN.findall(bare)], dtype=np.uint64)
    return np.unique(window_hashes(ids, SHINGLE))


def _package_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        own = [np.sort(shingles(code_only(t, lang == "python")).view(np.int64)) for t, lang in zip(pdf["release_text"], pdf["language"])]
        yield pdf[["package"]].assign(shingles=own)


class _Packages:
    """The known packages' shingles, to be searched inside a task."""

    def __init__(self, names: list[str], sets: list[np.ndarray]):
        self.names, self.sizes = names, [len(x) for x in sets]
        every = np.concatenate(sets).view(np.uint64) if sets else np.empty(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], np.repeat(np.arange(len(names)), self.sizes)[order]

    def most_similar(self, own: np.ndarray) -> str | None:
        if not len(own) or not len(self.every):
            return None
        low, high = np.searchsorted(self.every, own), np.searchsorted(self.every, own, side="right")
        hits = np.concatenate([self.owner[a:b] for a, b in zip(low, high) if b > a] or [np.empty(0, dtype=np.int64)])
        if len(hits) < SIMILAR * len(own) / 2:
            return None
        common = np.bincount(hits, minlength=len(self.names))
        alike = [common[i] / (len(own) + self.sizes[i] - common[i]) for i in np.flatnonzero(common)]
        best = np.flatnonzero(common)[int(np.argmax(alike))]
        return self.names[best] if max(alike) >= SIMILAR else None


def _reasons(known):
    """Reasons of files; without known packages (a broadcast), the shingles of those that have no other reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, path, language in zip(pdf["text"], pdf["path"], pdf["language"]):
                python = language == "python"
                reason = pkg = own = None
                if language in ("typescript", "javascript", "python") and text.strip():
                    reason = "notice" if has_notice(text) else path_reason(path)
                    if reason is None:
                        bare = code_only(text, python)
                        if _DATA[python].fullmatch(bare):
                            reason = "data"
                        elif not python and len(bare) >= 150 and len(re.findall(r"\s", bare)) < LEAST_SPACE * len(bare):
                            reason = "minified"
                        elif known is None:
                            own = np.sort(shingles(bare).view(np.int64))
                        elif pkg := known.value.most_similar(shingles(bare)):
                            reason = "package"
                    if (reason is not None or own is not None) and valid_for(text, language, path) is not True:
                        reason, own = reason and "unparsed", None
                out.append((reason, pkg, own))
            found = pdf[["file_id", "repo", "path", "language"]].assign(reason=[r for r, _, _ in out], package=[p for _, p, _ in out])
            yield found if known is not None else found.assign(shingles=[o for _, _, o in out])

    return run


def similar_sets(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(id, package): of each left set (id, shingles) the right one (package, shingles) of the greatest Jaccard similarity of at least `least`; ties by smaller name.

    Sets are sorted arrays of distinct hashes. Two sets as similar as that have one of the first n - ceil(least n) + 1 hashes of
    each in common, so only those are joined; candidates are then compared as a whole.
    """

    def first(c: str) -> Column:
        return F.explode(F.slice(c, F.lit(1), F.size(c) - F.ceil(F.size(c) * least).cast("int") + 1))

    left, right = left.where(F.size("shingles") > 0), right.where(F.size("shingles") > 0)
    heads = cut(right.select("package", first("shingles").alias("h")), "heads")
    by_hash = cut(heads.groupBy("h").agg(F.count("*").alias("n"), F.collect_list("package").alias("packages")), "heads")
    met = by_group(left.select("id", first("shingles").alias("h")), by_hash).select("id", F.explode("packages").alias("package")).distinct()
    both = met.join(left, "id").join(right.withColumnRenamed("shingles", "theirs"), "package")
    common = F.size(F.array_intersect("shingles", "theirs"))
    alike = both.select("id", "package", (common / (F.size("shingles") + F.size("theirs") - common)).alias("alike")).where(F.col("alike") >= least)
    return alike.groupBy("id").agg(F.min(F.struct((-F.col("alike")).alias("alike"), "package"))["package"].alias("package"))


def provenance(files: DataFrame, packages: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """(file_id, repo, path, language, reason, package, by_hand), one row per row of files with a text.

    reason: notice, vendored, generated, built, minified, data or package for files that nobody wrote by hand in that
    repository; unparsed for such files that don't parse; null for hand-written ones. Only
    TypeScript, JavaScript and Python files can have a reason. by_hand is true where reason is null or
    unparsed. Rows with null text are left out. Up to `most_broadcast` shingles of the packages (they are counted first) are broadcast and
    compared inside the tasks; beyond that files and packages are joined by shingle.
    """
    spark = files.sparkSession
    rows = packages.where("release_text is not null and pkg_name is not null").select(F.col("pkg_name").alias("package"), F.lower("language").alias("language"), "release_text")
    sets = cut(rows.mapInPandas(_package_shingles, "package string, shingles array<bigint>").distinct(), "packages")
    language = code_language(F.col("language"), F.col("path"))
    own = files.where("text is not null").select("file_id", "repo", "path", language.alias("language"), "text")
    schema = "file_id bigint, repo string, path string, language string, reason string, package string"
    if (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= most_broadcast:
        few = sets.orderBy("package").collect()
        known = spark.sparkContext.broadcast(_Packages([r["package"] for r in few], [np.array(r["shingles"], dtype=np.int64) for r in few]))
        found = own.mapInPandas(_reasons(known), schema)
    else:
        looked = cut(own.mapInPandas(_reasons(None), f"{schema}, shingles array<bigint>").withColumn("id", F.monotonically_increasing_id()), "looked")
        best = similar_sets(looked.where("shingles is not null").select("id", "shingles"), sets).withColumnRenamed("package", "copied")
        found = looked.join(best, "id", "left").withColumn("package", F.col("copied")).withColumn("reason", F.when(F.col("copied").isNotNull(), "package").otherwise(F.col("reason")))
        found = found.select("file_id", "repo", "path", "language", "reason", "package")
    return found.withColumn("by_hand", F.col("reason").isNull() | (F.col("reason") == "unparsed"))
