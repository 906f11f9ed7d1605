"""Source files that do not parse.

Method: the languages are ranked by telling tokens, and every file is parsed against all grammars in that order. A file whose own
grammar fails while another one accepts it has a wrong extension or label; failure of all
means corruption (truncation, merge conflicts, damaged text). Markdown accepts anything and so proves nothing. A
grammar that gives up on a text (nested too deeply for it) says nothing, and the file's validity is unknown.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import code_language
from corpusloom.llm.script_grammar import parses as script_parses

#: Tokens that tell a language.
TELLING = {
    "python": "def elif except self None True False pass lambda".split(),
    "typescript": "interface string number boolean any unknown readonly private public protected as".split(),
    "javascript": "const let var function require module exports => ===".split(),
    "json": '": true false null'.split(),
}
_TELLING_TOKEN = re.compile(r'[A-Za-z_]+|=>|===|":')


def ranking(text: str) -> list[str]:
    """The languages by how many of their telling tokens stand in the text."""
    counts = Counter(_TELLING_TOKEN.findall(text))
    return sorted(TELLING, key=lambda name: -sum(counts[t] for t in TELLING[name]))


_JSON = re.compile(r'[ \t\n\r]+|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|(?P<p>[\[\]{},:])')


def _deep_json(text: str) -> bool:
    """Strict JSON of any depth, token by token with a stack of open brackets."""
    opened: list[str] = []
    pos, due = 0, "value"  # value, first (a value or the end of a list), key, begin (a key or the end of an object), colon, after
    while pos < len(text):
        m = _JSON.match(text, pos)
        if not m:
            return False
        pos = m.end()
        kind, token = m.lastgroup, m[0]
        if kind is None:
            continue
        if due in ("value", "first") and (kind in "sv" or token in "[{"):
            if token in ("[", "{"):
                opened.append(token)
                due = "first" if token == "[" else "begin"
            else:
                due = "after"
        elif kind == "s" and due in ("key", "begin"):
            due = "colon"
        elif token == ":" and due == "colon":
            due = "value"
        elif token == "," and due == "after" and opened:
            due = "value" if opened[-1] == "[" else "key"
        elif token == "]" and due in ("after", "first") and opened[-1:] == ["["] or token == "}" and due in ("after", "begin") and opened[-1:] == ["{"]:
            opened.pop()
            due = "after"
        else:
            return False
    return due == "after" and not opened


def _strict_json(text: str) -> bool:
    def refuse(_: str) -> None:
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except RecursionError:
        return _deep_json(text)
    except ValueError:
        return False


def _python(text: str) -> bool | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.encode("utf-8", "surrogatepass"))
        return True
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError):
        return False


GRAMMARS = {
    "typescript": lambda t, markup: script_parses(t, True, markup),
    "javascript": lambda t, markup: script_parses(t, False, markup),
    "python": lambda t, markup: _python(t),
    "json": lambda t, markup: _strict_json(t),
}


def valid_for(text: str, language: str | None, path: str | None = None) -> bool | None:
    """Whether the language's own grammar accepts the text; None for languages without one and where it gives up."""
    if language == "markdown":
        return True
    if language not in GRAMMARS:
        return None
    return (language != "json" and not text.strip("\ufeff \t\r\n")) or GRAMMARS[language](text, (path or "").lower().endswith((".jsx", ".tsx")))


def judge(text: str, language: str | None, path: str | None = None) -> tuple[bool | None, list[str]]:
    """(valid, the languages whose grammars accept the text, the likeliest first); valid is None where it can't be said."""
    if language == "markdown":
        return True, []
    if language not in GRAMMARS:
        return None, []
    if language != "json" and not text.strip("\ufeff \t\r\n"):
        return True, [language]
    rank = ranking(text)
    markup = (path or "").lower().endswith((".jsx", ".tsx"))
    verdicts = {name: GRAMMARS[name](text, markup) for name in rank}
    return verdicts[language], [name for name in rank if verdicts[name]]


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [judge(*x) for x in zip(pdf["text"], pdf["language"], pdf["path"])]
        yield pdf[["file_id", "repo", "path", "language"]].assign(valid=pd.array([v for v, _ in found], dtype="boolean"), accepts=[x for _, x in found])


def checked_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, language, valid, accepts, parses_as, verdict), one row per row of files.

    language is the given one in lower case or else that of the extension. accepts: all languages whose grammars accept the
    text, the likeliest first (empty for Markdown and languages without grammar). verdict: valid, foreign (only
    other languages accept the text, the likeliest is parses_as), corrupt, or unknown (null text, a language
    without grammar, or a text nested too deeply to say; valid is null then). An empty code file is valid, empty JSON is not. One
    pass, no shuffle.
    """
    language = code_language(F.col("language"), F.col("path"))
    rows = files.select("file_id", "repo", "path", language.alias("language"), "text")
    known = rows.where("text is not null").mapInPandas(_judge, "file_id bigint, repo string, path string, language string, valid boolean, accepts array<string>")
    unknown = rows.where("text is null").select("file_id", "repo", "path", "language", F.lit(None).cast("boolean").alias("valid"), F.array().cast("array<string>").alias("accepts"))
    other = F.when(~F.col("valid"), F.get("accepts", F.lit(0)))
    verdict = F.when(F.col("valid").isNull(), "unknown").when(F.col("valid"), "valid").when(F.col("parses_as").isNotNull(), "foreign").otherwise("corrupt")
    return known.unionByName(unknown).withColumn("parses_as", other).withColumn("verdict", verdict)


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, foreign, invalid_rate) over the files of known validity; null repos and languages are groups of their own."""
    checked = checked_files(files).where("valid is not null")
    return checked.groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("verdict") == "foreign").alias("foreign")
    ).withColumn("invalid_rate", F.col("invalid") / F.col("files"))
