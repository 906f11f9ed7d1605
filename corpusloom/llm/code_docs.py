"""Functions paired with their documentation.

Method: comment spans and function spans are extracted independently of one another, together with what else stands
in the text; an as-of interval join gives each function the nearest eligible comment that ends before it,
and rejects it if a statement or an empty line lies between. Decorators and lint directives don't count as
statements. Of the joined comment (and, in Python, the docstring) only prose is kept: no tags, parameter
blocks, rulers, directives, disabled code or notes that documentation is missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import code_language

_TOKEN = {
    False: re.compile(r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S),
    True: re.compile(r"(?P<c>#[^\n]*)|'''(?:\\.|.)*?(?:'''|\Z)|\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?", re.S),
}
_SCRIPT_FUNCTION = re.compile(
    r"^[ \t]*(?:(?:export|default|async|static|public|private|protected|abstract|override|readonly|declare)\s+)*"
    r"(?:function\s*\*?\s*(?P<f>[\w$]+)|(?:const|let|var)\s+(?P<v>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\b\s*)?(?:function\b|\(|<|[\w$]+\s*=>)"
    r"|(?:get\s+|set\s+|\*\s*)?(?P<m>[#\w$]+)\s*(?:<[^>\n]*>)?\s*\()",
    re.M,
)
_PYTHON_FUNCTION = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<f>\w+)", re.M)
_DOCSTRING = re.compile(r"\s*(?:#[^\n]*\s*)*[rRuU]?('''|\"\"\"|'|\")(.*?)(?<!\\)\1", re.S)
_DECORATOR = re.compile(r"@[\w.$]+(?:\((?:[^()]|\([^()]*\))*\))?")
# How lint and tool directives begin.
_DIRECTIVE = re.compile(
    r"(?:eslint\b|tslint\b|jshint\b|jslint\b|prettier-ignore|biome-ignore|@ts-|ts-|istanbul\b|c8 ignore|v8 ignore|stylelint\b|noqa\b|pylint\b|flake8\b|type:\s*ignore|mypy:|pyright:|ruff:|isort:|fmt:|yapf:|nosec\b|pragma\b|noinspection\b|deno-lint|region\b|endregion\b|webpack\w+:|cspell:|spellchecker:|sonar|NOSONAR|@formatter)",
    re.I,
)
_RULER = re.compile(r"[\W_]*$|[-=*#~_+/]{3,}.*[-=*#~_+/]{2,}$|[-=*#~_+/]{2,}\s+[^a-z]*\w[\w ]*\s+[-=*#~_+/]{2,}$")
_PENDING = re.compile(
    r"(?:@?todo|fixme|xxx|tbd|hack|wip|placeholder)\b|.*\b(?:to be (?:written|documented|described|done|added)|(?:write|add|missing|needs?|no|lacks?|awaiting|pending|improve|fill in)\s+(?:the\s+|some\s+|proper\s+|a\s+|more\s+|any\s+|real\s+|better\s+)*(?:docs?|documentation|docstrings?|descriptions?|comments?|jsdoc)\b|document(?:ation)?\s+(?:this|me|later|pending|missing|to follow|follows|tbd)|undocumented|not (?:yet )?documented|(?:please\s+)?(?:describe|explain|document)\s+(?:this|me|here)\b|docs? (?:later|pending|missing|to follow|coming))",
    re.I,
)
_CODE_START = re.compile(r"(?:const|let|var|import|export|throw)\b|(?:else )?(?:if|for|while|switch|catch)\s*\(")
_CODE_MARK = re.compile(r"[=\[\]{}<>`$]|\w\(|![\w(]|&&|\|\|")
_PLAIN_WORD = re.compile(r"(?<![\w$.])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w$(]|\.\w)")
_INLINE_TAG = re.compile(r"\{@\w+[^{}]*\}")
_CODE = re.compile(
    r".*[;{}]\s*$|(?:const|let|var|return|import|export|def|class|function|await|throw|elif|else:|try:|raise|yield|del)\b.*[=(){}\[\]:]|(?:if|for|while|with|switch|catch|except)\b\s*\(?.*[:{)]\s*$|[\w$.\[\]]+\s*[-+*/|&]?=(?!=)\s*\S+.*|[\w$.]+\([^)]*\)\s*$|[\w$]+(?:\.[\w$]+)+\(.*|@\w+\("
)
_PROSE_TAG = re.compile(r"[@\\](?:description|summary)\b:?\s*(.*)$", re.I)
_TAG = re.compile(r"@\w|:(?:param|parameter|arg|argument|key|keyword|type|returns?|rtype|raises?|except|exception|yields?|ytype|var|ivar|cvar|meta)\b[^:]*:", re.I)
_BLOCK = re.compile(r"(?:Args|Arguments|Parameters|Params|Keyword Args|Keyword Arguments|Other Parameters|Returns?|Raises|Yields?|Attributes)\s*:?\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
SPANS = "struct<comments:array<struct<start:int,end:int,text:string>>,functions:array<struct<start:int,end:int,name:string,docstring:string,own:boolean>>,others:array<struct<start:int,end:int>>>"
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "function", "await", "typeof", "super"}
_PATTERN = re.compile(r"((?:[(,=:\[!&|?{};+\n]|\breturn)\s*)/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_PYTHON_HEAD = re.compile(r"\((?:[^()\"'#]|\((?:[^()]|\([^()]*\))*\)|'[^'\n]*'|\"[^\"\n]*\"|#[^\n]*)*\)[^:\n]*:")
_BODY = re.compile(r"\s*(?::[^{};=]*(?:\{[^{}]*\}[^{};=]*)*?)?\s*(?:=>\s*)?\{")
_EXPRESSION_BODY = re.compile(r"\s*(?::[^{};=]*)?\s*=>")


def _content(comment: str) -> list[str]:
    """Lines of a comment without its marks."""
    if comment.startswith("/*"):
        body = comment[2:-2] if comment.endswith("*/") else comment[2:]
        return [re.sub(r"^[ \t]*\*+(?!/)|^[!*]+", "", line).strip() for line in body.replace("\r", "").split("\n")]
    return [re.sub(r"^\s*(?://+|#+)[!:]?", "", line).strip() for line in comment.replace("\r", "").split("\n")]


def _comments(text: str, tokens: list[re.Match]) -> list[tuple[int, int, str]]:
    """(start, end, text) of all comments; line comments on successive lines are one, lint directives of one line none."""
    found: list[list] = []
    for t in tokens:
        if not t.lastgroup:
            continue
        c = t["c"]
        block = c.startswith("/*")
        between = text[found[-1][1] : t.start()] if found else ""
        if block or not found or not found[-1][3] or between.strip() or between.count("\n") != 1:
            found.append([t.start(), t.end(), c, not block])
        else:  # the next line of a run of line comments
            found[-1][1], found[-1][2] = t.end(), found[-1][2] + "\n" + c
    kept = []
    for a, b, c, _ in found:
        lines = [x for x in _content(c) if x]
        if not lines or not all(_DIRECTIVE.match(x) for x in lines) or c.startswith("/*"):
            kept.append((a, b, c))
    return kept


def _heads(text: str, tokens: list[re.Match], python: bool) -> list[re.Match]:
    """Where a function may begin: outside of comments and strings."""
    inside = iter([*((m.start(), m.end()) for m in tokens), (len(text) + 1, len(text) + 1)])
    lo, hi = next(inside)
    found = []
    for m in (_PYTHON_FUNCTION if python else _SCRIPT_FUNCTION).finditer(text):
        at = m.end() - 1
        while hi <= at:
            lo, hi = next(inside)
        if not lo <= at < hi and m.group(m.lastgroup) not in _CONTROL:
            found.append(m)
    return found


def _closing(bare: str, at: int) -> int:
    """Just behind the bracket that closes the one at `at`; -1 if there is none. bare has no brackets in comments and strings."""
    depth = 0
    for m in re.compile(r"[(\[{]|[)\]}]").finditer(bare, at):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.end()
    return -1


def _end(bare: str, head: re.Match, python: bool) -> int:
    """The end of the function with this head, or -1 if no body follows."""
    if python:
        indent = len(head[0]) - len(head[0].lstrip())
        opened = bare.find("(", head.end())
        at = bare.find("\n", _closing(bare, opened) if opened >= 0 else head.end())
        end = len(bare) if at < 0 else at
        for m in re.compile(r"\n([ \t]*)([^\s][^\n]*)").finditer(bare, max(at, 0) if at >= 0 else len(bare)):
            if len(m[1]) <= indent:
                break
            end = m.end()
        return end
    opened = bare.find("(", head.start(head.lastgroup))
    if head.lastgroup == "v" and (arrow := re.compile(r"[^\n(]*=>").match(bare, head.end(head.lastgroup))):
        closed = arrow.end()
        at = re.compile(r"\s*\{").match(bare, closed)
    else:
        closed = _closing(bare, opened) if opened >= 0 else -1
        if closed < 0:
            return -1
        at = _BODY.match(bare, closed)
        if not at and (arrow := _EXPRESSION_BODY.match(bare, closed)):
            closed = arrow.end()
        elif not at:
            return -1
    if at:
        end = _closing(bare, at.end() - 1)
        return end + (head.lastgroup == "v" and bare.startswith(";", end))
    depth = 0
    for m in re.compile(r"[(\[{]|[)\]}]|;|\n(?!\s*[.?:&|+])").finditer(bare, closed):
        depth += (m[0] in "([{") - (m[0] in ")]}")
        if depth < 0 or depth == 0 and m[0] in ";\n" and bare[closed : m.start()].strip():
            return m.end() if m[0] == ";" else m.start()
    return len(bare)


def spans(text: str, name: str | None, python: bool) -> tuple[list, list, list]:
    """All comments, all functions and all stretches of other text between them, found independently of one another.

    Functions are (start, end, name, docstring, own); own is the one called name or, if there is none, the first. A head without a
    body counts only as the own one.
    """
    tokens = list(_TOKEN[python].finditer(text))
    heads = _heads(text, tokens, python)
    if not heads:
        return [], [], []
    own = next((m for m in heads if name and m.group(m.lastgroup) == name), heads[0])
    blank = [(m.start(), m.end()) for m in tokens]
    bare, at = [], 0
    for a, b in blank:
        bare += [text[at:a], re.sub(r"[^\n]", " ", text[a:b]) if text[a] in "#/" else "_" * (b - a)]
        at = b
    code = "".join([*bare, text[at:]])
    if not python:
        code = _PATTERN.sub(lambda m: m[1] + "_" * (len(m[0]) - len(m[1])), code)
    functions = []
    for m in heads:
        end = _end(code, m, python)
        if end < 0 and m is not own:
            continue
        docstring = None
        if python:
            body = _PYTHON_HEAD.match(text, m.end())
            if body and (d := _DOCSTRING.match(text, body.end())):
                docstring = d[2]
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        functions.append((start, end if end >= 0 else len(text), m.group(m.lastgroup), docstring, m is own))
    comments = _comments(text, tokens)
    # What stands between one comment or function head and the next.
    bounds = sorted([(t.start(), t.end()) for t in tokens if t.lastgroup] + [(f[0], f[0]) for f in functions])
    others, at = [], 0
    for a, b in [*bounds, (len(text), len(text))]:
        gap = text[at:a]
        rest = _DECORATOR.sub("", gap)
        if rest.strip(" \t\r\n\ufeff") or re.search(r"\n[ \t\r]*\n", gap if at else gap.lstrip()):
            others.append((at, a))
        at = b
    return comments, functions, others


def _is_code(line: str) -> bool:
    """Whether a comment line is disabled code; a line of at least four plain words that ends in a semicolon, without a mark or a first word of code, is not."""
    if not _CODE.match(line):
        return False
    return not (line.endswith(";") and not _CODE_START.match(line) and not _CODE_MARK.search(line) and len(_PLAIN_WORD.findall(line)) >= 4)


def prose(lines: list[str], code: bool = True) -> str:
    """What of a comment's lines is prose, joined by spaces."""
    out: list[str] = []
    skipping = False
    for line in lines:
        line = line.strip()
        if not line:
            skipping = False
        elif m := _PROSE_TAG.match(line):
            skipping = False
            out.append(m[1])
        elif _TAG.match(line) or _BLOCK.match(line):
            skipping = True
        elif not (skipping or _DIRECTIVE.match(line) or _RULER.match(line) or _PENDING.match(line) or (code and _is_code(_INLINE_TAG.sub("", line).strip()))):
            out.append(line)
    return " ".join(x for x in out if x)


def describes(description: str, name: str | None, least: int) -> bool:
    """Whether the prose holds at least `least` words besides those of the name."""
    own = {p.lower() for p in _NAME_PART.findall(name or "")} | {(name or "").lower()}
    return sum(w.lower() not in own for w in _WORD.findall(re.sub(r"[\w$]*[a-z][A-Z][\w$]*|\w+_\w+", lambda m: " ".join(_NAME_PART.findall(m[0])), description))) >= least


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, name, python in zip(pdf["text"], pdf["name"], pdf["python"]):
            c, f, o = spans(text, name, bool(python))
            rows.append({"comments": [dict(zip(("start", "end", "text"), x)) for x in c], "functions": [dict(zip(("start", "end", "name", "docstring", "own"), x)) for x in f], "others": [dict(zip(("start", "end"), x)) for x in o]})
        yield pdf.assign(spans=rows)


def _describe(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for name, comment, docstring in zip(pdf["name"], pdf["comment"], pdf["docstring"]):
                parts = [prose(_content(comment))] if comment else []
                parts += [prose(docstring.replace("\r", "").split("\n"))] if docstring else []
                parts = [p for p in parts if describes(p, name, least)]
                kept.append("\n".join(parts) or None)
            yield pdf[["chunk_id", "repo", "path", "language", "name", "code"]].assign(description=kept)

    return run


def asof(comments: Column, at: Column, others: Column) -> Column:
    """The last comment that ends at or before `at`, or null if another span begins between the two."""
    before = F.filter(comments, lambda c: c["end"] <= at)
    last = F.try_element_at(before, F.lit(-1))
    blocked = F.exists(others, lambda o: (o["start"] >= last["end"]) & (o["end"] <= at))
    return F.when(~F.coalesce(blocked, F.lit(True)), last["text"])


def documented_functions(chunks: DataFrame, least_words: int = 4, nested: bool = False) -> DataFrame:
    """(chunk_id, repo, path, language, symbol_name, code, description) of the function and method rows that are documented.

    code is the function from its head to its end. With nested, the documented functions inside a row come out too, each
    under its own name. Rows of other or no symbol_type, without text, or whose documentation is missing or trivial are dropped;
    repeated rows come out once. Other columns are ignored; null names count as names without words.
    """
    language = code_language(F.col("language"), F.col("path"))
    python = F.when(language.isin("python"), True).when(language.isin("javascript", "typescript"), False).otherwise(F.col("text").rlike(r"(?m)^\s*(async +)?def +\w+.*:\s*(#.*)?$"))
    own = chunks.where(F.col("symbol_type").isin("function", "method") & F.col("text").isNotNull()).select(
        "chunk_id", "repo", "path", language.alias("language"), F.col("symbol_name").alias("name"), "text", python.alias("python")
    )
    schema = f"chunk_id string, repo string, path string, language string, name string, text string, python boolean, spans {SPANS}"
    extracted = own.mapInPandas(_extract, schema)
    # The nearest comment of each function, within the row: no shuffle.
    functions = extracted.withColumn("f", F.explode(F.col("spans.functions") if nested else F.filter("spans.functions", lambda f: f["own"])))
    joined = functions.select(
        "chunk_id", "repo", "path", "language", F.when(F.col("f.own"), F.col("name")).otherwise(F.col("f.name")).alias("name"),
        F.substring("text", F.col("f.start") + 1, F.col("f.end") - F.col("f.start")).alias("code"),
        asof(F.col("spans.comments"), F.col("f.start"), F.col("spans.others")).alias("comment"), F.col("f.docstring").alias("docstring"),
    ).where("comment is not null or docstring is not null")
    described = joined.mapInPandas(_describe(least_words), "chunk_id string, repo string, path string, language string, name string, code string, description string")
    return described.where("description is not null").withColumnRenamed("name", "symbol_name").dropDuplicates(["chunk_id", "repo", "path", "symbol_name", "code"])
