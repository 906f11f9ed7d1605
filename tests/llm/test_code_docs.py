from __future__ import annotations

import pytest

from corpusloom.llm.code_docs import documented_functions, prose

SCHEMA = "chunk_id string, repo string, path string, language string, symbol_type string, symbol_name string, text string, comment string, f int"
GOOD = "Returns the nearest bucket for a given key."
CASES = [
    (f"/** {GOOD} */\nfunction f(a) {{}}", "js", True),
    (f"/**\n * {GOOD}\n *\n * @param a thing\n */\n// eslint-disable-next-line no-x\nexport function f(a) {{}}", "js", True),
    (f"// ---- part ----\n// {GOOD}\nfunction f(a) {{}}", "js", True),
    ("// ---- part of the long module text ----\nfunction f(a) {}", "js", False),
    ("/**\n * @param a the nearest bucket for a given key\n * @returns the thing that was asked for\n */\nfunction f(a) {}", "js", False),
    (f"/**\n * @description {GOOD}\n */\nfunction f(a) {{}}", "js", True),
    (f"/** {GOOD} */\nconst x = 1;\nfunction f(a) {{}}", "js", False),
    (f"/** {GOOD} */\n\nfunction f(a) {{}}", "js", False),
    (f"function f(a) {{\n  // {GOOD}\n}}", "js", False),
    (f"function f(a) {{\n  const s = '/** {GOOD} */';\n}}", "js", False),
    ("// TODO: write a proper description of this function one day\nfunction f(a) {}", "js", False),
    ("// const a = g(parser, 44);\n// if (!a) return null;\nfunction f(a) {}", "js", False),
    ("/** eslint-disable-next-line */\nfunction f(a) {}", "js", False),
    (f'@cached(x=1)\ndef f(a: int = (1), *b) -> int:\n    """{GOOD}\n\n    Args:\n        a: thing\n    """\n', "py", True),
    ('def f(a):\n    """\n    Args:\n        a: the nearest bucket for a given key\n    """\n', "py", False),
    (f'def f(a):\n    x = """{GOOD}"""\n', "py", False),
    (f"# {GOOD}\n@cached\ndef f(a):\n    pass\n", "py", True),
    ("def f(a):\n    ':param a: the nearest bucket for a given key'\n", "py", False),
    ("", "py", False),
]


@pytest.mark.parametrize("kind", ["js", "py"])
def test_cases(spark, kind):
    rows = [(str(i), None, f"a.{k}", None, "function", "f", t, "x", 1) for i, (t, k, _) in enumerate(CASES) if k == kind]
    got = {r["chunk_id"] for r in documented_functions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {str(i) for i, (_, k, good) in enumerate(CASES) if k == kind and good}


def test_name_words_do_not_count_and_odd_rows(spark):
    text = "/** Sort the big ledger rows quickly. */\nfunction sortTheBigLedger(a) {}"
    rows = [("a", "r", "a.ts", "TypeScript", "method", "sortTheBigLedger", text, "", 1), ("b", "r", "a.ts", None, "method", None, text, "", 1), ("b", "r", "a.ts", None, "method", None, text, "", 1), ("c", "r", None, None, None, "f", text, "", 1), ("d", "r", "a.ts", None, "", "f", text, "", 1), ("e", "r", "a.ts", None, "method", "f", None, "", 1)]
    got = documented_functions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["chunk_id"], r["description"]) for r in got] == [("b", "Sort the big ledger rows quickly.")]
    assert documented_functions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prose_that_ends_in_a_semicolon_is_kept():
    lines = ["hands them to the owner in order. Callers must hold the branch open;", "don't call it before the frame is read;", "return the row that is nearest to the key;", "nearest bucket, see {@link Bucket}"]
    for line in lines:
        assert prose([line]) == line
    for line in ("return artifact.frame;", "const a = g(parser, 44);", "if (!a) return null;", "let a, b, c, d, e;", "gather_channel_merger();", "import a from 'the other part';", "function f(a) {", "}", "buildPromptRecord(header, the, last, one);", "a.b = c and d or e;"):
        assert prose([line]) == ""


def test_function_documented_by_two_lines_the_first_ending_in_a_semicolon(spark):
    text = "// Callers must hold the branch open;\n// flushes later.\nfunction f(a) {}"
    got = documented_functions(spark.createDataFrame([("a", "r", "a.js", None, "function", "f", text, "", 1)], SCHEMA)).collect()
    assert [r["description"] for r in got] == ["Callers must hold the branch open; flushes later."]


def pairs(spark, text, path, name, **options):
    df = spark.createDataFrame([("a", "r", path, None, "function", name, text, "", 1)], SCHEMA)
    return {(r["symbol_name"], r["code"], r["description"]) for r in documented_functions(df, **options).collect()}


def test_every_function_of_a_text_meets_its_nearest_comment(spark):
    inner = "function inner(b) {\n    return /[)}]/.test(b) ? '}' : \"{\";\n  }"
    arrow = "const last = async (a: number): Promise<void> => a + 1;"
    outer = f"function outer(a) {{\n  // Checks whether the text has closing brackets.\n  {inner}\n  return inner(a);\n}}"
    text = f"/** {GOOD} */\n{outer}\nlet x = 1;\n// Adds one to the given number.\n{arrow}\n// This comment belongs to the statement below.\nlet y = 2;\nfunction bare() {{}}\n"
    assert pairs(spark, text, "a.ts", "outer") == {("outer", outer, GOOD)}
    assert pairs(spark, text, "a.ts", "outer", nested=True) == {("outer", outer, GOOD), ("inner", inner, "Checks whether the text has closing brackets."), ("last", arrow, "Adds one to the given number.")}
    assert pairs(spark, text, "a.ts", "bare") == set()


def test_python_functions_end_with_their_indentation(spark):
    inner = f'def inner(c):\n        """{GOOD}"""\n        return c'
    outer = f"def outer(a,\n          b=(1, 2)):\n    # Counts all rows of the table twice.\n    {inner}\n\n    return 3"
    text = f"# Joins both sides of the given pair.\n{outer}\n\nx = 1\n"
    assert pairs(spark, text, "a.py", "outer", nested=True) == {("outer", outer, "Joins both sides of the given pair."), ("inner", inner, f"Counts all rows of the table twice.\n{GOOD}")}
