from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.splitting import split_oversized, split_text

TEXT = st.text(alphabet="ab .\n\r\t{}#é😀", max_size=400)


@given(TEXT, st.integers(2, 60), st.integers(0, 30))
@settings(deadline=None, max_examples=300)
def test_pieces_cover_the_text(text, most, overlap):
    if overlap >= most:
        with pytest.raises(ValueError):
            split_text(text, most, overlap)
        return
    pieces = split_text(text, most, overlap)
    assert all(0 < b - a <= most for a, b in pieces)
    assert "".join(text[before:b] for before, (_, b) in zip([0, *[b for _, b in pieces]], pieces)) == text
    assert all(c == max(0, b - overlap) for (_, b), (c, _) in zip(pieces, pieces[1:]))


def test_cuts_between_functions():
    unit = "export function f() {\n  const a = 1;\n  return a;\n}\n\n"
    assert all(b % len(unit) == 0 for _, b in split_text(unit * 60, 600, 50))


def test_rows_and_lines(spark):
    schema = "chunk_id string, repo string, path string, language string, symbol_type string, symbol_name string, file_hash string, start_line int, end_line int, text string, piece string"
    text = "".join(f"line {i} of the text\r\n" for i in range(300)) + "x" * 3000
    rows = [("a", None, None, None, None, None, "h", 10, None, text, "x"), ("b", "r", "p", "l", "", "n", "h", None, 3, text, "x"), ("c", "r", "p", "l", "t", "n", "h", 0, 0, None, "x"), ("d", "r", "p", "l", "t", "n", "h", 0, 0, "short", "x")]
    out = split_oversized(spark.createDataFrame([*rows, rows[0]], schema)).orderBy("piece").collect()
    a = [r for r in out if r["chunk_id"] == "a"][::2]
    assert {r["chunk_id"] for r in out} == {"a", "b"}
    assert all(r["text"] == text[r["char_start"] : r["char_end"]] and len(r["text"]) <= 2000 for r in out)
    assert all(r["start_line"] == 10 + text[: r["char_start"]].count("\n") and r["end_line"] == 10 + text[: r["char_end"] - 1].count("\n") for r in a)
    assert all(r["start_line"] is None for r in out if r["chunk_id"] == "b")
    assert split_oversized(spark.createDataFrame([], schema)).count() == 0
