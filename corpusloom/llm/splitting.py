"""Splitting oversized texts at natural boundaries.

Method: agglomerative merging. A text is cut into atomic segments; adjacent pairs wait in a heap by the strength of
the boundary between them, and the weakest boundaries are merged first while the combined size plus the
overlap stays under the limit. What is left are the strongest boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?;:。！？])\s+")
_SPACE = re.compile(r"\s+")


def _parts(text: str, start: int, end: int, most: int, level: int = 0) -> list[tuple[int, float]]:
    """(start, strength of the boundary before it) of segments of at most `most` characters of text[start:end]."""
    if end - start <= most:
        return [(start, 0.0)]
    if level == 2:  # no natural place: anywhere but within a line end
        out, at = [], start
        while at < end:
            out.append((at, 0.0))
            at += most
            if most > 1 and at < end and text[at] == "\n" and text[at - 1] == "\r":
                at -= 1
        return out
    places = [m.end() for m in (_SENTENCE, _SPACE)[level].finditer(text, start, end) if start < m.end() < end]
    out = []
    for a, b in zip([start, *places], [*places, end]):
        inner = _parts(text, a, b, most, level + 1)
        out += [(a, (2.0, 1.0)[level] if a > start else 0.0), *inner[1:]]
    return out


def boundaries(text: str, most: int) -> list[tuple[int, float]]:
    """Starts of atomic segments with the strength of the boundary before each: lines, or parts of long lines.

    An empty line, a line that opens or heads something, and a return to less indentation are strong.
    """
    lines = text.splitlines(keepends=True) if "\n" not in text else re.findall(r"[^\n]*\n|[^\n]+", text)
    out: list[tuple[int, float]] = []
    at, blank, before = 0, False, 0
    for line in lines:
        body = line.strip()
        indent = len(line) - len(line.lstrip(" \t"))
        strength = 3.0
        if body:
            strength += 4.0 / (1 + indent)  # the further left, the more natural
            strength += 5.0 * blank + 1.0 * (indent < before)
            strength += 6.0 * body.startswith("#") * (indent == 0) + 2.0 * bool(re.match(r"(?:export|function|class|def|async|interface|/\*\*|@)\b|/\*\*|@", body))
            strength -= 3.0 * body.startswith(("}", ")", "]", "else", "catch", "finally", "except", "elif", "* ", "*/"))
            before = indent
        else:
            strength = 2.5
        pieces = _parts(text, at, at + len(line), most)
        out += [(pieces[0][0], max(0.1, strength)), *pieces[1:]]
        blank = not body
        at += len(line)
    return out


def split_text(text: str, most: int = 2000, overlap: int = 300) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most `most` characters that cover the text; each begins `overlap` characters before
    the end of the last one (or as far as the text goes). A text within the limit is one piece, an empty one none."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and below the limit")
    n = len(text)
    if n <= most:
        return [(0, n)] if n else []
    room = most - overlap
    marks = boundaries(text, room)
    starts = [s for s, _ in marks] + [n]
    count = len(marks)
    after = list(range(1, count + 1))  # the next segment that is still a head
    head = [True] * count
    prior = list(range(-1, count - 1))
    end = starts[1:]
    heap = [(marks[i][1], end[i] - starts[i - 1], i) for i in range(1, count)]
    heapq.heapify(heap)
    while heap:
        strength, size, i = heapq.heappop(heap)
        if not head[i]:
            continue
        p = prior[i]
        now = end[i] - starts[p]
        if now != size:  # the pair has grown since
            if now <= (most if starts[p] == 0 else room):
                heapq.heappush(heap, (strength, now, i))
            continue
        if now > (most if starts[p] == 0 else room):
            continue
        head[i] = False
        end[p] = end[i]
        nxt = after[p] = after[i]
        if nxt < count:
            prior[nxt] = p
            heapq.heappush(heap, (marks[nxt][1], end[nxt] - starts[p], nxt))
        if p > 0:
            heapq.heappush(heap, (marks[p][1], end[p] - starts[prior[p]], p))
    cores = [(starts[i], end[i]) for i in range(count) if head[i]]
    return [(max(0, a - overlap), b) for a, b in cores]


PIECE_COLUMNS = "piece int, char_start int, char_end int, line_from int, line_to int, piece_text string"


def _split(most: int, overlap: int, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, origin = [], []
            for k, text in enumerate(pdf["text"]):
                line = at = 0
                for piece, (a, b) in enumerate(split_text(text, most, overlap)):
                    line += text.count("\n", at, a)
                    at = a
                    rows.append((piece, a, b, line, line + text.count("\n", a, b - 1), text[a:b]))
                    origin.append(k)
            out = pd.DataFrame(rows, columns=["piece", "char_start", "char_end", "line_from", "line_to", "piece_text"])
            kept = pdf[keep].iloc[origin].reset_index(drop=True)
            yield pd.concat([kept, out], axis=1)

    return run


def split_oversized(chunks: DataFrame, most: int = 2000, overlap: int = 300) -> DataFrame:
    """Every row with a text of more than `most` characters as pieces:
    (chunk_id, repo, path, language, symbol_type, symbol_name, file_hash, piece, pieces' char_start and char_end, start_line, end_line, text).

    Lines are counted from the row's start_line (null stays null). Null and shorter texts give no row;
    repeated rows are split each for itself; other columns are ignored. One pass, no shuffle.
    """
    keep = ["chunk_id", "repo", "path", "language", "symbol_type", "symbol_name", "file_hash", "start_line"]
    long = chunks.where(F.length("text") > most).select(*keep, "text")
    types = dict(long.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", " + PIECE_COLUMNS
    cut = long.mapInPandas(_split(most, overlap, keep), schema)
    return cut.select(
        *keep[:-1], "piece", "char_start", "char_end",
        (F.col("start_line") + F.col("line_from")).alias("start_line"), (F.col("start_line") + F.col("line_to")).alias("end_line"), F.col("piece_text").alias("text"),
    )
