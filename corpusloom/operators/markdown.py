"""Markdown documents to sections and section chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import pieces_at, split_positions, trim_blank

HEADER = r"(#{1,6})[^\S\n]+([^\n\r\x{2028}\x{2029}]+)(?:\n|\z)"


def sections(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, section, title, level, start_line, end_line, content): a section runs from its header to the next one.

    Text before the first header is titled `(document start)`, level 0; sections without content are
    dropped. Lines are 0-based; a header that ends in a carriage return isn't one. Null texts give no rows.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).rlike(rf"\A{HEADER}").cast("int").alias("led"), F.explode(pieces_at(F.col(text_col), HEADER)).alias("p"))
    marks = F.regexp_extract("p.piece", rf"\A{HEADER}", 1)
    headed = rows.select(id_col, "led", "p", marks.alias("marks"))
    title = F.when(F.col("marks") == "", F.lit("(document start)")).otherwise(trim_blank(F.regexp_extract("p.piece", rf"\A{HEADER}", 2)))
    content = trim_blank(F.when(F.col("marks") == "", F.col("p.piece")).otherwise(F.regexp_replace("p.piece", rf"\A{HEADER}", "")))
    out = headed.select(id_col, (F.col("p.k") + F.col("led")).alias("section"), title.alias("title"), F.length("marks").alias("level"), F.col("p.start_line").alias("start_line"), F.col("p.end_line").alias("end_line"), content.alias("content"))
    return out.where(F.length("content") > 0)


def with_header(found: DataFrame) -> DataFrame:
    """Adds `chunk`: the content under its header line."""
    head = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"), F.lit("\n\n"))).otherwise(F.lit(""))
    return found.withColumn("header", head).withColumn("chunk", F.concat("header", "content"))


def pack_paragraphs(found: DataFrame, most: int = 1500, least: int = 100) -> DataFrame:
    """Sections as chunks of about `most` characters, filled paragraph by paragraph; adds (part, name, chunk), and the lines are those of the part.

    A chunk (with a blank line after each paragraph) is closed when the next paragraph would exceed `most` and it holds more than `least` characters;
    each starts with the header, and all but the first are named `(cont.)`. A section within the limit is one chunk; the last chunk of a packed section is kept
    only if it is longer than `least`. Lines are counted as paragraphs with a blank line after each, anew for every part: a part begins at the section's start plus
    the lines of the part before it, so that lines may go back from the third part on; the last part ends with the section. A fold
    inside the row: no shuffle, no Python.
    """
    prepared = with_header(found)
    begin, until = F.col("start_line"), F.col("end_line")
    part = lambda name, chunk, a, b: F.struct(name.alias("name"), chunk.alias("chunk"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    first, more = F.col("title"), F.concat("title", F.lit(" (cont.)"))
    none = F.slice(F.array(part(first, F.lit(""), begin, until)), 1, 0)
    start = F.struct(F.col("header").alias("text"), none.alias("done"), F.lit(0).alias("offset"), F.lit(0).alias("at"))

    def name(state):
        return F.when(F.size(state["done"]) > 0, more).otherwise(first)

    def step(state, paragraph):
        lines = F.size(F.split(paragraph, "\n", -1))
        full = (F.length(state["text"]) + F.length(paragraph) + 2 > most) & (F.length(state["text"]) > least)
        joined = F.concat(F.when(full, F.col("header")).otherwise(state["text"]), paragraph, F.lit("\n\n"))
        closed = F.concat(state["done"], F.array(part(name(state), trim_blank(state["text"]), begin + state["at"], begin + state["at"] + state["offset"])))
        offset = F.when(full, lines).otherwise(state["offset"] + lines + 1)
        return F.struct(joined.alias("text"), F.when(full, closed).otherwise(state["done"]).alias("done"), offset.alias("offset"), F.when(full, state["offset"]).otherwise(state["at"]).alias("at"))

    def finish(state):
        last = trim_blank(state["text"])
        return F.when(F.length(last) > least, F.concat(state["done"], F.array(part(name(state), last, begin + state["at"], until)))).otherwise(state["done"])

    whole = F.array(part(first, F.col("chunk"), begin, until))
    parts = F.when(F.length("chunk") <= most, whole).otherwise(F.aggregate(F.split("content", r"\n\n+"), start, step, finish))
    return _parts(prepared, found, parts)


def _parts(prepared: DataFrame, found: DataFrame, parts: Column) -> DataFrame:
    kept = [c for c in found.columns if c not in ("content", "start_line", "end_line")]
    placed = prepared.select(*kept, F.posexplode(parts).alias("part", "p"))
    return placed.select(*kept, "part", F.col("p.name").alias("name"), F.col("p.a").alias("start_line"), F.col("p.b").alias("end_line"), F.col("p.chunk").alias("chunk"))


def split_sections(found: DataFrame, most: int = 1500, ratio: float = 0.15) -> DataFrame:
    """Sections as windows of `most` characters that overlap by `ratio`, without regard to paragraphs; adds (part, name, chunk).

    The other way of cutting long sections: all parts have the section's lines, and the end of a text may lie in none (see split_positions). A section
    within the limit is one chunk.
    """
    prepared = with_header(found)
    part = lambda name, chunk: F.struct(name.alias("name"), chunk.alias("chunk"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    cont = lambda k: F.when(k > 0, F.concat("title", F.lit(" (cont.)"))).otherwise(F.col("title"))
    windows = F.transform(split_positions(F.length("chunk"), most, ratio), lambda at, k: part(cont(k), F.substring("chunk", at + 1, F.lit(most))))
    return _parts(prepared, found, F.when(F.length("chunk") <= most, F.array(part(F.col("title"), F.col("chunk")))).otherwise(windows))
