"""Column functions over text. Null texts give null (arrays: empty) unless stated otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_]+"
BUCKETS = 30_000
#: White space that is trimmed, words without meaning of their own, marks of opinions and of remarks about an answer.
BLANK = " \t\n\x0b\f\r\u00a0\ufeff"
STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might must shall can
to of in for on with at by from as into through during before after above below between under again further then once here there
when where why how all each few more most other some such no nor not only own same so than too very just and but if or because
until while this that these those it its""".split()
OPINION = r"(?i)(think|believe|feel|suggest|recommend)|(might|could|should|probably|perhaps|maybe)|(in my opinion|i would say|it seems)"
META = r"(?i)^(in summary|to summarize|as mentioned|to clarify|note that)|^(as i said|as noted|as shown|as we can see)|^(let me|i will|i can|i should)"


def trim_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def tokens(text: Column) -> Column:
    """Maximal runs of [a-z0-9_] of the lower-cased text, in order."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the sha256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def term_hash(term: Column) -> Column:
    """Signed 32-bit hash h = 31 h + code of an ASCII term, as BIGINT."""
    codes = F.transform(F.split(term, ""), F.ascii)
    unsigned = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))
    return F.when(unsigned >= 2147483648, unsigned - 4294967296).otherwise(unsigned)


def bucket(term: Column) -> Column:
    return F.abs(term_hash(term)) % BUCKETS


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """The default embedder: counts of the terms' buckets, scaled to length 1 (all zero without terms)."""

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))

    def counted(dims: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.size(F.filter(dims, lambda x: x == d)).cast("double"))
        return bound(sums, scaled)

    return bound(F.transform(tokens(text), lambda t: F.abs(term_hash(t)) % size), counted)


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(dashed, "^-", ""), "-$", ""), 1, 30)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4.0).cast("bigint")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def truncate_lines(text: Column, most: int) -> Column:
    """The first `most` lines, with a note of how many are left out."""
    rows = lines(text)
    rest = F.size(rows) - most
    return F.when(rest > 0, F.concat(F.array_join(F.slice(rows, 1, most), "\n"), F.lit("\n... (truncated, "), rest.cast("string"), F.lit(" more lines)"))).otherwise(text)


def place(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def percent(score: Column) -> Column:
    return F.concat(F.floor(score * 100 + 0.5).cast("int").cast("string"), F.lit("%"))


def format_chunk(path: Column, start: Column, end: Column, language: Column, text: Column, score: Column, most_lines: int = 50, markdown: bool = True) -> Column:
    """A chunk with its place, its first lines and, unless score is null, its relevance, as Markdown or plain text."""
    body = truncate_lines(text, most_lines)
    if markdown:
        parts = [F.concat(F.lit("### "), place(path, start, end)), F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), body, F.lit("\n```")), F.concat(F.lit("*Relevance: "), percent(score), F.lit("*"))]
    else:
        parts = [F.concat(F.lit("--- "), place(path, start, end), F.lit(" ---")), body, F.concat(F.lit("[Relevance: "), percent(score), F.lit("]"))]
    return F.concat_ws("\n", *parts)


def sentences(text: Column) -> Column:
    """The text split after . ! or ? before white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def pieces_at(text: Column, start: str) -> Column:
    """The text cut before every line that begins like the pattern: array of (k, piece, start_line, end_line), lines 0-based.

    The pattern must not cross a line's end. The line end before a cut is left out. In the row: nothing is shuffled.
    """

    def placed(pieces: Column, starts: Column) -> Column:
        def one(k: Column) -> Column:
            piece, last = F.get(pieces, k), k == F.size(pieces) - 1
            end = F.get(starts, k + 1)
            return F.struct(
                k.alias("k"), F.when(last, piece).otherwise(F.substring(piece, F.lit(1), F.length(piece) - 1)).alias("piece"),
                F.get(starts, k).alias("start_line"), F.when(last, end).otherwise(end - 1).alias("end_line"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), one)

    def with_starts(pieces: Column) -> Column:
        ends = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
        starts = F.aggregate(ends, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
        return bound(starts, lambda x: placed(pieces, x))

    return bound(F.split(text, rf"(?<![^\n])(?={start})", -1), with_starts)


def is_verifiable(claim: Column) -> Column:
    """Neither a question nor an opinion nor a remark about the answer itself."""
    return ~(trim_blank(claim).endswith("?") | claim.rlike(OPINION) | claim.rlike(META))


def keywords(text: Column) -> Column:
    """Words of more than two characters outside the stop list; marks inside words are dropped."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def split_positions(length: Column, size: int, ratio: float, whole: bool = False) -> Column:
    """Start offsets of a fixed-size split: windows of `size`, step size - floor(size * ratio), stopping when less than 0.3 size is left.

    A window holds `size` characters, so up to 0.3 size - overlap characters at the end of a text lie in none. With `whole`, one more window
    follows in that case, and every character lies in one. Raises for overlaps that would never end.
    """
    overlap = int(size * ratio)
    if overlap >= 0.3 * size:
        raise ValueError("the overlap must stay below 0.3 of the size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((length - size) / step) if whole else F.floor((length - 0.3 * size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)
