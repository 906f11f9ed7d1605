"""Source files to chunks, one per top-level declaration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, pieces_at, split_positions

#: How a top-level declaration begins: at the left edge of its line.
BOUNDARY = r"(?:export[^\S\n]+)?(?:default[^\S\n]+)?(?:abstract[^\S\n]+)?(?:async[^\S\n]+)?(?:function\b|class\b|interface\b|enum\b|type[^\S\n]+\w+|(?:const|let|var)[^\S\n]+\w+[^\S\n]*=[^\S\n]*(?:async[^\S\n]*)?\(|def\b)"
#: A list of imported names, over several lines or one.
IMPORTED = r"import(?:\s+type)?\s+(?:\w+\s*,\s*)?\{([^{}]*)\}\s*from\b"
IMPORT = r"(?m)^import\b(?:[^;'\"]*?\bfrom)?\s*['\"][^'\"\n]*['\"]|^import [^;\n]*"
NAME = r"(?:function\s*\*?|class|interface|enum|type|const|let|var|def)\s+([\w$]+)"


def symbol_type(first_line: Column) -> Column:
    return F.when(first_line.rlike(r"\b(?:function|def)\b|=\s*(?:async\s*)?\("), "function").when(first_line.rlike(r"\bclass\b"), "class").when(first_line.rlike(r"\b(?:interface|enum|type)\b"), "other").otherwise("module")


def imported_names(text: Column) -> Column:
    """All names that import lists of the text take over, under the names they have in their modules."""
    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IMPORTED), 1), lambda x: F.split(x, ",")))
    bare = F.transform(names, lambda n: F.regexp_extract(n, r"^\s*(?:type\s+)?(\w+)(?:\s+as\s+\w+)?\s*$", 1))
    return F.filter(bare, lambda n: n != "")


def node_symbol_type(node: Column) -> Column:
    """Symbol type of a syntax node's type."""
    return F.when(node.contains("function"), "function").when(node.contains("class"), "class").when(node == "method_definition", "method").when(node.contains("declaration"), "module").otherwise("other")


def chunk_code(files: DataFrame, id_col: str = "file_id", text_col: str = "text", cut: Callable[[Column], Column] = lambda text: pieces_at(text, BOUNDARY)) -> DataFrame:
    """(id_col, chunk_id, symbol_type, symbol_name, start_line, end_line, chunk): runs of lines from one declaration to the next.

    What stands before the first declaration is a chunk of type module named `<module>`. Lines are 0-based; blank chunks
    are dropped; null texts give no rows. `cut` can be replaced by a parser's cut: an array of (k, piece, start_line, end_line). In the
    row: nothing is shuffled.
    """
    rows = files.where(F.col(text_col).isNotNull()).select(id_col, content_hash(F.col(text_col)).alias("hash"), F.explode(cut(F.col(text_col))).alias("p"))
    line = F.regexp_extract("p.piece", r"\A[^\n]*", 0)
    headed = rows.where(F.col("p.piece").rlike(r"\S")).select(id_col, "hash", "p", F.when((F.col("p.k") > 0) | line.rlike(rf"\A{BOUNDARY}"), line).alias("first"))
    name = F.when(F.col("first").isNull(), "<module>").otherwise(F.coalesce(F.nullif(F.regexp_extract("first", NAME, 1), F.lit("")), F.lit("<anonymous>")))
    kind = F.when(F.col("first").isNull(), "module").otherwise(symbol_type(F.col("first")))
    named = headed.withColumn("symbol_name", name).withColumn("symbol_type", kind)
    start = F.col("p.start_line")
    return named.select(id_col, F.concat_ws("-", "hash", start.cast("string"), "symbol_name").alias("chunk_id"), "symbol_type", "symbol_name", start.alias("start_line"), F.col("p.end_line").alias("end_line"), F.col("p.piece").alias("chunk"))


#: How a method begins, one step inside its class.
METHOD = r"(?:  |\t)(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)[^\S\n]+)*\*?[\w$#]+[^\S\n]*(?:<[^>\n]*>)?\([^\n]*\{[^\S\n]*(?:\n|\z)|(?:  |\t)  (?:async[^\S\n]+)?def[^\S\n]+\w+"
_NO_METHOD = r"^\s*(?:if|for|while|switch|catch|return|function|do|else|with)\b"
METHOD_NAME = r"([\w$#]+)[^\S\n]*(?:<[^>\n]*>)?\("


def code_units(files: DataFrame, id_col: str = "file_id", text_col: str = "text", imports: bool = True, most: int = 2000, ratio: float = 0.15) -> DataFrame:
    """(id_col, chunk_id, symbol_type, symbol_name, start_line, end_line, chunk): declarations and methods as chunks of their own.

    Every top-level declaration is a chunk (a class with all its methods), and every method of a class once more. A declaration goes on over lines
    that are indented, blank or begin with a closing bracket, a method over lines that are so one step further in; what stands between declarations is left
    out. With imports, the file's import statements stand before each chunk, which its lines don't reflect. Chunks of more than `most` characters are
    cut into windows named `X (part k)` under ids of their own (see split_positions). Null texts give no rows. In the row: nothing is shuffled.
    """
    text = F.col(text_col)
    prefix = F.array_join(F.regexp_extract_all(text, F.lit(IMPORT), 0), "\n")
    rows = files.where(text.isNotNull()).select(id_col, content_hash(text).alias("hash"), prefix.alias("prefix"), F.explode(pieces_at(text, BOUNDARY)).alias("p"))
    body = rf"\A{BOUNDARY}[^\n]*(?:\n(?:[}}\])][^\n]*|[^\S\n][^\n]*|)(?=\n|\z))*"
    own = rows.where(F.col("p.piece").rlike(rf"\A{BOUNDARY}")).withColumn("unit", F.regexp_replace(F.regexp_extract("p.piece", body, 0), r"\s+\z", ""))
    first = F.regexp_extract("unit", r"\A[^\n]*", 0)
    name = F.coalesce(F.nullif(F.regexp_extract(first, NAME, 1), F.lit("")), F.lit("<anonymous>"))
    declared = own.select(id_col, "hash", "prefix", symbol_type(first).alias("symbol_type"), name.alias("symbol_name"), F.col("p.start_line").alias("start_line"), "unit")
    inner = declared.where("symbol_type = 'class'").select(id_col, "hash", "prefix", F.col("start_line").alias("from"), F.explode(pieces_at(F.col("unit"), METHOD)).alias("p")).where("p.k > 0")
    goes_on = r"\A[^\n]*(?:\n(?:(?:  |\t)(?:  )?[}\])][^\n]*|(?:  |\t)[^\S\n][^\n]*|)(?=\n|\z))*"
    line = F.regexp_extract("p.piece", r"\A[^\n]*", 0)
    inner = inner.where(~line.rlike(_NO_METHOD)).withColumn("unit", F.regexp_replace(F.regexp_extract("p.piece", goes_on, 0), r"\s+\z", ""))
    methods = inner.select(id_col, "hash", "prefix", F.lit("method").alias("symbol_type"), F.coalesce(F.nullif(F.regexp_extract(line, METHOD_NAME, 1), F.lit("")), F.lit("<anonymous>")).alias("symbol_name"), (F.col("from") + F.col("p.start_line")).alias("start_line"), "unit")
    units = declared.unionByName(methods)
    lines = F.length("unit") - F.length(F.replace("unit", F.lit("\n"), F.lit("")))
    headed = F.when((F.col("prefix") != "") & F.lit(imports), F.concat("prefix", F.lit("\n\n"), "unit")).otherwise(F.col("unit"))
    ids = F.concat_ws("-", "hash", F.col("start_line").cast("string"), "symbol_name")
    whole = units.select(id_col, ids.alias("chunk_id"), "symbol_type", "symbol_name", "start_line", (F.col("start_line") + lines).alias("end_line"), headed.alias("chunk"))
    part = lambda n, c, x: F.struct(n.alias("n"), c.alias("c"), x.alias("x"))
    windows = F.transform(
        split_positions(F.length("chunk"), most, ratio),
        lambda at, k: part(F.concat("symbol_name", F.lit(" (part "), (k + 1).cast("string"), F.lit(")")), F.concat("chunk_id", F.lit("-part"), k.cast("string")), F.substring("chunk", at + 1, F.lit(most))),
    )
    parts = F.when(F.length("chunk") > most, windows).otherwise(F.array(part(F.col("symbol_name"), F.col("chunk_id"), F.col("chunk"))))
    return whole.withColumn("p", F.explode(parts)).select(id_col, F.col("p.c").alias("chunk_id"), "symbol_type", F.col("p.n").alias("symbol_name"), "start_line", "end_line", F.col("p.x").alias("chunk"))
