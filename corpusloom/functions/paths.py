"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language.
EXTENSIONS = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "json": "json", "md": "markdown"}


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit(""))


def code_language(language: Column, path: Column) -> Column:
    """The language in lower case or, if null or blank, that of the path's extension."""
    by_extension = F.lit(None).cast("string")
    for ext, name in EXTENSIONS.items():
        by_extension = F.when(extension(path) == ext, name).otherwise(by_extension)
    return F.coalesce(F.nullif(F.lower(F.trim(language)), F.lit("")), by_extension)
