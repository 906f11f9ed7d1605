"""Files of a directory tree as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash

INCLUDE = (r"\.(?:ts|tsx|js|jsx|md)$",)
EXCLUDE = (r"(?:^|/)node_modules/", r"(?:^|/)dist/", r"(?:^|/)\.")


def scan_files(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """(path, text, file_hash, modified, bytes) of the files below root whose path relative to it matches an include and no exclude pattern.

    Paths are filtered before contents are read into text; bytes that aren't UTF-8 become replacement characters.
    """
    prefix = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.element_at(F.split("path", prefix.replace("file://", ""), 2), -1)
    wanted = F.lit(False)
    for pattern in include:
        wanted = wanted | F.col("relative").rlike(pattern)
    for pattern in exclude:
        wanted = wanted & ~F.col("relative").rlike(pattern)
    text = F.decode("content", "UTF-8")
    return files.withColumn("relative", path).where(wanted).select(F.col("relative").alias("path"), text.alias("text"), content_hash(text).alias("file_hash"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
