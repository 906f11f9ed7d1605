"""The chunk store: keyed merges, deletes, incremental indexing, caches and quantisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.sequences import previous


def latest(rows: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """One row per key: that of the greatest `at` (null is oldest), ties by the other columns given."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new, and those of existing whose key is not among them."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_matching(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed; rows with a null key stay."""
    return rows.join(doomed.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (repo, path, hash) the manifest doesn't hold as the path's latest entry. Null repos compare as equal."""
    seen = latest(manifest, ["repo", "path"], "indexed_at", "file_hash").select("repo", "path", "file_hash")
    same = files["repo"].eqNullSafe(seen["repo"]) & (files["path"] == seen["path"]) & (files["file_hash"] == seen["file_hash"])
    return files.join(seen, same, "left_anti")


def removed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repo, path) of the manifest that no file has any more."""
    known = manifest.select("repo", "path").distinct()
    here = files.select("repo", "path").distinct()
    return known.join(here, known["repo"].eqNullSafe(here["repo"]) & (known["path"] == here["path"]), "left_anti")


def _quantile(values: DataFrame, quantile: float, most: int = 100_000, bins: int = 4096) -> float | None:
    """The interpolated quantile of values (x), rounded to 9 decimals: a histogram per pass, until at most `most` values are left to rank."""
    n, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    place = quantile * (n - 1)
    first, below = int(place), 0

    def between(lower: float, upper: float) -> float:
        return round(lower + (place - first) * (upper - lower), 9)

    # Ranks first and first + 1 are wanted; `below` of all values lie under low.
    while low < high:
        inside = values.where(F.col("x").between(low, high))
        step = (high - low) / bins
        if low + step <= low:  # neighbouring numbers: nothing lies between them
            least = inside.where(F.col("x") == low).count()
            return between(low if first - below < least else high, low if first + 1 - below < least else high)
        counts = sorted(inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / step)).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())  # bins rows
        kept, seen = [], below
        for b in counts:
            if seen <= first + 1 and seen + b["n"] > first:
                kept.append((seen, b))
            seen += b["n"]
        (below, head), tail = kept[0], kept[-1][1]
        if len(kept) > 1:  # the two ranks lie at the facing ends of two ranges
            return between(head["hi"], tail["lo"])
        low, high = head["lo"], head["hi"]
        if head["n"] <= most and low < high:
            ranked = [r[0] for r in values.where(F.col("x").between(low, high)).orderBy("x").collect()[first - below :][:2]]
            return between(ranked[0], ranked[-1])
    return between(low, low)


def quantize_int8(vectors: DataFrame, id_col: str, vector_col: str, quantile: float = 0.99) -> DataFrame:
    """(id_col, bound, codes): scalar quantisation to -127..127, clipped at the quantile of all absolute values.

    The bound is exact (interpolated between the two nearest ranks): counts by value range find the range of each rank, and only that
    range's values are ranked, narrowed again while it holds many. Non-finite components are left out of it and become 0; null vectors stay null.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    values = vectors.select(F.explode(vector_col).alias("x")).where(~bad(F.col("x")))
    bound = _quantile(values.select(F.abs(F.col("x").cast("double")).alias("x")), quantile)
    bound = vectors.sparkSession.createDataFrame([(bound,)], "bound double")
    scaled = lambda x: F.when(bad(x), 0.0).otherwise(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x.cast("double") / F.col("bound") * 127 + 0.5).cast("double"))))
    return vectors.join(F.broadcast(bound), F.lit(True)).select(id_col, "bound", F.transform(vector_col, lambda x: scaled(x).cast("tinyint")).alias("codes"))


def embed_batch(rows: DataFrame, cache: DataFrame, id_col: str, text_col: str, embedder: Callable[[Column], Column]) -> DataFrame:
    """(id_col, text_col, hash, origin, source, vector) of every row with a text.

    cache: (id_col, vector), vectors of rows whose texts are among those of rows. Texts are known by the hash of their content; of several
    cached vectors of one text that of the smallest id counts (source). Each text that the cache lacks is embedded once, however many rows hold it, and
    the vectors are joined back. embedder: an expression from texts to array<double>, built-in or a pandas UDF around a model.
    """
    own = rows.where(F.col(text_col).isNotNull()).select(id_col, text_col, F.substring(F.sha2(text_col, 256), 1, 16).alias("hash"))
    found = own.select(id_col, "hash").distinct().join(cache.where("vector is not null"), id_col).groupBy("hash").agg(F.min(id_col).alias("source"), F.min_by("vector", id_col).alias("vector"))
    missing = own.groupBy("hash").agg(F.min(text_col).alias("text")).join(found.select("hash"), "hash", "left_anti")
    vectors = found.withColumn("origin", F.lit("cached")).unionByName(missing.select("hash", embedder(F.col("text")).alias("vector"), F.lit(None).cast(own.schema[id_col].dataType).alias("source"), F.lit("embedded").alias("origin")))
    return own.join(vectors, "hash").select(id_col, text_col, "hash", "origin", "source", "vector")


def cache_hits(log: DataFrame, key: str, at: str, ttl: str = "INTERVAL 24 HOURS") -> DataFrame:
    """The access log with `hit`: the key was used before, within the time to live (each use renews it).

    Accesses of a busy key are sorted hour by hour, not all at once. Rows without a time never hit.
    """
    ties = [c for c in log.columns if c not in (key, at)][:1]
    found = previous(log, key, [at, *ties], F.col(at), F.date_trunc("hour", at), "_before")
    return found.withColumn("hit", F.coalesce(F.col("_before") + F.expr(ttl) >= F.col(at), F.lit(False))).drop("_before")


def cache_keep(log: DataFrame, key: str, at: str, size: str, most_bytes: float, most_entries: int) -> DataFrame:
    """(key, last_access, bytes, keep): least recently used keys are evicted once more recent ones fill the bounds.

    Two levels of running sums (within hours, then over hours), so that no task sorts all keys.
    """
    entries = log.groupBy(key).agg(F.max(at).alias("last_access"), F.max(F.coalesce(size, F.lit(0))).alias("bytes")).withColumn("slot", F.date_trunc("hour", "last_access"))
    w = Window.partitionBy("slot").orderBy(F.col("last_access").desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    inner = entries.withColumn("b", F.sum("bytes").over(w)).withColumn("n", F.row_number().over(Window.partitionBy("slot").orderBy(F.col("last_access").desc(), key)))
    slots = entries.groupBy("slot").agg(F.sum("bytes").alias("slot_bytes"), F.count("*").alias("slot_n"))
    newer = Window.partitionBy(F.lit(1)).orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per hour
    slots = slots.select("slot", F.coalesce(F.sum("slot_bytes").over(newer), F.lit(0)).alias("b0"), F.coalesce(F.sum("slot_n").over(newer), F.lit(0)).alias("n0"))
    keep = (F.col("b") + F.col("b0") <= most_bytes) & (F.col("n") + F.col("n0") <= most_entries)
    return inner.join(slots, "slot").select(key, "last_access", "bytes", keep.alias("keep"))
