"""Incremental indexing as a stream: new chunk rows into a keyed store, and a cache with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.operators.store import latest


BUCKETS = 64


def _newest(spark: SparkSession, store: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of every bucket of the store, of versions under `before`: at most a row per bucket and version is listed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{store}/v=*/bucket=*")
    found = [s.getPath().toString() for s in pattern.getFileSystem(conf).globStatus(pattern) or []]
    newest: dict[int, tuple[int, str]] = {}
    for path in found:
        v, b = (int(part.split("=")[1]) for part in path.split("/")[-2:])
        if (before is None or v < before) and v >= newest.get(b, (-1, ""))[0]:
            newest[b] = v, path
    return {b: path for b, (_, path) in newest.items()}


def read_store(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The rows of a store that follow_chunks keeps: the newest version of each bucket."""
    paths = list(_newest(spark, store).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def follow_chunks(spark: SparkSession, source: str, store: str, checkpoint: str, key: str = "chunk_id", at: str = "indexed_at", ties: tuple[str, ...] = ()) -> StreamingQuery:
    """Merges Parquet files as they arrive in `source` into a store of BUCKETS buckets by key: store/v=N/bucket=B (see read_store).

    Each batch keeps the latest row per key and replaces older rows of those keys; only the buckets that its keys fall into are read and written
    anew. A batch that is run again after a failure overwrites its own version only, so every file counts once. Ends when all files present are read.
    """
    schema = spark.read.parquet(source).schema
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch.where(F.col(key).isNotNull()), [key], at, *ties)
        before = _newest(spark, store, number)
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most BUCKETS rows
        paths = [before[b] for b in touched if b in before]
        if paths:
            new = latest(spark.read.schema(schema).parquet(*paths).unionByName(new), [key], at, *ties)
        new.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/v={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_lookups(events: DataFrame, at: str, key: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Lookups and different keys per window of an event stream; rows later than `late` are dropped by the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("lookups"), F.approx_count_distinct(key).alias("keys")).select(F.col("window.start").alias("begins"), "lookups", "keys")


def cached_lookups(events: DataFrame, key: str, at: str, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, hits, misses) per key and batch of a stream: a lookup hits if the last one was within the time to live.

    A key's state goes once the watermark (events up to `late` behind) has passed the end of its time to live: its next lookup misses anyway.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        hits = misses = 0
        for now in sorted(t for pdf in batches for t in pdf["seconds"]):
            hit = last is not None and now - last <= ttl_seconds
            hits, misses, last = hits + hit, misses + (not hit), now
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + ttl_seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": [keys[0]], "hits": [hits], "misses": [misses]})

    timed = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).where("at is not null").withWatermark("at", late)
    timed = timed.withColumn("seconds", F.unix_micros("at") / 1_000_000)
    return timed.groupBy("key").applyInPandasWithState(run, "key string, hits bigint, misses bigint", "last double", "update", "EventTimeTimeout")
