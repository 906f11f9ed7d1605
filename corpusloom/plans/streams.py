"""Queries that feed the tables through streams and return what the streams leave behind."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.session import run_dir
from corpusloom.streaming import ingest as I

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT chunk_id, max(indexed_at) AS indexed_at FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def index_stream(spark, sf_dir):
    """The chunk store after all files of the table have arrived: the latest row of every chunk."""
    place = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/chunks.parque[t]"  # as a pattern, the table may be a file or a folder
    I.follow_chunks(spark, source, f"{place}/store", f"{place}/checkpoint").awaitTermination()
    return I.read_store(spark, f"{place}/store", spark.read.parquet(source).schema).select("chunk_id", "indexed_at")


@query("SELECT user_id::VARCHAR AS key, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM (SELECT user_id, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOURS >= ts, false) AS hit FROM events WHERE ts IS NOT NULL) GROUP BY user_id")
def cache_stream(spark, sf_dir):
    """Hits and misses of every user's lookups in a cache with a time to live of a day, counted by a stream."""
    place = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parque[t]"
    stream = I.cached_lookups(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "user_id", "ts", 86_400)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/found/batch={number}")
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("key string, hits bigint, misses bigint").parquet(f"{place}/found")
    return found.groupBy("key").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
