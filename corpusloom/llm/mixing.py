"""Mixing sources to target weights.

Method: Sainte-Laguë apportionment. Records are packed into blocks of about equal tokens within (source, shard);
blocks are allotted to the sources by highest quotients of target share over odd numbers, up to max_repeats
times what a source has; each source's quota is apportioned over its shards in the same way, and each shard
selects its blocks in a seeded order. Quotients are never listed: the last one that counts is found by bisection.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import whole_groups
from corpusloom.session import cut

TOKENIZER = os.environ.get("CORPUSLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text for this tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_SHARDS = 16_384
BROADCAST_TARGETS = 10_000
SALTS = 64
STEPS = 256


def clean_source(source: Column) -> Column:
    """Lower case without outer white space; null stays null."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def _count(table):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.value.splitlines())}
        coder = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pdf[["id", "source"]].assign(tokens=[len(coder.encode_ordinary(t)) for t in pdf["text"]])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) with the source in clean spelling; rows without id or text are dropped.

    The vocabulary (a file of about a megabyte, whatever the corpus) is read on the driver and broadcast.
    """
    with open(tokenizer, "rb") as f:
        table = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.where(F.col("text").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), clean_source(F.col("source")).alias("source"), "text")
    return rows.mapInPandas(_count(table), "id bigint, source string, tokens bigint")


def sainte_lague(weights: list[float], limits: list[int], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2 k + 1), at most limits[i] each; ties to the earlier entry.

    The last quotient that gets a seat is found by bisection, so memory and time don't depend on the number of seats.
    """
    w, most = np.array(weights, dtype=np.float64), np.array(limits, dtype=np.int64)
    most = np.where(w > 0, np.clip(most, 0, max(seats, 0)), 0)
    if not len(w) or most.sum() <= seats:
        return most.tolist()
    low, high = 0.0, float(w.max()) * 2
    while low < (middle := (low + high) / 2) < high:
        if _seats_down_to(w, most, middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = _seats_down_to(w, most, high)
    open_ = got < most  # the few seats left go to the highest next quotients
    following = np.where(open_, w / (2.0 * got + 1), -1.0)
    got[np.argsort(-following, kind="stable")[: seats - got.sum()]] += 1
    return got.tolist()


def _seats_down_to(w: np.ndarray, most: np.ndarray, quotient: float) -> np.ndarray:
    """How many quotients of each entry are at least `quotient`."""
    with np.errstate(over="ignore", divide="ignore"):
        fit = np.minimum((w / quotient - 1) / 2, most)
    n = np.minimum(most, np.floor(fit).astype(np.int64) + 1).clip(0)
    n -= (n > 0) & (w / (2.0 * n - 1) < quotient)  # rounding may be off by one
    return n + ((n < most) & (w / (2.0 * n + 1) >= quotient))


def apportion(entries: DataFrame, seats: int, name: str = "source") -> DataFrame:
    """(name, quota) of entries (name, weight, most): Sainte-Laguë over a table of any length.

    The last quotient that gets a seat is enclosed by STEPS values at a time, a sum per value over the table;
    entries are never collected. Ties go to the smaller name.
    """
    w, most = F.col("weight"), F.least(F.col("most"), F.lit(seats))
    own = entries.select(name, "weight", F.when(w > 0, F.greatest(most, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("most"))
    total, top = own.agg(F.sum("most"), F.max("weight")).first()
    if (total or 0) <= seats:
        return own.select(name, F.col("most").alias("quota"))

    def held(quotient) -> Column:
        fit = F.floor(F.least((F.col("weight") / quotient - 1) / 2, F.col("most").cast("double"))).cast("bigint") + 1
        n = F.least(F.col("most"), F.greatest(F.lit(0), fit))
        n = n - ((n > 0) & (F.col("weight") / (2 * n - 1) < quotient)).cast("int")  # rounding may be off by one
        return n + ((n < F.col("most")) & (F.col("weight") / (2 * n + 1) >= quotient)).cast("int")

    own = cut(own, "entries")
    low, high = 0, int(np.float64(top * 2).view(np.int64))  # positive numbers are ordered like their bits
    while high - low > 1:
        inner = np.unique(np.linspace(low, high, STEPS + 2)[1:-1].astype(np.int64))
        inner = inner[(inner > low) & (inner < high)]
        if not len(inner):
            inner = np.array([(low + high) // 2])
        tried = F.posexplode(F.transform(F.lit(inner.view(np.float64).tolist()), held)).alias("step", "n")
        sums = dict(own.select(tried).groupBy("step").agg(F.sum("n")).collect())  # STEPS rows
        low = int(max((x for i, x in enumerate(inner) if sums[i] > seats), default=low))
        high = int(min((x for i, x in enumerate(inner) if sums[i] <= seats), default=high))
        if seats in sums.values():
            break
    high = float(np.int64(high).view(np.float64))
    got = cut(own.withColumn("quota", held(high)), "quotas")
    left = seats - (got.agg(F.sum("quota")).first()[0] or 0)
    following = got.where("quota < most").orderBy((F.col("weight") / (2 * F.col("quota") + 1)).desc(), name).limit(left).select(name, F.lit(1).alias("one"))
    return got.join(following, name, "left").select(name, (F.col("quota") + F.coalesce("one", F.lit(0))).cast("bigint").alias("quota"))


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each source's quota over its shards (at most MAX_SHARDS rows); rows are sorted by (source, shard)."""
    for pdf in whole_groups(batches, ["source"]):
        source, blocks, most, quota = (pdf[c].to_numpy() for c in ("source", "blocks", "max_repeats", "quota"))
        ends = [*np.flatnonzero(source[1:] != source[:-1]) + 1, len(source)]
        split: list[int] = []
        for a, b in zip([0, *ends], ends):
            split += sainte_lague(blocks[a:b].astype(float), blocks[a:b] * most[a:b], int(quota[a]))
        yield pdf[["source", "shard", "blocks"]].assign(quota=split)


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int | None = None, seed: int = 17, id_col: str = "doc_id", tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(picked, report).

    picked: (id_col, source, tokens, copies), one row per record that is used. report: (source, target_share,
    max_repeats, available_tokens, mixed_tokens, actual_share), one row per target, also those without records.
    total_tokens is the size of the mixture (default: all tokens of the targets' sources); where max_repeats
    keeps a source below its share, the others keep their proportions and fill the total as far as they can.
    Records without source, without a target or without tokens aren't used. Up to BROADCAST_TARGETS targets (they are counted first) are
    broadcast and get their quotas on the driver; beyond that the quotas are found in Spark (see apportion), with equal results.
    """
    spark = docs.sparkSession
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    goal = cut(goal, "targets")
    rows = token_counts(docs, id_col, tokenizer).where("tokens > 0")
    few = goal.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
    if few:
        rows = rows.join(F.broadcast(goal.select("source")), "source")
    else:  # a source may hold a third of all rows: both sides are spread over salts
        salts = goal.select("source", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salts, ["source", "salt"]).drop("salt")
    counted = cut(rows, "tokens")
    have = cut(counted.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("records")), "have")
    everything, records = have.agg(F.coalesce(F.sum("available_tokens"), F.lit(0)), F.coalesce(F.sum("records"), F.lit(0))).first()
    total = everything if total_tokens is None else total_tokens
    shards = max(1, min(MAX_SHARDS, records // 50_000 + 4))
    block = block_tokens or max(512, min(65_536, total // 4_000))
    # Blocks: runs of records in a seeded order within (source, shard); a shard is small however large the source.
    order = Window.partitionBy("source", "shard").orderBy("draw", "id")
    placed = counted.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(shards)).cast("int")).withColumn("draw", F.xxhash64(F.lit(seed + 1), "id"))
    run = placed.withColumn("block", F.floor((F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")) / block))
    run = cut(run.withColumn("block", F.dense_rank().over(Window.partitionBy("source", "shard").orderBy("block")) - 1).drop("draw"), "blocks")
    stock = cut(run.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens"), (F.max("block") + 1).cast("bigint").alias("blocks")), "stock")
    per = stock.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("blocks").alias("blocks")).join(goal, "source")
    mean = F.col("tokens") / F.col("blocks")
    entries = cut(per.select("source", "target_share", "max_repeats", mean.alias("mean"), (F.col("target_share") / mean).alias("weight"), (F.col("blocks") * F.col("max_repeats")).alias("most")), "entries")
    # Seats are blocks; a source's blocks may differ in size from another's, so seats come from the tokens.
    wanted, per_seat = entries.agg(F.sum("target_share"), F.sum(F.col("target_share") / F.col("mean"))).first()
    seats = round(per_seat / wanted * total) if wanted else 0
    if few:
        rows = sorted(entries.select("source", "weight", "most").collect())  # at most BROADCAST_TARGETS rows
        quotas = spark.createDataFrame(list(zip([r[0] for r in rows], sainte_lague([r[1] for r in rows], [r[2] for r in rows], seats))), "source string, quota bigint")
    else:
        quotas = apportion(entries, seats)
    quotas = quotas.join(entries.select("source", "max_repeats"), "source")
    quota = stock.select("source", "shard", "blocks").join(quotas, "source").repartition("source").sortWithinPartitions("source", "shard")
    quota = cut(quota.mapInPandas(_split, "source string, shard int, blocks bigint, quota bigint"), "quota")
    chosen = run.select("source", "shard", "block").distinct().join(quota, ["source", "shard"])
    lot = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block")
    chosen = chosen.withColumn("copies", F.floor(F.col("quota") / F.col("blocks")) + (F.row_number().over(lot) <= F.pmod(F.col("quota"), F.col("blocks"))).cast("int"))
    picked = run.join(chosen.where("copies > 0").select("source", "shard", "block", "copies"), ["source", "shard", "block"]).select(F.col("id").alias(id_col), "source", "tokens", F.col("copies").cast("bigint").alias("copies"))
    mixed = picked.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    report = goal.join(have.drop("records"), "source", "left").join(mixed, "source", "left").fillna(0, ["available_tokens", "mixed_tokens"])
    whole = report.agg(F.sum("mixed_tokens").alias("whole"))  # one row
    report = report.join(F.broadcast(whole), F.lit(True)).withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.nullif(F.col("whole"), F.lit(0)), F.lit(0.0))).drop("whole")
    return picked, report.select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", "actual_share")
