"""Claims against evidence: matching, coverage, confidence and the decisions that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import keywords, tokens
from corpusloom.operators.sequences import previous
from corpusloom.session import cut


BLOCK = 512


def _blocks(claims: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with g (group) and block, such that all evidence of a group meets each block of up to BLOCK of its claims: (group, block) is never large.

    Most groups have one block and cost nothing extra; evidence is repeated only for groups with more claims than that.
    """
    own = claims.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("int"))
    wide = own.where("block > 0").groupBy("g").agg(F.max("block").alias("blocks"))
    spread = evidence.join(wide, "g", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(0))))).drop("blocks")
    return own.repartition("g", "block"), spread.repartition("g", "block")


def match_evidence(claims: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """Every claim with its first matching evidence of the same group, or nulls.

    claims: (group, pos, claim), pos a number; evidence: (group, epos, evidence, sources, confidence). Evidence matches if one text holds
    the other, or if at least half of the claim's keywords (rounded up) occur among its own.

    Joined by keyword and counted: sentences without a common keyword meet only if one of them has too few. A text that another one holds
    shares all its keywords with it but perhaps the first and the last, so only claims of up to three and evidence of up to
    two keywords are compared with all of their group. Null groups match nothing; the first match is a min aggregate.
    """
    c = cut(claims.select(F.col(group).alias("g"), "pos", "claim", F.transform(keywords(F.col("claim")), lambda w: F.xxhash64(w)).alias("words")), "claims")
    e = cut(evidence.select(F.col(group).alias("g"), "epos", "evidence", "sources", "confidence", F.transform(keywords(F.col("evidence")), lambda w: F.xxhash64(w)).alias("ewords")), "evidence")
    own, theirs = _blocks(c.select("g", "pos", "claim", "words"), e.select("g", "epos", "evidence", F.array_distinct("ewords").alias("ewords")))
    n, m = F.size("words").alias("n"), F.size("ewords").alias("m")
    left, right = own.select("g", "block", "pos", n, F.explode("words").alias("w")), theirs.select("g", "block", "epos", m, F.explode("ewords").alias("w"))
    shared = left.join(right, ["g", "block", "w"]).groupBy("g", "block", "pos", "epos", "n", "m").agg(F.count("*").alias("shared"))
    shared = cut(shared.select("g", "pos", "epos", (F.col("shared") * 2 >= F.col("n")).alias("hit"), ((F.col("m") > 2) & (F.col("shared") >= F.col("m") - 2)).alias("near")).where("hit or near"), "shared")
    hit = shared.where("hit").groupBy("g", "pos").agg(F.min("epos").alias("epos"))
    holds = F.contains(F.lower("claim"), F.lower("evidence"))
    held = shared.where("not hit").select("g", "pos", "epos").join(c.select("g", "pos", "claim"), ["g", "pos"]).join(e.select("g", "epos", "evidence"), ["g", "epos"]).where(holds).select("g", "pos", "epos")
    overlap = F.size(F.filter("words", lambda w: F.array_contains("ewords", w)))
    either = holds | F.contains(F.lower("evidence"), F.lower("claim")) | (overlap * 2 >= F.size("words"))
    short = own.where(F.size("words") <= 3).join(theirs, ["g", "block"]).where(either).select("g", "pos", "epos")
    small = own.where(F.size("words") > 3).join(theirs.where(F.size("ewords") <= 2), ["g", "block"]).where(either).select("g", "pos", "epos")
    first = hit.unionByName(held).unionByName(short).unionByName(small).groupBy("g", "pos").agg(F.min("epos").alias("epos"))
    best = e.groupBy("g", "epos").agg(F.min(F.struct("evidence", "sources", "confidence")).alias("m"))
    found = first.join(best, ["g", "epos"]).select("g", "pos", "epos", "m.sources", "m.confidence")
    return c.select("g", "pos", "claim").join(found, ["g", "pos"], "left").select(F.col("g").alias(group), "pos", "claim", "epos", "sources", "confidence")


def gap_reason(epos: Column, sources: Column, confidence: Column, least: float = 0.3) -> Column:
    """Why a claim isn't covered, or null."""
    return F.when(epos.isNull(), "No evidence found").when(F.coalesce(sources, F.lit(0)) == 0, "Evidence has no source chunks").when(F.coalesce(confidence, F.lit(0.0)) < least, "Low confidence evidence")


def coverage(matched: DataFrame, group: str) -> DataFrame:
    """(group, total, covered, ratio, average, sources): ratio is 1 where there are no claims; average is that of matched evidence with sources."""
    reason = gap_reason(F.col("epos"), F.col("sources"), F.col("confidence"))
    out = matched.groupBy(group).agg(
        F.count("pos").alias("total"), F.count_if(reason.isNull() & F.col("pos").isNotNull()).alias("covered"),
        F.coalesce(F.avg(F.when(F.col("sources") > 0, F.col("confidence"))), F.lit(0.0)).alias("average"), F.countDistinct("epos").alias("sources"),
    )
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("covered") / F.col("total")))


def consistency(cited: DataFrame, group: str) -> DataFrame:
    """(group, consistency) of cited (group, path, symbol): 1 for fewer than two rows, else the mean of 1 / distinct paths and 1 / distinct symbols."""
    counts = cited.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(F.nullif(F.col("path"), F.lit(""))).alias("p"), F.countDistinct(F.nullif(F.col("symbol"), F.lit(""))).alias("s"))
    part = lambda c: F.when(F.col(c) > 0, 1.0 / F.col(c)).otherwise(0.0)
    return counts.select(group, F.when(F.col("n") < 2, 1.0).otherwise((part("p") + part("s")) / 2).alias("consistency"))


def confidence(retrieval: Column, covered: Column, chunks: Column, consistent: Column) -> Column:
    """Weighted score within 0 and 1."""
    score = 0.4 * retrieval + 0.35 * covered + 0.1 * F.least(F.lit(1.0), 0.2 * chunks) + 0.15 * consistent
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def recurse_decision(runs: DataFrame, group: str, order: str, score: str, least: float = 0.5, gain: float = 0.05, width: int = 4096) -> DataFrame:
    """Whether another round pays: at first if the score is too low, later only if it also rose by `gain`.

    order is a number; rows are compared with the one before in ranges of `width`, so a long run is not sorted in one task.
    """
    low = F.coalesce(F.col(score), F.lit(0.0)) < least
    found = previous(runs, group, [order], F.col(score), F.floor(F.col(order) / width), "_before")
    return found.withColumn("recurse", low & (F.col("_before").isNull() | (F.col(score) - F.col("_before") >= gain))).drop("_before")


def claim_links(claims: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """(group, pos, epos, shared): all evidence of a claim's group that shares two of its terms, or half of them.

    claims: (group, pos, claim); evidence: (group, epos, evidence). A claim's terms are its different keywords, or its words of
    more than four letters where it has fewer than two keywords. Joined by term and counted: texts without a common term never meet.
    """
    hashed = lambda a: F.transform(a, lambda w: F.xxhash64(w))
    long = lambda c: F.filter(tokens(F.col(c)), lambda w: F.length(w) > 4)
    c = claims.select(F.col(group).alias("g"), "pos", hashed(F.array_distinct(keywords(F.col("claim")))).alias("k"), hashed(F.array_distinct(long("claim"))).alias("l"))
    c = c.select("g", "pos", F.when(F.size("k") >= 2, F.col("k")).otherwise(F.col("l")).alias("terms"))
    e = evidence.select(F.col(group).alias("g"), "epos", hashed(F.array_distinct(F.concat(keywords(F.col("evidence")), long("evidence")))).alias("terms"))
    own, theirs = _blocks(cut(c, "claims"), cut(e, "evidence"))
    left, right = own.select("g", "block", "pos", F.size("terms").alias("n"), F.explode("terms").alias("term")), theirs.select("g", "block", "epos", F.explode("terms").alias("term"))
    shared = left.join(right, ["g", "block", "term"]).groupBy("g", "block", "pos", "epos", "n").agg(F.count("*").alias("shared"))
    return shared.where("shared >= 2 or shared * 2 >= n").select(F.col("g").alias(group), "pos", "epos", "shared")


def confidence_warnings(retrieval: Column, covered: Column, chunks: Column, consistent: Column) -> Column:
    """What to warn of, joined by semicolons; empty if nothing."""
    return F.concat_ws(
        "; ",
        F.when(retrieval < 0.5, "weak retrieval"),
        F.when(covered < 0.5, "few claims covered"),
        F.when(chunks == 0, "no source cited"),
        F.when(consistent < 0.3, "scattered sources"),
    )
