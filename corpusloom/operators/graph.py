"""Dependency graphs."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, run_dir


def levels(nodes: DataFrame, edges: DataFrame, node: str = "node", needs: str = "needs", most: int | None = None) -> DataFrame:
    """(node, level): 1 without dependencies, else one more than the greatest level among them.

    edges holds (node, needs). Nodes on a cycle, behind one, or with an unknown dependency never get a level and are
    left out. One round per level: it appends the nodes whose dependencies are all known, the greatest at the last level, to a
    table in the shared folder, so the lineage stays short and nothing is written twice.
    It runs until a round adds nothing; more than `most` levels, if given, raise an error.
    """
    spark = nodes.sparkSession
    kind = nodes.schema[node].dataType
    pairs = cut(edges.where(F.col(needs).isNotNull()).select(F.col(node).cast(kind).alias(node), F.col(needs).cast(kind).alias(needs)).distinct(), "edges")
    fresh = nodes.select(node).distinct().join(pairs, node, "left_anti").withColumn("level", F.lit(1))
    path, schema = f"{run_dir(spark)}/levels-{uuid.uuid4().hex}", f"`{node}` {kind.simpleString()}, level int"
    for level in count(1):
        fresh.write.mode("append").parquet(path)
        done = spark.read.schema(schema).parquet(path)
        if done.where(F.col("level") == level).isEmpty():
            break
        if most is not None and level > most:
            raise ValueError(f"the graph has more than {most} levels")
        met = done.select(F.col(node).alias(needs), F.col("level").alias("below"))
        state = pairs.join(met, needs, "left").groupBy(node).agg(F.count_if(F.col("below").isNull()).alias("missing"), F.max("below").alias("below"))
        fresh = state.where((F.col("missing") == 0) & (F.col("below") == level)).select(node, F.lit(level + 1).alias("level"))
    return done


def on_cycles(nodes: DataFrame, edges: DataFrame, node: str = "node", needs: str = "needs") -> DataFrame:
    """(node): the nodes that lead back to themselves; a node that needs itself is one.

    Nodes without a dependency on others that may lie on a cycle, and nodes that none of those need, are taken away round by round. What
    stays lies on a cycle or between two; reach sets are kept for these nodes only. Unknown dependencies and null ends count as none.
    """
    kind = nodes.schema[node].dataType
    left = cut(edges.select(F.col(node).cast(kind).alias("a"), F.col(needs).cast(kind).alias("b")).dropna().distinct(), "edges")
    size = left.count()
    while size:
        kept = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        kept = cut(kept, "edges")
        if (now := kept.count()) == size:
            break
        left, size = kept, now
    reach = fresh = left
    while size and not fresh.isEmpty():
        step = fresh.select("a", F.col("b").alias("m")).join(left.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        fresh = cut(step.join(reach, ["a", "b"], "left_anti"), "reach")
        reach = cut(reach.unionByName(fresh), "reach")
    return reach.where("a = b").select(F.col("a").alias(node)).distinct()


def missing_references(nodes: DataFrame, edges: DataFrame, node: str = "node", needs: str = "needs") -> DataFrame:
    """Edges that point to no node."""
    return edges.where(F.col(needs).isNotNull()).join(nodes.select(F.col(node).alias(needs)).distinct(), needs, "left_anti").select(node, needs).distinct()


def reachable(edges: DataFrame, start: DataFrame, node: str = "node", needs: str = "needs", most: int | None = None) -> DataFrame:
    """(node): everything the start nodes need, directly or through others; a start node only if something leads back to it.

    One round per step away from the start; each follows the edges of the nodes that are new, and writes what it found to the
    shared folder. Cycles end the walk, null ends of edges are ignored. It runs until a step adds nothing; more than `most`
    steps, if given, raise an error.
    """
    pairs = cut(edges.select(node, needs).where(F.col(node).isNotNull() & F.col(needs).isNotNull()).distinct(), "edges")
    fresh, done = start.select(node).distinct(), None
    for step in count(1):
        met = pairs.join(fresh, node, "left_semi").select(F.col(needs).alias(node)).distinct()
        fresh = cut(met if done is None else met.join(done, node, "left_anti"), "reached")
        if done is not None and fresh.isEmpty():
            break
        if most is not None and step > most:
            raise ValueError(f"there are nodes more than {most} steps away")
        done = fresh if done is None else cut(done.unionByName(fresh), "reached")
    return done
