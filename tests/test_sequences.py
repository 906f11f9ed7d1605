"""Rows before rows, claim links, reachability and cache hits against brute force, with nulls, ties and empty tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators import evidence as E
from corpusloom.operators import graph as G
from corpusloom.operators.sequences import previous
from corpusloom.operators.store import cache_hits


def test_previous_equals_one_sorted_pass(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(i)])) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "n long, g string, v double").withColumn("_own", F.lit("kept"))
    got = {r["n"]: r["before"] for r in previous(df, "g", ["n"], F.col("v"), F.floor(F.col("n") / 7)).collect()}
    last, want = {}, {}
    for n, g, v in sorted(rows, key=lambda r: r[0]):
        want[n] = last.get(g)
        last[g] = v
    assert got == want


def test_previous_of_nothing(spark):
    empty = spark.createDataFrame([], "n long, g string, v double")
    assert previous(empty, "g", ["n"], F.col("v"), F.col("n")).collect() == []


def test_cache_hits_across_hours(spark):
    rows = [("k", "2024-01-01 00:59:00", 1), ("k", "2024-01-01 01:01:00", 2), ("k", "2024-01-02 01:01:00", 3), ("k", "2024-01-03 01:02:00", 4), ("k", None, 5), ("k", "2024-01-03 01:02:00", 6)]
    log = spark.createDataFrame(rows, "key string, at string, n int").withColumn("at", F.col("at").cast("timestamp"))
    hits = {r["n"]: r["hit"] for r in cache_hits(log.select("n", "key", "at"), "key", "at").collect()}
    assert hits == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_claim_links_nulls_and_ties(spark):
    claims = spark.createDataFrame([(1, 0, "The parser reads every header"), (1, 2, None), (1, 4, ""), (2, 0, "Parser header")], "d long, pos long, claim string")
    evidence = spark.createDataFrame([(1, 1, "A header that the parser reads"), (1, 3, "nothing here"), (2, 1, "header"), (2, 3, None)], "d long, epos long, evidence string")
    got = sorted(tuple(r) for r in E.claim_links(claims, evidence, "d").collect())
    assert got == [(1, 0, 1, 3), (2, 0, 1, 1)]
    assert E.claim_links(claims.limit(0), evidence, "d").count() == 0


def test_reachable_with_cycles_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 6), (5, None), (1, 2)], "node long, needs long")
    start = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    assert sorted(r[0] for r in G.reachable(edges, start(1)).collect()) == [1, 2, 3]
    assert sorted(r[0] for r in G.reachable(edges, start(4, None)).collect()) == [5]
    assert G.reachable(edges, start(9)).collect() == []


def test_recurse_decision_across_ranges(spark):
    runs = spark.createDataFrame([("a", 1, 0.2), ("a", 9, 0.3), ("a", 17, 0.31), ("a", 30, 0.9), ("b", 2, None)], "g string, n long, s double")
    got = {(r["g"], r["n"]): r["recurse"] for r in E.recurse_decision(runs, "g", "n", "s", width=8).collect()}
    assert got == {("a", 1): True, ("a", 9): True, ("a", 17): False, ("a", 30): False, ("b", 2): True}
