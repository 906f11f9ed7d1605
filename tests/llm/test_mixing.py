from __future__ import annotations

import os
import tracemalloc

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from corpusloom.llm.mixing import TOKENIZER, apportion, mixture, sainte_lague

DOCS, TARGETS = "doc_id bigint, text string, source string, tokens string", "source string, target_share double, max_repeats int"


def test_quotas():
    assert sainte_lague([0.5, 0.3, 0.2], [100, 100, 100], 10) == [5, 3, 2]
    assert sainte_lague([0.5, 0.5], [2, 100], 10) == [2, 8]
    assert sainte_lague([1.0, 0.0], [3, 9], 10) == [3, 0]
    assert sainte_lague([], [], 4) == []


def listed(weights, limits, seats):
    """All quotients, sorted."""
    every = sorted((-w / (2 * k + 1), i) for i, (w, m) in enumerate(zip(weights, limits)) if w > 0 for k in range(min(m, seats)))[:seats]
    return [sum(i == j for _, j in every) for i in range(len(weights))]


@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.25, 0.3, 1.0, 7.0]), st.integers(0, 30)), max_size=8), st.integers(0, 90))
@example([(0.1, 5), (0.1, 5), (0.1, 5), (0.25, 11), (0.3, 14), (1.0, 30), (0.1, 5)], 74)
@settings(max_examples=200, deadline=None)
def test_bisection_gives_the_highest_quotients(entries, seats):
    weights, limits = [w for w, _ in entries], [m for _, m in entries]
    assert sainte_lague(weights, limits, seats) == listed(weights, limits, seats)


def test_a_thousand_million_seats():
    tracemalloc.start()
    got = sainte_lague([i + 1.0 for i in range(14)], [10**9] * 14, 10**9)
    assert sum(got) == 10**9 and abs(got[13] - 14 * got[0]) <= 14 and tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def test_quotas_of_a_table(spark):
    entries = [(f"s{i:02d}", ((i * 7) % 5) / 10, (i * 13) % 9) for i in range(40)]
    table = spark.createDataFrame(entries, "source string, weight double, most bigint")
    for seats in (0, 1, 17, 60, 10_000):
        got = {r["source"]: r["quota"] for r in apportion(table, seats).collect()}
        assert [got[s] for s, _, _ in entries] == listed([w for _, w, _ in entries], [m for _, _, m in entries], seats)
    assert apportion(table.limit(0), 5).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs the tokenizer's file")
def test_more_targets_than_are_broadcast(spark):
    docs = spark.range(10_050).selectExpr("id as doc_id", "'one two three' as text", "concat('S', id) as source")
    targets = spark.range(10_050).selectExpr("concat('s', id) as source", "1.0D / 10050 as target_share", "1 as max_repeats")
    picked, report = mixture(docs, targets)
    assert picked.count() == report.where("mixed_tokens = 3").count() == 10_050


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs the tokenizer's file")
def test_shares_repeats_and_odd_rows(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten"
    rows = [(i, text, ("A", " a ", "a")[i % 3], "") for i in range(600)] + [(1000 + i, text, "b", "") for i in range(60)] + [(2000, None, "a", ""), (2001, "", "a", ""), (None, text, "a", ""), (2002, text, None, ""), (2003, text, "zz", "")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.0, 5), (None, 0.1, 1), ("c", None, None)], TARGETS)
    picked, report = mixture(docs, targets, total_tokens=3000, block_tokens=20)
    shares = {r["source"]: r["actual_share"] for r in report.collect()}
    assert set(shares) == {"a", "b", "none", "c"} and abs(shares["a"] - 0.5) < 0.05 and abs(shares["b"] - 0.5) < 0.05
    got = picked.collect()
    assert max(r["copies"] for r in got if r["source"] == "b") <= 3 and max(r["copies"] for r in got if r["source"] == "a") == 1
    assert len({r["doc_id"] for r in got}) == len(got)
    again = {(r["doc_id"], r["copies"]) for r in mixture(docs, targets, total_tokens=3000, block_tokens=20)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    monkeypatch.setattr("corpusloom.llm.mixing.BROADCAST_TARGETS", 1)
    in_spark = {(r["doc_id"], r["copies"]) for r in mixture(docs, targets, total_tokens=3000, block_tokens=20)[0].collect()}
    assert in_spark == again
    scarce = {r["source"]: r["mixed_tokens"] for r in mixture(docs, targets, total_tokens=100_000)[1].collect()}
    assert scarce["a"] == 6000 and scarce["b"] == 1800
    empty, none = mixture(docs.limit(0), targets)
    assert empty.count() == 0 and none.agg({"mixed_tokens": "sum"}).first()[0] == 0
