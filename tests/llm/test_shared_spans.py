from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.rolling import codes_of, sampled_windows, window_hashes
from corpusloom.llm.shared_spans import chain, fuzzy_passages, shared_share, shared_spans

SCHEMA = "doc_id bigint, text string, t bigint, n string"


def brute(docs: dict, least: int) -> set:
    out = set()
    for i, x in docs.items():
        others = {y[p : p + least] for j, y in docs.items() if j != i for p in range(len(y) - least + 1)}
        run = None
        for p in range(len(x) - least + 1):
            if x[p : p + least] in others:
                if run and p <= run[1]:
                    run[1] = p + least
                else:
                    if run:
                        out.add((i, *run))
                    run = [p, p + least]
        if run:
            out.add((i, *run))
    return out


def found(spark, docs: dict, least: int) -> set:
    df = spark.createDataFrame([(i, x, 1, "x") for i, x in docs.items()], SCHEMA)
    return {tuple(r) for r in shared_spans(df, min_len=least).collect()}


def test_equals_brute_force(spark):
    for seed, least in ((5, 8), (6, 21), (7, 5), (8, 30), (9, 16)):
        rng = random.Random(seed)
        parts = ["".join(rng.choice("ab c\n😀") for _ in range(rng.randint(1, 40))) for _ in range(12)]
        docs = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for i in range(60)}
        docs |= {100: docs[3], 101: docs[3], 102: "", 103: "a" * 50, 104: "a" * 30}
        assert found(spark, docs, least) == brute(docs, least)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "x" * 50, 1, "a"), (1, None, 1, "a"), (2, "", None, None)], SCHEMA)
    assert shared_spans(df, min_len=10).count() == 0
    assert shared_spans(df.limit(0), min_len=10).count() == 0
    assert {tuple(r) for r in shared_share(df.where("doc_id = 2"), min_len=10).collect()} == {(2, 0, 0, 0.0)}


def test_hot_paragraph_and_repetition_inside_one_row(spark):
    paragraph = "the same standard paragraph stands in every row, word for word."
    docs = {i: f"{i} own words {i * 7919} " + paragraph + f" tail {i * 104729}" for i in range(300)}
    docs[999] = "once more once more once more once more once more once more "
    got = found(spark, docs, 40)
    assert got == brute(docs, 40) and len(got) == 300


@given(st.text(alphabet="abc é😀", max_size=80), st.integers(1, 20))
@settings(deadline=None)
def test_window_hashes_depend_on_content_only(text, k):
    h = window_hashes(codes_of(text), k)
    seen: dict = {}
    for i in range(len(text) - k + 1):
        assert seen.setdefault(text[i : i + k], h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


def test_every_window_holds_a_seed():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (0, 5, 40, 300)]
    which, at, _ = sampled_windows(texts, 10, 11)
    for i, t in enumerate(texts):
        own = set(at[which == i].tolist())
        assert all(own & set(range(p, p + 11)) for p in range(len(t) - 20 + 1))


def test_chain_prefers_collinear_matches():
    score, root = chain(np.array([0, 10, 20, 500]), np.array([0, 10, 20, 3]), 10, 0.25)
    assert score.tolist() == [10, 20, 30, 10] and root.tolist() == [0, 0, 0, 3]


def test_fuzzy_passages_bridge_a_difference(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    df = spark.createDataFrame([(1, a + "X" + b, 1, ""), (2, a + "YY" + b, 1, "")], SCHEMA)
    rows = fuzzy_passages(df, min_len=60).collect()
    assert len(rows) == 1 and rows[0]["p_end"] - rows[0]["p_start"] > 500 and 0.9 < rows[0]["identity"] < 1
    assert (rows[0]["doc_id"], rows[0]["partner_id"]) in ((1, 2), (2, 1))


def test_reference_that_repeats_the_seed(spark):
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh ") for _ in range(90))
    tails = ["".join(rng.choice("stuvwxyz ") for _ in range(60)) for _ in range(4)]
    docs = {1: part + tails[0] + part + tails[1], 2: part + tails[1] + part + tails[2], 3: part + tails[0] + part + tails[3], 4: tails[3] + part + tails[2] + part}
    assert found(spark, docs, 60) == brute(docs, 60)
