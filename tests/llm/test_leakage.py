from __future__ import annotations

import random
import re

import numpy as np

from corpusloom.llm.leakage import leaked_tiles, leaks, tile

DOCS, ITEMS = "doc_id bigint, text string, item_id int, h string", "item_id bigint, suite string, text string"


def brute(docs, items, least):
    def grams(t):
        w = re.findall("[a-z0-9_]+", t.lower())
        return {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}

    return {(d, i) for d, x in docs for i, y in items if grams(x) & grams(y)}


def test_equals_brute_force_by_either_way(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(12)]
    docs = []
    for d in range(80):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 10)))]
        if d % 3 == 0:
            own = items[d % 12][1].split()
            parts.append(",\n".join(own[rng.randint(0, 4) :]).upper())
        docs.append((d, " . ".join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(20)] + [(300 + i, docs[3][1]) for i in range(40)]
    items += [(20, items[3][1]), (21, items[3][1])]
    a = spark.createDataFrame([(d, x, 1, "x") for d, x in docs], DOCS)
    b = spark.createDataFrame([(i, "s", x) for i, x in items], ITEMS)
    for most in (10_000, 1):
        got = {(r["doc"], r["item"]) for r in leaked_tiles(a, b, least=5, most_broadcast=most).collect()}
        assert got == brute(docs, items, 5)


def test_reordered_passages_are_covered(spark):
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words[20:]) + " other words here " + " ".join(words[:20])
    a = spark.createDataFrame([(1, text, 1, "x"), (2, None, 1, "x"), (None, text, 1, "x"), (3, "", 1, "x")], DOCS)
    b = spark.createDataFrame([(9, "s", " ".join(words)), (None, "s", "w1"), (8, "s", None)], ITEMS)
    (row,) = leaks(a, b, threshold=0.9).collect()
    assert (row["doc_id"], row["item_id"], row["tiles"], row["covered_words"], row["coverage"]) == (1, 9, 2, 40, 1.0)
    assert leaks(a.limit(0), b).count() == 0 and leaks(a, b.limit(0)).count() == 0


def test_other_scripts_and_short_items(spark):
    text = "и вот тринадцать слов подряд которые стоят и в тексте и в проверке"
    a = spark.createDataFrame([(1, "Вначале. " + text.upper() + "! Конец", 1, "x"), (2, "nur drei Wörter hier", 1, "x")], DOCS)
    b = spark.createDataFrame([(1, "s", text), (2, "s", "drei Wörter hier"), (3, "s", "hier drei Wörter"), (4, "s", "")], ITEMS)
    for most in (10_000, 1):
        both = {(r["doc_id"], r["item_id"], r["coverage"]) for r in leaks(a, b, words=r"\w+", short=True, most_broadcast=most).collect()}
        assert both == {(1, 1, 1.0), (2, 2, 1.0)}
    assert leaks(a, b).count() == 0 and {r["item_id"] for r in leaks(a, b, words=r"\w+").collect()} == {1}


def test_tiles_do_not_overlap():
    # words 0-9 of the document equal words 0-9 of the item; words 5-12 equal words 20-27
    pos = np.array([0, 1, 2, 3, 4, 5, 5, 6, 7])
    other = np.array([0, 1, 2, 3, 4, 5, 20, 21, 22])
    tiles = tile(pos, other, 3)
    used = [p + i for p, _, n in tiles for i in range(n)]
    assert len(used) == len(set(used)) and (0, 0, 8) in tiles
