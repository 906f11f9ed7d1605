"""Evaluation texts leaking into training text.

Method: greedy string tiling. Shared seeds of `least` words are found by rolling hashes (Karp-Rabin) and
joined; per (document, item) pair the longest match whose words are all unmarked is marked as a tile, again and
again, until no match of `least` words is left. Tiles of reordered passages count alike, so the share of the
item that its tiles cover shows how much of it leaked; a threshold on it keeps the items that leaked for the most part.

Equal documents and equal items are folded into classes (by a 64-bit hash of the text): seeds, tiles and coverage are
those of classes, and ids come back at the end.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import slices, whole_groups
from corpusloom.llm.rolling import window_hashes
from corpusloom.llm.skew import by_group
from corpusloom.session import cut

WORDS = r"[a-z0-9_]+"
SEED_SCHEMA = "h bigint, id bigint, pos int, n_words int, size int"
TILE_SCHEMA = "doc bigint, item bigint, doc_start int, item_start int, length int, item_words int"


class _WordIds(dict):
    """64-bit ids of words; forgets all once there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = i = xxhash.xxh3_64_intdigest(word)
        return i


def _seeds(sizes: list[int], words: str, wanted=None, short_only: bool = False):
    """All windows of so many words, or only those whose hash is in the broadcast sorted array; short_only: only whole texts of fewer words than sizes[0]."""
    bits = np.uint64((1 << 22) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, word = _WordIds(), re.compile(words)
        maybe = None
        if wanted is not None:
            maybe = np.zeros(1 << 22, dtype=bool)
            maybe[wanted.value & bits] = True
        for batch in batches:
            for pdf in slices(batch, "text", 200_000):
                lists = [word.findall(t.lower()) for t in pdf["text"]]
                if short_only:
                    lists = [x if len(x) < sizes[0] else [] for x in lists]
                counts = np.array([len(x) for x in lists], dtype=np.int64)
                codes = np.fromiter((ids[w] for x in lists for w in x), dtype=np.uint64, count=int(counts.sum()))
                starts = np.cumsum(counts) - counts
                for size in range(1, sizes[0]) if short_only else sizes:
                    h = window_hashes(codes, size)
                    ends = np.repeat(starts + counts, counts)[: len(h)]
                    keep = np.arange(len(h)) + size <= ends
                    if short_only:
                        keep &= np.repeat(counts, counts)[: len(h)] == size
                    if maybe is not None:
                        keep &= maybe[h & bits]
                    at = np.flatnonzero(keep)
                    if maybe is not None and len(at):
                        at = at[np.isin(h[at], wanted.value)]
                    which = np.searchsorted(starts, at, side="right") - 1
                    yield pd.DataFrame({"h": h[at].view(np.int64), "id": pdf["t"].to_numpy()[which], "pos": (at - starts[which]).astype(np.int32), "n_words": counts[which].astype(np.int32), "size": np.full(len(at), size, dtype=np.int32)})

    return run


def tile(pos: np.ndarray, other: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start, start in other, words) from matched windows of `least` words."""
    order = np.lexsort((pos, pos - other))
    pos, other = pos[order], other[order]
    cut = np.flatnonzero((np.diff(pos) != 1) | (np.diff(other) != 1)) + 1
    heap = [(-(b - a + least - 1), int(pos[a]), int(other[a])) for a, b in zip([0, *cut], [*cut, len(pos)]) if b > a]
    heapq.heapify(heap)
    mine, theirs, tiles = set(), set(), []
    while heap:
        size, p, q = heapq.heappop(heap)
        taken = [i for i in range(-size) if p + i in mine or q + i in theirs]
        if not taken:
            tiles.append((p, q, -size))
            mine.update(range(p, p - size))
            theirs.update(range(q, q - size))
            continue
        for a, b in zip([-1, *taken], [*taken, -size]):  # what is left between marked words
            if b - a - 1 >= least:
                heapq.heappush(heap, (-(b - a - 1), p + a + 1, q + a + 1))
    return sorted(tiles)


def _tiles():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ready in whole_groups(batches, ["doc", "item"]):
            out = []
            doc, item = ready["doc"].to_numpy(), ready["item"].to_numpy()
            pos, other, words, size = (ready[c].to_numpy() for c in ("pos", "other", "item_words", "size"))
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(doc)]):
                out += [(doc[a], item[a], p, q, n, words[a]) for p, q, n in tile(pos[a:b].astype(np.int64), other[a:b].astype(np.int64), int(size[a]))]
            yield pd.DataFrame(out, columns=["doc", "item", "doc_start", "item_start", "length", "item_words"])

    return run


def _classes(rows: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Texts with their class, and (id, t) of all rows."""
    own = rows.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    return own.select("t", "text"), cut(own.select("id", "t"), "members")


def _with_ids(found: DataFrame, members: DataFrame, t: str, name: str) -> DataFrame:
    """found with the ids of all members of its classes t. A class's rows of found go along as a list: what one text holds."""
    own = found.groupBy(F.col(t).alias("t")).agg(F.collect_list(F.struct(*[c for c in found.columns if c != t])).alias("found"))
    sizes = members.groupBy("t").agg(F.count("*").alias("n"))
    return by_group(members, cut(own.join(sizes, "t"), "classes"), "t").select(F.col("id").alias(name), F.explode("found").alias("f")).select(name, "f.*")


def _class_tiles(texts: DataFrame, own: DataFrame, least: int, words: str, short: bool, most_broadcast: int) -> DataFrame:
    spark = texts.sparkSession
    item_seeds = own.mapInPandas(_seeds([least], words), SEED_SCHEMA)
    sizes = [least]
    if short:
        item_seeds = item_seeds.unionByName(own.mapInPandas(_seeds([least], words, short_only=True), SEED_SCHEMA))
    item_seeds = cut(item_seeds.distinct(), "items")  # equal items give equal rows
    if short:
        sizes = sorted(r[0] for r in item_seeds.select("size").distinct().collect())  # at most `least` rows
    wanted = None
    few = item_seeds.limit(most_broadcast + 1).count() <= most_broadcast
    if few:
        known = np.array([r[0] for r in item_seeds.select("h").distinct().toLocalIterator()], dtype=np.int64)
        wanted = spark.sparkContext.broadcast(np.sort(known.view(np.uint64)))
    doc_seeds = texts.mapInPandas(_seeds(sizes, words, wanted), SEED_SCHEMA).select("h", "id", "pos", "size").distinct()
    doc_seeds = doc_seeds if few else cut(doc_seeds, "seeds")
    right = item_seeds.select("h", "size", F.col("id").alias("item"), F.col("pos").alias("other"), F.col("n_words").alias("item_words"))
    # Beyond the bound both sides are read from tables and joined by shuffle, where adaptive execution splits hot hashes.
    matches = doc_seeds.join(F.broadcast(right) if few else right, ["h", "size"]).select(F.col("id").alias("doc"), "item", "pos", "other", "item_words", "size")
    return matches.repartition("doc", "item").sortWithinPartitions("doc", "item", "pos", "other").mapInPandas(_tiles(), TILE_SCHEMA)


def leaked_tiles(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = 12, words: str = WORDS, short: bool = False,
    most_broadcast: int = 2_000_000,
) -> DataFrame:
    """(doc, item, doc_start, item_start, length, item_words): the tiles of every document and item that share `least` words in a row.

    Words are the maximal runs of the pattern `words` in the lower-cased text. An item of fewer than `least` words counts, if `short`,
    where all its words stand in a row, and otherwise has no tiles. Up to `most_broadcast` rows of item seeds are broadcast and filter the
    documents' seeds inside the tasks; beyond that all seeds are joined by shuffle. Rows with a null id or text give no
    row; equal documents, and equal items, each give their own rows.
    """
    texts, members = _classes(docs, doc_id, text)
    own, item_members = _classes(items, item_id, text)
    tiles = cut(_class_tiles(texts, own, least, words, short, most_broadcast), "tiles")
    return _with_ids(_with_ids(tiles, members, "doc", "doc_"), item_members, "item", "item_").withColumnsRenamed({"doc_": "doc", "item_": "item"}).select("doc", "item", "doc_start", "item_start", "length", "item_words")


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = 12, threshold: float = 0.0, words: str = WORDS,
    short: bool = False, most_broadcast: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, tiles, covered_words, item_words, coverage) of the pairs whose tiles cover at least `threshold` of the item."""
    texts, members = _classes(docs, doc_id, text)
    own, item_members = _classes(items, item_id, text)
    found = _class_tiles(texts, own, least, words, short, most_broadcast).groupBy("doc", "item").agg(
        F.count("*").alias("tiles"), F.sum("length").alias("covered_words"), F.max("item_words").cast("bigint").alias("item_words")
    )
    found = found.withColumn("coverage", F.col("covered_words") / F.col("item_words")).where(F.col("coverage") >= threshold)
    named = _with_ids(_with_ids(found, members, "doc", "doc_"), item_members, "item", "item_")
    return named.select(F.col("doc_").alias(doc_id), F.col("item_").alias(item_id), "tiles", "covered_words", "item_words", "coverage")
