"""Long exact spans shared between records.

Method: shared k-mer seeds are joined, collinear matches are chained with gap costs through a Fenwick
tree into fuzzy passages, and the chains are aligned. Seeds are k-mers sampled by winnowing, so densely that in a common span
of min_len characters each next seed touches or overlaps the one before: a run of a chain's seeds on one
diagonal is a common stretch without a gap and needs no look at the texts. Only the windows of min_len characters that
reach beyond an end of a run are compared by hash, which places the ends exactly.

A seed's group is never expanded into pairs: each occurrence is linked to one occurrence in one text of the group, its reference.
A window that two texts share beyond their runs with the reference reaches beyond a run in both, or stands in the reference too, so
comparing these windows, and those of the reference at the same places, with one another finds every span. Where the
reference itself repeats the seed, all windows that hold the seed are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import slices, whole_groups
from corpusloom.llm.rolling import codes_of, sampled_windows, window_hashes
from corpusloom.llm.skew import by_group
from corpusloom.session import cut

SEED_SCHEMA = "h bigint, t bigint, pos int, again boolean"
WINDOW_SCHEMA = "h bigint, t bigint, pos int"
RUN_SCHEMA = "t bigint, partner bigint, chain int, p_start int, p_end int, q_start int, q_end int, score double"
CHARS_AT_ONCE = 48_000  # the arrays of so many characters stay in a core's cache


def _seeds(k: int, w: int):
    """All sampled k-mers; again: the text holds this one several times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "text", CHARS_AT_ONCE):
                which, pos, h = sampled_windows(part["text"].tolist(), k, w)
                order = np.lexsort((h, which))
                same = (which[order][1:] == which[order][:-1]) & (h[order][1:] == h[order][:-1])
                again = np.zeros(len(h), dtype=bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                yield pd.DataFrame({"h": h.view(np.int64), "t": part["t"].to_numpy()[which], "pos": pos.astype(np.int32), "again": again})

    return run


def chain(pos: np.ndarray, other: np.ndarray, k: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Collinear chaining of matches (pos, other) of k characters, sorted by (pos, other).

    A match extends the best chain that ends before it in both texts, at a cost of gap for each
    unmatched character on either side, unless a new chain scores more. A Fenwick tree over the ranks
    of `other` keeps the best prefix. Returns each match's score and its chain's first match.
    """
    n = len(pos)
    rank = np.unique(other, return_inverse=True)[1] + 1
    size = int(rank.max()) if n else 0
    best, where = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, root = np.empty(n), np.empty(n, dtype=np.int64)
    i = 0
    while i < n:
        j = i
        while j < n and pos[j] == pos[i]:  # equal positions don't precede one another
            top, at, r = -np.inf, -1, int(rank[j]) - 1
            while r > 0:
                if best[r] > top:
                    top, at = best[r], where[r]
                r -= r & -r
            joined = top + k - gap * float(pos[j] + other[j]) + gap * k
            score[j], root[j] = (joined, root[at]) if at >= 0 and joined > k else (k, j)
            j += 1
        for m in range(i, j):
            value, r = score[m] + gap * float(pos[m] + other[m] + k), int(rank[m])
            while r <= size:
                if value > best[r]:
                    best[r], where[r] = value, m
                r += r & -r
        i = j
    return score, root


def _runs(k: int, gap: float):
    """Rows sorted by (t, partner, pos, partner_pos) within the partition to one row per run: seeds of one chain on one
    diagonal, each beginning at most k characters after the one before."""

    def chained(g: pd.DataFrame) -> pd.DataFrame:
        t, partner, pos, other = (g[c].to_numpy() for c in ("t", "partner", "pos", "partner_pos"))
        pos, other = pos.astype(np.int64), other.astype(np.int64)
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (partner[1:] != partner[:-1])) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(t)]):
            p, q = pos[a:b], other[a:b]
            score, root = chain(p, q, k, gap)
            order = np.lexsort((p, p - q, root))
            p, q, root, score = p[order], q[order], root[order], score[order]
            best = np.full(int(root.max()) + 1, -np.inf)
            np.maximum.at(best, root, score)
            new = np.flatnonzero((np.diff(root) != 0) | (np.diff(p - q) != 0) | (np.diff(p) > k)) + 1
            first, last = np.array([0, *new]), np.array([*new, len(p)]) - 1
            out.append((np.full(len(first), t[a]), np.full(len(first), partner[a]), root[first], p[first], p[last] + k, q[first], q[last] + k, best[root[first]]))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pd.DataFrame(dict(zip(("t", "partner", "chain", "p_start", "p_end", "q_start", "q_end", "score"), columns)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ready in whole_groups(batches, ["t", "partner"]):
            yield chained(ready)

    return run


def _windows(min_len: int):
    """The windows that begin within the given ranges (both ends included, cut at the text's ends)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text, t, ranges in zip(pdf["text"], pdf["t"], pdf["ranges"]):
                codes = codes_of(text)
                wanted = np.zeros(max(0, len(codes) - min_len + 1), dtype=bool)
                for r in ranges:
                    wanted[max(0, r["lo"]) : max(0, r["hi"] + 1)] = True
                at = np.flatnonzero(wanted)
                if len(at):
                    h = window_hashes(codes, min_len)[at].view(np.int64)
                    yield pd.DataFrame({"h": h, "t": np.full(len(at), t, dtype=np.int64), "pos": at.astype(np.int32)})

    return run


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, text) with t the class of equal texts; rows with a null id or text are dropped."""
    return docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.length(text_col).alias("n"), F.col(text_col).alias("text")
    )


def _links(docs: DataFrame, min_len: int) -> tuple[DataFrame, int]:
    """(t, pos, partner, partner_pos, again): every shared seed with its group's reference; again: the reference repeats the seed."""
    k = max(1, 5 * min_len // 8)
    long = docs.where(F.col("n") >= min_len).select("t", "text")
    seeds = cut(long.mapInPandas(_seeds(k, max(1, min(k, min_len - k))), SEED_SCHEMA), "seeds")
    groups = seeds.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min(F.struct("again", "t", "pos")).alias("ref"), F.count("*").alias("n"))
    groups = cut(groups.where("lo <> hi").select("h", "n", F.col("ref.t").alias("partner"), F.col("ref.pos").alias("partner_pos"), F.col("ref.again").alias("full")), "groups")
    links = by_group(seeds.drop("again"), groups).where("full or t <> partner").select("t", "pos", "partner", "partner_pos", "full")
    return links.distinct(), k  # copies of a text give equal rows


def _chained(links: DataFrame, k: int, gap: float) -> DataFrame:
    order = ["t", "partner", "pos", "partner_pos"]
    return links.where("t <> partner").select(*order).repartition("t").sortWithinPartitions(*order).mapInPandas(_runs(k, gap), RUN_SCHEMA)


def fuzzy_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 400, gap: float = 0.25) -> DataFrame:
    """Passages that two texts have in common up to gaps, one row per chain: (id_col, partner_id, p_start, p_end, q_start, q_end,
    score, identity).

    Both ids are the smallest ones of their text; the partner is one text per passage, not every text that holds it. identity is the share
    of the longer side that lies in runs of equal text. Null ids and texts and texts under min_len give no row.
    """
    base = text_classes(docs, id_col, text_col)
    links, k = _links(base, min_len)
    runs = _chained(links, k, gap)
    chains = runs.groupBy("t", "partner", "chain").agg(
        F.min("p_start").alias("p_start"), F.max("p_end").alias("p_end"), F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end"),
        F.max("score").alias("score"), F.sum(F.col("p_end") - F.col("p_start")).alias("equal"),
    )
    longer = F.greatest(F.col("p_end") - F.col("p_start"), F.col("q_end") - F.col("q_start"))
    names = cut(base.where(F.col("n") >= min_len).groupBy("t").agg(F.min("id").alias("id")), "names")
    named = chains.join(names.select("t", F.col("id").alias(id_col)), "t").join(names.select(F.col("t").alias("partner"), F.col("id").alias("partner_id")), "partner")
    return named.select(id_col, "partner_id", "p_start", "p_end", "q_start", "q_end", "score", F.least(F.lit(1.0), F.col("equal") / longer).alias("identity"))


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 400, gap: float = 0.25) -> DataFrame:
    """(id, span_start, span_end): merged stretches covered by windows of min_len characters that another row holds too.

    Rows whose whole text occurs in another row (at least min_len characters) come out as one span.
    Repetition inside one row doesn't count. Rows with a null id and null, empty and shorter texts give no row; offsets are
    in code points, end exclusive. Other columns of docs are ignored.
    """
    base = text_classes(docs, id_col, text_col)
    slim = cut(base.where(F.col("n") >= min_len).select("id", "t", "n"), "texts")
    classes = slim.groupBy("t", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    links, k = _links(base, min_len)
    links = cut(links, "links")
    runs = cut(_chained(links, k, gap), "runs")
    both = runs.select("t", F.col("p_start").alias("a"), F.col("p_end").alias("b")).unionByName(runs.select(F.col("partner").alias("t"), F.col("q_start").alias("a"), F.col("q_end").alias("b"))).distinct()
    # Runs of min_len characters are shared as they are; what may be shared beyond them are windows over one of their ends.
    whole = F.col("b") - F.col("a") >= min_len
    over = F.when(whole, F.array(F.struct((F.col("a") + k - min_len).alias("lo"), (F.col("a") - 1).alias("hi")), F.struct((F.col("b") - min_len + 1).alias("lo"), (F.col("b") - k).alias("hi"))))
    ranges = both.select("t", F.explode(over.otherwise(F.array(F.struct((F.col("a") + k - min_len).alias("lo"), (F.col("b") - k).alias("hi"))))).alias("r"))
    full = links.where("full").select("t", F.struct((F.col("pos") + k - min_len).alias("lo"), F.col("pos").alias("hi")).alias("r"))
    ranges = ranges.unionByName(full).groupBy("t").agg(F.collect_set("r").alias("ranges"))  # as many as the text has seeds, or a few times that
    chosen = ranges.join(classes, "t").select(F.col("rep").alias("id"), "ranges")
    windows = cut(base.select("id", "t", "text").join(chosen, "id").select("text", "t", "ranges").mapInPandas(_windows(min_len), WINDOW_SCHEMA), "windows")
    common = cut(windows.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n"), "common")
    hit = by_group(windows, common, how="left_semi").select("t", F.col("pos").alias("a"), (F.col("pos") + min_len).alias("b"))
    found = hit.unionByName(both.where(whole))
    before = Window.partitionBy("t").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)  # one text
    islands = found.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(Window.partitionBy("t").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("t", "island").agg(F.min("a").cast("bigint").alias("span_start"), F.max("b").cast("bigint").alias("span_end"))
    partly = classes.where("copies = 1").join(merged, "t").select(F.col("rep").alias(id_col), "span_start", "span_end")
    # Classes with more than a ten-thousandth of all rows are broadcast.
    copied = by_group(slim.select("id", F.col("t").alias("h"), F.col("n").alias("length")), classes.where("copies > 1").select(F.col("t").alias("h"), F.col("copies").alias("n")))
    copied = copied.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("span_start"), F.col("length").cast("bigint").alias("span_end"))
    return partly.unionByName(copied)


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 400) -> DataFrame:
    """For every row: its length, how many of its characters are shared, and the ratio (0 for null or empty texts)."""
    found = shared_spans(docs, id_col, text_col, min_len).groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    n = F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return docs.select(id_col, n.alias("n_chars")).join(found, id_col, "left").select(
        id_col, "n_chars", shared.alias("shared_chars"), F.coalesce(shared / F.nullif(F.col("n_chars"), F.lit(0)), F.lit(0.0)).alias("shared_ratio")
    )
