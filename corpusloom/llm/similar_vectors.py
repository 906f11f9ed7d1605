"""Most similar vectors for every vector.

Method: randomly rotated one-bit codes. Vectors are spread over cells (spherical k-means fitted on a
bounded sample; every vector lies in its `spill` nearest cells and is asked about in its `probes` nearest). Beyond MAX_CELLS
a cell is a coarse centroid and one of several parts of what a vector has beyond it, so that cells keep their size as the
collection grows. Within a cell each vector is a code of one bit
per rotated dimension plus a correction scalar; inner products with 4-bit queries are estimated from
popcounts, and only pairs whose estimate plus error bound can still matter are computed exactly.

Equal vectors form one class that takes part once; its members are put back at the end, so a group of copies
of any size costs one vector. Cells larger than `max_cell` are compared block by block in separate tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

CELL_ROWS = 256
MAX_CELLS = 16_384
SAMPLE_PER_CELL = 32
MAX_SAMPLE = 262_144
MAX_PARTS = 4096
QUERY_ROWS = 256
SLICE = 1 << 22
BROADCAST_ROWS = 100_000
HOT_CLASSES = 10_000


def usable_vectors(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """(id, dense): of each chunk_id within the model the row of the latest embedded_at (null counts as oldest),
    kept if it has exactly dim finite numbers that are not all zero. Rows without chunk_id are dropped."""
    own = vectors.where((F.col("model") == model) & F.col("chunk_id").isNotNull()).select(
        F.col("chunk_id").alias("id"), "dense", F.coalesce(F.col("embedded_at").cast("timestamp"), F.lit(0).cast("timestamp")).alias("at")
    )
    latest = own.groupBy("id").agg(F.max_by("dense", "at").alias("dense"))
    finite = F.forall("dense", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return latest.where((F.size("dense") == dim) & finite & F.exists("dense", lambda x: x != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float32)


def _unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(scale > 0, scale, 1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means on the sample."""
    x = _unit(sample.astype(np.float64)).astype(np.float32)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 1024] @ c.T).argmax(axis=1) for a in range(0, len(x), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 to rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


class OneBitCodes:
    """Codes of unit vectors: packed signs of the rotated vector and <code, vector>."""

    def __init__(self, rotated: np.ndarray, epsilon: float):
        dim = rotated.shape[1]
        bits = rotated > 0
        self.root = math.sqrt(dim)
        self.words = _packed(bits)
        self.ones = bits.sum(axis=1).astype(np.float32)
        self.fit = np.abs(rotated).sum(axis=1) / self.root
        self.error = epsilon * np.sqrt(np.maximum(0, 1 - self.fit**2) / (self.fit**2 * max(1, dim - 1))) + 0.01

    def estimate(self, queries: np.ndarray) -> np.ndarray:
        """Estimated inner products, a row per rotated query; queries are rounded to 4 bits a dimension."""
        low = queries.min(axis=1, keepdims=True)
        step = np.maximum((queries.max(axis=1, keepdims=True) - low) / 15, 1e-12)
        level = np.rint((queries - low) / step).astype(np.uint8)
        dots = np.zeros((len(queries), len(self.words)), dtype=np.float32)
        for plane in range(4):
            q = _packed((level >> plane) & 1)
            count = np.zeros(dots.shape, dtype=np.uint8 if self.words.shape[1] <= 3 else np.uint16)
            for w in range(self.words.shape[1]):
                count += np.bitwise_count(q[:, w, None] & self.words[None, :, w])
            dots += np.float32(1 << plane) * count
        inner = 2 * (step * dots + low * self.ones[None, :]) - queries.sum(axis=1, keepdims=True)
        return inner / (self.root * self.fit[None, :])


def nearest_in_cell(unit: np.ndarray, names: np.ndarray, query: np.ndarray, data: np.ndarray, turn: np.ndarray, k: int, least: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, cosine rounded to 6) of each query's k best data rows by (cosine, name) of at least `least`.

    unit holds the rows in double precision; query and data are row numbers; a row is not its own neighbour.
    """
    rotated = (unit @ turn).astype(np.float32)
    codes = OneBitCodes(rotated[data], epsilon)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(query), QUERY_ROWS):
        q = query[a : a + QUERY_ROWS]
        estimate = codes.estimate(rotated[q])
        floor = np.full(len(q), least - 1e-6, dtype=np.float32)
        if least <= -1 and len(data) > k + 1:  # without a threshold the (k+1)-th lower bound prunes
            floor = np.maximum(floor, np.partition(estimate - codes.error, -(k + 1), axis=1)[:, -(k + 1)])
        i, j = np.nonzero(estimate + codes.error >= floor[:, None])
        i, j = q[i], data[j]
        i, j = i[i != j], j[i != j]
        exact = np.concatenate([np.einsum("ij,ij->i", unit[i[b : b + 65536]], unit[j[b : b + 65536]]) for b in range(0, len(i), 65536)] or [np.empty(0)])
        exact = np.round(exact, 6)
        keep = exact >= least
        i, j, exact = i[keep], j[keep], exact[keep]
        order = np.lexsort((names[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[place < k], j[place < k], exact[place < k]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))


def fit_parts(sample: np.ndarray, coarse: np.ndarray, parts: int, rounds: int = 5, seed: int = 13) -> np.ndarray:
    """Centroids of what the sample's unit vectors have beyond their nearest coarse centroid (plain k-means)."""
    x = _unit(sample.astype(np.float64)).astype(np.float32)
    near = np.concatenate([(x[a : a + 1024] @ coarse.T).argmax(axis=1) for a in range(0, len(x), 1024)])
    x -= coarse[near]
    r = x[np.random.default_rng(seed).choice(len(x), min(parts, len(x)), replace=False)].copy()
    for _ in range(rounds):
        half = (r * r).sum(axis=1) / 2
        near = np.concatenate([(x[a : a + 1024] @ r.T - half).argmax(axis=1) for a in range(0, len(x), 1024)])
        total, count = np.zeros_like(r), np.bincount(near, minlength=len(r))
        np.add.at(total, near, x)
        r[count > 0] = total[count > 0] / count[count > 0, None]
    return r


def nearest_cells(unit: np.ndarray, coarse: np.ndarray, parts: np.ndarray, top: int) -> np.ndarray:
    """Each row's `top` nearest cells, nearest first. A cell is a coarse centroid and one of the parts: number coarse * len(parts) + part.

    Rows are taken in slices, so that no array holds more than SLICE numbers.
    """
    out = []
    wide = min(top, len(coarse))
    top = min(top, len(coarse) * len(parts))
    rows = max(1, SLICE // max(len(coarse), wide * len(parts)))
    half = (parts * parts).sum(axis=1) / 2
    for a in range(0, len(unit), rows):
        x = unit[a : a + rows]
        score = x @ coarse.T
        near = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
        score = np.take_along_axis(score, near, axis=1)
        if len(parts) == 1:
            order = np.argsort(-score, axis=1)[:, :top]
            out.append(np.take_along_axis(near, order, axis=1).astype(np.int64))
            continue
        # nearness to coarse + part: x c + x r - c r - r r / 2, up to a constant
        fine = score[:, :, None] + (x @ parts.T)[:, None, :] - (coarse[near.ravel()] @ parts.T).reshape(len(x), wide, -1) - half
        fine = fine.reshape(len(x), -1)
        best = np.argpartition(-fine, top - 1, axis=1)[:, :top]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(fine, best, axis=1), axis=1), axis=1)
        out.append(np.take_along_axis(near, best // len(parts), axis=1).astype(np.int64) * len(parts) + best % len(parts))
    return np.concatenate(out) if out else np.empty((0, top), dtype=np.int64)


def similar_vectors(
    vectors: DataFrame, k: int = 10, least: float = -1.0, model: str = "beacon-embed-96", dim: int = 96, probes: int = 8, spill: int = 2, epsilon: float = 3.0,
    max_cell: int = 4096, max_coarse: int = MAX_CELLS,
) -> DataFrame:
    """(id, neighbour, cosine): for every usable vector its k most similar others, ties by smaller id.

    Cosines are in double precision, rounded to 6 decimals; neighbours below `least` are left out.
    A neighbour is seen if one of its `spill` nearest cells is among the vector's `probes` nearest; everything within a cell is
    exact up to the error bound. Empty or unusable input gives no rows; extra columns of vectors are ignored.
    """
    spark = vectors.sparkSession
    # Equal vectors: two independent 64-bit hashes.
    same = F.concat(F.hex(F.xxhash64("dense")), F.lit("-"), F.hex(F.xxhash64(F.lit(3), "dense")))
    usable = cut(usable_vectors(vectors, model, dim).select("id", same.alias("class"), "dense"), "vectors")
    reps = usable.groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("dense").alias("dense"))

    n = usable.count()
    cells = max(1, n // CELL_ROWS)
    coarse_cells, part_cells = min(cells, max_coarse), min(MAX_PARTS, -(-cells // max_coarse))
    rows = min(max(coarse_cells, part_cells) * SAMPLE_PER_CELL, MAX_SAMPLE)
    share = min(1.0, rows / max(1, n))
    sample = usable.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("dense").limit(rows * 3 // 2)
    points = np.array(sample.toPandas()["dense"].tolist(), dtype=np.float32).reshape(-1, dim)
    if not len(points):
        points = np.eye(1, dim, dtype=np.float32)
    coarse = fit_cells(points, coarse_cells)
    parts = fit_parts(points, coarse, part_cells) if part_cells > 1 else np.zeros((1, dim), dtype=np.float32)
    centre = spark.sparkContext.broadcast((coarse, parts))  # at most MAX_CELLS and MAX_PARTS vectors
    turn = spark.sparkContext.broadcast(rotation(dim))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                near = nearest_cells(_unit(_matrix(pdf["dense"])), *centre.value, max(probes, spill))
                yield pdf.assign(cells=list(near))

    # Placed once; a row knows its cells, nearest first.
    placed = cut(reps.select("id", (F.col("copies") > 1).alias("many"), "dense").mapInPandas(assign, "id string, many boolean, dense array<float>, cells array<bigint>"), "placed")
    sizes = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("rows"))
    big = cut(sizes.where(F.col("rows") > max_cell).select("cell", F.ceil(F.col("rows") / max_cell).cast("int").alias("blocks")), "big")
    few = big.limit(BROADCAST_ROWS + 1).count()
    spread = placed.select("id", "many", "dense", F.posexplode("cells").alias("place", "cell")).select(
        "id", "many", "dense", "cell", (F.col("place") < probes).alias("q"), (F.col("place") < spill).alias("d")
    )
    if few:
        blocks = F.coalesce("blocks", F.lit(1))
        spread = spread.join(F.broadcast(big) if few <= BROADCAST_ROWS else big, "cell", "left").withColumn("blocks", blocks)
        spread = spread.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # A block of queries meets each block of data in a task of its own: (cell, query block, data block).
        as_query = spread.where("q or own = other").select("cell", F.col("own").alias("qb"), F.col("other").alias("db"), "id", "many", "dense", "q", (F.col("d") & (F.col("own") == F.col("other"))).alias("d"))
        as_data = spread.where("d and own <> other").select("cell", F.col("other").alias("qb"), F.col("own").alias("db"), "id", "many", "dense", F.lit(False).alias("q"), F.lit(True).alias("d"))
        work, key = as_query.unionByName(as_data), ["cell", "qb", "db"]
    else:
        work, key = spread, ["cell"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        names, many = pdf["id"].to_numpy(), pdf["many"].to_numpy()
        unit = _unit(_matrix(pdf["dense"]).astype(np.float64))
        i, j, cos = nearest_in_cell(unit, names, np.flatnonzero(pdf["q"]), np.flatnonzero(pdf["d"]), turn.value, k + 1, least, epsilon)
        return pd.DataFrame({"a": names[i], "b": names[j], "cosine": cos, "a_many": many[i], "b_many": many[j]})

    near = work.groupBy(*key).applyInPandas(compare, "a string, b string, cosine double, a_many boolean, b_many boolean")
    multi = cut(reps.where("copies > 1").select("class", F.col("id").alias("rep"), "copies"), "classes")
    near = near.unionByName(multi.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine"), F.lit(True).alias("a_many"), F.lit(True).alias("b_many")))

    # Classes back to members: only the k + 1 smallest ids of a class can be anybody's neighbour. Classes with more than a
    # ten-thousandth of all rows are at most 10,000 and are broadcast, so none is gathered in one task.
    hot = multi.where(F.col("copies") * HOT_CLASSES > n)
    slim = usable.select("id", "class")
    members = slim.join(F.broadcast(hot), "class").unionByName(slim.join(F.broadcast(hot.select("class")), "class", "left_anti").join(multi.where(F.col("copies") * HOT_CLASSES <= n), "class"))
    members = members.select("rep", "id", (F.col("copies") * HOT_CLASSES > n).alias("hot"))
    lots = members.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(64)))
    short = lots.withColumn("n", F.row_number().over(Window.partitionBy("rep", "lot").orderBy("id"))).where(F.col("n") <= k + 1)
    leaders = short.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1)
    wide = near.where("b_many").join(leaders.select("rep", "id"), F.col("b") == F.col("rep")).select("a", F.col("id").alias("b"), "cosine", "a_many")
    listed = near.where("not b_many").select("a", "b", "cosine", "a_many").unionByName(wide)
    by_rank = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    # The same pair may come from two cells: equal rows stand side by side, so dense_rank counts them once.
    ranked = listed.withColumn("n", F.dense_rank().over(by_rank)).where(F.col("n") <= k + 1).distinct()
    ranked = cut(ranked, "ranked")
    plain = ranked.where(~F.col("a_many") & (F.col("n") <= k)).select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine")
    theirs = ranked.where("a_many").select(F.col("a").alias("rep"), F.col("b").alias("neighbour"), "cosine")
    few_hot = theirs.join(F.broadcast(hot.select("rep")), "rep", "left_semi")  # at most HOT_CLASSES * (k + 1) rows
    own = members.where("hot").join(F.broadcast(few_hot), "rep").unionByName(members.where("not hot").join(theirs, "rep")).where("neighbour <> id").select("id", "neighbour", "cosine")
    place = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    own = own.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).drop("n")
    return plain.unionByName(own)


def similar_pairs(vectors: DataFrame, k: int = 10, least: float = 0.8, **options) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b, of which either is among the other's k nearest, with cosine of at least `least`."""
    near = similar_vectors(vectors, k, least, **{"probes": 3, "spill": 3} | options)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def search_vectors(vectors: DataFrame, asked: DataFrame, k: int = 10, least: float = -1.0, model: str = "beacon-embed-96", dim: int = 96, epsilon: float = 3.0, block: int = 1024) -> DataFrame:
    """(id, neighbour, cosine): the k nearest among all usable vectors of those whose chunk_id is in asked(id); ties by smaller id.

    All codes are scanned, so only the error bound (epsilon) can lose a neighbour. Queries are taken in blocks of
    about `block` rows and sent to every task; each batch keeps its own k best, and only those are shuffled.
    """
    spark = vectors.sparkSession
    usable = cut(usable_vectors(vectors, model, dim), "vectors")
    wanted = usable.join(asked.select("id").distinct(), "id", "left_semi")
    turn = spark.sparkContext.broadcast(rotation(dim))
    parts = max(1, -(-wanted.count() // block))
    found = None
    for part in range(parts):
        some = wanted.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toPandas()  # about one block

        def scan(batches, some=some):
            names, own = some["id"].to_numpy(), _matrix(some["dense"]).reshape(-1, dim)
            for pdf in batches:
                if not (len(pdf) and len(some)):
                    continue
                every = np.concatenate([names, pdf["id"].to_numpy()])
                unit = _unit(np.concatenate([own, _matrix(pdf["dense"])]).astype(np.float64))
                # a query's own row comes along as data; one more place is kept for it
                i, j, cosine = nearest_in_cell(unit, every, np.arange(len(own)), np.arange(len(own), len(every)), turn.value, k + 1, least, epsilon)
                out = pd.DataFrame({"id": every[i], "neighbour": every[j], "cosine": cosine})
                yield out[out["id"] != out["neighbour"]]

        near = usable.mapInPandas(scan, "id string, neighbour string, cosine double")
        found = near if found is None else found.unionByName(near)
    place = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return found.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).drop("n")
