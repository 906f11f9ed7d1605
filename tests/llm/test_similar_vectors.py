from __future__ import annotations

import numpy as np

from corpusloom.llm.similar_vectors import OneBitCodes, fit_cells, fit_parts, nearest_cells, rotation, search_vectors, similar_pairs, similar_vectors

SCHEMA = "chunk_id string, model string, dense array<float>, embedded_at timestamp_ntz, id int"


def brute(names, m, k, least):
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    out = set()
    alphabetical = np.argsort(np.array(names))
    for i in range(len(u)):
        score = np.round(u @ u[i], 6)
        order = [j for j in alphabetical[np.argsort(-score[alphabetical], kind="stable")][: k + 1] if j != i][:k]
        out |= {(names[i], names[j]) for j in order if score[j] >= least}
    return out


def table(spark, rows):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(n, "m", [float(x) for x in v], at, 7) for n, v in rows], SCHEMA)


def clusters(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)


def test_small_tables_are_exact_with_copies_and_blocks(spark):
    m = np.concatenate([clusters(150), np.repeat(clusters(8, seed=9)[:1], 40, axis=0)])
    names = [f"v{i:03d}" for i in range(len(m))]
    df = table(spark, list(zip(names, m)))
    for least in (-1.0, 0.8):
        got = {(r["id"], r["neighbour"]) for r in similar_vectors(df, 5, least, "m", 16, epsilon=6.0, max_cell=50).collect()}
        assert got == brute(names, m, 5, least)


def test_recall_over_many_cells(spark):
    m = clusters(4000)
    names = [f"v{i:05d}" for i in range(len(m))]
    got = {(r["id"], r["neighbour"]) for r in similar_vectors(table(spark, list(zip(names, m))), 10, 0.8, "m", 16).collect()}
    want = brute(names, m, 10, 0.8)
    assert len(got & want) >= 0.97 * len(want) and all(a != b for a, b in got)


def test_recall_without_threshold_and_in_two_levels(spark):
    m = clusters(4000)
    names = [f"v{i:05d}" for i in range(len(m))]
    df, want = table(spark, list(zip(names, m))), brute(names, m, 10, -1.0)
    for coarse in (16_384, 4):
        got = {(r["id"], r["neighbour"]) for r in similar_vectors(df, 10, -1.0, "m", 16, max_coarse=coarse, max_cell=300).collect()}
        assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_cells_are_the_nearest_ones_in_small_slices(monkeypatch):
    x = clusters(300)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coarse = fit_cells(x, 6)
    parts = fit_parts(x, coarse, 5)
    monkeypatch.setattr("corpusloom.llm.similar_vectors.SLICE", 64)
    near = nearest_cells(x, coarse, parts, 6)
    all_cells = (coarse[:, None, :] + parts[None, :, :]).reshape(-1, x.shape[1])
    distance = ((x[:, None, :] - all_cells[None, :, :]) ** 2).sum(axis=2)
    assert near.shape == (300, 6) and (np.take_along_axis(distance, near, axis=1)[:, 0] <= distance.min(axis=1) + 1e-5).all()
    assert nearest_cells(x, coarse, parts[:1] * 0, 9).shape == (300, 6)


def test_unusable_rows_and_empty_table(spark):
    rows = [("a", None), ("b", [0.0] * 16), ("c", [1.0] * 5), ("d", []), ("e", [float("nan")] * 16), (None, [1.0] * 16), ("f", [1.0] * 16), ("g", [2.0] * 16)]
    import datetime

    old, new = datetime.datetime(2023, 1, 1), datetime.datetime(2024, 1, 1)
    data = [(n, "m", v, new, 1) for n, v in rows] + [("f", "m", [-1.0] * 16, old, 1), ("g", "m", [-1.0] * 16, None, 1), ("x", "other", [1.0] * 16, new, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    assert [tuple(r) for r in similar_pairs(df, model="m", dim=16).collect()] == [("f", "g")]
    assert similar_pairs(df.limit(0), model="m", dim=16).count() == 0


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(300, 96))
    u = (u / np.linalg.norm(u, axis=1, keepdims=True) @ rotation(96)).astype(np.float32)
    codes = OneBitCodes(u, 3.0)
    assert (np.abs(codes.estimate(u[:50]) - u[:50] @ u.T) <= codes.error + 0.02).mean() > 0.99


def test_search_scans_everything(spark):
    m = clusters(700)
    names = [f"v{i:03d}" for i in range(len(m))]
    df = table(spark, list(zip(names, m)))
    asked = spark.createDataFrame([(n,) for n in [*names[::50], "nobody", None]], "id string")
    want = {(a, b) for a, b in brute(names, m, 7, -1.0) if a in names[::50]}
    for block in (5, 1000):
        got = {(r["id"], r["neighbour"]) for r in search_vectors(df, asked, 7, model="m", dim=16, epsilon=6.0, block=block).collect()}
        assert got == want
    assert search_vectors(df, asked.limit(0), model="m", dim=16).count() == 0 == search_vectors(df.limit(0), asked, model="m", dim=16).count()
