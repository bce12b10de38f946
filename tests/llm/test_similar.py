import numpy as np
import pyarrow as pa
import pytest

from confab.llm import similar as S
from confab.llm.components import components

SCHEMA = "id bigint, embedding array<float>, is_active int, node bigint, component string"  # the last two clash


def brute(rows, dim, k=5, least=0.7):
    kept = [(i, np.asarray(v, float)) for i, v, a in rows if a == 1 and v is not None and len(v) == dim and np.any(v)]
    ids, u = np.array([i for i, _ in kept]), np.stack([v / np.linalg.norm(v) for _, v in kept])
    g = np.round(u @ u.T, 9)
    np.fill_diagonal(g, -2)
    out = set()
    for r in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-g[r, j], ids[j]))[:k]:
            if g[r, j] >= least:
                out.add((min(ids[r], ids[j]), max(ids[r], ids[j])))
    return {(int(a), int(b)) for a, b in out}


def pairs(spark, voice, face=()):
    make = lambda rows: spark.createDataFrame([(i, None if v is None else [float(x) for x in v], a, 9, "c") for i, v, a in rows], SCHEMA)
    got = S.similar_pairs(make(voice), make(face)).collect()
    return {(r.id_a, r.id_b) for r in got if r.modality == "voice"}, {(r.id_a, r.id_b) for r in got if r.modality == "face"}


def clusters(seed, dim, sizes, first=1, noise=0.45):
    rng, rows = np.random.default_rng(seed), []
    for n in sizes:
        centre = rng.standard_normal(dim)
        rows += [(first + len(rows) + k, centre + noise * rng.standard_normal(dim), 1) for k in range(n)]
    return rows


def test_recall_against_brute_force(spark):
    voice, face = clusters(1, 192, [1, 2, 7, 30, 12, 2] * 4), clusters(2, 512, [3, 1, 9, 2])
    got = pairs(spark, voice, face)
    for found, want in zip(got, (brute(voice, 192), brute(face, 512))):
        assert found <= want and len(found) >= 0.98 * len(want)


def test_rows_that_do_not_count(spark):
    base = clusters(3, 192, [3])
    bad = [(50, None, 1), (51, [], 1), (52, [0.0] * 192, 1), (53, base[0][1][:191], 1), (54, base[0][1], 0), (55, base[0][1], None), (56, [float("nan")] * 192, 1)]
    assert pairs(spark, base + bad)[0] == brute(base, 192)


def test_copies_rank_by_id(spark):
    base = clusters(4, 192, [2])
    rows = base + [(100 + k, base[0][1] * 2.0**k, 1) for k in range(8)]
    assert pairs(spark, rows)[0] == brute(rows, 192)


def test_empty_tables(spark):
    assert pairs(spark, []) == (set(), set())


@pytest.mark.parametrize("copies", [0, 60])
def test_large_neighbourhoods_are_walked(spark, monkeypatch, copies):
    rows = clusters(5, 192, [150], noise=0.3)
    rows += [(1000 + k, rows[0][1], 1) for k in range(copies)]
    monkeypatch.setattr(S, "BLOCK", 20)
    found, want = pairs(spark, rows)[0], brute(rows, 192)
    assert len(found & want) >= 0.9 * len(want)
    if copies:
        assert {p for p in want if p[1] >= 1000} <= found


def walked(rows, block, monkeypatch, k=3, pieces=7):
    monkeypatch.setattr(S, "BLOCK", block)
    cuts = range(0, len(rows), pieces)
    batches = [pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in part]), pa.array([i for _, i, _ in part]), pa.array([v for _, _, v in part], pa.list_(pa.float32()))], ["walk", "node", "embedding"]) for part in (rows[at : at + pieces] for at in cuts)]
    return {(int(n), int(m)) for out in S._walk(k, -1.0)(iter(batches)) for n, m in zip(out.column("node").to_pylist(), out.column("neighbour").to_pylist())}


@pytest.mark.parametrize("first", [7, 8, 16, 17, 40])
@pytest.mark.parametrize("second", [1, 8, 9, 16])
def test_walks_of_any_length_have_no_empty_block(monkeypatch, first, second):
    rng = np.random.default_rng(first)
    rows = [(walk, 1000 * walk + i, rng.standard_normal(6).tolist()) for walk, n in ((1, first), (2, second)) for i in range(n)]
    got = walked(rows, 8, monkeypatch)
    assert {n for n, _ in got} == {i for w, i, _ in rows if (first, second)[w - 1] > 1}
    for walk, n in ((1, first), (2, second)):
        if n <= 16:  # two blocks are compared as a whole
            ids, u = zip(*[(i, np.float32(v) / np.linalg.norm(np.float32(v))) for w, i, v in rows if w == walk])
            g = np.stack(u) @ np.stack(u).T
            np.fill_diagonal(g, -2)
            assert {(ids[a], ids[b]) for a in range(n) for b in np.argsort(-g[a])[: min(3, n - 1)]} == {p for p in got if p[0] // 1000 == walk}


def test_a_walk_of_exactly_one_production_block():
    rng = np.random.default_rng(5)
    batches = [pa.RecordBatch.from_arrays([pa.array([walk] * n), pa.array(np.arange(n) + walk * 10_000), pa.array(list(rng.standard_normal((n, 4)).astype(np.float32)), pa.list_(pa.float32()))], ["walk", "node", "embedding"]) for walk, n in ((1, 2048), (2, 4096), (3, 3))]
    assert sum(out.num_rows for out in S._walk(2, -1.0)(iter(batches))) == 2 * (2048 + 4096 + 3)


def test_windows_connect_everything_near():
    rng = np.random.default_rng(6)
    for _ in range(20):
        near = np.triu(rng.random((30, 30)) < 0.03)
        near = near | near.T | np.eye(30, dtype=bool)
        parent = S._joined(near[10:], np.arange(30), 10)
        for i in range(10, 30):
            assert len({parent[j] for j in np.flatnonzero(near[i])}) == 1


@pytest.mark.parametrize("least", [None, 0.3])
def test_nearest_without_and_with_a_low_threshold(spark, monkeypatch, least):
    monkeypatch.setattr(S, "BLOCK", 40)
    rows = clusters(8, 192, [40, 30, 20, 1, 1], noise=0.8)
    table = spark.createDataFrame([(i, [float(x) for x in v], a, 9, "c") for i, v, a in rows], SCHEMA)
    got = {(r.node // 2, r.neighbour // 2) for r in S.neighbours({0: (table, 192)}, 4, least).collect()}
    u = np.stack([v / np.linalg.norm(v) for _, v, _ in rows])
    g = u @ u.T
    np.fill_diagonal(g, -2)
    want = {(r + 1, int(j) + 1) for r in range(len(rows)) for j in np.argsort(-g[r])[:4] if g[r, j] >= (-1 if least is None else least)}
    assert len(got & want) >= 0.97 * len(want)


def test_hilbert_order_visits_neighbours():
    side = 8
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    order = cells[np.argsort(S.hilbert_keys(cells, 3))]
    assert np.abs(np.diff(order, axis=0)).sum(axis=1).tolist() == [1] * (side * side - 1)


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[k] for k in range(100, 120)} == {100} and got[201] == 200 and 3 in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
