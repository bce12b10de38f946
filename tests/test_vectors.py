import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.functions import columns as C
from confab.operators import vectors as V


def test_cosine_dot_and_unit(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>").select(
        C.cosine(F.col("a"), F.col("b")).alias("ab"), C.cosine(F.col("a"), F.col("z")).alias("az"), C.dot(F.col("a"), F.col("s")).alias("short"), C.unit(F.col("z")).alias("u")
    ).first()
    assert row.ab == pytest.approx(2**-0.5) and row.az == 0 and row.short == 0 and row.u == [0.0, 0.0]


def test_best_name_ties_go_to_the_first(spark):
    scored = spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.9), (2, "a", 0.1)], "k int, n string, score double")
    got = {r.k: (r.n, r.margin, r.accepted) for r in V.best_names(scored, "k", "n", 0.5).collect()}
    assert got == {1: ("a", 0.0, True), 2: ("a", 1.0, False)}


def test_speaker_tracker():
    t = V.SpeakerTracker()
    a = t.take(np.array([1.0, 0, 0]))
    assert t.take(np.array([0.95, 0.1, 0])) == a != t.take(np.array([0.0, 1, 0]))
    full = V.SpeakerTracker(most=2)
    first = full.take(np.array([1.0, 0, 0]))
    full.take(np.array([0.0, 1, 0]))
    assert full.take(np.array([0.3, 0, 0.95])) == first


def test_enrolment_gate():
    g = V.Enroller()
    assert g.take(np.array([1.0, 0]), 0.0)
    assert not g.take(np.array([0.0, 1]), 400) and not g.take(np.array([1.0, 0]), 400)
    assert g.take(np.array([1.0, 0.5]), 400) and not g.take(np.array([1.0, 0.8]), 410)


def test_homonyms_split_by_voice():
    h = V.HomonymSplitter()
    assert [h.take(np.array(v, float)) for v in ([1, 0], [0.9, 0.2], [0, 1])] == [0, 0, 1]


def test_centroid_linkage_and_cut():
    z = V.centroid_linkage(np.array([[0.0], [1], [10], [11], [30]]))
    assert tuple(z[0]) == (0, 1, 1.0, 2)
    labels = V.flat_clusters(z, z[:, 2], 3.0)
    assert len(set(labels)) == 3 and labels[0] == labels[1] and labels[2] == labels[3]


def test_agglomerate_gives_the_wanted_number():
    rng = np.random.default_rng(1)
    centres = np.eye(4)
    points = np.concatenate([c + 0.05 * rng.standard_normal((15, 4)) for c in centres])
    assert len(set(V.agglomerate(points))) == 4 and len(set(V.agglomerate(points, wanted=2))) == 2
    assert V.agglomerate(points[:1]).tolist() == [0]


def test_consolidation_keeps_the_real_name():
    v = {"Person_1": np.array([1.0, 0]), "Ana": np.array([0.98, 0.199]), "Bia": np.array([0.97, 0.243])}
    left, merged = V.consolidate(list(v), v, lambda n: n.startswith("Person_"))
    assert set(left) == {"Ana", "Bia"} and merged == {"Person_1": "Bia"}  # every later identity that is like it is tried in turn


def test_diversity_closed_form(spark):
    rng = np.random.default_rng(2)
    vs = rng.standard_normal((6, 5))
    u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    g = u @ u.T
    want = 1 - (g.sum() - np.trace(g)) / 30
    df = spark.createDataFrame([(1, v.tolist()) for v in vs] + [(2, [1.0] * 5)], "k int, v array<double>")
    got = {r.k: r.diversity for r in V.diversity(df, "k", "v").collect()}
    assert got[1] == pytest.approx(want) and got[2] == 0


@pytest.mark.parametrize("most", [None, 0])
def test_matches_equal_brute_force_in_one_matrix_and_in_blocks(spark, monkeypatch, most):
    rng = np.random.default_rng(3)
    known, probes = rng.standard_normal((23, 6)), rng.standard_normal((40, 6))
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    known[5] = known[4]  # a tie
    if most is not None:
        monkeypatch.setattr(V, "KNOWN_BYTES", most)
        monkeypatch.setattr(V, "BLOCK_NAMES", 7)
        monkeypatch.setattr(V, "BLOCK_PROBES", 11)
    k = spark.createDataFrame([(f"n{i:02d}", v.tolist()) for i, v in enumerate(known)], "name string, centroid array<double>")
    p = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(probes)] + [(90, None, "x"), (91, [], "x"), (92, [0.0] * 6, "x"), (93, [1.0, 2.0], "x")], "id bigint, v array<double>, score string")
    got = {(r.id, r["rank"]): (r.name, round(r.score, 9)) for r in V.matches(p, k, "id", "name", "v", top=3).collect()}
    want = {}
    for i, v in enumerate(probes):
        g = np.round(known @ v / np.linalg.norm(v), 12)
        for rank, j in enumerate(sorted(range(23), key=lambda j: (-g[j], j))[:3], 1):
            want[i, rank] = (f"n{j:02d}", round(float(g[j]), 9))
    assert {x: y for x, y in got.items() if x[0] < 90} == want and {x for x, _ in got if x >= 90} == {92, 93}
    assert V.matches(p, k.limit(0), "id", "name", "v").count() == 0


def test_sums_of_ragged_and_missing_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", [5.0]), ("b", None), ("b", []), (None, [1.0]), ("c", [1.0, None])], "k string, v array<double>")
    assert {r.k: (r.n, r.total) for r in V.vector_sums(df.repartition(3), "k", "v").collect()} == {"a": (3, [9.0, 6.0]), None: (1, [1.0])}
