from confab.llm import runs as R

SCHEMA = "id bigint, session_pk bigint, seg_index bigint, speaker_name string, timestamp string, entity string, key string, block int"


def found(spark, rows):
    df = spark.createDataFrame([(i, s, k, n, t, "x", "y", 0) for i, (s, k, n, t) in enumerate(rows)], SCHEMA)
    return sorted((r.entity, r.first, r.last, r.n, r.duration) for r in R.speaker_runs(df).collect())


def test_written_forms_slips_and_numbers(spark):
    names = ["Ana Lúcia Prado", "ANA_LUCIA_PRADO", '"Ana Lucia Prado."', "Ana Lúcai Prado", "Ana Lúcia Prdo", "Bruno Teixeira 2", "Bruno Teixeira", "bruno teixeira", "spk_001", "spk_002", "spk-002"]
    assert [(a, b, n) for _, a, b, n, _ in found(spark, [(1, k, n, None) for k, n in enumerate(names)])] == [(0, 4, 5), (6, 7, 2), (9, 10, 2)]


def test_gaps_repeats_nulls_and_order(spark):
    rows = [(1, 9, "Ana", None), (1, 4, "Ana", None), (1, 4, "Bia", None), (1, 5, None, None), (1, 6, "Ana", None), (2, 0, None, None), (2, 1, None, None), (None, 0, "Ana", None), (3, None, "Ana", None)]
    assert [(s, a, b, n) for s, a, b, n, _ in found(spark, rows)] == [(1, 6, 9, 2)]
    assert found(spark, []) == []


def test_runs_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 10)
    labels = ["A a a a"] * 35 + ["B b b b"] * 5 + ["C c c c"] + ["D d d d"] * 19 + [None] + ["D d d d"] * 4
    got = [(a, b, n) for _, a, b, n, _ in found(spark, [(1, k, n, None) for k, n in enumerate(labels)])]
    assert got == [(0, 34, 35), (35, 39, 5), (41, 59, 19), (61, 64, 4)]


def test_durations(spark):
    rows = [(1, 0, "Ana", "2024-03-13T16:20:00.500"), (1, 1, "Ana", "16:20:08"), (2, 0, "Ana", "1672550385965"), (2, 1, "Ana", "01/01/2023 05:19:50"), (3, 0, "Ana", None), (3, 1, "Ana", "nonsense"), (4, 0, "Ana", "23:59:58"), (4, 1, "Ana", "00:00:03")]
    assert [d for *_, d in found(spark, rows)] == [7.5, 4.035, None, 5.0]
