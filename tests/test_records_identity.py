import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.operators import dialogue, frames, identity, records, store, tracking, vectors
from confab.sources import sessions

CANDIDATES = "array<struct<name:string,score:double>>"


def test_gender_keeps_all_where_none_fits(spark):
    df = spark.createDataFrame([(1, [("Ana", 0.9), ("Bruno", 0.8), ("Xyz", 0.7)], "male"), (2, [("Ana", 0.9)], "male"), (3, [("Ana", 0.9)], None), (4, [], "male"), (5, None, "male")], f"i int, c {CANDIDATES}, g string")
    got = {r.i: r.k and [x.name for x in r.k] for r in df.select("i", records.gender_kept(F.col("c"), F.col("g")).alias("k")).collect()}
    assert got == {1: ["Bruno", "Xyz"], 2: ["Ana"], 3: ["Ana"], 4: [], 5: None}


def test_metrics_record_has_all_keys_and_nulls(spark):
    row = dict(timestamp="2024-01-02T03:04:05.678", decision="VERIFIER_HIGH (0.91)", raw_best_name="Unknown", raw_conf=0.123456, chosen_name='Ana "A"', chosen_conf=0.9, final_name=None, final_speaker="spk_001", audio_gender=None,
               candidates=[(f'n"{i}', 0.5 + i / 3) for i in range(7)], filtered=[("a", 0.9), ("b", 0.84)], asd_active=True, n_faces=2, fn_reasons=["BELOW: 0.1", "X"], fp_risk="none", fp_reasons=["w: 1"], text="olá", duration_s=1.239, whisper_ms=None, verifier_ms=2.25, segment_ms=3.0, avg_logprob=-0.12345, avg_no_speech=0.5)
    schema = f"timestamp string, decision string, raw_best_name string, raw_conf double, chosen_name string, chosen_conf double, final_name string, final_speaker string, audio_gender string, candidates {CANDIDATES}, filtered {CANDIDATES}, asd_active boolean, n_faces int, fn_reasons array<string>, fp_risk string, fp_reasons array<string>, text string, duration_s double, whisper_ms double, verifier_ms double, segment_ms double, avg_logprob double, avg_no_speech double"
    r = json.loads(records.metrics_record(spark.createDataFrame([tuple(row.values())], schema)).first().record)
    assert len(r) == 28 and r["raw_best_name"] is None and r["final_name"] is None and r["whisper_ms"] is None and r["is_identified"] is False
    assert r["margin"] == 0.06 and r["raw_conf"] == 0.1235 and r["fn_reasons"] == ["BELOW", "X"] and r["fp_reasons"] == ["w: 1"] and len(r["candidates"]) == 5 and r["candidates"][1] == ['n"1', 0.8333]


def test_kept_frames_and_tokens(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0, 5.0, 1.0]), (2, [float("-inf")] * 4)], "i int, s array<double>")
    got = {r.i: tuple(r)[1:] for r in df.select("i", frames.best_token(F.col("s")).alias("b"), frames.best_token(frames.masked(F.col("s"), (1,), F.lit(False), ())).alias("m"), frames.drawn_token(F.col("s"), 1.0, F.lit(0.999999)).alias("d")).collect()}
    assert got[1] == (1, 2, 3) and got[2][0] == 0
    text = "  olá 🙂 "
    raw = text.encode()
    import base64

    cut = spark.createDataFrame([([base64.b64encode(raw[i : i + 3]).decode() for i in range(0, len(raw), 3)],)], "t array<string>")
    assert cut.select(frames.token_text(F.col("t"))).first()[0] == text.strip()


def test_spaced_is_greedy_across_stretches(spark):
    rng = np.random.default_rng(4)
    times = np.sort(np.round(rng.random(300) * 900, 3))
    want, last = [], -np.inf
    for t in times:
        if t - last >= 10:
            want.append(t)
            last = t
    df = spark.createDataFrame([("a", float(t)) for t in times] + [("b", 1.0), ("b", 1.0)], "k string, at double").repartition(5)
    got = identity.spaced(df, "k", "at", 10.0).collect()
    assert sorted(r.at for r in got if r.k == "a") == want and [r.at for r in got if r.k == "b"] == [1.0]


def test_folds_cut_at_pauses_give_the_same(spark):
    rng = np.random.default_rng(5)
    at = np.cumsum(rng.choice([1.0, 2.0, 9.0], 200))
    rows = [(s, i, 1000 * s + i, str(rng.choice(["bom dia", "bom dia!", "vamos", "certo"])), float(t)) for s in (1, 2) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "session_pk bigint, seg_index bigint, id bigint, text string, at double")
    step = lambda state, r: r if state.keep(r["at"], r["text"]) else None
    whole = dialogue.fold(df, "session_pk", ["seg_index", "id"], dialogue.RepeatFilter, step, "session_pk bigint, seg_index bigint, id bigint, text string, at double")
    assert sorted(r.id for r in dialogue.drop_repeats(df).collect()) == sorted(r.id for r in whole.collect())


def test_names_that_are_saved(spark):
    names = spark.createDataFrame([("Ana Lima", None), ("ANA LIMA", "Person_1"), ("Bia", None), ("gente", None), ("Unknown", "x"), ("Person_3", None), (None, None), ("  ", None), ("Bia 2", None)], "name string, old_name string")
    files = spark.createDataFrame([("ana lima_20240101_1",), ("biazinha",), (None,)], "base string")
    assert {(r.name, r.old_name) for r in identity.savable(names, files, ("gente",)).collect()} == {("ANA LIMA", "Person_1"), ("Bia", None), ("Person_3", None), ("Unknown", "x"), ("Bia 2", None)}
    assert {r.name for r in identity.with_stored_file(names.filter("name is not null"), files).collect()} == {"Ana Lima", "ANA LIMA"}


def test_face_names_match_the_plain_fold(spark):
    rng = np.random.default_rng(6)
    known = rng.standard_normal((4, 16))
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    rows = [(s, f, f / 10, t, (known[t % 3] + 0.2 * rng.standard_normal(16)).tolist()) for s in (1, 2) for f in range(12) for t in range(3)]
    df = spark.createDataFrame(rows, "session bigint, frame bigint, at double, track bigint, embedding array<double>")
    profiles = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(known)], "name string, centroid array<double>")
    got = {(r.session, r.frame, r.track): r.name for r in tracking.name_faces(df, profiles, "session").collect()}
    assert len(got) == len(rows) and {got[s, 11, t] for s in (1, 2) for t in range(3)} == {"n0", "n1", "n2"}
    assert got[1, 0, 0] == "Unknown"


def test_face_names_compare_profiles_beyond_what_a_task_holds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    known = np.linalg.qr(rng.standard_normal((64, 64)))[0][:30]
    names = {f"n{i:02d}": v for i, v in enumerate(known)} | {"n99": known[4]}  # a copy: the first of equals counts
    free = np.linalg.qr(np.vstack([known, rng.standard_normal((34, 64))]).T)[0].T[30:]
    # of each track: the nearest profile, how near, and the frame at which it comes
    tracks = {s: [(4, 0.9, 0), (7 + s, 0.62, 0), (9, 0.62, 30), (11, 0.1, 5), (12 + s, 0.62, 50), (4, 0.8, 20), (11, 0.1, 60)] for s in (1, 2)} | {3: [(20, 0.9, 0)]}
    rows = []
    for s, own in tracks.items():
        for t, (k, near, begin) in enumerate(own):
            for f in range(begin, begin + 130 - 10 * t):
                v = near * known[k] + np.sqrt(1 - near**2) * (0.8 * free[t] + 0.6 * free[8 + rng.integers(20)])
                rows.append((s, f, f / 10, t, (float(rng.uniform(1, 9)) * v).tolist()))
    want = {}
    for s in tracks:
        namer = tracking.FaceNamer(known=dict(names))
        for f in sorted({r[1] for r in rows if r[0] == s}):
            shown = {r[3]: np.array(r[4]) / (np.linalg.norm(r[4]) + 1e-8) for r in rows if r[:2] == (s, f)}
            want |= {(s, f, t): (n, round(x, 9)) for t, (n, x) in namer.take(f / 10, shown).items()}
    df = spark.createDataFrame(rows, "session bigint, frame bigint, at double, track bigint, embedding array<double>").repartition(5)
    profiles = spark.createDataFrame([(n, v.tolist()) for n, v in names.items()], "name string, centroid array<double>")
    found = lambda: {(r.session, r.frame, r.track): (r.name, round(r.score, 9)) for r in tracking.name_faces(df, profiles, "session").collect()}
    assert {n for n, _ in want.values()} >= {"Unknown", "n04", "n08", "n09", "n13", "n14", "n20", "Person_1"}
    assert found() == want
    monkeypatch.setattr(tracking, "MOST_PROFILES", 0)
    monkeypatch.setattr(vectors, "KNOWN_BYTES", 8 * 64 * 8, raising=False)
    assert found() == want


def test_session_files_are_in_order_and_replaceable(spark, tmp_path):
    lines = spark.createDataFrame([(pk, i, f"line {i}") for pk in (1, 2) for i in range(50)], "session_pk bigint, seg_index bigint, line string").repartition(7)
    sessions.save_sessions(str(tmp_path), lines, lines.limit(0), lines.filter("session_pk = 1"), lines.withColumnRenamed("line", "record"), ["seg_index"])
    text = lambda kind, pk: [x for f in sorted((tmp_path / kind / f"session_pk={pk}").glob("part-*")) for x in f.read_text().splitlines()]
    assert text("transcript", 1) == [f"line {i}" for i in range(50)] == text("metrics", 2)
    sessions.write_lines(lines.filter("session_pk = 2 and seg_index < 3"), str(tmp_path / "transcript"), ["seg_index"])
    assert text("transcript", 2) == ["line 0", "line 1", "line 2"] and len(text("transcript", 1)) == 50


def test_tables_scripts_and_statements(spark, tmp_path):
    store.run_script(spark, f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path / 'kept'}'; USE kept")
    store.create_tables(spark, "kept")
    store.create_tables(spark, "kept")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN kept").collect()} >= set(store.SCHEMAS)
    assert store.run_sql({"t": spark.range(10)}, "SELECT count(*) AS n FROM {t} WHERE id >= :least", {"least": 4}).first().n == 6
    store.run_script(spark, "USE default; DROP DATABASE kept CASCADE")
    with pytest.raises(Exception):
        store.run_script(spark, "SELECT 1; nonsense")
