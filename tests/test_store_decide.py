from pyspark.sql import functions as F

from confab.operators import decide, reports, store

EVIDENCE = "id int, raw_name string, raw_conf double, best_name string, best_conf double, second_conf double, gender string, active_person string, active_name string, guess_person string, guess_name string, guess_ok boolean, faces int, face_person string, face_name string, hint string, hint_face string, hint_name string, expected int, activity boolean, people array<struct<person:string,name:string>>, settled boolean"
BASE = {"raw_name": "Unknown", "raw_conf": -1.0, "guess_ok": True, "faces": 0, "activity": True, "people": [], "settled": True}


def decided(spark, *cases):
    columns = [c.split()[0] for c in EVIDENCE.replace("array<struct<person:string,name:string>>", "x").split(", ")]
    rows = [tuple(({"id": i} | BASE | c).get(k) for k in columns) for i, c in enumerate(cases)]
    return [r.asDict() for r in decide.gender_passes(decide.cascade(spark.createDataFrame(rows, EVIDENCE))).orderBy("id").collect()]


def test_cascade(spark):
    strong = {"raw_name": "Alice", "raw_conf": 0.9, "best_name": "Alice", "best_conf": 0.9}
    weak = {"raw_name": "Alice 2", "raw_conf": 0.70, "active_person": "spk_1", "active_name": "Person_1"}
    face = {"faces": 1, "face_person": "spk_2", "face_name": "Bob"}
    got = decided(
        spark, strong, strong | {"second_conf": 0.5}, strong | {"best_conf": 0.86, "raw_conf": 0.6, "second_conf": 0.84}, weak, {k: v for k, v in weak.items() if not k.startswith("active_")},
        face, face | {"expected": 3}, {"faces": 1, "face_person": "spk_3", "face_name": "Person_1", "raw_conf": 0.4}, {"faces": 1, "face_person": "spk_3", "face_name": "Person_1", "raw_conf": 0.1, "activity": False},
        {"faces": 2, "guess_person": "spk_4", "guess_ok": False, "hint": "spk_9"}, {"hint": "spk_9", "hint_face": "spk_2", "hint_name": "Bob"},
    )
    assert [g["decision"] for g in got] == ["VERIFIER_HIGH", "VERIFIER_HIGH", "SESSION_TRACKER", "VERIFIER_WEAK", "SESSION_TRACKER", "FACE_ONLY", "SESSION_TRACKER", "SINGLE_FACE", "SESSION_TRACKER", "SESSION_HINT", "SESSION_FACE"]
    assert got[3]["speaker_name"] == "Alice" and got[10]["person"] == "spk_2"


def test_gender_passes(spark):
    people = [("spk_1", "Maria Lima"), ("spk_2", "Pedro Dias")]
    got = decided(spark, {"hint": "spk_9", "gender": "female", "faces": 2, "people": people, "activity": False}, {"active_person": "spk_2", "active_name": "Pedro Dias", "gender": "female", "faces": 2, "people": people}, {"hint": "spk_9", "gender": "female", "people": people, "activity": False, "settled": False})
    assert [(g["final_decision"], g["final_name"]) for g in got] == [("GENDER_FACE", "Maria Lima"), ("GENDER_REROUTE", "Maria Lima"), ("SESSION_HINT", None)]


def test_insert_ignore_keeps_the_first(spark):
    have = spark.createDataFrame([(3, "Ana", "female")], "id bigint, name string, gender string")
    new = spark.createDataFrame([("Ana", "male", 0), ("Bia", "female", 2), ("Bia", None, 1), (None, None, 3)], "name string, gender string, ord int")
    got = {r.name: (r.id, r.gender) for r in store.insert_ignore(have, new).collect()}
    assert got["Ana"] == (3, "female") and got["Bia"] == (4, None) and len(got) == 2


def test_upsert_gives_a_new_id_and_drops_children(spark):
    sessions = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, session_id string")
    kids = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, session_pk bigint")
    out = store.upsert_sessions(sessions, spark.createDataFrame([("a",)], "session_id string"), {"segments": kids})
    assert sorted(tuple(r) for r in out["sessions"].collect()) == [(2, "b"), (3, "a")] and [r.session_pk for r in out["segments"].collect()] == [2]


def test_reasons_and_risk(spark):
    df = spark.createDataFrame([("ASD (x)", "Ana", 0.6, [("Ana", 0.6)], [], "male")], "d string, n string, s double, offered array<struct<name:string,score:double>>, kept array<struct<name:string,score:double>>, g string")
    row = df.select(reports.missed_reasons(F.col("d"), F.col("n"), F.col("s"), F.col("kept"), F.col("offered"), F.col("g")).alias("r"), reports.false_positive_risk(F.col("d"), F.lit("Ana Lima"), F.col("s"), F.col("g"), F.lit(True), F.lit(5), F.lit(4)).alias("f")).first()
    assert row.r == ["BELOW_THRESHOLD", "GENDER_FILTERED"]
    assert row.f.risk == "high" and row.f.reasons == ["UNCONFIRMED_KNOWN", "GENDER_MISMATCH", "SPEAKER_OVERFLOW"]


def test_transcript_falls_back_to_the_speaker(spark):
    rows = spark.createDataFrame([(1, 0, "10:00:00", None, "spk_1", "oi", False), (1, 1, "10:00:01", "", "spk_2", "olá", True)], "s int, seg_index int, clock string, name string, speaker string, text string, uncertain boolean")
    assert reports.transcript_text(rows, "s", ["seg_index"]).first().transcript == "[10:00:00] spk_1: oi\n[10:00:01] spk_2: [texto incerto] olá"
