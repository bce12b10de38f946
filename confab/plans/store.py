"""Queries of the session store."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions.columns import half_even
from confab.operators import store
from confab.session import table


def get_speaker(spark, d):
    return table(spark, d, "speakers").filter(F.col("name") == "Person_1").select("id", "name", "gender", "created_at")


def list_speakers(spark, d):
    return store.list_speakers(table(spark, d, "speakers"), table(spark, d, "voice_embeddings"), table(spark, d, "face_embeddings")).orderBy("name")


def list_sessions(spark, d):
    return store.list_sessions(table(spark, d, "sessions"), table(spark, d, "segments"), table(spark, d, "validations")).orderBy(F.desc("session_id"))


def get_session(spark, d):
    s = table(spark, d, "sessions").filter(F.col("id") == 3)
    return s.select("id", "session_id", F.coalesce("config", F.lit("{}")).alias("config"), F.coalesce("summary", F.lit("{}")).alias("summary"), "audio_file")


def get_segments(spark, d):
    return store.segments_of(table(spark, d, "segments"), 3)


def latest_validation(spark, d):
    return store.latest_validations(table(spark, d, "validations"))


def accuracy_trend(spark, d):
    return store.accuracy_trend(table(spark, d, "sessions"), table(spark, d, "validations"))


def insert_ignore(spark, d):
    incoming = table(spark, d, "segments").filter("final_name is not null").groupBy(F.col("final_name").alias("name")).agg(F.min("id").alias("ord"), F.min_by("audio_gender", "id").alias("gender"))
    return store.insert_ignore(table(spark, d, "speakers"), incoming)


def upsert_cascade(spark, d):
    """Every tenth session saved again: new ids, and how many segments and validations each session keeps."""
    sessions = table(spark, d, "sessions").select("id", "session_id")
    out = store.upsert_sessions(sessions, sessions.filter("id % 10 = 0").select("session_id"), {"segments": table(spark, d, "segments"), "validations": table(spark, d, "validations")})
    count = lambda t, name: out[t].groupBy(F.col("session_pk").alias("id")).agg(F.count("*").alias(name))
    joined = out["sessions"].join(count("segments", "segments"), "id", "left").join(count("validations", "validations"), "id", "left")
    return joined.select("id", "session_id", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("validations", F.lit(0)).alias("validations"))


def delete_cascade(spark, d):
    """What is left of voices and faces when the organisations leave."""
    gone = F.col("name").rlike("(?i)(ltda|eireli|s\\.a\\.)")
    out = store.delete_speakers(table(spark, d, "speakers"), gone, {"voice": table(spark, d, "voice_embeddings"), "face": table(spark, d, "face_embeddings")})
    return out["voice"].select(F.lit("voice").alias("kind"), "id", "speaker_id").unionByName(out["face"].select(F.lit("face").alias("kind"), "id", "speaker_id"))


def soft_delete(spark, d):
    return table(spark, d, "voice_embeddings").select("id", F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("is_active")).alias("is_active"))


def hard_delete(spark, d):
    return table(spark, d, "face_embeddings").filter("id % 7 <> 0").select("id", "speaker_id")


def rename_speaker(spark, d):
    return table(spark, d, "speakers").select("id", F.when(F.col("name") == "Person_1", F.lit("Convidada Nova")).otherwise(F.col("name")).alias("name"))


def rename_voice_files(spark, d):
    files = table(spark, d, "voice_embeddings").select("id", F.regexp_replace("source_file", r"\.(npy|json)$", "").alias("base"))
    return store.rename_prefixed(files, "Person_1", "Convidada")


def count_voice(spark, d):
    return table(spark, d, "voice_embeddings").filter("is_active = 1").groupBy("speaker_id").agg(F.count("*").alias("voices"))


def voice_means(spark, d):
    means = store.mean_embeddings(table(spark, d, "voice_embeddings"), table(spark, d, "speakers"), 192)
    return means.select("name", F.posexplode("mean").alias("pos", "x")).select("name", "pos", half_even(F.col("x"), 6).alias("x"))


def face_means(spark, d):
    means = store.mean_embeddings(table(spark, d, "face_embeddings"), table(spark, d, "speakers"), 512)
    return means.select("name", F.posexplode("mean").alias("pos", "x")).select("name", "pos", half_even(F.col("x"), 6).alias("x"))


def save_segments_coerce(spark, d):
    docs = table(spark, d, "segments").select("id", F.try_parse_json(F.regexp_replace("metrics_json", r":\s*(NaN|-?Infinity)\b", ": null")).alias("doc")).filter(F.schema_of_variant("doc").startswith("OBJECT"))
    return store.coerce_segments(docs)


def validation_accuracy(spark, d):
    return store.line_accuracy(table(spark, d, "validations"), table(spark, d, "validation_lines"))


QUERIES = {
    f.__name__: f
    for f in (
        get_speaker, list_speakers, list_sessions, get_session, get_segments, latest_validation, accuracy_trend, insert_ignore, upsert_cascade, delete_cascade, soft_delete, hard_delete, rename_speaker,
        rename_voice_files, count_voice, voice_means, face_means, save_segments_coerce, validation_accuracy,
    )
}


def _means(source: str, dim: int) -> str:
    return f"""
        WITH e AS (
            SELECT s.name, unnest(v.embedding) AS x, generate_subscripts(v.embedding, 1) - 1 AS pos
            FROM {source} v JOIN speakers s ON s.id = v.speaker_id WHERE v.is_active = 1 AND len(v.embedding) = {dim}
        ), m AS (SELECT name, pos, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY name, pos),
        n AS (SELECT name, sqrt(sum(x * x)) AS n FROM m GROUP BY name)
        SELECT m.name, CAST(m.pos AS INTEGER) AS pos, round_even(CASE WHEN n.n > 0 THEN x / n.n ELSE x END * 1e6, 0) / 1e6 AS x FROM m JOIN n USING (name)
    """


ORACLE_SQL = {
    "get_speaker": "SELECT id, name, gender, created_at FROM speakers WHERE name = 'Person_1'",
    "list_speakers": """
        SELECT s.id, s.name, s.gender, s.created_at, count(DISTINCT v.id) AS voice_count, count(DISTINCT f.id) AS face_count
        FROM speakers s LEFT JOIN voice_embeddings v ON v.speaker_id = s.id AND v.is_active = 1
        LEFT JOIN face_embeddings f ON f.speaker_id = s.id AND f.is_active = 1 GROUP BY ALL
    """,
    "list_sessions": """
        SELECT s.id, s.session_id, s.started_at, count(g.id) AS segment_count, max_by(v.accuracy, v.id) AS validated_accuracy
        FROM sessions s LEFT JOIN segments g ON g.session_pk = s.id LEFT JOIN validations v ON v.session_pk = s.id GROUP BY ALL
    """,
    "get_session": "SELECT id, session_id, coalesce(config, '{}') AS config, coalesce(summary, '{}') AS summary, audio_file FROM sessions WHERE id = 3",
    "get_segments": "SELECT id, seg_index, speaker_name, text, decision_type, raw_conf, is_identified, coalesce(metrics_json, '{}') AS metrics FROM segments WHERE session_pk = 3",
    "latest_validation": """
        SELECT session_pk, id, validated_at, accuracy, named_accuracy, total_lines, correct, incorrect FROM validations
        QUALIFY row_number() OVER (PARTITION BY session_pk ORDER BY id DESC) = 1
    """,
    "accuracy_trend": """
        WITH s AS (SELECT *, CASE WHEN json_valid(summary) THEN CAST(summary AS JSON) END AS j FROM sessions)
        SELECT session_id, CAST(coalesce(j->>'$.total_segments', j->>'$.totalSegments') AS DOUBLE) AS total_segments, CAST(coalesce(j->>'$.fn_rate', j->>'$.fnRate') AS DOUBLE) AS fn_rate,
               CAST(coalesce(j->>'$.unique_speakers', j->>'$.uniqueSpeakers') AS DOUBLE) AS unique_speakers, v.accuracy AS validated_accuracy, v.named_accuracy
        FROM s LEFT JOIN validations v ON v.session_pk = s.id
    """,
    "insert_ignore": """
        WITH i AS (SELECT final_name AS name, arg_min(struct_pack(g := audio_gender), id).g AS gender FROM segments WHERE final_name IS NOT NULL GROUP BY 1),
        f AS (SELECT * FROM i WHERE name NOT IN (SELECT name FROM speakers))
        SELECT id, name, gender FROM speakers
        UNION ALL SELECT (SELECT max(id) FROM speakers) + row_number() OVER (ORDER BY name), name, gender FROM f
    """,
    "upsert_cascade": """
        WITH n AS (
            SELECT id, session_id, id AS old FROM sessions WHERE id % 10 <> 0
            UNION ALL SELECT (SELECT max(id) FROM sessions) + row_number() OVER (ORDER BY session_id), session_id, NULL FROM sessions WHERE id % 10 = 0
        )
        SELECT id, session_id, (SELECT count(*) FROM segments g WHERE g.session_pk = n.old) AS segments, (SELECT count(*) FROM validations v WHERE v.session_pk = n.old) AS validations FROM n
    """,
    "delete_cascade": """
        WITH gone AS (SELECT id FROM speakers WHERE regexp_matches(name, '(?i)(ltda|eireli|s\\.a\\.)'))
        SELECT 'voice' AS kind, id, speaker_id FROM voice_embeddings WHERE speaker_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'face', id, speaker_id FROM face_embeddings WHERE speaker_id NOT IN (SELECT id FROM gone)
    """,
    "soft_delete": "SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE is_active END AS is_active FROM voice_embeddings",
    "hard_delete": "SELECT id, speaker_id FROM face_embeddings WHERE id % 7 <> 0",
    "rename_speaker": "SELECT id, CASE WHEN name = 'Person_1' THEN 'Convidada Nova' ELSE name END AS name FROM speakers",
    "rename_voice_files": """
        WITH f AS (SELECT id, regexp_replace(source_file, '\\.(npy|json)$', '') AS base FROM voice_embeddings)
        SELECT id, CASE WHEN base = 'Person_1' OR starts_with(base, 'Person_1_') THEN 'Convidada' || substr(base, 9) ELSE base END AS base FROM f
    """,
    "count_voice": "SELECT speaker_id, count(*) AS voices FROM voice_embeddings WHERE is_active = 1 GROUP BY speaker_id",
    "voice_means": _means("voice_embeddings", 192),
    "face_means": _means("face_embeddings", 512),
    "save_segments_coerce": """
        WITH j AS (SELECT id, CAST(metrics_json AS JSON) AS j FROM segments WHERE json_valid(metrics_json) AND json_type(CAST(CASE WHEN json_valid(metrics_json) THEN metrics_json ELSE 'null' END AS JSON)) = 'OBJECT')
        SELECT id, coalesce(nullif(j->>'$.final_name', ''), j->>'$.final_speaker') AS speaker_name,
               CASE WHEN NOT list_contains(json_keys(j), 'raw_conf') THEN 0.0 WHEN (j->>'$.raw_conf') IS NULL THEN NULL ELSE coalesce(TRY_CAST(j->>'$.raw_conf' AS DOUBLE), 0.0) END AS raw_conf,
               CASE WHEN NOT list_contains(json_keys(j), 'whisper_ms') THEN 0.0 WHEN (j->>'$.whisper_ms') IS NULL THEN NULL ELSE coalesce(TRY_CAST(j->>'$.whisper_ms' AS DOUBLE), 0.0) END AS whisper_ms,
               coalesce(CAST(TRY_CAST(j->>'$.is_identified' AS BOOLEAN) AS INTEGER), 0) AS is_identified, coalesce(CAST(TRY_CAST(j->>'$.is_fn' AS BOOLEAN) AS INTEGER), 0) AS is_fn,
               coalesce(j->>'$.fp_risk', 'none') AS fp_risk, coalesce(j->>'$.text', '') AS text FROM j
    """,
    "validation_accuracy": """
        SELECT validation_id, count(*) AS lines, count(*) FILTER (WHERE predicted = corrected) AS "right", round_even(count(*) FILTER (WHERE predicted = corrected) / count(*) * 1e4, 0) / 1e4 AS share
        FROM validation_lines WHERE validation_id IN (SELECT id FROM validations) GROUP BY validation_id
    """,
}
