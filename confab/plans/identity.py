"""Queries of identities over a session: ids, bindings, stored voices, enrolment."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions import wordlists as W
from confab.functions.columns import half_even, is_generic
from confab.operators import identity, reports, store
from confab.plans.reports import _GENERIC, gender_sql
from confab.plans.text import TITLE, listed, sql_pattern
from confab.session import table


def _segments(spark, d):
    return table(spark, d, "segments").filter("seg_index is not null")


def person_ids(spark, d):
    return identity.person_ids(_segments(spark, d).filter(~is_generic(F.col("final_name"))), "session_pk", "final_name", ["seg_index", "id"])


def bound_faces(spark, d):
    s = _segments(spark, d).filter("decision is not null").select("id", "session_pk", "seg_index", "decision", F.col("final_speaker").alias("hint"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("face_"), (F.col("id") % 5).cast("string"))).alias("person"))
    return identity.bound_faces(s, "session_pk", "hint", ["seg_index", "id"]).select("id", F.coalesce("bound", F.lit("")).alias("bound"))


def voice_buffers(spark, d):
    s = _segments(spark, d).filter("segment_ms is not null and final_speaker is not null").select("session_pk", F.col("final_speaker").alias("speaker"), "seg_index", "id", (F.col("segment_ms") / 1000).alias("s"))
    b = identity.voice_buffers(s, ["session_pk", "speaker"], ["seg_index", "id"], "s")
    return b.select("session_pk", "speaker", "chunks", half_even(F.col("seconds"), 3).alias("seconds"))


def _bases(spark, d):
    return table(spark, d, "voice_embeddings").filter("source_file is not null").select("id", F.regexp_replace("source_file", r"\.(npy|json)$", "").alias("base"))


def stored_voices(spark, d):
    """Labels for which a voice is stored."""
    labels = table(spark, d, "speakers").select("name").unionByName(_bases(spark, d).select(F.upper(F.substring_index("base", "_", 1)).alias("name")))
    return identity.with_stored_file(labels.filter("name is not null"), _bases(spark, d))


def live_saves(spark, d):
    names = table(spark, d, "segments").select(F.col("final_name").alias("name"), F.col("raw_best_name").alias("old_name")).distinct()
    files = _bases(spark, d).select("base").unionByName(table(spark, d, "speakers").filter("id % 2 = 0 and name is not null").select(F.concat("name", F.lit("_20240101_000000")).alias("base")))
    return identity.savable(names, files, W.NOT_VOCATIVES)


def face_enrolments(spark, d):
    """File names of voices enrolled from a face, one for each named speaker of a session."""
    s = _segments(spark, d).filter(~is_generic(F.col("final_name"))).groupBy("session_pk", "final_name").agg(F.min("id").alias("id"))
    return s.select("session_pk", identity.file_name(F.col("final_name"), F.lpad(F.col("id").cast("string"), 8, "0"), "fvbind").alias("base"))


def replaced_profiles(spark, d):
    v = table(spark, d, "voice_embeddings").filter("is_active = 1 and size(embedding) = 192").filter(F.exists("embedding", lambda x: x != 0))
    p = identity.replaced_profiles(v, "speaker_id", "id", "embedding")
    return p.select("speaker_id", "last", "n", half_even(F.col("centroid")[0], 6).alias("first"), half_even(F.col("centroid")[191], 6).alias("last_number"))


def pruned_files(spark, d):
    return identity.pruned_files(_bases(spark, d), "id").select("id", "base", "person")


def spaced_runs(spark, d):
    """Events at which a costly step runs again: ten hours or more behind the last run of their user."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"))
    return identity.spaced(e, "user_id", "moment", 36_000_000_000)


def post_session(spark, d):
    pending = reports.unnamed_speakers(table(spark, d, "segments").filter("final_speaker is not null"))
    given = pending.select("session_pk", "speaker", F.when(F.col("session_pk") % 3 > 0, F.concat(F.lit(" Convidada "), (F.col("session_pk") % 9).cast("string"))).otherwise(" ").alias("name"))
    return identity.post_session(pending, given).select("session_pk", "speaker", "name", half_even(F.col("seconds"), 3).alias("seconds"))


def mirrored_voices(spark, d):
    """Rows that enrolment adds to the store: the speaker's id, made where the name is new, and the file."""
    names = table(spark, d, "segments").filter("final_name is not null").groupBy(F.col("final_name").alias("name")).agg(F.min("id").alias("ord")).withColumn("gender", F.lit(None).cast("string"))
    speakers = store.insert_ignore(table(spark, d, "speakers").filter("name is not null"), names)
    ids = speakers.groupBy("name").agg(F.min("id").alias("speaker_id"))
    return names.join(ids, "name").select("speaker_id", "name", F.concat("name", F.lit("_live.npy")).alias("source_file"))


def speaker_vectors(spark, d):
    """Active voices of one speaker, by id."""
    v = table(spark, d, "voice_embeddings").join(table(spark, d, "speakers").filter("name = 'Person_1'").select(F.col("id").alias("speaker_id")), "speaker_id", "left_semi")
    return v.filter("is_active = 1").select("id", F.size("embedding").alias("dim"), "source_file")


def sql_scan(spark, d):
    """A statement with named arguments over the store's tables."""
    return store.run_sql({"segments": table(spark, d, "segments"), "sessions": table(spark, d, "sessions")}, "SELECT s.session_id, count(*) AS n FROM {segments} g JOIN {sessions} s ON s.id = g.session_pk WHERE g.raw_conf >= :least GROUP BY s.session_id", {"least": 0.5})


def introduced_speakers(spark, d):
    """Names by which speakers introduce themselves; speakers' notes of their names stand in for their first words."""
    s = _segments(spark, d).filter("final_speaker is not null").select("session_pk", F.col("final_speaker").alias("speaker"), "seg_index", "id", (F.col("id") % 3 == 0).alias("known"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("Olá, eu sou "), F.coalesce("final_name", F.lit("alguém")))).otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("gender"))
    return identity.introduced(s, ["seg_index", "id"])


def face_voices(spark, d):
    e = table(spark, d, "events")
    name = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("Person_"), F.col("user_id").cast("string"))).otherwise(F.concat(F.when(F.col("user_id") % 2 == 0, "Ana ").otherwise("Bruno "), F.col("user_id").cast("string")))
    seen = e.select(name.alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") / 10).alias("seconds"), (F.col("value") / 1000).alias("rms"), F.when(F.col("event_id") % 3 == 0, "female").when(F.col("event_id") % 3 == 1, "male").alias("gender"))
    stored = table(spark, d, "speakers").select(F.concat(F.lit("Ana "), (F.col("id") * 4).cast("string")).alias("name")).filter("name < 'Ana 5'")
    return identity.face_voices(seen, stored, cooldown=36_000_000_000).select("name", F.col("at").alias("moment"))


def camera_names(spark, d):
    s = _segments(spark, d).select("session_pk", "seg_index", "id", F.col("final_speaker").alias("person"), "final_name", F.when(F.col("id") % 4 < 3, F.concat(F.lit("face_"), (F.col("id") % 6).cast("string"))).alias("face"), F.when(F.col("id") % 5 < 3, F.lit("Person_1")).otherwise(F.lit("Ana Lima")).alias("face_name"), F.when(F.col("id") % 7 == 0, F.lit("Bia Souza")).when(F.col("id") % 7 == 1, F.col("final_name")).alias("shown"))
    return identity.camera_names(s, ["seg_index", "id"])


def rename_cycle(spark, d):
    """Stored voices after a person is renamed: moved files, all but the newest eight of each person gone."""
    moved = store.rename_prefixed(_bases(spark, d), "spk00001", "Convidada")
    return identity.pruned_files(moved, "id").select("id", "base", "person")


def store_columns(spark, d):
    """Columns of the store's tables as declared."""
    rows = [(name, column, i) for name, ddl in store.SCHEMAS.items() for i, column in enumerate(spark.createDataFrame([], ddl).columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")


QUERIES = {
    f.__name__: f
    for f in (person_ids, bound_faces, voice_buffers, stored_voices, live_saves, face_enrolments, replaced_profiles, pruned_files, spaced_runs, post_session, mirrored_voices, speaker_vectors, introduced_speakers, face_voices, camera_names, rename_cycle, sql_scan, store_columns)
}

_BASE = "regexp_replace(source_file, '\\.(npy|json)$', '')"
_PERSON = "CASE WHEN len(string_split(regexp_replace(base, '(_auto|_fvbind)$', ''), '_')) >= 3 THEN regexp_replace(regexp_replace(base, '(_auto|_fvbind)$', ''), '^(.+)_\\d+_\\d+$', '\\1') ELSE regexp_replace(base, '(_auto|_fvbind)$', '') END"
_STRIPPED = "regexp_replace({0}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
_STORED = "EXISTS (SELECT 1 FROM {files} f WHERE lower(f.base) = lower(" + _STRIPPED.format("{name}").replace("{00A0}", "{{00A0}}") + ") OR starts_with(lower(f.base), lower(" + _STRIPPED.format("{name}").replace("{00A0}", "{{00A0}}") + ") || '_'))"
_BLOCKED = ", ".join(f"'{w}'" for w in ("unknown", *W.NOT_VOCATIVES))
_NO_NUMBER = _STRIPPED.format("regexp_replace(name, '[\\s\\x{00A0}]+\\d+$', '')")
_INTRODUCED = ", ".join(f"CASE WHEN lower(regexp_extract({n}, '^[^\\s\\x{{00A0}}]*')) NOT IN ({listed(W.NOT_NAMES)}) THEN {n} END" for n in (f"nullif(regexp_extract(text, '{sql_pattern(p)}', 1), '')" for p in W.INTRODUCTIONS))
ORACLE_SQL = {
    "introduced_speakers": f"""
        WITH s AS (SELECT session_pk, final_speaker AS speaker, seg_index, id, CASE WHEN id % 5 = 0 THEN 'Olá, eu sou ' || coalesce(final_name, 'alguém') ELSE text END AS text FROM segments WHERE seg_index IS NOT NULL AND final_speaker IS NOT NULL AND id % 3 <> 0),
        h AS (SELECT *, coalesce({_INTRODUCED}) AS name FROM s), f AS (SELECT session_pk, speaker, arg_min(name, struct_pack(a := seg_index, b := id)) AS name FROM h WHERE name IS NOT NULL GROUP BY 1, 2)
        SELECT session_pk, speaker, {TITLE} AS name FROM f
    """,
    "face_voices": f"""
        WITH RECURSIVE k AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'Person_' || user_id WHEN user_id % 2 = 0 THEN 'Ana ' || user_id ELSE 'Bruno ' || user_id END AS name, epoch_us(ts) AS moment, value / 10 AS seconds, value / 1000 AS rms, CASE event_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender FROM events),
        e AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY moment) AS n FROM k WHERE name NOT LIKE 'Person_%' AND name NOT IN (SELECT 'Ana ' || (id * 4) FROM speakers WHERE 'Ana ' || (id * 4) < 'Ana 5')),
        r AS (SELECT name, n, moment, moment AS kept, seconds, rms, gender FROM e WHERE n = 1 UNION ALL SELECT e.name, e.n, e.moment, CASE WHEN e.moment - r.kept >= 36000000000 THEN e.moment ELSE r.kept END, e.seconds, e.rms, e.gender FROM r JOIN e ON e.name = r.name AND e.n = r.n + 1)
        SELECT name, moment FROM r WHERE moment = kept AND seconds >= 3 AND rms >= CAST(1e-4 AS DOUBLE) AND coalesce(({gender_sql('name')}) = gender, true)
    """,
    "camera_names": f"""
        WITH s AS (SELECT session_pk, seg_index, id, final_speaker AS person, final_name, CASE WHEN id % 4 < 3 THEN 'face_' || (id % 6) END AS face, CASE WHEN id % 5 < 3 THEN 'Person_1' ELSE 'Ana Lima' END AS face_name, CASE WHEN id % 7 = 0 THEN 'Bia Souza' WHEN id % 7 = 1 THEN final_name END AS shown FROM segments WHERE seg_index IS NOT NULL)
        SELECT session_pk, face, arg_min(final_name, struct_pack(a := seg_index, b := id)) AS name FROM s
        WHERE NOT coalesce({_GENERIC.format('final_name')}, true) AND face IS NOT NULL AND face IS DISTINCT FROM person AND face_name = 'Person_1' AND NOT coalesce(NOT {_GENERIC.format('shown')} AND shown <> final_name, false) GROUP BY 1, 2
    """,
    "rename_cycle": f"""
        WITH f AS (SELECT id, {_BASE} AS b FROM voice_embeddings WHERE source_file IS NOT NULL), m AS (SELECT id, CASE WHEN b = 'spk00001' OR starts_with(b, 'spk00001_') THEN 'Convidada' || substr(b, 9) ELSE b END AS base FROM f), p AS (SELECT id, base, {_PERSON} AS person FROM m)
        SELECT id, base, person FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY id DESC) AS n FROM p) WHERE n <= 8
    """,
    "person_ids": f"""
        WITH f AS (SELECT session_pk, final_name, min(struct_pack(a := seg_index, b := id)) AS f FROM segments WHERE seg_index IS NOT NULL AND NOT coalesce({_GENERIC.format('final_name')}, true) GROUP BY 1, 2)
        SELECT session_pk, final_name, printf('spk_%03d', row_number() OVER (PARTITION BY session_pk ORDER BY f, final_name)) AS person FROM f
    """,
    "bound_faces": f"""
        WITH s AS (SELECT *, CASE WHEN regexp_matches(decision, '^({"|".join(identity.CONFIRMING)})') AND id % 3 > 0 THEN 'face_' || (id % 5) END AS c FROM segments WHERE seg_index IS NOT NULL AND decision IS NOT NULL)
        SELECT id, coalesce(CASE WHEN final_speaker IS NOT NULL THEN last_value(c IGNORE NULLS) OVER (PARTITION BY session_pk, final_speaker ORDER BY seg_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, '') AS bound FROM s
    """,
    "voice_buffers": """
        WITH s AS (SELECT *, row_number() OVER (PARTITION BY session_pk, final_speaker ORDER BY seg_index DESC, id DESC) AS n FROM segments WHERE seg_index IS NOT NULL AND segment_ms IS NOT NULL AND final_speaker IS NOT NULL)
        SELECT session_pk, final_speaker AS speaker, count(*) AS chunks, round_even(sum(segment_ms / 1000) * 1e3, 0) / 1e3 AS seconds FROM s WHERE n <= 30 GROUP BY 1, 2
    """,
    "stored_voices": f"""
        WITH f AS (SELECT DISTINCT {_BASE} AS base FROM voice_embeddings WHERE source_file IS NOT NULL), l AS (SELECT name FROM speakers WHERE name IS NOT NULL UNION SELECT upper(split_part(base, '_', 1)) FROM f)
        SELECT name FROM l WHERE {_STORED.format(files='f', name='l.name')}
    """,
    "live_saves": f"""
        WITH f AS (SELECT {_BASE} AS base FROM voice_embeddings WHERE source_file IS NOT NULL UNION SELECT name || '_20240101_000000' FROM speakers WHERE id % 2 = 0 AND name IS NOT NULL),
        n AS (SELECT DISTINCT final_name AS name, raw_best_name AS old_name FROM segments WHERE final_name IS NOT NULL), d AS (SELECT DISTINCT name FROM n), s AS (SELECT name FROM d WHERE {_STORED.format(files='f', name='d.name')})
        SELECT name, old_name FROM n WHERE ({_GENERIC.format(_NO_NUMBER)} OR ({_NO_NUMBER} <> '' AND lower({_NO_NUMBER}) NOT IN ({_BLOCKED}))) AND (coalesce({_GENERIC.format('old_name')}, false) OR name NOT IN (SELECT name FROM s))
    """,
    "face_enrolments": f"SELECT session_pk, final_name || '_' || lpad(CAST(min(id) AS VARCHAR), 8, '0') || '_fvbind' AS base FROM segments WHERE seg_index IS NOT NULL AND NOT coalesce({_GENERIC.format('final_name')}, true) GROUP BY session_pk, final_name",
    "replaced_profiles": """
        WITH v AS (SELECT speaker_id, id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM voice_embeddings WHERE is_active = 1 AND len(embedding) = 192 AND list_sum(list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE))) > 0),
        p AS (SELECT speaker_id, max(id) AS last, count(*) AS n, arg_max(e, id) AS e FROM v GROUP BY 1), q AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM p)
        SELECT speaker_id, last, n, round_even(e[1] / l * 1e6, 0) / 1e6 AS first, round_even(e[192] / l * 1e6, 0) / 1e6 AS last_number FROM q
    """,
    "pruned_files": f"""
        WITH f AS (SELECT id, {_BASE} AS base FROM voice_embeddings WHERE source_file IS NOT NULL), p AS (SELECT id, base, {_PERSON} AS person FROM f)
        SELECT id, base, person FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY id DESC) AS n FROM p) WHERE n <= 8
    """,
    "spaced_runs": """
        WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
        r AS (SELECT user_id, n, moment, moment AS kept FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.moment, CASE WHEN e.moment - r.kept >= 36000000000 THEN e.moment ELSE r.kept END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT user_id, moment FROM r WHERE moment = kept
    """,
    "post_session": f"""
        WITH p AS (SELECT session_pk, final_speaker AS speaker, sum(segment_ms) / 1000 AS s FROM segments WHERE final_speaker IS NOT NULL AND coalesce({_GENERIC.format('final_name')}, true) GROUP BY 1, 2 HAVING sum(segment_ms) / 1000 >= 5)
        SELECT session_pk, speaker, 'Convidada ' || (session_pk % 9) AS name, round_even(s * 1e3, 0) / 1e3 AS seconds FROM p WHERE session_pk % 3 > 0
    """,
    "mirrored_voices": """
        WITH n AS (SELECT DISTINCT final_name AS name FROM segments WHERE final_name IS NOT NULL), k AS (SELECT name, min(id) AS id FROM speakers WHERE name IS NOT NULL GROUP BY 1),
        f AS (SELECT name, row_number() OVER (ORDER BY name) + (SELECT max(id) FROM speakers WHERE name IS NOT NULL) AS id FROM n WHERE name NOT IN (SELECT name FROM k))
        SELECT coalesce(k.id, f.id) AS speaker_id, n.name, n.name || '_live.npy' AS source_file FROM n LEFT JOIN k ON k.name = n.name LEFT JOIN f ON f.name = n.name
    """,
    "speaker_vectors": "SELECT id, CAST(len(embedding) AS INTEGER) AS dim, source_file FROM voice_embeddings WHERE is_active = 1 AND speaker_id IN (SELECT id FROM speakers WHERE name = 'Person_1')",
    "sql_scan": "SELECT s.session_id, count(*) AS n FROM segments g JOIN sessions s ON s.id = g.session_pk WHERE g.raw_conf >= 0.5 GROUP BY s.session_id",
    "store_columns": "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS position FROM information_schema.columns WHERE table_name IN ('speakers', 'voice_embeddings', 'face_embeddings', 'sessions', 'segments', 'validations', 'validation_lines')",
}
