"""Queries of naming, folds over faces and turns, and token codes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.functions import codes
from confab.functions.columns import half_even
from confab.operators import naming
from confab.session import table


def _named(spark, d):
    s = table(spark, d, "segments").filter("final_speaker is not null")
    return s.groupBy("session_pk", F.col("final_speaker").alias("speaker")).agg(F.max("final_name").alias("name"))


def last_speaker(spark, d):
    named = _named(spark, d).filter("speaker in ('spk_020', 'spk_021', 'spk_022')").withColumn("name", F.when(F.col("speaker") == "spk_022", "Person_1").otherwise(F.col("name")))
    mentioned = table(spark, d, "sessions").select(F.col("id").alias("session_pk"), F.concat(F.lit("Convidada "), (F.col("id") % 9).cast("string")).alias("name"))
    return naming.last_speakers(named, mentioned, 3)


def last_speaker_all(spark, d):
    """Over all speakers of each session and their names as stored; last_speaker reads the three labels that its SQL twin names."""
    mentioned = table(spark, d, "sessions").select(F.col("id").alias("session_pk"), F.concat(F.lit("Convidada "), (F.col("id") % 9).cast("string")).alias("name"))
    return naming.last_speakers(_named(spark, d), mentioned)


def llm_answers(spark, d):
    answers = table(spark, d, "sessions").select(F.col("id").alias("session_pk"), F.concat(F.lit('Aqui: {"spk_020": "ana lima", "spk_099": "maria souza", "spk_098": 5, "spk_097": "x"} fim')).alias("answer"))
    return naming.answered(answers, _named(spark, d))


def powerset_decode(spark, d):
    rows = table(spark, d, "events").select("event_id", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.pmod(F.floor(F.col("value") * (i + 3)), F.lit(11)).cast("double")).alias("scores"))
    s = rows.select("event_id", codes.powerset(F.col("scores")).alias("p"), half_even(codes.log_sum_exp(F.col("scores")), 6).alias("lse"))
    return s.select("event_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.col("p")[2].alias("c"), "lse")


def name_sets(spark, d):
    """Names used, mentioned, both and free of each session, as sets."""
    s = table(spark, d, "segments")
    sets = s.groupBy("session_pk").agg(F.array_sort(F.collect_set("final_name")).alias("used"), F.array_sort(F.collect_set("raw_best_name")).alias("heard"))
    return sets.select("session_pk", F.size(F.array_except("heard", "used")).alias("free"), F.size(F.array_union("heard", "used")).alias("all_names"), F.size(F.array_intersect("heard", "used")).alias("both"))


def speaking_states(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("track"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 0.2).alias("at"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))
    return naming.speaking_states(e).select("track", half_even(F.col("at"), 3).alias("at"), "speaking")


def face_persons(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("frame"), (F.col("event_id") % 4).alias("track"), F.when(F.col("value") < 20, "Unknown").when(F.col("value") < 40, F.concat(F.lit("Person_"), (F.col("event_id") % 4).cast("string"))).otherwise(F.concat(F.lit("Nome "), (F.col("event_id") % 3).cast("string"))).alias("name"))
    return naming.face_persons(e)


def merged_turns(spark, d):
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("session"), F.col("vec_id").alias("ord"), F.floor(F.col("vec_id") / 30 % 2).cast("bigint").alias("slot"), F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("voice"))
    return naming.merged_turns(v)


def token_codes(spark, d):
    words = table(spark, d, "speakers").select("id", F.posexplode(F.split("name", r"\s+")).alias("n", "token")).filter("token <> ''")
    return words.select("id", "n", codes.token_hash("token").alias("hash"), F.array_join(codes.token_buckets("token"), "/").alias("buckets"), codes.shape("token").alias("shape"), codes.python_repr("token").alias("repr"), F.left("token", F.lit(1)).alias("prefix"), F.right("token", F.lit(3)).alias("suffix"))


QUERIES = {f.__name__: f for f in (last_speaker, last_speaker_all, llm_answers, powerset_decode, name_sets, speaking_states, face_persons, merged_turns, token_codes)}

_NAMED = "n AS (SELECT session_pk, final_speaker AS speaker, max(final_name) AS name FROM segments WHERE final_speaker IS NOT NULL GROUP BY 1, 2)"
_LAST_ALL = """
    c AS (SELECT session_pk, count(DISTINCT speaker) AS speakers, count(DISTINCT speaker) FILTER (WHERE NOT {g}) AS known, count(DISTINCT speaker) FILTER (WHERE {g}) AS unknown, min(speaker) FILTER (WHERE {g}) AS speaker FROM n GROUP BY 1)
    SELECT session_pk, speaker, 'Convidada ' || (session_pk % 9) AS name FROM c JOIN sessions s ON s.id = session_pk WHERE known = speakers - 1 AND unknown = 1
        AND NOT EXISTS (SELECT 1 FROM n WHERE n.session_pk = c.session_pk AND n.name = 'Convidada ' || (c.session_pk % 9))
"""
_GENERIC = "coalesce(regexp_full_match({0}, '(Person_\\d+|spk_\\d+|Desconhecido_\\d+|Unknown|Unknown_\\d+)'), true)"
ORACLE_SQL = {
    "last_speaker_all": f"WITH {_NAMED}, {_LAST_ALL.format(g=_GENERIC.format('name'))}",
    # one row after the other: the state is whether the face speaks, and since when its score asks for a change
    "speaking_states": """
        WITH RECURSIVE e AS (SELECT user_id AS track, n, n * CAST(0.2 AS DOUBLE) AS t, score FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, least(1.0, value / 100) AS score FROM events)),
        r AS (
            SELECT track, n, t, false AS speaking, t AS since FROM e WHERE n = 1
            UNION ALL
            SELECT track, n, t, CASE WHEN flips THEN NOT speaking ELSE speaking END, CASE WHEN flips OR NOT turning THEN t ELSE since END FROM (
                SELECT *, turning AND t - since >= CASE WHEN speaking THEN 0.5 ELSE 0.25 END AS flips FROM (
                    SELECT e.track, e.n, e.t, r.speaking, r.since, CASE WHEN r.speaking THEN e.score < CAST(0.35 AS DOUBLE) ELSE e.score >= CAST(0.55 AS DOUBLE) END AS turning FROM r JOIN e ON e.track = r.track AND e.n = r.n + 1
                )
            )
        )
        SELECT track, round_even(t * 1e3, 0) / 1e3 AS "at", speaking FROM r
    """,
    "last_speaker": f"""
        WITH {_NAMED}, k AS (SELECT session_pk, speaker, CASE WHEN speaker = 'spk_022' THEN 'Person_1' ELSE name END AS name FROM n WHERE speaker IN ('spk_020', 'spk_021', 'spk_022')),
        c AS (SELECT session_pk, count(*) FILTER (WHERE NOT {_GENERIC.format('name')}) AS known, count(*) FILTER (WHERE {_GENERIC.format('name')}) AS unknown, min(speaker) FILTER (WHERE {_GENERIC.format('name')}) AS speaker FROM k GROUP BY 1)
        SELECT session_pk, speaker, 'Convidada ' || (session_pk % 9) AS name FROM c JOIN sessions s ON s.id = session_pk WHERE known = 2 AND unknown = 1
    """,
    "llm_answers": f"""
        WITH {_NAMED}, a AS (SELECT id AS session_pk, unnest(['spk_020', 'spk_099']) AS speaker, unnest(['Ana Lima', 'Maria Souza']) AS name FROM sessions)
        SELECT session_pk, speaker, name FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.session_pk = a.session_pk AND NOT {_GENERIC.format('n.name')} AND (n.speaker = a.speaker OR n.name = a.name))
    """,
    "powerset_decode": """
        WITH s AS (SELECT event_id, list_transform(range(0, 7), lambda i: CAST(floor(value * (i + 3)) AS BIGINT) % 11) AS s FROM events),
        b AS (SELECT event_id, s, list_position(s, list_max(s)) AS k FROM s)
        SELECT event_id, CAST(k IN (2, 5, 6) AS INTEGER) AS a, CAST(k IN (3, 5, 7) AS INTEGER) AS b, CAST(k IN (4, 6, 7) AS INTEGER) AS c,
               round_even((list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(CAST(x - list_max(s) AS DOUBLE)))))) * 1e6, 0) / 1e6 AS lse FROM b
    """,
    "name_sets": """
        WITH u AS (SELECT DISTINCT session_pk, final_name AS name FROM segments WHERE final_name IS NOT NULL), h AS (SELECT DISTINCT session_pk, raw_best_name AS name FROM segments WHERE raw_best_name IS NOT NULL),
        j AS (SELECT coalesce(u.session_pk, h.session_pk) AS session_pk, u.name AS a, h.name AS b FROM u FULL JOIN h ON u.session_pk = h.session_pk AND u.name = h.name)
        SELECT p.session_pk, CAST(count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS INTEGER) AS free, CAST(count(coalesce(a, b)) AS INTEGER) AS all_names, CAST(count(*) FILTER (WHERE a = b) AS INTEGER) AS both
        FROM (SELECT DISTINCT session_pk FROM segments) p LEFT JOIN j ON j.session_pk = p.session_pk GROUP BY p.session_pk
    """,
}
