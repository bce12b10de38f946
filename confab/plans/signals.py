"""Queries of tracking and signal operators, on inputs derived from the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.functions import audio
from confab.functions.columns import half_even
from confab.operators import tracking, vectors
from confab.session import table


def _detections(spark, d):
    """Boxes that drift with the frame: one recording for each user, a frame for every third event."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, d, "events").select("user_id", F.floor(n / 3).alias("frame"), (n % 3).cast("bigint").alias("det"), "value")
    x = F.col("det") * 120.0 + F.col("frame") * 2.0 + F.col("value") % 5
    y = F.col("det") * 15.0 + F.col("frame") + F.col("value") % 3
    return e.select("user_id", "frame", "det", x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 80).alias("y2"), F.least(F.lit(0.99), 0.2 + F.col("value") % 90 / 100).alias("confidence"))


def face_tracks(spark, d):
    t = tracking.track_faces(_detections(spark, d), "user_id")
    return t.select("user_id", "frame", "track", *(half_even(F.col(c), 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


def box_suppression(spark, d):
    b = _detections(spark, d).withColumn("frame", F.col("user_id") * 100_000 + F.floor(F.col("frame") / 4)).withColumn("det", F.row_number().over(Window.partitionBy("frame").orderBy("x1", "y1", "confidence")).cast("bigint"))
    return tracking.best_boxes(b, "frame")


def _signals(spark, d):
    rows = table(spark, d, "speakers").select("id", (F.lit(90.0) + F.col("id") % 150).alias("hz"))
    return rows.select("id", "hz", F.transform(F.sequence(F.lit(0), F.lit(15999)), lambda i: F.sin(i * F.col("hz") * 2 * 3.141592653589793 / 16000) * 0.3 + F.sin(i * F.col("hz") * 4 * 3.141592653589793 / 16000) * 0.1).alias("signal"))


def face_names(spark, d):
    """Names of tracks in recordings of four hundred vectors, one a frame, by the profiles of half the speakers."""
    f = table(spark, d, "face_embeddings").filter("is_active = 1 and size(embedding) = 512").filter(F.exists("embedding", lambda x: x != 0))
    known = vectors.centroids(f.filter("speaker_id % 2 = 0").withColumn("name", F.concat(F.lit("Rosto "), F.col("speaker_id").cast("string"))), "name", "embedding", normalise=False)
    f = f.select("id", "speaker_id", "embedding", F.floor(F.col("id") / 400).alias("session")).repartition("session")
    frame = F.row_number().over(Window.partitionBy("session", "speaker_id").orderBy("id")).cast("bigint")
    shown = f.select("session", frame.alias("frame"), (frame * 0.1).alias("at"), F.col("speaker_id").alias("track"), "embedding")
    return tracking.name_faces(shown, known, "session").select("session", "frame", "track", "name", half_even(F.col("score"), 6).alias("score"))


def pitch_gender(spark, d):
    return _signals(spark, d).select("id", "hz", F.coalesce(audio.gender_of_signal("signal"), F.lit("unknown")).alias("gender"))


def loudness(spark, d):
    s = _signals(spark, d).select("id", audio.at_loudness("signal").alias("y"))
    rms = F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x) / F.size("y"))
    return s.select("id", half_even(rms, 6).alias("rms"))


def speech_spans(spark, d):
    p = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: F.least(F.lit(1.0), x["value"] / 100))
    s = table(spark, d, "events").groupBy("user_id").agg(p.alias("p")).select("user_id", F.posexplode(audio.spans_of_speech("p")).alias("n", "s"))
    return s.select("user_id", "n", "s.start", "s.end")


QUERIES = {f.__name__: f for f in (face_tracks, box_suppression, face_names, pitch_gender, loudness, speech_spans)}
ORACLE_SQL = {
    # the estimate of a clean tone is at most a little above its frequency, so 155 Hz counts as above
    "pitch_gender": "SELECT id, CAST(90 + id % 150 AS DOUBLE) AS hz, CASE WHEN id % 150 >= 65 THEN 'female' WHEN id % 150 < 50 THEN 'male' ELSE 'unknown' END AS gender FROM speakers",
    # a signal at the target level, or at the highest that its peak allows
    "loudness": """
        WITH s AS (SELECT id, 90 + id % 150 AS hz FROM speakers), x AS (SELECT id, sin(i * CAST(hz AS DOUBLE) * 2 * pi() / 16000) * CAST(0.3 AS DOUBLE) + sin(i * CAST(hz AS DOUBLE) * 4 * pi() / 16000) * CAST(0.1 AS DOUBLE) AS x FROM s, range(0, 16000) r(i)),
        l AS (SELECT id, sqrt(avg(x * x)) AS rms, max(abs(x)) AS top FROM x GROUP BY id)
        SELECT id, round_even(least(CAST(0.1 AS DOUBLE), rms / top) * 1e6, 0) / 1e6 AS rms FROM l
    """,
    # spans end at pauses of 16 windows from their first quiet one, and are padded by 4800 samples or half a gap
    "speech_spans": """
        WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, least(1.0, value / 100) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        v AS (SELECT user_id, i, n, coalesce(lead(i) OVER (PARTITION BY user_id ORDER BY i), n) AS nxt FROM w WHERE p >= 0.5),
        q AS (SELECT v.user_id, v.i, v.n, v.nxt, min(w.i) AS first, max(w.i) AS last FROM v LEFT JOIN w ON w.user_id = v.user_id AND w.p < CAST(0.35 AS DOUBLE) AND w.i > v.i AND w.i < v.nxt GROUP BY ALL),
        c AS (SELECT *, coalesce(last - first >= 16, false) AS closes FROM q),
        g AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM c),
        s AS (SELECT user_id, span, min(i) * 512 AS a, coalesce(max(first) FILTER (WHERE closes), any_value(n)) * 512 AS b, any_value(n) * 512 AS total FROM g GROUP BY user_id, span),
        o AS (SELECT *, row_number() OVER k - 1 AS pos, a - lag(b) OVER k AS gap_before, lead(a) OVER k - b AS gap_after FROM s WINDOW k AS (PARTITION BY user_id ORDER BY span))
        SELECT user_id, CAST(pos AS INTEGER) AS n, CAST(CASE WHEN gap_before IS NULL THEN greatest(0, a - 4800) WHEN gap_before < 9600 THEN a - gap_before // 2 ELSE a - 4800 END AS BIGINT) AS start,
               CAST(CASE WHEN gap_after IS NULL THEN least(total, b + 4800) WHEN gap_after < 9600 THEN b + gap_after // 2 ELSE b + 4800 END AS BIGINT) AS "end" FROM o
    """,
}
