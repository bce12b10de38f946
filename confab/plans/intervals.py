"""Queries of the interval, run and ranking operators over the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.functions.columns import half_even
from confab.operators import intervals
from confab.session import table

FRAME = 0.2  # seconds that one event of a user stands for


def _frames(spark, d):
    events = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select("user_id", "event_id", "ts", "event_type", "value", n.alias("frame"), F.col("event_type").isin("view", "click").alias("active"))


def _seconds(c):
    return F.unix_micros(c.cast("timestamp")) / 1e6


def speech_turns(spark, d):
    turns = intervals.activity_turns(_frames(spark, d), "user_id", "frame", "active", FRAME)
    return turns.select("user_id", half_even(F.col("start_sec"), 4).alias("start_sec"), half_even(F.col("end_sec"), 4).alias("end_sec"))


def binarized_turns(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    frames = table(spark, d, "events").select("user_id", "event_type", n.alias("frame"), (F.col("value") > 50).alias("active"))
    turns = intervals.binarized_turns(frames, "user_id", "frame", "event_type", "active", FRAME)
    return turns.select("user_id", "slot", half_even(F.col("start_sec"), 4).alias("start_sec"), half_even(F.col("end_sec"), 4).alias("end_sec"))


def _activity(spark, d):
    """Windows of 5 frames that step 3: chunk, absolute frame, local speaker, its cluster and activity."""
    f = _frames(spark, d).select("user_id", F.floor(F.col("frame") / 5).alias("chunk"), (F.col("frame") % 5).alias("local"), "event_type", F.round("value").cast("bigint").alias("v"))
    speakers = f.select("user_id", "chunk", (F.col("chunk") * 3 + F.col("local")).alias("frame"), F.col("event_type").alias("speaker"), (F.ascii("event_type") % 2).alias("cluster"), "v")
    return speakers.select("user_id", "chunk", "frame", "speaker", "cluster", (F.col("v") % 3).alias("activity"))


def overlap_add(spark, d):
    return intervals.overlap_count(_activity(spark, d), "user_id", "frame")


def cluster_activations(spark, d):
    return intervals.cluster_activations(_activity(spark, d), "user_id", "frame")


def top_active(spark, d):
    a = _activity(spark, d)
    return intervals.top_active(intervals.cluster_activations(a, "user_id", "frame"), intervals.overlap_count(a, "user_id", "frame"), "user_id", "frame")


def active_speaker(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("user_id"), "event_type", "value", _seconds(F.col("ts")).alias("at"))
    spans = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), F.col("at").alias("start"), (F.col("at") + 600).alias("end"))
    samples = events.filter("event_type in ('view', 'click')").select((F.col("user_id") % 5).alias("track"), "at", "value")
    scores = intervals.interval_means(spans, samples, 1440.0, 3600.0, 2)
    return intervals.dominant(scores, "span_id", 10.0, margin=2.5).select("span_id", "track", half_even(F.col("score"), 4).alias("score"))


def loudest_mover(spark, d):
    """The ratio form of the dominant speaker: movement above a floor and half as much again as the second's."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", _seconds(F.col("ts")).alias("at"))
    spans = events.filter("event_type = 'signup'").select(F.col("event_id").alias("span_id"), F.col("at").alias("start"), (F.col("at") + 600).alias("end"))
    samples = events.filter("event_type = 'click'").select((F.col("user_id") % 3).alias("track"), "at", "value")
    scores = intervals.interval_means(spans, samples, 1440.0, 3600.0, 2)
    return intervals.dominant(scores, "span_id", 3.0, ratio=1.5).select("span_id", "track", half_even(F.col("score"), 4).alias("score"))


def active_in_session(spark, d):
    """The dominant track among the samples of each span's own session only."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", _seconds(F.col("ts")).alias("at"))
    spans = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), "user_id", F.col("at").alias("start"), (F.col("at") + 600).alias("end"))
    samples = events.filter("event_type in ('view', 'click')").select("user_id", (F.col("event_id") % 3).alias("track"), "at", "value")
    scores = intervals.interval_means(spans, samples, 86_400.0, 43_200.0, 1, "user_id")
    return intervals.dominant(scores, "span_id", 10.0, margin=2.5).select("span_id", "track", half_even(F.col("score"), 4).alias("score"))


def asof_previous(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'view'").select("user_id", "ts", "value")
    found = intervals.asof_previous(left, right, "user_id", "ts", "value", F.date_trunc("DAY", F.col("ts")))
    return found.select("event_id", "user_id", F.col("previous").alias("previous_value"))


def _streams(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("total_sec"))


def chunk_windows(spark, d):
    return intervals.chunk_windows(_streams(spark, d), "user_id")


def chunk_windows_low_latency(spark, d):
    return intervals.low_latency_windows(_streams(spark, d), "user_id")


def recent_mean(spark, d):
    by = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return table(spark, d, "events").select("event_id", half_even(F.avg("value").over(by), 6).alias("score"))


def frame_diff(spark, d):
    by = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.lag("embedding").over(by).alias("previous"))
    change = F.aggregate(F.zip_with("embedding", "previous", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    moved = F.when(F.col("previous").isNull() | (F.size("previous") != F.size("embedding")), 0.0).otherwise(change)
    return rows.select("vec_id", "label", half_even(moved, 6).alias("moved"))


def topn_per_frame(spark, d):
    by = Window.partitionBy(F.date_trunc("HOUR", F.col("ts"))).orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(by)).filter("n <= 4").select("event_id", "n")


def label_dedup(spark, d):
    by = Window.partitionBy(F.date_trunc("HOUR", F.col("ts")), "event_type").orderBy(F.desc("value"), "event_id")
    shown = F.when((F.row_number().over(by) == 1) & (F.col("event_type") != "error"), F.col("event_type")).otherwise("Unknown")
    return table(spark, d, "events").select("event_id", shown.alias("label"))


def confidence_split(spark, d):
    c = F.col("value") / 100
    return table(spark, d, "events").select("event_id", F.when(c > 0.45, "high").when((c > 0.1) & (c < 0.45), "low").otherwise("none").alias("band"))


def sampled_scores(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("n", n).filter("n % 30 = 0").select("event_id", "user_id", "n")


def padded_segments(spark, d):
    s = table(spark, d, "segments").filter("seg_index is not null").select("id", (F.col("seg_index") % 15).cast("double").alias("start"), ((F.col("seg_index") % 15) + (F.col("id") % 7) * 0.3).alias("end"), F.lit(5.0).alias("zone"), F.lit(15.0).alias("total"))
    p = intervals.pad_segments(s)
    return p.select("id", *(half_even(F.col(c), 4).alias(c) for c in ("start", "end", "heard_from", "heard_to")))


def chunk_pipeline(spark, d):
    """Turns of each stream that is not silent, clipped to the new zone and padded for the recogniser."""
    loud = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("peak")).filter("peak >= 1").select("user_id")
    turns = intervals.activity_turns(_frames(spark, d).join(loud, "user_id", "left_semi"), "user_id", "frame", "active", FRAME)
    zones = turns.select("user_id", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.lit(3.0).alias("zone"), F.lit(12.0).alias("total"))
    return intervals.pad_segments(zones).select("user_id", *(half_even(F.col(c), 4).alias(c) for c in ("start", "end", "heard_from", "heard_to")))


def face_slices(spark, d):
    s = table(spark, d, "events").select("event_id", intervals.slice_bounds(F.floor("value").cast("int") - 20, F.floor(F.col("value") * 2).cast("int") - 60, F.lit(64)).alias("s"))
    return s.select("event_id", F.coalesce("s.from", F.lit(-1)).alias("from_px"), F.coalesce("s.to", F.lit(-1)).alias("to_px"))


QUERIES = {
    f.__name__: f
    for f in (
        speech_turns, binarized_turns, overlap_add, cluster_activations, top_active, active_speaker, active_in_session, loudest_mover, asof_previous, chunk_windows, chunk_windows_low_latency, recent_mean, frame_diff, topn_per_frame,
        label_dedup, confidence_split, sampled_scores, padded_segments, chunk_pipeline, face_slices,
    )
}

_FRAMES = "f AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"
_ACTIVITY = f"""{_FRAMES}, a AS (
    SELECT user_id, frame // 5 AS chunk, (frame // 5) * 3 + frame % 5 AS frame, event_type AS speaker, ascii(event_type) % 2 AS cluster, CAST(round(value) AS BIGINT) % 3 AS activity FROM f
)"""
_SPANS = """
    s AS (SELECT event_id AS span_id, epoch_us(ts) / 1e6 AS st FROM events WHERE event_type = '{kind}'),
    x AS (SELECT user_id % {tracks} AS track, epoch_us(ts) / 1e6 AS at, value FROM events WHERE event_type IN ({samples})),
    m AS (SELECT span_id, track, count(*) AS n, avg(value) AS score FROM s JOIN x ON x.at BETWEEN s.st - 1440 AND s.st + 600 + 1440 GROUP BY 1, 2 HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM m WINDOW w AS (PARTITION BY span_id ORDER BY score DESC, track))
    SELECT span_id, track, round_even(score * 1e4, 0) / 1e4 AS score FROM r WHERE k = 1 AND score >= {least} AND (second IS NULL OR {clear})
"""
ORACLE_SQL = {
    "speech_turns": f"""
        WITH {_FRAMES}, i AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM f WHERE event_type IN ('view', 'click')),
        r AS (SELECT user_id, min(frame) * 0.2 AS s, (max(frame) + 1) * 0.2 AS e FROM i GROUP BY user_id, g),
        n AS (SELECT *, CASE WHEN CAST(s AS DOUBLE) - lag(CAST(e AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY s) < 0.5 THEN 0 ELSE 1 END AS new FROM r),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS grp FROM n)
        SELECT user_id, CAST(min(s) AS DOUBLE) AS start_sec, CAST(max(e) AS DOUBLE) AS end_sec FROM g GROUP BY user_id, grp HAVING CAST(max(e) AS DOUBLE) - CAST(min(s) AS DOUBLE) >= 0.5
    """,
    "chunk_pipeline": f"""
        WITH {_FRAMES}, i AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM f WHERE event_type IN ('view', 'click') AND user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(value) >= 1)),
        r AS (SELECT user_id, min(frame) * 0.2 AS s, (max(frame) + 1) * 0.2 AS e FROM i GROUP BY user_id, g),
        n AS (SELECT *, CASE WHEN CAST(s AS DOUBLE) - lag(CAST(e AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY s) < 0.5 THEN 0 ELSE 1 END AS new FROM r),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS grp FROM n),
        t AS (SELECT user_id, CAST(min(s) AS DOUBLE) AS s, CAST(max(e) AS DOUBLE) AS e FROM g GROUP BY user_id, grp HAVING CAST(max(e) AS DOUBLE) - CAST(min(s) AS DOUBLE) >= 0.5),
        c AS (SELECT user_id, greatest(s, 3.0) AS s, least(e, 12.0) AS e FROM t), k AS (SELECT *, greatest(0.0, 2.0 - (e - s)) AS miss FROM c WHERE e - s >= 0.5),
        b AS (SELECT *, greatest(0.0, least(s - 3.0, miss / 2)) AS before FROM k), a AS (SELECT *, greatest(0.0, least(12.0 - e, miss - before)) AS after FROM b)
        SELECT user_id, round_even(s * 1e4, 0) / 1e4 AS start, round_even(e * 1e4, 0) / 1e4 AS "end", round_even((s - before) * 1e4, 0) / 1e4 AS heard_from, round_even((e + after) * 1e4, 0) / 1e4 AS heard_to FROM a
    """,
    "binarized_turns": """
        WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS frame, value > 50 AS active FROM events),
        c AS (SELECT *, CASE WHEN lag(active) OVER w = active THEN 0 ELSE 1 END AS ch, max(frame) OVER (PARTITION BY user_id, event_type) AS last FROM f WINDOW w AS (PARTITION BY user_id, event_type ORDER BY frame)),
        r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id, event_type ORDER BY frame) AS run FROM c),
        s AS (SELECT user_id, event_type, CAST(min(frame) * 0.2 + 0.1 AS DOUBLE) AS start_sec, CAST(least(max(frame) + 1, any_value(last)) * 0.2 + 0.1 AS DOUBLE) AS end_sec FROM r WHERE active GROUP BY user_id, event_type, run)
        SELECT user_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS INTEGER) AS slot, start_sec, end_sec FROM s WHERE end_sec - start_sec > 1e-6
    """,
    "overlap_add": f"WITH {_ACTIVITY} SELECT user_id, frame, CAST(round_even(sum(activity) / count(DISTINCT chunk), 0) AS INTEGER) AS count FROM a GROUP BY user_id, frame",
    "cluster_activations": f"WITH {_ACTIVITY}, b AS (SELECT user_id, chunk, frame, cluster, max(activity) AS best FROM a GROUP BY ALL) SELECT user_id, frame, cluster, CAST(sum(best) AS BIGINT) AS activation FROM b GROUP BY user_id, frame, cluster",
    "top_active": f"""
        WITH {_ACTIVITY}, b AS (SELECT user_id, chunk, frame, cluster, max(activity) AS best FROM a GROUP BY ALL),
        t AS (SELECT user_id, frame, cluster, sum(best) AS act FROM b GROUP BY ALL), n AS (SELECT user_id, frame, round_even(sum(activity) / count(DISTINCT chunk), 0) AS k FROM a GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, frame ORDER BY act DESC, cluster) AS rank FROM t)
        SELECT user_id, frame, cluster, CAST(rank AS INTEGER) AS rank FROM r JOIN n USING (user_id, frame) WHERE rank <= k
    """,
    "active_speaker": "WITH " + _SPANS.format(kind="purchase", tracks=5, samples="'view', 'click'", least=10.0, clear="score - second >= 2.5"),
    "active_in_session": """
        WITH s AS (SELECT event_id AS span_id, user_id, epoch_us(ts) / 1e6 AS st FROM events WHERE event_type = 'purchase'), x AS (SELECT user_id, event_id % 3 AS track, epoch_us(ts) / 1e6 AS t, value FROM events WHERE event_type IN ('view', 'click')),
        m AS (SELECT span_id, track, avg(value) AS score FROM s JOIN x ON x.user_id = s.user_id AND x.t BETWEEN s.st - 86400 AND s.st + 600 + 86400 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM m WINDOW w AS (PARTITION BY span_id ORDER BY score DESC, track))
        SELECT span_id, track, round_even(score * 1e4, 0) / 1e4 AS score FROM r WHERE k = 1 AND score >= 10 AND (second IS NULL OR score - second >= 2.5)
    """,
    "loudest_mover": "WITH " + _SPANS.format(kind="signup", tracks=3, samples="'click'", least=3.0, clear="second < 3.0 OR score / second >= 1.5"),
    "asof_previous": """
        SELECT l.event_id, l.user_id, r.value AS previous_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts > r.ts
    """,
    "chunk_windows": """
        WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), k AS (SELECT user_id, n, unnest(generate_series(0, n)) AS k FROM t),
        w AS (SELECT user_id, n, k, CASE WHEN k = 0 THEN 0 ELSE 8 + 5 * (k - 1) END AS s FROM k)
        SELECT user_id, k AS "window", CAST(s AS DOUBLE) AS start_sec, CAST(CASE WHEN k = 0 THEN 8 ELSE s + 15 END AS DOUBLE) AS end_sec, CAST(CASE WHEN k <= 1 THEN s ELSE s + 10 END AS DOUBLE) AS new_from_sec
        FROM w WHERE CASE WHEN k = 0 THEN 8 ELSE s + 15 END <= n
    """,
    "chunk_windows_low_latency": """
        WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), k AS (SELECT user_id, n, unnest(generate_series(0, n)) AS k FROM t)
        SELECT user_id, k AS "window", CAST(greatest(0, 4 * k - 4) AS DOUBLE) AS start_sec, CAST(4 * k + 4 AS DOUBLE) AS end_sec, CAST(4 * k AS DOUBLE) AS new_from_sec FROM k WHERE 4 * k + 4 <= n
    """,
    "recent_mean": "SELECT event_id, round_even(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) * 1e6, 0) / 1e6 AS score FROM events",
    "frame_diff": """
        WITH p AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
        e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(prev) AS y FROM p WHERE prev IS NOT NULL)
        SELECT vec_id, label, round_even(sum(abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))) / count(*) * 1e6, 0) / 1e6 AS moved FROM e GROUP BY ALL UNION ALL SELECT vec_id, label, 0.0 FROM p WHERE prev IS NULL
    """,
    "topn_per_frame": "SELECT event_id, CAST(n AS INTEGER) AS n FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 4",
    "label_dedup": "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY value DESC, event_id) = 1 AND event_type <> 'error' THEN event_type ELSE 'Unknown' END AS label FROM events",
    "confidence_split": "SELECT event_id, CASE WHEN value / 100 > CAST(0.45 AS DOUBLE) THEN 'high' WHEN value / 100 > CAST(0.1 AS DOUBLE) AND value / 100 < CAST(0.45 AS DOUBLE) THEN 'low' ELSE 'none' END AS band FROM events",
    "sampled_scores": "SELECT event_id, user_id, CAST(n AS INTEGER) AS n FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 30 = 0",
    "padded_segments": """
        WITH g AS (SELECT id, CAST(seg_index % 15 AS DOUBLE) AS s, CAST(seg_index % 15 AS DOUBLE) + (id % 7) * CAST(0.3 AS DOUBLE) AS e FROM segments WHERE seg_index IS NOT NULL),
        c AS (SELECT id, greatest(s, 5.0) AS s, least(e, 15.0) AS e FROM g), k AS (SELECT *, greatest(0.0, 2.0 - (e - s)) AS miss FROM c WHERE e - s >= 0.5),
        b AS (SELECT *, greatest(0.0, least(s - 5.0, miss / 2)) AS before FROM k), a AS (SELECT *, greatest(0.0, least(15.0 - e, miss - before)) AS after FROM b)
        SELECT id, round_even(s * 1e4, 0) / 1e4 AS start, round_even(e * 1e4, 0) / 1e4 AS "end", round_even((s - before) * 1e4, 0) / 1e4 AS heard_from, round_even((e + after) * 1e4, 0) / 1e4 AS heard_to FROM a
    """,
    "face_slices": """
        WITH v AS (SELECT event_id, CAST(floor(value) AS INTEGER) - 20 AS a, CAST(floor(value * 2) AS INTEGER) - 60 AS b FROM events),
        c AS (SELECT event_id, CASE WHEN a < 0 THEN greatest(a + 64, 0) ELSE least(a, 64) END AS a, CASE WHEN b < 0 THEN greatest(b + 64, 0) ELSE least(b, 64) END AS b FROM v)
        SELECT event_id, CASE WHEN b > a THEN a ELSE -1 END AS from_px, CASE WHEN b > a THEN b ELSE -1 END AS to_px FROM c
    """,
}
