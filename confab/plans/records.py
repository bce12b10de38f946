"""Queries of metrics records, session payloads, reports as lines, and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from confab.functions.columns import clock_of, half_even
from confab.operators import frames, records
from confab.plans.reports import _GENERIC, _TYPE, gender_sql
from confab.session import table


def _candidates():
    score = F.col("raw_conf")
    listed = [(F.coalesce("raw_best_name", F.lit("Unknown")), score), (F.lit("Carolina Lemos"), score - 0.03), (F.col("final_name"), score - 0.1)]
    return F.filter(F.array(*(F.struct(n.alias("name"), s.alias("score")) for n, s in listed)), lambda c: c["name"].isNotNull())


def _offered(spark, d):
    s = table(spark, d, "segments").filter("raw_conf is not null").withColumn("candidates", _candidates())
    return s.withColumn("filtered", records.gender_kept(F.col("candidates"), F.col("audio_gender")))


def gender_candidates(spark, d):
    """The candidates of each segment that the voice's gender leaves."""
    return _offered(spark, d).select("id", F.array_join(F.transform("filtered", lambda c: c["name"]), "|").alias("kept"))


def _recorded(spark, d):
    first = F.get("filtered", F.lit(0))
    reasons = F.when(F.col("is_fn") == 1, F.array(F.concat(F.lit("BELOW_THRESHOLD: "), F.format_string("%.3f", "raw_conf")), F.lit("MARGIN_REJECT"))).otherwise(F.expr("cast(array() as array<string>)"))
    s = _offered(spark, d).withColumn("raw_best_name", F.coalesce("raw_best_name", F.lit("Unknown"))).withColumn("chosen_name", first["name"]).withColumn("chosen_conf", first["score"])
    s = s.withColumn("asd_active", F.col("id") % 2 == 0).withColumn("n_faces", (F.col("id") % 4).cast("int")).withColumn("fn_reasons", reasons).withColumn("fp_reasons", F.array(F.concat(F.lit("WEAK: "), F.coalesce("decision_type", F.lit("?")))))
    return s.withColumn("duration_s", F.coalesce(F.col("segment_ms"), F.lit(0.0)) / 1000).withColumn("avg_logprob", F.col("raw_conf") - 1).withColumn("avg_no_speech", 1 - F.col("raw_conf"))


def segment_metrics(spark, d):
    """Fields of the metrics record of each segment, read back from its JSON."""
    r = records.metrics_record(_recorded(spark, d))
    read = lambda path, kind="string": F.get_json_object("record", f"$.{path}").cast(kind)
    return r.select(
        "id", read("decision_type").alias("decision_type"), read("raw_best_name").alias("raw_best_name"), read("chosen_name").alias("chosen_name"), read("raw_conf", "double").alias("raw_conf"), read("is_identified").alias("is_identified"), read("n_candidates", "int").alias("n_candidates"),
        read("n_filtered", "int").alias("n_filtered"), read("margin", "double").alias("margin"), read("is_fn").alias("is_fn"), read("fn_reasons[0]").alias("reason"), read("text_len", "int").alias("text_len"), read("segment_duration_s", "double").alias("duration"), read("candidates[1][0]").alias("second"),
        read("candidates[1][1]", "double").alias("second_score"),
    )


def session_payloads(spark, d):
    """Configuration and summary of each session, read back from their JSON."""
    p = records.session_payloads(table(spark, d, "segments"), speakers=4)
    read = lambda c, path, kind="double": F.get_json_object(c, f"$.{path}").cast(kind)
    return p.select("session_pk", read("config", "num_speakers", "int").alias("num_speakers"), read("config", "sample_rate", "int").alias("sample_rate"), read("summary", "total_segments", "bigint").alias("total_segments"), read("summary", "fn_rate").alias("fn_rate"), read("summary", "median_raw_conf").alias("median_raw_conf"), read("summary", "decision_counts.VERIFIER_HIGH", "bigint").alias("verifier_high"))


def face_payloads(spark, d):
    from confab.plans.reports import face_metrics

    p = records.face_payloads(face_metrics(spark, d), "user_id", "faces_only", "external")
    return p.select("user_id", F.get_json_object("payload", "$.mode").alias("mode"), F.get_json_object("payload", "$.face.n_samples").cast("bigint").alias("n_samples"), F.get_json_object("payload", "$.face.mean").cast("double").alias("mean"))


def fp_report(spark, d):
    s = table(spark, d, "segments").filter("raw_conf is not null")
    return records.risk_lines(s, ["seg_index", "id"]).select("session_pk", "id", "part", "line")


def fp_heads(spark, d):
    return records.risk_heads(table(spark, d, "segments"))


def transcript_lines(spark, d):
    """The transcript of every session as rows, times in any notation as HH:mm:ss."""
    s = table(spark, d, "segments")
    e = s.select("session_pk", "seg_index", "id", clock_of(F.col("timestamp")).alias("clock"), F.col("final_name").alias("name"), F.coalesce("final_speaker", F.lit("?")).alias("speaker"), "text", F.coalesce(F.col("raw_conf") < 0.3, F.lit(False)).alias("uncertain"))
    return records.transcript_lines(e, "session_pk", ["id"])


def segment_logprob(spark, d):
    """Mean log-probability of the windows of each segment, unweighted."""
    w = table(spark, d, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("segment"), (-F.col("value") / 100).alias("logprob"))
    return w.groupBy("user_id", "segment").agg(half_even(F.avg("logprob"), 6).alias("avg_logprob"), F.count("*").alias("windows"))


def _scores():
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.pmod(F.floor(F.col("value") * (i + 3)), F.lit(11)).cast("double"))


def token_choice(spark, d):
    """The best and the drawn token of masked scores."""
    e = table(spark, d, "events").select("event_id", _scores().alias("s"), (F.col("event_id") % 4 == 0).alias("first"), (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000.0).alias("chance"))
    m = e.select("event_id", frames.masked(F.col("s"), (2, 5), F.col("first"), (0,)).alias("m"), "chance")
    return m.select("event_id", frames.best_token(F.col("m")).alias("best"), frames.drawn_token(F.col("m"), 2.0, F.col("chance") * 0.999 + 0.0005).alias("drawn"))


def token_text(spark, d):
    """Texts put together from tokens of three bytes, which cut characters."""
    cut = F.transform(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit("(.{2,6})"), F.lit(1)), lambda h: F.base64(F.unhex(h)))
    return table(spark, d, "segments").filter("text is not null").select("id", frames.token_text(cut).alias("text"))


def speech_audio(spark, d):
    """Two slices of each user's signal back to back."""
    signal = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"])
    s = table(spark, d, "events").groupBy("user_id").agg(signal.alias("x"))
    spans = F.array(F.struct(F.lit(2).alias("from"), F.lit(5).alias("to")), F.struct(F.lit(8).alias("from"), F.lit(12).alias("to")))
    return s.select("user_id", F.posexplode(frames.joined_slices(F.col("x"), spans)).alias("pos", "sample"))


def grey_values(spark, d):
    channel = lambda k: F.pmod(F.floor(F.col("value") * k), F.lit(256)).cast("int")
    return table(spark, d, "events").select("event_id", frames.grey(channel(3), channel(7), channel(11)).alias("grey"))


def mouth_region(spark, d):
    """Mean of the lower middle part of 8 by 8 images."""
    pixels = F.transform("embedding", lambda x: F.floor(x.cast("double") * 127 + 128).cast("int"))
    part = frames.region(pixels, 8, 8, 0.2, 0.55, 0.8, 0.95)
    return table(spark, d, "embeddings").select("vec_id", F.size(part).alias("n"), half_even(F.aggregate(part, F.lit(0), lambda s, x: s + x) / F.size(part), 4).alias("mean"))


def latest_frames(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_trunc("DAY", F.col("ts")).alias("tick"), "ts", "event_id", "value")
    return frames.latest(e, ["user_id", "tick"], ["ts", "event_id"]).select("user_id", "event_id", "value")


def retained_scores(spark, d):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("at")
    r = frames.retained(table(spark, d, "events").select("event_id", "user_id", at, "value"), "user_id", "at", "value", 20.0)
    return r.select("event_id", "held", half_even(F.col("mean"), 6).alias("mean"))


def frame_labels(spark, d):
    """Labels of the four largest faces of each frame."""
    e = table(spark, d, "events").select("event_id", F.date_trunc("HOUR", F.col("ts")).alias("frame"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("value").alias("x2"), F.lit(1.0).alias("y2"), F.when(F.col("event_id") % 3 == 0, "Unknown").otherwise(F.concat(F.lit("P"), F.col("user_id").cast("string"))).alias("name"), (F.col("event_id") % 100 / 100.0).alias("score"))
    kept = frames.largest(e, ["frame"], 4, ["event_id"])
    return kept.select("event_id", frames.shown(F.col("name"), F.col("score")).alias("label"), (F.col("name") != "Unknown").alias("identified"))


def timelines(spark, d):
    chunks = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_id") % 3 * 16000).alias("samples"))
    t = frames.timeline(chunks, "user_id", "at", "samples")
    return t.select("user_id", *(half_even(F.col(c), 3).alias(c) for c in ("start", "end", "held_from")))


def llm_runs(spark, d):
    """Segments after which the model is asked for names: every tenth, if one of the last twenty speakers is anonymous."""
    from confab.functions.columns import is_generic

    by = Window.partitionBy("session_pk").orderBy("seg_index", "id")
    s = table(spark, d, "segments").filter("seg_index is not null").withColumn("n", F.row_number().over(by)).withColumn("anonymous", F.max(is_generic(F.col("final_name")).cast("int")).over(by.rowsBetween(-19, 0)))
    return s.filter("n % 10 = 0 and anonymous = 1").select("id", "session_pk", "n")


QUERIES = {
    f.__name__: f
    for f in (
        gender_candidates, segment_metrics, session_payloads, face_payloads, fp_report, fp_heads, transcript_lines, segment_logprob, token_choice, token_text, speech_audio, grey_values, mouth_region, latest_frames,
        retained_scores, frame_labels, timelines, llm_runs,
    )
}


def _offered_sql() -> str:
    names = {"a": "coalesce(raw_best_name, 'Unknown')", "b": "'Carolina Lemos'", "c": "final_name"}
    fits = lambda n: f"coalesce(({gender_sql(n)}) = audio_gender, true)"
    kept = " UNION ALL ".join(f"SELECT id, {k} AS k, {n} AS name, raw_conf - {gap} AS score, audio_gender IS NULL OR {fits(n)} AS ok FROM s WHERE {n} IS NOT NULL" for k, (n, gap) in enumerate(zip(names.values(), ("0", "CAST(0.03 AS DOUBLE)", "CAST(0.1 AS DOUBLE)"))))
    return f"""
        s AS (SELECT * FROM segments WHERE raw_conf IS NOT NULL), o AS ({kept}), t AS (SELECT id, max(CASE WHEN ok THEN 1 ELSE 0 END) AS fitting FROM o GROUP BY id),
        f AS (SELECT o.id, list(name ORDER BY k) AS names, list(score ORDER BY k) AS scores FROM o JOIN t USING (id) WHERE ok OR fitting = 0 GROUP BY o.id),
        a AS (SELECT id, list(name ORDER BY k) AS names, list(score ORDER BY k) AS scores FROM o GROUP BY id)
    """


_CLOCK = """CASE WHEN regexp_full_match(t, '\\d{10}(\\.\\d+)?') THEN strftime(make_timestamp(CAST(floor(CAST(t AS DOUBLE)) AS BIGINT) * 1000000), '%H:%M:%S') WHEN regexp_full_match(t, '\\d{13}') THEN strftime(make_timestamp(CAST(floor(CAST(t AS DOUBLE) / 1000) AS BIGINT) * 1000000), '%H:%M:%S')
    WHEN regexp_full_match(t, '\\d{1,2}:\\d{2}:\\d{2}(\\.\\d+)?') THEN lpad(split_part(t, ':', 1), 2, '0') || ':' || split_part(t, ':', 2) || ':' || substr(split_part(t, ':', 3), 1, 2)
    WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}') THEN substr(t, 12, 8) WHEN regexp_matches(t, '^\\d{1,2}/\\d{1,2}/\\d{4}[ T]+\\d{2}:\\d{2}:\\d{2}') THEN regexp_extract(t, '[ T]+(\\d{2}:\\d{2}:\\d{2})', 1) ELSE '--:--:--' END"""
ORACLE_SQL = {
    "gender_candidates": f"WITH {_offered_sql()} SELECT id, array_to_string(names, '|') AS kept FROM f",
    "segment_metrics": f"""
        WITH {_offered_sql()}
        SELECT s.id, {_TYPE.format('decision')} AS decision_type, nullif(raw_best_name, 'Unknown') AS raw_best_name, nullif(f.names[1], 'Unknown') AS chosen_name, round_even(raw_conf * 1e4, 0) / 1e4 AS raw_conf,
               CASE WHEN coalesce({_GENERIC.format('final_name')}, true) THEN 'false' ELSE 'true' END AS is_identified, CAST(len(a.names) AS INTEGER) AS n_candidates, CAST(len(f.names) AS INTEGER) AS n_filtered,
               CASE WHEN len(f.names) >= 2 THEN round_even((f.scores[1] - f.scores[2]) * 1e4, 0) / 1e4 END AS margin, CASE WHEN is_fn = 1 THEN 'true' ELSE 'false' END AS is_fn, CASE WHEN is_fn = 1 THEN 'BELOW_THRESHOLD' END AS reason,
               CAST(length(coalesce(text, '')) AS INTEGER) AS text_len, round_even(coalesce(segment_ms, 0) / 1000 * 100, 0) / 100 AS duration, a.names[2] AS second, round_even(a.scores[2] * 1e4, 0) / 1e4 AS second_score
        FROM s JOIN f ON f.id = s.id JOIN a ON a.id = s.id
    """,
    "session_payloads": f"""
        SELECT session_pk, 4 AS num_speakers, 16000 AS sample_rate, count(*) AS total_segments, round_even(count(*) FILTER (WHERE is_fn = 1) / count(*) * 1e4, 0) / 1e4 AS fn_rate,
               round_even(coalesce(median(raw_conf) FILTER (WHERE raw_conf > 0), 0) * 1e4, 0) / 1e4 AS median_raw_conf, nullif(count(*) FILTER (WHERE {_TYPE.format('decision')} = 'VERIFIER_HIGH'), 0) AS verifier_high FROM segments GROUP BY session_pk
    """,
    "face_payloads": """
        WITH s AS (SELECT user_id, value / 100 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
        SELECT user_id, 'faces_only' AS mode, count(*) AS n_samples, round_even(avg(s) * 1e4, 0) / 1e4 AS mean FROM s WHERE n % 30 = 0 GROUP BY user_id
    """,
    "fp_report": """
        WITH s AS (SELECT *, CAST(CAST(CAST(raw_conf AS DECIMAL(18, 6)) AS DECIMAL(18, 3)) AS VARCHAR) AS shown FROM segments WHERE fp_risk IN ('high', 'medium') AND raw_conf IS NOT NULL)
        SELECT session_pk, id, 0 AS part, 'risk=' || upper(fp_risk) || '  decision=' || coalesce(decision, 'None') || '  final=' || coalesce(final_name, 'None') || '  speaker=' || coalesce(final_speaker, 'None') AS line FROM s
        UNION ALL SELECT session_pk, id, 1, '  raw_best=' || coalesce(raw_best_name, 'None') || ':' || shown || '  gender=' || coalesce(audio_gender, 'None') FROM s
    """,
    "fp_heads": "SELECT session_pk, count(*) AS suspects, count(*) FILTER (WHERE fp_risk = 'high') AS high, count(*) FILTER (WHERE fp_risk = 'medium') AS medium FROM segments WHERE fp_risk IN ('high', 'medium') GROUP BY 1",
    "transcript_lines": f"""
        WITH s AS (SELECT *, trim(timestamp) AS t FROM segments)
        SELECT session_pk, id, '[' || {_CLOCK} || '] ' || coalesce(nullif(final_name, ''), coalesce(final_speaker, '?')) || ': ' || CASE WHEN raw_conf < CAST(0.3 AS DOUBLE) THEN '[texto incerto] ' ELSE '' END || coalesce(text, '') AS line FROM s
    """,
    "segment_logprob": "SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS segment, round_even(avg(-value / 100) * 1e6, 0) / 1e6 AS avg_logprob, count(*) AS windows FROM events GROUP BY 1, 2",
    "token_choice": """
        WITH s AS (SELECT event_id, event_id % 4 = 0 AS first, (event_id * 7919 % 1000) / 1000 * CAST(0.999 AS DOUBLE) + CAST(0.0005 AS DOUBLE) AS chance, list_transform(range(0, 7), lambda i: CAST(CAST(floor(value * (i + 3)) AS BIGINT) % 11 AS DOUBLE)) AS s FROM events),
        k AS (SELECT event_id, chance, s, first, unnest(range(0, 7)) AS i FROM s), m AS (SELECT event_id, chance, i, s[i + 1] AS x FROM k WHERE i NOT IN (2, 5) AND NOT (first AND i = 0)),
        w AS (SELECT event_id, chance, i, x, exp((x - max(x) OVER (PARTITION BY event_id)) / 2) AS w FROM m),
        c AS (SELECT event_id, i, x, chance, sum(w) OVER (PARTITION BY event_id ORDER BY i) AS run, sum(w) OVER (PARTITION BY event_id) AS total FROM w)
        SELECT event_id, CAST(arg_max(i, x * 100 - i) AS INTEGER) AS best, CAST(min(i) FILTER (WHERE run >= chance * total) AS INTEGER) AS drawn FROM c GROUP BY event_id
    """,
    "token_text": "SELECT id, trim(text) AS text FROM segments WHERE text IS NOT NULL",
    "speech_audio": """
        WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY user_id), j AS (SELECT user_id, list_concat(x[3:5], x[9:12]) AS x FROM s)
        SELECT user_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS sample FROM j
    """,
    "grey_values": "SELECT event_id, CAST(floor(CAST(0.299 AS DOUBLE) * (CAST(floor(value * 3) AS BIGINT) % 256) + CAST(0.587 AS DOUBLE) * (CAST(floor(value * 7) AS BIGINT) % 256) + CAST(0.114 AS DOUBLE) * (CAST(floor(value * 11) AS BIGINT) % 256) + 0.5) AS INTEGER) AS grey FROM events",
    "mouth_region": """
        WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 127 + 128) AS INTEGER)) AS p FROM embeddings), r AS (SELECT vec_id, list_concat(list_concat(p[34:38], p[42:46]), p[50:54]) AS r FROM p)
        SELECT vec_id, CAST(len(r) AS INTEGER) AS n, round_even(list_sum(r) / len(r) * 1e4, 0) / 1e4 AS mean FROM r
    """,
    "latest_frames": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "retained_scores": """
        SELECT event_id, count(*) OVER w AS held, round_even(avg(value) OVER w * 1e6, 0) / 1e6 AS mean FROM (SELECT *, epoch_us(ts) / 1e6 / 3600 AS h FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY h RANGE BETWEEN 20 PRECEDING AND CURRENT ROW)
    """,
    "frame_labels": """
        WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Unknown' ELSE 'P' || user_id END AS name, event_id % 100 AS score, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY value DESC, event_id) AS n FROM events)
        SELECT event_id, name || ' (0.' || lpad(CAST(score AS VARCHAR), 2, '0') || ')' AS label, name <> 'Unknown' AS identified FROM e WHERE n <= 4
    """,
    "timelines": """
        WITH t AS (SELECT user_id, min(epoch_us(ts)) / 1e6 AS s, sum(event_id % 3 * 16000) / 16000 AS n FROM events GROUP BY 1)
        SELECT user_id, round_even(s * 1e3, 0) / 1e3 AS start, round_even((s + n) * 1e3, 0) / 1e3 AS "end", round_even(greatest(s, s + n - 40) * 1e3, 0) / 1e3 AS held_from FROM t
    """,
    "llm_runs": f"""
        WITH s AS (SELECT id, session_pk, row_number() OVER w AS n, max(CASE WHEN coalesce({_GENERIC.format('final_name')}, true) THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS g FROM segments WHERE seg_index IS NOT NULL WINDOW w AS (PARTITION BY session_pk ORDER BY seg_index, id))
        SELECT id, session_pk, CAST(n AS INTEGER) AS n FROM s WHERE n % 10 = 0 AND g = 1
    """,
}
