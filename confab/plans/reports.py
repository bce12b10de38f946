"""Queries of summaries, diagnostics and reports over the stored segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions.columns import decision_type as type_of
from confab.functions.columns import clock_of, half_even, is_generic, strip_homonym
from confab.operators import reports
from confab.session import table


def session_summary(spark, d):
    return reports.session_summary(table(spark, d, "segments"))


def decision_histogram(spark, d):
    return reports.decision_histogram(table(spark, d, "segments"))


def face_metrics(spark, d):
    scores = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("value") / 100).alias("score"))
    return reports.score_statistics(scores, "user_id", "score", 0.65, 30, ["ts", "event_id"])


def decision_type(spark, d):
    return table(spark, d, "segments").select("id", type_of(F.col("decision")).alias("type"))


def generic_names(spark, d):
    name = F.col("speaker_name")
    return table(spark, d, "segments").select("id", *(is_generic(name, w).cast("int").alias(w) for w in ("registry", "face_sync", "person_or_spk", "verifier")), strip_homonym(name).alias("without_number"))


def fn_reasons(spark, d):
    s = table(spark, d, "segments").filter("raw_best_name is not null and decision is not null and raw_conf is not null")
    offered = F.array(F.struct(F.col("raw_best_name").alias("name"), F.col("raw_conf").alias("score")))
    kept = F.when(F.col("audio_gender").isNull() | (F.col("id") % 3 != 0), offered).otherwise(F.filter(offered, lambda c: F.lit(False)))
    reasons = reports.missed_reasons(F.col("decision"), F.col("raw_best_name"), F.col("raw_conf"), kept, offered, F.col("audio_gender"))
    return s.select("id", F.array_join(reasons, "|").alias("reasons"))


def fp_risk(spark, d):
    s = table(spark, d, "segments").filter("decision is not null and raw_conf is not null")
    known = table(spark, d, "speakers").select(F.col("name").alias("final_name")).distinct().withColumn("known", F.lit(True))
    named = s.filter(~is_generic(F.col("final_name"))).groupBy("session_pk").agg(F.count_distinct("final_name").alias("identified"))
    joined = s.join(known, "final_name", "left").join(named, "session_pk", "left")
    risk = reports.false_positive_risk(F.col("decision"), F.col("final_name"), F.col("raw_conf"), F.col("audio_gender"), F.coalesce("known", F.lit(False)), F.coalesce("identified", F.lit(0)), F.lit(4))
    return joined.select("id", risk.alias("r")).select("id", "r.risk", F.array_join("r.reasons", "|").alias("reasons"))


def fn_events(spark, d):
    s = table(spark, d, "segments").filter("is_fn = 1")
    text = F.when(F.length("text") > 60, F.concat(F.left("text", F.lit(60)), F.lit("..."))).otherwise(F.col("text"))
    best = F.when(F.col("raw_best_name").isNotNull() | (F.col("raw_conf") > 0), F.concat(F.coalesce("raw_best_name", F.lit("Unknown")), F.lit("="), F.format_string("%.3f", F.coalesce("raw_conf", F.lit(0.0))))).otherwise("none")
    return s.select("id", "decision", text.alias("text"), best.alias("raw_best"))


def label_projection(spark, d):
    return table(spark, d, "segments").select("id", reports.label(F.col("final_name"), F.coalesce("final_speaker", F.lit("?"))).alias("label"))


def transcript_text(spark, d):
    s = table(spark, d, "segments").filter("timestamp like '____-__-__T%' and seg_index is not null")
    e = s.select("session_pk", "seg_index", "id", F.substring("timestamp", 12, 8).alias("clock"), F.col("final_name").alias("name"), F.coalesce("final_speaker", F.lit("?")).alias("speaker"), "text", F.coalesce(F.col("raw_conf") < 0.3, F.lit(False)).alias("uncertain"))
    return reports.transcript_text(e, "session_pk", ["seg_index", "id"])


def transcript_full(spark, d):
    """Every entry of each session, whatever the notation of its time; transcript_text keeps the ISO times that its SQL twin can say."""
    s = table(spark, d, "segments").withColumn("unplaced", F.col("seg_index").isNull())
    e = s.select("session_pk", "unplaced", "seg_index", "id", clock_of(F.col("timestamp")).alias("clock"), F.col("final_name").alias("name"), F.coalesce("final_speaker", F.lit("?")).alias("speaker"), "text", F.coalesce(F.col("raw_conf") < 0.3, F.lit(False)).alias("uncertain"))
    return reports.transcript_text(e, "session_pk", ["unplaced", "seg_index", "id"])


def fn_report(spark, d):
    """The header and the events of each session's report of missed voices."""
    s = table(spark, d, "segments").filter("is_fn = 1 and seg_index is not null and decision is not null")
    line = F.concat(F.lit("  decision="), "decision", F.lit(" final="), F.coalesce("final_name", F.lit("None")), F.lit(" gender="), F.coalesce("audio_gender", F.lit("None")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "id", line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit("FALSE NEGATIVE REPORT — "), F.count("*").cast("string"), F.lit(" event(s)\n"))
    return s.groupBy("session_pk").agg(F.concat(head, F.array_join(lines, "\n")).alias("report"))


def unnamed_speakers(spark, d):
    u = reports.unnamed_speakers(table(spark, d, "segments"))
    return u.select("session_pk", F.coalesce("speaker", F.lit("?")).alias("speaker"), half_even(F.col("seconds"), 3).alias("seconds"))


def llm_prompt_lines(spark, d):
    """The last 40 lines of each session and its first known names, as they go into a prompt."""
    from pyspark.sql import Window

    s = table(spark, d, "segments").filter("seg_index is not null and text is not null")
    back = F.row_number().over(Window.partitionBy("session_pk").orderBy(F.desc("seg_index"), F.desc("id")))
    last = s.withColumn("back", back).filter("back <= 40")
    line = F.concat(F.coalesce("final_speaker", F.lit("?")), F.lit(": "), "text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "id", line.alias("line")))), lambda x: x["line"])
    return last.groupBy("session_pk").agg(F.array_join(lines, "\n").alias("lines"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (session_summary, decision_histogram, face_metrics, decision_type, generic_names, fn_reasons, fp_risk, fn_events, label_projection, transcript_text, transcript_full, fn_report, unnamed_speakers, llm_prompt_lines)}


def _names(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def gender_sql(name: str) -> str:
    """SQL text for the gender of a name's first word."""
    from confab.functions import wordlists as W
    from confab.functions.text import _plain

    key = f"strip_accents(lower(regexp_extract({name}, '^[\\s\\x{{00A0}}]*([^\\s\\x{{00A0}}]*)', 1)))"
    return f"CASE WHEN {key} IN ({_names(_plain(W.FEMALE_NAMES))}) THEN 'female' WHEN {key} IN ({_names(_plain(W.MALE_NAMES))}) THEN 'male' END"


_GENERIC = "regexp_full_match({0}, '(Person_\\d+|spk_\\d+|Desconhecido_\\d+|Unknown|Unknown_\\d+)')"
_TYPE = "trim(split_part(split_part({0}, '(', 1), ' ', 1))"
ORACLE_SQL = {
    "session_summary": """
        SELECT session_pk, count(*) AS total_segments, count(*) FILTER (WHERE is_fn = 1) AS total_fn, count(*) FILTER (WHERE is_identified = 1) AS total_identified, count(DISTINCT final_speaker) AS unique_speakers,
               round_even(count(*) FILTER (WHERE is_fn = 1) / count(*) * 1e4, 0) / 1e4 AS fn_rate, round_even(count(*) FILTER (WHERE is_identified = 1) / count(*) * 1e4, 0) / 1e4 AS identification_rate,
               round_even(coalesce(avg(raw_conf) FILTER (WHERE raw_conf > 0), 0) * 1e4, 0) / 1e4 AS avg_raw_conf, round_even(coalesce(median(raw_conf) FILTER (WHERE raw_conf > 0), 0) * 1e4, 0) / 1e4 AS median_raw_conf,
               round_even(CAST(sum(CAST(whisper_ms AS DECIMAL(18,4))) AS DOUBLE) / count(whisper_ms) * 10, 0) / 10 AS avg_whisper_ms, round_even(CAST(sum(CAST(verifier_ms AS DECIMAL(18,4))) AS DOUBLE) / count(verifier_ms) * 10, 0) / 10 AS avg_verifier_ms, round_even(CAST(sum(CAST(segment_ms AS DECIMAL(18,4))) AS DOUBLE) / count(segment_ms) * 10, 0) / 10 AS avg_segment_ms,
               count(*) FILTER (WHERE fp_risk = 'high') AS total_fp_high, count(*) FILTER (WHERE fp_risk = 'medium') AS total_fp_medium, round_even(count(*) FILTER (WHERE fp_risk IN ('high', 'medium')) / count(*) * 1e4, 0) / 1e4 AS fp_rate
        FROM segments GROUP BY session_pk
    """,
    "decision_histogram": f"""
        WITH t AS (SELECT session_pk, {_TYPE.format('decision')} AS type, count(*) AS n, min(struct_pack(a := coalesce(seg_index, -1), b := id)) AS f FROM segments WHERE decision IS NOT NULL GROUP BY 1, 2)
        SELECT session_pk, string_agg(type || '=' || n, ', ' ORDER BY f) AS decision_counts FROM t GROUP BY session_pk
    """,
    "face_metrics": """
        WITH s AS (SELECT user_id, value / 100 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
        SELECT user_id, count(*) AS n_samples, round_even(avg(s) * 1e4, 0) / 1e4 AS mean, round_even(median(s) * 1e4, 0) / 1e4 AS median, round_even(max(s) * 1e4, 0) / 1e4 AS max, round_even(min(s) * 1e4, 0) / 1e4 AS min,
               round_even(count(*) FILTER (WHERE s >= CAST(0.65 AS DOUBLE)) / count(*) * 1e4, 0) / 1e4 AS pct_matched,
               round_even(coalesce(avg(s) FILTER (WHERE s >= CAST(0.65 AS DOUBLE)), 0) * 1e4, 0) / 1e4 AS mean_matched, round_even(coalesce(avg(s) FILTER (WHERE s < CAST(0.65 AS DOUBLE)), 0) * 1e4, 0) / 1e4 AS mean_unmatched
        FROM s WHERE n % 30 = 0 GROUP BY user_id
    """,
    "decision_type": f"SELECT id, {_TYPE.format('decision')} AS type FROM segments",
    "generic_names": """
        SELECT id, CAST(coalesce(regexp_full_match(speaker_name, '(Person_\\d+|spk_\\d+|Desconhecido_\\d+|Unknown|Unknown_\\d+)'), true) AS INTEGER) AS registry,
               CAST(coalesce(regexp_full_match(speaker_name, '(Person_\\d+|spk_\\d+|Desconhecido_\\d+)'), true) AS INTEGER) AS face_sync, CAST(coalesce(regexp_full_match(speaker_name, '(Person_\\d+|spk_\\d+)'), true) AS INTEGER) AS person_or_spk,
               CAST(coalesce(regexp_full_match(speaker_name, '(spk_\\d+|Person_\\d+|Desconhecido_\\d+|Unknown(_\\d+)?)'), true) AS INTEGER) AS verifier, regexp_replace(speaker_name, '[\\s\\x{00A0}]+\\d+$', '') AS without_number
        FROM segments
    """,
    "fn_reasons": """
        WITH s AS (SELECT *, raw_best_name <> 'Unknown' AND raw_conf >= CAST(0.45 AS DOUBLE) AS ok FROM segments WHERE raw_best_name IS NOT NULL AND decision IS NOT NULL AND raw_conf IS NOT NULL)
        SELECT id, CASE WHEN starts_with(decision, 'VERIFIER') THEN '' ELSE concat_ws('|', CASE WHEN ok AND raw_conf < CAST(0.8 AS DOUBLE) THEN 'BELOW_THRESHOLD' END,
               CASE WHEN ok AND audio_gender IS NOT NULL AND id % 3 = 0 THEN 'GENDER_FILTERED' END) END AS reasons FROM s
    """,
    "fp_risk": f"""
        WITH i AS (SELECT session_pk, count(DISTINCT final_name) AS k FROM segments WHERE final_name IS NOT NULL AND decision IS NOT NULL AND raw_conf IS NOT NULL AND NOT {_GENERIC.format('final_name')} GROUP BY 1),
        s AS (SELECT g.id, {_TYPE.format('decision')} AS t, raw_conf AS c, audio_gender AS ag, {gender_sql('final_name')} AS ng, coalesce(i.k, 0) AS k,
                     final_name IS NOT NULL AND NOT {_GENERIC.format('final_name')} AS named, final_name IN (SELECT name FROM speakers WHERE name IS NOT NULL) AS known
              FROM segments g LEFT JOIN i USING (session_pk) WHERE decision IS NOT NULL AND raw_conf IS NOT NULL),
        r AS (SELECT id, coalesce(named AND t IN ('VERIFIER_WEAK', 'FACE_ONLY', 'SINGLE_FACE'), false) AS w, coalesce(named AND known AND c < CAST(0.8 AS DOUBLE), false) AS u, coalesce(named AND ag <> ng, false) AS m, coalesce(named AND k > 4, false) AS o FROM s)
        SELECT id, CASE WHEN u OR m THEN 'high' WHEN w OR o THEN 'medium' ELSE 'none' END AS risk,
               concat_ws('|', CASE WHEN w THEN 'WEAK_DECISION' END, CASE WHEN u THEN 'UNCONFIRMED_KNOWN' END, CASE WHEN m THEN 'GENDER_MISMATCH' END, CASE WHEN o THEN 'SPEAKER_OVERFLOW' END) AS reasons FROM r
    """,
    "fn_events": """
        SELECT id, decision, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS text,
               CASE WHEN raw_best_name IS NOT NULL OR raw_conf > 0 THEN coalesce(raw_best_name, 'Unknown') || '=' || CAST(CAST(CAST(coalesce(raw_conf, 0.0) AS DECIMAL(18, 6)) AS DECIMAL(18, 3)) AS VARCHAR) ELSE 'none' END AS raw_best FROM segments WHERE is_fn = 1
    """,
    "label_projection": f"SELECT id, '(' || CASE WHEN final_name IS NOT NULL AND NOT {_GENERIC.format('final_name')} THEN final_name ELSE coalesce(final_speaker, '?') END || ')' AS label FROM segments",
    "transcript_text": """
        SELECT session_pk, string_agg('[' || substr(timestamp, 12, 8) || '] ' || coalesce(nullif(final_name, ''), coalesce(final_speaker, '?')) || ': ' || CASE WHEN raw_conf < CAST(0.3 AS DOUBLE) THEN '[texto incerto] ' ELSE '' END || coalesce(text, ''), chr(10) ORDER BY seg_index, id) AS transcript
        FROM segments WHERE timestamp LIKE '____-__-__T%' AND seg_index IS NOT NULL GROUP BY session_pk
    """,
    "fn_report": """
        SELECT session_pk, 'FALSE NEGATIVE REPORT — ' || count(*) || ' event(s)' || chr(10) || string_agg('  decision=' || decision || ' final=' || coalesce(final_name, 'None') || ' gender=' || coalesce(audio_gender, 'None'), chr(10) ORDER BY seg_index, id) AS report
        FROM segments WHERE is_fn = 1 AND seg_index IS NOT NULL AND decision IS NOT NULL GROUP BY session_pk
    """,
    "unnamed_speakers": f"""
        SELECT session_pk, coalesce(final_speaker, '?') AS speaker, round_even(sum(segment_ms) / 1000 * 1e3, 0) / 1e3 AS seconds FROM segments
        WHERE coalesce({_GENERIC.format('final_name')}, true) GROUP BY 1, 2 HAVING sum(segment_ms) / 1000 >= 5
    """,
    "llm_prompt_lines": """
        WITH b AS (SELECT *, row_number() OVER (PARTITION BY session_pk ORDER BY seg_index DESC, id DESC) AS back FROM segments WHERE seg_index IS NOT NULL AND text IS NOT NULL)
        SELECT session_pk, string_agg(coalesce(final_speaker, '?') || ': ' || text, chr(10) ORDER BY seg_index, id) AS lines, count(*) AS n FROM b WHERE back <= 40 GROUP BY session_pk
    """,
}
