"""Records of a session: metrics of each segment, configuration and summary as JSON, reports as lines.

Reports come as rows (session_pk, order columns, line), not as one text a
session: a session that is never closed is written in order by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.columns import decision_type, half_even, is_generic
from confab.functions.text import gender_of
from confab.operators.reports import session_summary

KEEP_NULLS = {"ignoreNullFields": "false"}


def gender_kept(candidates: Column, gender: Column) -> Column:
    """Candidates (name, score) that don't contradict the voice's gender; all of them where every one does, or it is unknown."""
    own = lambda c: F.coalesce(gender_of(c["name"]) == gender, F.lit(True))
    kept = F.filter(candidates, own)
    return F.when(gender.isNull() | (F.size(kept) == 0), candidates).otherwise(kept)


def _pair(candidate: Column) -> Column:
    """A candidate as a JSON list of its name and score."""
    name = F.to_json(F.array(candidate["name"]))
    return F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.lit(","), half_even(candidate["score"], 4).cast("string"), F.lit("]"))


def metrics_record(decided: DataFrame) -> DataFrame:
    """Decided segments with their metrics ``record``, a JSON text of 28 keys.

    Needs timestamp, decision, raw_best_name, raw_conf, chosen_name, chosen_conf,
    final_name, final_speaker, audio_gender, candidates and filtered (arrays of
    name and score, the best first), asd_active, n_faces, fn_reasons, fp_risk,
    fp_reasons, text, duration_s, whisper_ms, verifier_ms, segment_ms,
    avg_logprob, avg_no_speech.  Unknown names are null, reasons of missed voices
    lose their figures, five candidates are kept as written.
    """
    c = F.col
    known = lambda n: F.when(c(n) != "Unknown", c(n))
    first, second = F.get("filtered", F.lit(0)), F.get("filtered", F.lit(1))
    fields = F.struct(
        "timestamp", "decision", decision_type(c("decision")).alias("decision_type"), known("raw_best_name").alias("raw_best_name"), half_even(c("raw_conf"), 4).alias("raw_conf"),
        known("chosen_name").alias("chosen_name"), half_even(c("chosen_conf"), 4).alias("chosen_conf"), "final_name", "final_speaker", (~is_generic(c("final_name"))).alias("is_identified"), "audio_gender",
        F.size("candidates").alias("n_candidates"), F.size("filtered").alias("n_filtered"), F.when(F.size("filtered") >= 2, half_even(first["score"] - second["score"], 4)).alias("margin"), "asd_active", "n_faces",
        (F.size("fn_reasons") > 0).alias("is_fn"), F.transform("fn_reasons", lambda r: F.substring_index(r, ":", 1)).alias("fn_reasons"), "fp_risk", "fp_reasons", F.length(F.coalesce("text", F.lit(""))).alias("text_len"),
        half_even(c("duration_s"), 2).alias("segment_duration_s"), *(half_even(c(ms), 1).alias(ms) for ms in ("whisper_ms", "verifier_ms", "segment_ms")), half_even(c("avg_logprob"), 3).alias("avg_logprob"), half_even(c("avg_no_speech"), 3).alias("avg_no_speech"),
    )
    flat = F.to_json(fields, KEEP_NULLS)
    listed = F.array_join(F.transform(F.slice("candidates", 1, 5), _pair), ",")
    return decided.withColumn("record", F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), F.lit(',"candidates":['), listed, F.lit("]}")))


def session_payloads(segments: DataFrame, threshold: float = 0.80, least: float = 0.70, speakers: int | None = None, model: str = "small", extra: dict[str, Column] | None = None) -> DataFrame:
    """(session_pk, config, summary): both as JSON texts, for every session that has segments; ``extra`` adds to the configuration."""
    counts = segments.select("session_pk", F.coalesce(decision_type(F.col("decision")), F.lit("")).alias("type")).groupBy("session_pk", "type").agg(F.count("*").alias("n"))
    counted = counts.groupBy("session_pk").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("decision_counts"))  # a few types a session
    joined = session_summary(segments).join(counted, "session_pk", "left")
    names = [f for f in joined.columns if f != "session_pk"]
    config = F.struct(F.lit(threshold).alias("verifier_threshold"), F.lit(least).alias("verifier_confidence_min"), F.lit(speakers).cast("int").alias("num_speakers"), F.lit(model).alias("whisper_size"), F.lit(16000).alias("sample_rate"), *(v.alias(k) for k, v in (extra or {}).items()))
    return joined.select("session_pk", F.to_json(config, KEEP_NULLS).alias("config"), F.to_json(F.struct(*names), KEEP_NULLS).alias("summary"))


def face_payloads(metrics: DataFrame, key: str, mode: str, provider: str) -> DataFrame:
    """(key, payload): what a session of faces alone stores, its face metrics under ``face``."""
    face = F.struct(*(c for c in metrics.columns if c != key))
    return metrics.select(key, F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(provider).alias("audio_provider"), face.alias("face")), KEEP_NULLS).alias("payload"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def risk_lines(segments: DataFrame, order: list[str]) -> DataFrame:
    """(session_pk, order columns, line) of the report on doubtful names: a line for the decision and one for the voice."""
    s = segments.filter(F.col("fp_risk").isin("high", "medium"))
    head = F.concat(F.lit("risk="), F.upper("fp_risk"), F.lit("  decision="), _text("decision"), F.lit("  final="), _text("final_name"), F.lit("  speaker="), _text("final_speaker"))
    voice = F.concat(F.lit("  raw_best="), _text("raw_best_name"), F.lit(":"), F.format_string("%.3f", F.coalesce("raw_conf", F.lit(0.0))), F.lit("  gender="), _text("audio_gender"))
    return s.select("session_pk", *order, F.posexplode(F.array(head, voice)).alias("part", "line"))


def risk_heads(segments: DataFrame) -> DataFrame:
    """(session_pk, suspects, high, medium) of each session with doubtful names: the head of its report."""
    s = segments.filter(F.col("fp_risk").isin("high", "medium"))
    return s.groupBy("session_pk").agg(F.count("*").alias("suspects"), F.count_if(F.col("fp_risk") == "high").alias("high"), F.count_if(F.col("fp_risk") == "medium").alias("medium"))


def transcript_lines(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, order columns, line): the lines of transcript_text() as rows."""
    who = F.coalesce(F.nullif("name", F.lit("")), "speaker")
    mark = F.when(F.col("uncertain"), "[texto incerto] ").otherwise("")
    return entries.select(key, *order, F.concat(F.lit("["), "clock", F.lit("] "), who, F.lit(": "), mark, F.coalesce("text", F.lit(""))).alias("line"))
