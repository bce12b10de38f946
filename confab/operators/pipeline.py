"""The segment pipeline: from a recognised text and its evidence to a named entry with diagnostics, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions.text import rejection
from confab.operators import decide, records, reports


def accepted(segments: DataFrame) -> DataFrame:
    """Segments whose text is speech (needs text, avg_logprob, avg_no_speech)."""
    return segments.filter(rejection(F.col("text"), F.col("avg_logprob"), F.col("avg_no_speech")).isNull())


def attributed(segments: DataFrame, threshold: float = 0.80, least: float = 0.70) -> DataFrame:
    """Accepted segments with final_decision, final_name, label, missed (reasons), risk, risk_reasons and their metrics record.

    Beside the evidence of ``decide`` it needs id, timestamp, text, avg_logprob,
    avg_no_speech, candidates (array of name and score, the best first),
    final_speaker, known, identified, expected_speakers, activity, faces,
    duration_s, whisper_ms, verifier_ms and segment_ms.  Every step is an
    expression over the row: nothing is shuffled.
    """
    c = F.col
    kept = accepted(segments).withColumn("filtered", records.gender_kept(c("candidates"), c("gender")))
    decided = decide.gender_passes(decide.cascade(kept, threshold, least))
    raw = F.coalesce("raw_name", F.lit("Unknown"))
    decided = decided.withColumn("label", reports.label(c("final_name"), F.coalesce("final_speaker", F.lit("?"))))
    decided = decided.withColumn("missed", reports.missed_reasons(c("final_decision"), raw, c("raw_conf"), c("filtered"), c("candidates"), c("gender"), threshold, least))
    risk = reports.false_positive_risk(c("final_decision"), c("final_name"), c("raw_conf"), c("gender"), c("known"), c("identified"), c("expected_speakers"), threshold)
    decided = decided.withColumn("_risk", risk).withColumn("risk", c("_risk.risk")).withColumn("risk_reasons", c("_risk.reasons")).drop("_risk")
    names = {
        "decision": c("final_decision"), "raw_best_name": raw, "chosen_name": F.coalesce("chosen", F.lit("Unknown")), "chosen_conf": c("chosen_conf"), "audio_gender": c("gender"), "asd_active": c("active_person").isNotNull(),
        "n_faces": c("faces"), "fn_reasons": c("missed"), "fp_risk": c("risk"), "fp_reasons": c("risk_reasons"),
    }
    own = ["timestamp", "raw_conf", "final_name", "final_speaker", "candidates", "filtered", "text", "duration_s", "whisper_ms", "verifier_ms", "segment_ms", "avg_logprob", "avg_no_speech"]
    kept_columns = ["id", "final_decision", "label", "missed", "risk", "risk_reasons"]
    return records.metrics_record(decided.select(*kept_columns, *own, *(v.alias(k) for k, v in names.items()))).select(*kept_columns, "final_name", "record")
