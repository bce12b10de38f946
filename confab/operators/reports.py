"""Session summaries, error diagnostics and report texts over segment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.columns import decision_type, half_even, is_generic
from confab.functions.text import gender_of

AWARENESS = 0.45  # voice scores below this are no missed match
MARGIN = 0.04


def session_summary(segments: DataFrame) -> DataFrame:
    """One row of rates, means and medians for each session that has segments; confidences count above zero only."""
    sure = F.when(F.col("raw_conf") > 0, F.col("raw_conf"))
    share = lambda c: half_even(c / F.count("*"), 4)
    mean_ms = lambda c: half_even(F.sum(F.col(c).cast("decimal(18,4)")).cast("double") / F.count(c), 1)  # noqa: E731  (exact sums: the same mean in any order)
    high, medium = F.count_if(F.col("fp_risk") == "high"), F.count_if(F.col("fp_risk") == "medium")
    fn, named = F.count_if(F.col("is_fn") == 1), F.count_if(F.col("is_identified") == 1)
    return segments.groupBy("session_pk").agg(
        F.count("*").alias("total_segments"), fn.alias("total_fn"), named.alias("total_identified"), F.count_distinct("final_speaker").alias("unique_speakers"),
        share(fn).alias("fn_rate"), share(named).alias("identification_rate"), half_even(F.coalesce(F.avg(sure), F.lit(0.0)), 4).alias("avg_raw_conf"), half_even(F.coalesce(F.median(sure), F.lit(0.0)), 4).alias("median_raw_conf"),
        mean_ms("whisper_ms").alias("avg_whisper_ms"), mean_ms("verifier_ms").alias("avg_verifier_ms"), mean_ms("segment_ms").alias("avg_segment_ms"),
        high.alias("total_fp_high"), medium.alias("total_fp_medium"), share(high + medium).alias("fp_rate"),
    )


def decision_histogram(segments: DataFrame) -> DataFrame:
    """(session_pk, decision_counts): types with their counts, in the order in which they first come."""
    counts = segments.withColumn("type", decision_type(F.col("decision"))).filter("type is not null").groupBy("session_pk", "type").agg(F.count("*").alias("n"), F.min(F.struct("seg_index", "id")).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "type", "n")))  # a few types for each session
    return counts.groupBy("session_pk").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["type"], F.lit("="), x["n"].cast("string"))), ", ").alias("decision_counts"))


def score_statistics(scores: DataFrame, key: str, score: str, threshold: float, every: int, order: list[str]) -> DataFrame:
    """Statistics of every n-th match score of each key: count, mean, median, extremes, share and means by the threshold."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    sampled = scores.withColumn("n", n).filter(F.col("n") % every == 0)
    s, hit = F.col(score), F.col(score) >= threshold
    mean = lambda c: half_even(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return sampled.groupBy(key).agg(
        F.count("*").alias("n_samples"), mean(s).alias("mean"), half_even(F.median(s), 4).alias("median"), half_even(F.max(s), 4).alias("max"), half_even(F.min(s), 4).alias("min"),
        half_even(F.count_if(hit) / F.count("*"), 4).alias("pct_matched"), mean(F.when(hit, s)).alias("mean_matched"), mean(F.when(~hit, s)).alias("mean_unmatched"),
    )


def missed_reasons(decision: Column, name: Column, score: Column, kept: Column, offered: Column, gender: Column, threshold: float = 0.80, least: float = 0.70) -> Column:
    """Why a plausible voice was not used, without the figures; empty for voice decisions.

    ``kept`` and ``offered`` are arrays of (name, score): the candidates after and before the gender filter.
    """
    plausible = (name != "Unknown") & (score >= AWARENESS)
    kept_names = F.transform(kept, lambda c: c["name"])
    offered_names = F.transform(offered, lambda c: c["name"])
    first, second = F.get(kept, F.lit(0)), F.get(kept, F.lit(1))
    close = (F.size(kept) >= 2) & (first["score"] >= AWARENESS) & (first["score"] - second["score"] < MARGIN) & gender.isNull()
    reasons = F.array(
        F.when(plausible & (score < threshold), "BELOW_THRESHOLD").when(plausible & (score < least), "BELOW_CONF_MIN"),
        F.when(plausible & F.array_contains(offered_names, name) & ~F.array_contains(kept_names, name), "GENDER_FILTERED"),
        F.when(close, "MARGIN_REJECT"),
    )
    return F.when(F.startswith(decision, F.lit("VERIFIER")), F.array_compact(F.array(F.lit(None).cast("string")))).otherwise(F.array_compact(reasons))


def false_positive_risk(decision: Column, final_name: Column, score: Column, gender: Column, known: Column, identified: Column, expected: Column, threshold: float = 0.80) -> Column:
    """(risk, reasons) of a named decision: none, medium or high; ``known`` tells whether the voice has a profile."""
    named = final_name.isNotNull() & ~is_generic(final_name)
    kind, own = decision_type(decision), gender_of(final_name)
    weak = kind.isin("VERIFIER_WEAK", "FACE_ONLY", "SINGLE_FACE")
    unsure, mismatch, many = known & (score < threshold), gender.isNotNull() & own.isNotNull() & (own != gender), (expected > 0) & (identified > expected)
    yes = lambda c: F.coalesce(named & c, F.lit(False))
    risk = F.when(yes(unsure) | yes(mismatch), "high").when(yes(weak) | yes(many), "medium").otherwise("none")
    reasons = F.array_compact(F.array(F.when(yes(weak), "WEAK_DECISION"), F.when(yes(unsure), "UNCONFIRMED_KNOWN"), F.when(yes(mismatch), "GENDER_MISMATCH"), F.when(yes(many), "SPEAKER_OVERFLOW")))
    return F.struct(risk.alias("risk"), reasons.alias("reasons"))


def label(name: Column, speaker: Column) -> Column:
    """A real name in brackets, else the speaker id."""
    return F.concat(F.lit("("), F.when(~is_generic(name), name).otherwise(speaker), F.lit(")"))


def transcript_text(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, transcript): "[HH:mm:ss] who: text" lines; an empty name falls back to the speaker, doubtful text is marked.

    ``entries`` has clock, name, speaker, text and uncertain.
    """
    who = F.coalesce(F.nullif("name", F.lit("")), "speaker")
    mark = F.when(F.col("uncertain"), "[texto incerto] ").otherwise("")
    line = F.concat(F.lit("["), "clock", F.lit("] "), who, F.lit(": "), mark, F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))  # the lines of one session's document
    return entries.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def unnamed_speakers(segments: DataFrame, least_sec: float = 5.0) -> DataFrame:
    """Anonymous speakers with enough audio to be worth a name: (session_pk, speaker, seconds)."""
    return segments.filter(is_generic(F.col("final_name"))).groupBy("session_pk", F.col("final_speaker").alias("speaker")).agg((F.sum("segment_ms") / 1000).alias("seconds")).filter(F.col("seconds") >= least_sec)
