"""A session's files: transcript, reports and metrics of many sessions, written in one pass each.

Every kind has a folder with one part for each session (``session_pk=…``) whose
lines are in order; writing again replaces the sessions that are written and
leaves the others, so a repeated or retried save changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, folder: str, order: list[str]) -> None:
    """Writes (session_pk, order columns, line) as text, in order within each session; long sessions are cut into files by range."""
    placed = lines.repartitionByRange("session_pk", *order).sortWithinPartitions("session_pk", *order)
    text = F.regexp_replace(F.col("line"), r"\r?\n", " ").alias("value")
    placed.select("session_pk", text).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_pk").text(folder)


def save_sessions(folder: str, transcript: DataFrame, missed: DataFrame, doubtful: DataFrame, metrics: DataFrame, order: list[str]) -> None:
    """Saves transcripts, the reports of missed voices and doubtful names (session_pk, order columns, line) and the metrics records (session_pk, order columns, record)."""
    for name, lines in (("transcript", transcript), ("fn_report", missed), ("fp_report", doubtful), ("metrics", metrics.withColumnRenamed("record", "line"))):
        write_lines(lines, f"{folder}/{name}", order)
