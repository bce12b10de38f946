"""Queries that answer for every row of their tables."""

from pyspark.sql import functions as F

from confab.functions.columns import clock_of
from confab.operators import naming
from confab.plans import naming as named_queries
from confab.plans import reports, signals


def test_clock_of_every_notation(spark):
    times = ["2024-03-05T09:08:07.250Z", "2024-03-05 09:08:07", "05/03/2024 09:08:07", "09:08:07", "9:08:07.5", "1709629687", "1709629687000", None, "soon"]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    assert [r[0] for r in df.select(clock_of(F.col("t"))).collect()] == ["09:08:07"] * 7 + ["--:--:--"] * 2


def test_transcript_has_every_segment(spark, data):
    rows = spark.read.parquet(f"{data}/segments.parquet")
    got = reports.transcript_full(spark, data).select(F.explode(F.split("transcript", r"\n(?=\[(?:\d\d:\d\d:\d\d|--:--:--)\] )")).alias("line"))
    assert got.count() == rows.count()
    assert got.filter("line like '[--:--:--]%'").count() == rows.filter("timestamp is null").count()


def test_signals_of_every_speaker(spark, data):
    n = spark.read.parquet(f"{data}/speakers.parquet").count()
    assert signals.pitch_gender(spark, data).count() == n and signals.loudness(spark, data).count() == n


def test_last_speaker_takes_the_number_from_the_session(spark, data):
    named = spark.createDataFrame([(1, "a", "Ana"), (1, "b", "spk_001"), (2, "a", "Ana"), (2, "b", "Bia"), (2, "c", "Caio"), (2, "d", None), (3, "a", "Person_1"), (3, "b", "Person_2"), (4, "a", "Ana")], "session_pk bigint, speaker string, name string")
    heard = spark.createDataFrame([(i, "Davi") for i in (1, 2, 3, 4)], "session_pk bigint, name string")
    assert sorted(tuple(r) for r in naming.last_speakers(named, heard).collect()) == [(1, "b", "Davi"), (2, "d", "Davi")]
    assert {r.speaker for r in named_queries.last_speaker_all(spark, data).collect()} <= {r[0] for r in spark.read.parquet(f"{data}/segments.parquet").select("final_speaker").distinct().collect()}
