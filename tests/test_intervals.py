import datetime

import pytest
from pyspark.sql import functions as F

from confab.operators import intervals as I


def frames(spark, on, length, slot=0):
    return spark.createDataFrame([(1, slot, i, i in on) for i in range(length)], "k int, s int, f int, a boolean")


def test_turns_fill_gaps_and_drop_short_runs(spark):
    sec = 0.1
    two = frames(spark, {*range(0, 10), *range(13, 25)}, 40)  # a pause of 0.3 s
    assert len(I.activity_turns(two, "k", "f", "a", sec).collect()) == 1
    apart = frames(spark, {*range(0, 10), *range(18, 30)}, 40)  # a pause of 0.8 s
    assert len(I.activity_turns(apart, "k", "f", "a", sec).collect()) == 2
    assert I.activity_turns(frames(spark, {*range(3)}, 40), "k", "f", "a", sec).count() == 0
    assert I.activity_turns(frames(spark, set(), 4), "k", "f", "a", sec).count() == 0


def test_binarized_turn_ends_at_the_next_midpoint(spark):
    row = I.binarized_turns(frames(spark, {1, 2}, 5, 3), "k", "f", "s", "a", 1.0).first()
    assert (row.slot, row.start_sec, row.end_sec) == (0, 1.5, 3.5)


@pytest.mark.parametrize(("seconds", "frame"), [(0.0, 0), (1.0, 58), (10.0, 588)])
def test_closest_frame(spark, seconds, frame):
    assert spark.range(1).select(I.closest_frame(F.lit(seconds))).first()[0] == frame


def test_chunk_windows(spark):
    rows = {t: [tuple(r)[1:] for r in I.chunk_windows(spark.createDataFrame([(1, float(t))], "k int, total_sec double"), "k").orderBy("window").collect()] for t in (7, 8, 23, 28, 33)}
    kinds = {t: [(s, e, n) for _, s, e, n in r] for t, r in rows.items()}
    assert kinds[7] == [] and kinds[8] == [(0, 8, 0)] and kinds[23] == [(0, 8, 0), (8, 23, 8)]
    assert kinds[28][-1] == (13, 28, 23) and kinds[33][-1][0] == 18


def test_low_latency_windows(spark):
    got = I.low_latency_windows(spark.createDataFrame([(1, 12.5)], "k int, total_sec double"), "k").orderBy("window").collect()
    assert [tuple(r)[2:] for r in got] == [(0, 4, 0), (0, 8, 4), (4, 12, 8)]


def test_asof_is_strict_and_crosses_buckets(spark):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    right = spark.createDataFrame([(1, at(1, 1), 1.0), (1, at(3, 5), 3.0), (2, at(1, 1), 9.0)], "k int, ts timestamp, v double")
    left = spark.createDataFrame([(1, at(1, 1)), (1, at(1, 2)), (1, at(3, 5)), (1, at(9, 9)), (3, at(1, 1))], "k int, ts timestamp")
    got = I.asof_previous(left, right, "k", "ts", "v", F.date_trunc("DAY", F.col("ts"))).orderBy("k", "ts").collect()
    assert [r.previous for r in got] == [None, 1.0, 1.0, 3.0, None]


@pytest.mark.parametrize(("scores", "least", "margin", "who"), [({0: 0.9, 1: 0.1}, 0.5, 0.15, 0), ({0: 0.80, 1: 0.75}, 0.5, 0.15, None), ({0: 0.40}, 0.5, 0.15, None), ({0: 0.40}, 0.3, 0.15, 0)])
def test_dominant(spark, scores, least, margin, who):
    df = spark.createDataFrame([(1, t, s) for t, s in scores.items()], "span_id int, track int, score double")
    got = I.dominant(df, "span_id", least, margin=margin).collect()
    assert [r.track for r in got] == ([] if who is None else [who])


def test_padding(spark):
    df = spark.createDataFrame([(4.0, 5.8, 5.0, 15.0), (8.0, 8.8, 5.0, 15.0), (1.0, 4.0, 5.0, 15.0)], "start double, end double, zone double, total double")
    got = sorted((r.start, round(r.heard_from, 6), round(r.heard_to, 6)) for r in I.pad_segments(df).collect())
    assert got == [(5.0, 5.0, 7.0), (8.0, 7.4, 9.4)]
