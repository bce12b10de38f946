"""Structured Streaming twins of the batch operators; fed the same rows they give the same results."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.operators.dialogue import RepeatFilter
from confab.operators.vectors import SpeakerTracker, _unit

IDLE_MS = 12 * 3600 * 1000  # a session lasts less than twelve hours
LATE = "40 seconds"  # how long the recorder keeps sound: later rows are dropped


def zone_counts(events: DataFrame, at: str, key: str, seconds: int = 4) -> DataFrame:
    """(key, zone, n): rows of each new zone of low-latency windows, given out when the watermark has passed it."""
    return events.withWatermark(at, LATE).groupBy(key, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("zone"), "n")


def sliding_means(events: DataFrame, at: str, key: str, value: str, seconds: int = 15, step: int = 5) -> DataFrame:
    """(key, start, mean, n) of the steady windows that overlap by all but their step."""
    w = events.withWatermark(at, LATE).groupBy(key, F.window(at, f"{seconds} seconds", f"{step} seconds").alias("w"))
    return w.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "mean", "n")


def once(rows: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """Rows whose keys were not seen within the watermark: overlapping windows deliver the same frames again."""
    return rows.withWatermark(at, LATE).dropDuplicatesWithinWatermark(keys)


def stateful(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict | None], schema: str, idle: int | None = None) -> DataFrame:
    """A fold of ``confab.operators.dialogue`` over a stream: its state is kept between micro-batches, by key.

    The state of a key that brings no row for ``idle`` milliseconds goes, so
    closed sessions don't stay for ever (IDLE_MS suits sessions); one that opens
    again starts anew.  A query with such a timeout runs until it is stopped, so
    it is not for the trigger that ends with the data at hand.
    """
    columns = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(which: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fold = pickle.loads(state.get[0]) if state.exists else start()
        out = []
        for row in pd.concat(list(parts)).sort_values(order, kind="stable").to_dict("records"):
            made = step(fold, row)
            if made is not None:
                out.append({c: made[c] for c in columns})
        state.update((pickle.dumps(fold),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=columns)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "fold binary", "append", "NoTimeout" if idle is None else "ProcessingTimeTimeout")


def drop_repeats(entries: DataFrame, idle: int | None = None) -> DataFrame:
    """Twin of ``dialogue.drop_repeats``."""
    step = lambda fold, r: r if fold.keep(r["at"], r["text"]) else None
    return stateful(entries, "session_pk", ["seg_index", "id"], RepeatFilter, step, "session_pk bigint, seg_index bigint, id bigint, text string, at double", idle)


def track_speakers(rows: DataFrame, most: int | None = None, idle: int | None = None) -> DataFrame:
    """Twin of ``vectors.track_speakers`` over (session, ord, embedding)."""
    import numpy as np

    def step(fold: SpeakerTracker, r: dict) -> dict:
        return {"session": r["session"], "ord": r["ord"], "speaker": fold.take(_unit(np.asarray(r["embedding"], np.float64)))}

    return stateful(rows, "session", ["ord"], lambda: SpeakerTracker(most), step, "session bigint, ord bigint, speaker string", idle)
