"""Interval, run and as-of operators over timestamped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAST_FRAME_SEC = 270 / 16000  # one frame of the fast segmentation
FULL_FRAME_SEC = 10 / 589  # one frame of the full segmentation


def activity_turns(frames: DataFrame, key: str, frame: str, active: str, frame_sec: float = FAST_FRAME_SEC, gap_sec: float = 0.5, least_sec: float = 0.5) -> DataFrame:
    """(key, start_sec, end_sec): runs of active frames; runs closer than ``gap_sec`` are one, short ones go."""
    on = frames.filter(F.col(active)).select(key, F.col(frame).alias("f"))
    order = Window.partitionBy(key).orderBy("f")
    # runs of adjacent frames: the frame number minus its rank among the active frames stays the same
    islands = on.withColumn("island", F.col("f") - F.row_number().over(order)).groupBy(key, "island").agg(F.min("f").alias("a"), F.max("f").alias("b"))
    spans = islands.select(key, (F.col("a") * frame_sec).alias("start_sec"), ((F.col("b") + 1) * frame_sec).alias("end_sec"))
    return merge_spans(spans, key, gap_sec, closed=False).filter(F.col("end_sec") - F.col("start_sec") >= least_sec)


def merge_spans(spans: DataFrame, key: str, gap_sec: float, closed: bool) -> DataFrame:
    """Spans of one key that are closer than the gap, or as close (``closed``), put together."""
    order = Window.partitionBy(key).orderBy("start_sec", "end_sec")
    reach = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pause = F.col("start_sec") - reach
    apart = pause > gap_sec if closed else pause >= gap_sec
    grouped = spans.withColumn("new", F.when(reach.isNull() | apart, 1).otherwise(0)).withColumn("group", F.sum("new").over(order))
    return grouped.groupBy(key, "group").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).drop("group")


def binarized_turns(frames: DataFrame, key: str, frame: str, slot: str, active: str, frame_sec: float = FULL_FRAME_SEC, collar_sec: float = 0.0) -> DataFrame:
    """(key, slot, start_sec, end_sec) between frame midpoints; slots are numbered anew among those present.

    A run ends at the midpoint of the first inactive frame after it, or of the
    last frame of all; runs of no length go.
    """
    by = Window.partitionBy(key, slot).orderBy(frame)
    marked = frames.withColumn("change", F.when(F.lag(active).over(by) == F.col(active), 0).otherwise(1)).withColumn("run", F.sum("change").over(by))
    last = F.max(frame).over(Window.partitionBy(key, slot))
    runs = marked.withColumn("last", last).filter(F.col(active)).groupBy(key, slot, "run").agg(F.min(frame).alias("a"), F.max(frame).alias("b"), F.first("last").alias("last"))
    middle = lambda c: c * frame_sec + frame_sec / 2
    spans = runs.select(key, slot, middle(F.col("a")).alias("start_sec"), middle(F.least(F.col("b") + 1, F.col("last"))).alias("end_sec"))
    if collar_sec > 0:
        spans = merge_spans(spans.withColumn("k", F.struct(key, slot)), "k", collar_sec, closed=True).select("k.*", "start_sec", "end_sec")
    kept = spans.filter(F.col("end_sec") - F.col("start_sec") > 1e-6)
    return kept.withColumn("slot", (F.dense_rank().over(Window.partitionBy(key).orderBy(slot)) - 1).cast("int")).select(key, "slot", "start_sec", "end_sec")


def closest_frame(seconds: Column, frame_sec: float = FULL_FRAME_SEC) -> Column:
    return F.rint((seconds - frame_sec / 2) / frame_sec).cast("int")


def overlap_count(activity: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, frame, count): mean activity of each absolute frame over the windows that hold it, to the nearest even."""
    return activity.groupBy(key, frame).agg(F.rint(F.sum("activity") / F.countDistinct("chunk")).cast("int").alias("count"))


def cluster_activations(activity: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, frame, cluster, activation): the most active local speaker of a cluster in each window, summed over windows."""
    best = activity.groupBy(key, "chunk", frame, "cluster").agg(F.max("activity").alias("best"))
    return best.groupBy(key, frame, "cluster").agg(F.sum("best").alias("activation"))


def top_active(activations: DataFrame, counts: DataFrame, key: str, frame: str) -> DataFrame:
    """The ``count`` most active clusters of each frame; equal activations keep the lower cluster."""
    rank = F.row_number().over(Window.partitionBy(key, frame).orderBy(F.desc("activation"), "cluster"))
    return activations.withColumn("rank", rank).join(counts, [key, frame]).filter(F.col("rank") <= F.col("count")).select(key, frame, "cluster", "rank")


def interval_means(spans: DataFrame, samples: DataFrame, pad: float, bucket: float, least: int, within: str | None = None) -> DataFrame:
    """(span_id, track, samples, score): mean sample of each track in each span widened by ``pad``, both ends included.

    ``spans`` has span_id, start, end; ``samples`` track, at, value, all in
    seconds.  Both sides meet in time buckets (an equi-join), so no span is
    compared with the samples of another time.  Where both have a column
    ``within``, such as their session, only samples of the span's own are met.
    """
    low, high = F.col("start") - pad, F.col("end") + pad
    own = [within] if within else []
    cells = spans.select("span_id", *own, low.alias("low"), high.alias("high")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))
    placed = samples.withColumn("cell", F.floor(F.col("at") / bucket))
    met = cells.join(placed, [*own, "cell"]).filter(F.col("at").between(F.col("low"), F.col("high")))
    return met.groupBy("span_id", "track").agg(F.count("*").alias("samples"), F.avg("value").alias("score")).filter(F.col("samples") >= least)


def dominant(scores: DataFrame, key: str, least: float, margin: float | None = None, ratio: float | None = None) -> DataFrame:
    """(key, track) of the clearly highest score: at least ``least``, ahead of the second by a margin or a ratio."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "track")
    first = scores.withColumn("n", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).filter(F.col("n") == 1)
    clear = F.col("second").isNull()
    if margin is not None:
        clear = clear | (F.col("score") - F.col("second") >= margin)
    if ratio is not None:
        clear = clear | (F.col("second") < least) | (F.col("score") / F.col("second") >= ratio)
    return first.filter((F.col("score") >= least) & clear).select(key, "track", "score")


def asof_previous(left: DataFrame, right: DataFrame, key: str, at: str, value: str, bucket: Column) -> DataFrame:
    """Left rows with the nearest earlier right value of their key (strictly before), null where there is none.

    No range join: both sides are sorted together inside (key, bucket), and the
    last value of each bucket is carried to the next ones, so a key that holds a
    third of the rows is spread over its buckets.  ``bucket`` is an expression
    of the time column that grows with it.
    """
    l = left.withColumn("side", F.lit(1)).withColumn("carried", F.lit(None).cast(right.schema[value].dataType))  # noqa: E741
    r = right.select(key, at, F.lit(0).alias("side"), F.col(value).alias("carried"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("bucket", bucket)
    # equal times: left rows sort before right ones, so only earlier rights are seen
    inside = Window.partitionBy(key, "bucket").orderBy(at, F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("here", F.last("carried", ignorenulls=True).over(inside))
    ends = r.withColumn("bucket", bucket).groupBy(key, "bucket").agg(F.max_by("carried", at).alias("end"))
    steps = left.select(key, at).withColumn("bucket", bucket).select(key, "bucket").unionByName(ends.select(key, "bucket")).distinct().join(ends, [key, "bucket"], "left")
    before = steps.withColumn("before", F.last("end", ignorenulls=True).over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select(key, "bucket", "before")
    return seen.filter("side = 1").join(before, [key, "bucket"], "left").withColumn("previous", F.coalesce("here", "before")).drop("side", "carried", "bucket", "here", "before")


def chunk_windows(streams: DataFrame, key: str) -> DataFrame:
    """(key, window, start_sec, end_sec, new_from_sec) of all windows that a stream of ``total_sec`` covers.

    The first window has 8 seconds, the second 15; later ones step 5 seconds and
    are new in their last 5 only.
    """
    k = F.explode(F.when(F.col("total_sec") < 8, F.expr("cast(array() as array<bigint>)")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("total_sec") - 13) / 5), F.lit(0)).cast("bigint"))))
    w = streams.filter("total_sec >= 8").select(key, "total_sec", k.alias("window"))
    n = F.col("window")
    start = F.when(n == 0, 0.0).otherwise(8.0 + 5.0 * (n - 1))
    end = F.when(n == 0, 8.0).otherwise(start + 15.0)
    new = F.when(n <= 1, start).otherwise(start + 10.0)
    return w.select(key, "window", start.alias("start_sec"), end.alias("end_sec"), new.alias("new_from_sec"), "total_sec").filter("end_sec <= total_sec").drop("total_sec")


def low_latency_windows(streams: DataFrame, key: str) -> DataFrame:
    """The same for windows of 4 new seconds after up to 4 seconds of context."""
    w = streams.filter("total_sec >= 4").select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("total_sec") / 4).cast("bigint") - 1)).alias("window"))
    new = F.col("window") * 4.0
    return w.select(key, "window", F.greatest(F.lit(0.0), new - 4.0).alias("start_sec"), (new + 4.0).alias("end_sec"), new.alias("new_from_sec"))


def pad_segments(groups: DataFrame, least_sec: float = 2.0, keep_sec: float = 0.5) -> DataFrame:
    """Segments (start, end, zone, total in seconds) clipped to the new zone; short ones get context on both sides.

    Before goes up to half of what is missing, no further than the zone; after goes the rest.
    """
    clipped = groups.withColumn("start", F.greatest("start", "zone")).withColumn("end", F.least("end", "total")).filter(F.col("end") - F.col("start") >= keep_sec)
    missing = F.greatest(F.lit(0.0), least_sec - (F.col("end") - F.col("start")))
    before = F.greatest(F.lit(0.0), F.least(F.col("start") - F.col("zone"), missing / 2))
    padded = clipped.withColumn("before", before)
    after = F.greatest(F.lit(0.0), F.least(F.col("total") - F.col("end"), missing - F.col("before")))
    return padded.withColumn("after", after).withColumn("heard_from", F.col("start") - F.col("before")).withColumn("heard_to", F.col("end") + F.col("after"))


def slice_bounds(start: Column, stop: Column, n: Column) -> Column:
    """(from, to) of a slice on an axis of length n: negative bounds count from the end, both clamp; null if empty."""
    clamp = lambda x: F.when(x < 0, F.greatest(x + n, F.lit(0))).otherwise(F.least(x, n))
    return F.when(clamp(stop) > clamp(start), F.struct(clamp(start).alias("from"), clamp(stop).alias("to")))
