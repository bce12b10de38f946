"""Repeated consecutive events of a sequence, collapsed to one event each.

Events become symbols of a string: within a block of an entity every canonical
label gets a Unicode code point, the block's events are concatenated in order,
and a regular expression with a back reference finds the repetitions; spans map
back to positions and times.  Blocks hold a bounded number of positions, so a
never-ending entity is spread over many tasks; runs that touch a block's border
are then put together by windows over the blocks' border runs only.

Defined cases
  * rows repeated under one (entity, position) count once, the smallest id;
  * missing positions do not end a run; a null label is in no run and ends one;
  * events without a readable time have a null duration; empty input, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.columns import event_time
from confab.llm.labels import canonical_labels, label_keys

BLOCK = 4096  # positions of one block; bounds the rows of one group and the alphabet of one string
FIRST_SYMBOL = 0x3400  # code points from here on stand for labels; all of them are single UTF-16 units
BREAK = "-"  # stands for a null label, which no run may hold
DAY = 86400


def elapsed(began: Column, ended: Column) -> Column:
    """Seconds between two event times; where a date is missing, the times of day count, over midnight too."""
    dated = (began >= DAY) & (ended >= DAY)
    return F.when(dated, ended - began).otherwise(F.pmod(F.pmod(ended, F.lit(DAY)) - F.pmod(began, F.lit(DAY)), F.lit(DAY)))


def distinct_events(rows: DataFrame, entity: str, position: str, label: str, time: str | None = None) -> DataFrame:
    """(entity, position, label, time) once for each position; partial aggregation runs before the shuffle."""
    kept = F.struct(F.col("id"), F.col(label).alias("label"), (event_time(F.col(time)) if time else F.lit(None).cast("double")).alias("at"))
    once = rows.filter(F.col(entity).isNotNull() & F.col(position).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(position).alias("position")).agg(F.min(kept).alias("e"))
    return once.select("entity", "position", "e.label", "e.at")


def canonical_events(rows: DataFrame, entity: str, position: str, label: str, time: str | None = None) -> DataFrame:
    """Distinct events with the canonical label of their speaker."""
    events = distinct_events(rows, entity, position, label, time).withColumn("key", label_keys(F.col("label")))
    labels = canonical_labels(events, "entity", "label")
    return events.join(labels, ["entity", "key"], "left").select("entity", "position", "at", F.col("canonical").alias("label"))


def _symbol(rank: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(rank + FIRST_SYMBOL), 4, "0")), "UTF-16BE")


def block_runs(events: DataFrame) -> DataFrame:
    """Maximal runs within each block: entity, block, label, n, first, last and the border flags."""
    blocks = events.withColumn("block", F.floor(F.col("position") / BLOCK)).groupBy("entity", "block").agg(F.sort_array(F.collect_list(F.struct("position", "at", "label"))).alias("events"))
    alphabet = blocks.withColumn("alphabet", F.array_sort(F.array_distinct(F.array_compact(F.transform("events", lambda e: e["label"])))))
    numbers = F.map_from_arrays(F.col("alphabet"), F.when(F.size("alphabet") > 0, F.sequence(F.lit(1), F.size("alphabet"))).otherwise(F.expr("cast(array() as array<int>)")))
    coded = alphabet.withColumn("numbers", numbers)
    text = F.array_join(F.transform("events", lambda e: F.when(e["label"].isNull(), F.lit(BREAK)).otherwise(_symbol(F.element_at(F.col("numbers"), e["label"])))), "")
    spans = coded.withColumn("runs", F.regexp_extract_all(text, F.lit(r"([^-])\1*+|-"), F.lit(0)))
    # positions of the spans: running sum of their lengths
    ends = F.aggregate("runs", F.expr("cast(array() as array<int>)"), lambda acc, r: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(r)))
    placed = spans.withColumn("ends", F.when(F.size("runs") > 0, ends).otherwise(F.expr("cast(array() as array<int>)")))
    rows = placed.select("entity", "block", F.size("events").alias("size"), "events", F.inline(F.arrays_zip("runs", "ends")))
    start = F.col("ends") - F.length("runs")
    first, last = F.element_at("events", start + 1), F.element_at("events", F.col("ends"))
    return rows.select(
        "entity", "block", first["label"].alias("label"), F.length("runs").alias("n"), first["position"].alias("first"), last["position"].alias("last"), first["at"].alias("began"), last["at"].alias("ended"),
        (start == 0).alias("opens"), (F.col("ends") == F.col("size")).alias("closes"),
    )


def collapse(events: DataFrame) -> DataFrame:
    """One row for each maximal run of one label, runs of a single event included.

    Columns entity, label, n, first, last, duration (seconds from the first to
    the last event of the run, null where one of these times is unknown).
    """
    runs = block_runs(events)
    inner = runs.filter(~F.col("opens") & ~F.col("closes") & F.col("label").isNotNull())
    border = runs.filter(F.col("opens") | F.col("closes"))
    order = Window.partitionBy("entity").orderBy("block", "first")
    # a border run goes on from the previous one if that closes its block, this one opens the next, and the labels agree
    goes_on = F.col("opens") & F.lag("closes").over(order) & (F.lag("label").over(order) == F.col("label"))
    chained = border.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("new").over(order))
    merged = (
        chained.filter("label is not null").groupBy("entity", "chain")
        .agg(F.min("label").alias("label"), F.sum("n").cast("int").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("began", "first").alias("began"), F.max_by("ended", "last").alias("ended"))
    )
    columns = ["entity", "label", "n", "first", "last", "began", "ended"]
    return inner.select(columns).unionByName(merged.select(columns)).withColumn("duration", F.round(elapsed(F.col("began"), F.col("ended")), 3)).drop("began", "ended")


def speaker_runs(segments: DataFrame) -> DataFrame:
    """Runs of two or more segments of one session by one speaker."""
    return collapse(canonical_events(segments, "session_pk", "seg_index", "speaker_name", "timestamp")).filter("n >= 2")
