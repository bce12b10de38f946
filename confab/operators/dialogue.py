"""Order-dependent rules of one session's transcript, as folds over its rows in order.

Each fold's core is a plain class that takes one row at a time; the batch form
feeds it the sorted rows of a session, the streaming form the rows as they come.
"""

from __future__ import annotations

import re
from collections import OrderedDict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.text import alike

Row = dict


class RepeatFilter:
    """Drops a line that is near one of the last six kept lines of the last five seconds."""

    def __init__(self, seconds: float = 5.0, likeness: float = 0.80, lines: int = 6):
        self.seconds, self.likeness = seconds, likeness
        self.kept: deque = deque(maxlen=lines)

    def keep(self, at: float, text: str) -> bool:
        bare = re.sub(r"[^\w\s]", "", text.lower()).strip()
        if any(at - t <= self.seconds and alike(bare, other, self.likeness) for t, other in reversed(self.kept)):
            return False
        self.kept.append((at, bare))
        return True


class VoteBox:
    """Names a speaker by how others address whoever speaks next: two votes each, a name at three."""

    def __init__(self, window: float = 30.0, needed: int = 3, weight: int = 2):
        self.window, self.needed, self.weight = window, needed, weight
        self.votes: dict[str, OrderedDict[str, int]] = {}
        self.names: dict[str, str] = {}
        self.owners: dict[str, str] = {}
        self.pending: tuple[str, str, float] | None = None

    def take(self, at: float, speaker: str, addressee: str | None) -> str | None:
        """The speaker's name after this row; the addressee named in it counts for the rows to come."""
        if speaker not in self.names and self.pending is not None:
            name, caller, since = self.pending
            free = self.owners.get(name, speaker) == speaker
            if caller != speaker and at - since < self.window and free:
                box = self.votes.setdefault(speaker, OrderedDict())
                box[name] = box.get(name, 0) + self.weight
        box = self.votes.get(speaker)
        if box and speaker not in self.names:
            best = max(box, key=box.get)  # equal votes: the first one given
            if box[best] >= self.needed and self.owners.get(best, speaker) == speaker:
                self.names[speaker], self.owners[best] = best, speaker
                del self.votes[speaker]
        if self.pending is not None and at - self.pending[2] > self.window:
            self.pending = None
        if addressee:
            self.pending = (addressee, speaker, at)
        return self.names.get(speaker)


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, Row], Row | None], schema: str, forgets: tuple[str, float] | None = None) -> DataFrame:
    """Runs a fold over each key's rows in order.

    ``forgets`` (time column, seconds) tells that a fold's state counts for
    nothing once a row comes more than so long after all before it.  Keys are
    then cut at such pauses, and a task holds a stretch without one; otherwise
    it holds a key, bounded by what one meeting says.
    """
    parts = [key]
    if forgets is not None:
        at, pause = forgets
        before = F.max(at).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(F.col(at) - before <= pause, 0).otherwise(1)
        rows = rows.withColumn("_fresh", fresh).withColumn("_stretch", F.sum("_fresh").over(Window.partitionBy(key).orderBy(*order))).drop("_fresh")
        parts = [key, "_stretch"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state, out = start(), []
        for row in part.sort_values(order, kind="stable").to_dict("records"):
            made = step(state, row)
            if made is not None:
                out.append(made)
        columns = [c.strip().split()[0].strip("`") for c in schema.split(",")]
        return pd.DataFrame(out, columns=columns)

    return rows.groupBy(*parts).applyInPandas(run, schema)


def drop_repeats(entries: DataFrame) -> DataFrame:
    """Entries (session_pk, seg_index, id, text, at) without near repeats of what was just kept."""
    step = lambda state, r: r if state.keep(r["at"], r["text"]) else None
    return fold(entries, "session_pk", ["seg_index", "id"], RepeatFilter, step, "session_pk bigint, seg_index bigint, id bigint, text string, at double", forgets=("at", RepeatFilter().seconds))


def context_votes(rows: DataFrame) -> DataFrame:
    """(session_pk, id, speaker, name) of rows (session_pk, seg_index, id, speaker, addressee, at) once a speaker has a name."""

    def step(state: VoteBox, r: Row) -> Row | None:
        called = r["addressee"] if isinstance(r["addressee"], str) else None
        name = state.take(r["at"], r["speaker"], called)
        return None if name is None else {"session_pk": r["session_pk"], "id": r["id"], "speaker": r["speaker"], "name": name}

    return fold(rows, "session_pk", ["seg_index", "id"], VoteBox, step, "session_pk bigint, id bigint, speaker string, name string")
