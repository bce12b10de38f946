"""Names of a session's speakers: deduction, answers of a model, faces and their hysteresis, merged turns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions.codes import answered_names
from confab.functions.columns import is_generic
from confab.operators.dialogue import fold


def last_speakers(named: DataFrame, mentioned: DataFrame, expected: int | None = None) -> DataFrame:
    """(session_pk, speaker, name): where all speakers but one are named and one mentioned name is free, it is theirs.

    ``named`` has session_pk, speaker, name (a generic name for those unknown);
    ``mentioned`` session_pk, name.  Where no number is ``expected``, each session's own number of speakers is.
    """
    own = named.select("session_pk", "speaker", "name").distinct()
    counts = own.groupBy("session_pk").agg(F.count_distinct(F.when(~is_generic(F.col("name")), F.col("speaker"))).alias("known"), F.count_distinct(F.when(is_generic(F.col("name")), F.col("speaker"))).alias("unknown"), F.min(F.when(is_generic(F.col("name")), F.col("speaker"))).alias("speaker"), F.count_distinct("speaker").alias("speakers"))
    number = F.col("speakers") if expected is None else F.lit(expected)
    free = mentioned.select("session_pk", "name").distinct().join(own.select("session_pk", "name"), ["session_pk", "name"], "left_anti").groupBy("session_pk").agg(F.count("*").alias("free"), F.min("name").alias("name"))
    return counts.filter((F.col("known") == number - 1) & (F.col("unknown") == 1)).join(free.filter("free = 1"), "session_pk").select("session_pk", "speaker", "name")


def answered(answers: DataFrame, named: DataFrame) -> DataFrame:
    """(session_pk, speaker, name) from answers (session_pk, answer): never over a real name, never a name that is taken."""
    rows = answers.select("session_pk", F.explode(answered_names(F.col("answer"))).alias("speaker", "name")).withColumn("name", F.initcap("name"))
    real = named.filter(~is_generic(F.col("name")))
    unnamed = rows.join(real.select("session_pk", "speaker"), ["session_pk", "speaker"], "left_anti")
    return unnamed.join(real.select("session_pk", "name"), ["session_pk", "name"], "left_anti").select("session_pk", "speaker", "name")


@dataclass
class Speaking:
    """On after a high score has lasted, off after a low one has: live state of one face."""

    on: float = 0.55
    on_for: float = 0.25
    off: float = 0.35
    off_for: float = 0.5
    speaking: bool = False
    since: float | None = None

    def take(self, at: float, score: float) -> bool:
        turning = score < self.off if self.speaking else score >= self.on
        if not turning:
            self.since = at
            return self.speaking
        self.since = at if self.since is None else self.since
        if at - self.since >= (self.off_for if self.speaking else self.on_for):
            self.speaking, self.since = not self.speaking, at
        return self.speaking


@dataclass
class FaceNames:
    """Persons of face tracks: a known name leads to its person, a real name replaces a placeholder, others get new ids."""

    persons: dict[int, str] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    owners: dict[str, str] = field(default_factory=dict)
    used: dict[str, int] = field(default_factory=dict)
    frame: float | None = None

    def take(self, frame: float, track: int, name: str) -> str:
        if frame != self.frame:
            self.frame, self.used = frame, {}
        real = name != "Unknown" and not _placeholder(name)
        person = self.persons.get(track)
        if name in self.owners:
            person = self.owners[name]
        elif person is None:
            person = f"spk_{len(set(self.persons.values()) | set(self.names)):03d}"
            self.names[person] = name
            if real:
                self.owners[name] = person
        else:
            shown = self.names.get(person, "")
            if real and (_placeholder(shown) or shown in ("", "Unknown")) and name not in self.used:
                self.names[person] = name
                self.owners[name] = person
            elif _placeholder(name) and shown in ("", "Unknown") and name not in self.names.values():
                self.names[person] = name
        self.persons[track] = person
        shown = self.names.get(person, name)
        if shown != "Unknown" and not _placeholder(shown):
            self.used[shown] = track
        return person


def _placeholder(name: str) -> bool:
    head, _, tail = name.rpartition("_")
    return head in ("Person", "spk", "Desconhecido") and tail.isdigit()


class TurnMerger:
    """Turns of one slot go on while the voice stays like that of the group's first turn; no voice counts as the same."""

    def __init__(self, same: float = 0.40):
        self.same, self.slot, self.head, self.group = same, None, None, -1

    def take(self, slot: int, voice: np.ndarray | None) -> int:
        like = self.head is None or voice is None or float(voice @ self.head) >= self.same
        if self.group < 0 or slot != self.slot or not like:
            self.slot, self.head, self.group = slot, voice, self.group + 1
        return self.group


def speaking_states(scores: DataFrame) -> DataFrame:
    """(track, at, speaking) of scores (track, at, score) in order of time."""
    step = lambda s, r: {"track": r["track"], "at": r["at"], "speaking": s.take(r["at"], r["score"])}
    return fold(scores, "track", ["at"], Speaking, step, "track bigint, at double, speaking boolean")


def face_persons(faces: DataFrame) -> DataFrame:
    """(session, frame, track, person) of faces (session, frame, track, name)."""
    step = lambda s, r: {"session": r["session"], "frame": r["frame"], "track": r["track"], "person": s.take(r["frame"], r["track"], r["name"])}
    return fold(faces, "session", ["frame", "track"], FaceNames, step, "session bigint, frame bigint, track bigint, person string")


def merged_turns(turns: DataFrame) -> DataFrame:
    """(session, ord, group_no) of turns (session, ord, slot, voice: unit vectors or null)."""

    def step(s: TurnMerger, r: dict) -> dict:
        voice = r["voice"]
        voice = None if voice is None or not len(voice) else np.asarray(voice, np.float64)
        return {"session": r["session"], "ord": r["ord"], "group_no": s.take(r["slot"], voice)}

    return fold(turns, "session", ["ord"], TurnMerger, step, "session bigint, ord bigint, group_no bigint")
