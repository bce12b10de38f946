"""Identities over a session: ids of persons, bindings, stored voices and their names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.columns import clean_file_name, is_generic, strip_homonym, unit
from confab.functions.text import corrected_name, gender_of, introduced_name, title_case

# Decisions that rest on a face or a voice.
CONFIRMING = ("ASD", "ASD_GUESS", "FACE_ONLY", "SINGLE_FACE", "GENDER_FACE", "GENDER_REROUTE", "VERIFIER_HIGH", "VERIFIER_MOD", "VERIFIER_WEAK")


def person_ids(heard: DataFrame, session: str, name: str, order: list[str]) -> DataFrame:
    """(session, name, person): an id for each name of a session, numbered as they are first heard.

    Names are pre-aggregated, so only the distinct names of a session are numbered together.
    """
    first = heard.filter(F.col(name).isNotNull()).groupBy(session, name).agg(F.min(F.struct(*order)).alias("first"))
    number = F.row_number().over(Window.partitionBy(session).orderBy("first", name))
    return first.select(session, name, F.format_string("spk_%03d", number).alias("person"))


def bound_faces(decided: DataFrame, session: str, hint: str, order: list[str]) -> DataFrame:
    """Decided segments with ``bound``: the person whom a confirming decision last gave to the voice session before this row.

    Needs decision and person.
    """
    confirmed = F.when(F.col("decision").rlike("^(" + "|".join(CONFIRMING) + ")") & F.col("person").isNotNull(), F.col("person"))
    before = Window.partitionBy(session, hint).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return decided.withColumn("bound", F.when(F.col(hint).isNotNull(), F.last(confirmed, ignorenulls=True).over(before)))


def voice_buffers(chunks: DataFrame, keys: list[str], order: list[str], seconds: str, most: int = 30) -> DataFrame:
    """(keys, chunks, seconds): what is kept of each speaker, the last ``most`` chunks; the limit runs before the shuffle too."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    kept = chunks.withColumn("_back", back).filter(F.col("_back") <= most)
    return kept.groupBy(*keys).agg(F.count("*").alias("chunks"), F.sum(seconds).alias("seconds"))


def stripped(text: Column) -> Column:
    """A text without white space of any kind around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def with_stored_file(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name) of those for which a stored voice (base) exists: the name itself or the name and an underscore, in any case.

    Each base gives its own beginnings, so it is an equi-join.
    """
    parts = F.split(F.lower("base"), "_")
    begins = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))).alias("key")).distinct()
    return names.select("name", F.lower(stripped(F.col("name"))).alias("key")).distinct().join(begins, "key", "left_semi").select("name")


def savable(names: DataFrame, files: DataFrame, blocked: tuple[str, ...]) -> DataFrame:
    """Names (name, old_name) under which a live voice is saved.

    Empty names, ``Unknown`` and words that address people are no names unless
    made by the app; a name with a stored voice is left alone unless it has just
    replaced a generic one.
    """
    base = stripped(strip_homonym(F.col("name")))
    plausible = is_generic(base) | ((base != "") & ~F.lower(base).isin("unknown", *blocked))
    replaced = F.col("old_name").isNotNull() & is_generic(F.col("old_name"))
    there = with_stored_file(names.filter("name is not null"), files).withColumn("stored", F.lit(True))
    return names.filter(F.col("name").isNotNull() & plausible).join(there, "name", "left").filter(replaced | F.col("stored").isNull()).select("name", "old_name")


def file_name(name: Column, stamp: Column, kind: str = "") -> Column:
    """The name under which a voice is stored: person, time, and how it was made."""
    return F.concat(name, F.lit("_"), stamp, F.lit(f"_{kind}" if kind else ""))


def replaced_profiles(vectors: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, last, n, centroid) of enrolment in memory: the newest vector takes the centroid's place, all of them count."""
    newest = F.max_by(F.struct(F.col(order).alias("last"), F.col(vector).alias("v")), order).alias("newest")
    return vectors.groupBy(key).agg(newest, F.count("*").alias("n")).select(key, "newest.last", "n", unit(F.col("newest.v")).alias("centroid"))


def pruned_files(files: DataFrame, order: str, most: int = 8) -> DataFrame:
    """Stored voices (base) of each person without all but the newest ``most``."""
    newest = F.row_number().over(Window.partitionBy("person").orderBy(F.desc(order)))
    return files.withColumn("person", clean_file_name(F.col("base"))).withColumn("_n", newest).filter(F.col("_n") <= most).drop("_n")


def spaced(rows: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """(key, at) of the rows that lie ``gap`` or more behind the last one kept of their key.

    A row that far behind its forerunner is always kept, so keys are cut there:
    a task holds a stretch without such a pause, not a whole key.
    """
    by = Window.partitionBy(key).orderBy(at)
    fresh = F.when(F.col(at) - F.lag(at).over(by) < gap, 0).otherwise(1)
    islands = rows.select(key, at).withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable")
        times, kept, n = part[at].to_numpy(np.float64), [], 0
        while n < len(times):
            kept.append(n)
            n = int(np.searchsorted(times, times[n] + gap, side="left"))
        return part.iloc[kept][[key, at]]

    kinds = [rows.schema[c].dataType.simpleString() for c in (key, at)]
    return islands.groupBy(key, "island").applyInPandas(run, f"`{key}` {kinds[0]}, `{at}` {kinds[1]}")


def post_session(pending: DataFrame, given: DataFrame) -> DataFrame:
    """(session_pk, speaker, name, seconds): anonymous speakers to whom somebody gave a name after the session; blank names don't count."""
    names = given.select("session_pk", "speaker", stripped(F.col("name")).alias("name")).filter("name <> ''")
    return pending.join(names, ["session_pk", "speaker"]).select("session_pk", "speaker", "name", "seconds")


def introduced(segments: DataFrame, order: list[str]) -> DataFrame:
    """(session_pk, speaker, name): the first name by which a speaker without a real name introduces themselves.

    Needs session_pk, speaker, known (whether the speaker has a real name), text
    and gender; the name is put in title case and made to fit a known gender.
    """
    heard = segments.withColumn("said", introduced_name(F.col("text"))).filter(F.col("said").isNotNull() & ~F.col("known"))
    first = heard.groupBy("session_pk", "speaker").agg(F.min_by(F.struct("said", "gender"), F.struct(*order)).alias("v"))
    return first.select("session_pk", "speaker", corrected_name(title_case(F.col("v.said")), F.col("v.gender")).alias("name"))


def face_voices(seen: DataFrame, stored: DataFrame, cooldown: float = 120.0, least_sec: float = 3.0, silence: float = 1e-4) -> DataFrame:
    """(name, at) of the moments at which a recognised face that speaks gives its name a voice.

    ``seen`` has name, at, seconds, rms and gender; ``stored`` the names that
    have a voice.  A try uses up its name's cool-down whether it succeeds or not;
    it fails on short or silent sound and on a voice of the other gender.
    """
    faces = seen.filter(~is_generic(F.col("name"))).join(stored.select("name").distinct(), "name", "left_anti")
    tried = spaced(faces, "name", "at", cooldown)
    good = (F.col("seconds") >= least_sec) & (F.col("rms") >= silence) & F.coalesce(gender_of(F.col("name")) == F.col("gender"), F.lit(True))
    return tried.join(faces, ["name", "at"]).filter(good).select("name", "at")


def camera_names(decided: DataFrame, order: list[str]) -> DataFrame:
    """(session_pk, face, name): the name that a confirmed voice first gives to an anonymous face which moves while it speaks.

    Needs session_pk, person (who speaks), final_name, face (the person of the
    moving face), face_name and shown (the name that the camera confirmed for
    it).  A face that is the speaker's own, or that the camera knows under
    another real name, is left alone.
    """
    confirmed = ~is_generic(F.col("shown")) & (F.col("shown") != F.col("final_name"))
    fits = ~is_generic(F.col("final_name")) & F.col("face").isNotNull() & ~F.col("face").eqNullSafe(F.col("person")) & is_generic(F.col("face_name")) & ~F.coalesce(confirmed, F.lit(False))
    return decided.filter(fits).groupBy("session_pk", "face").agg(F.min_by("final_name", F.struct(*order)).alias("name"))
