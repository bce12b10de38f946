"""Small column builders shared by the operators: rounding, vectors, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that the app makes itself, one pattern for each place that tests for them.
GENERIC = {
    "registry": r"^(Person_\d+|spk_\d+|Desconhecido_\d+|Unknown|Unknown_\d+)$",
    "face_sync": r"^(Person_\d+|spk_\d+|Desconhecido_\d+)$",
    "person_or_spk": r"^(Person_\d+|spk_\d+)$",
    "verifier": r"^(spk_\d+|Person_\d+|Desconhecido_\d+|Unknown(_\d+)?)$",
}


def half_even(x: Column, digits: int) -> Column:
    """Rounds the scaled double half to even, as the reports do."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def is_generic(name: Column, where: str = "registry") -> Column:
    """Whether a label was made by the app; a null name counts as generic."""
    return F.coalesce(name.rlike(GENERIC[where]), F.lit(True))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; 0 where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ or a vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union; 0 for an empty union."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return F.coalesce(w * h / F.nullif(union, F.lit(0.0)), F.lit(0.0))


def decision_type(label: Column) -> Column:
    """What a decision label says before its bracket and its first blank."""
    return F.trim(F.substring_index(F.substring_index(label, "(", 1), " ", 1))


def strip_homonym(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\s+\d+$", "")


def clean_file_name(base: Column) -> Column:
    """A stored voice's person: without one _auto or _fvbind and a trailing time stamp."""
    bare = F.regexp_replace(base, r"(_auto|_fvbind)$", "")
    return F.when(F.size(F.split(bare, "_")) >= 3, F.regexp_replace(bare, r"^(.+)_\d+_\d+$", "$1")).otherwise(bare)


def event_time(text: Column) -> Column:
    """Seconds since the epoch of the notations found in the field, or null.

    Dates with times in ISO or day-first order, epoch seconds or milliseconds; a
    time of day without a date gives the seconds since midnight (below 86400).
    """
    t = F.trim(text)
    iso = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, "Z$", ""), "T", " "))
    day_first = F.try_to_timestamp(F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})[ T]+", "$3-$2-$1 "))
    number = F.when(t.rlike(r"^\d{10}(\.\d+)?$"), t.try_cast("double")).when(t.rlike(r"^\d{13}$"), t.try_cast("double") / 1000)
    seconds = lambda c: F.unix_micros(c) / 1e6
    clock = F.regexp_extract(t, r"^(\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)$", 1).try_cast("int") * 3600 + F.regexp_extract(t, r"^(\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)$", 2).try_cast("int") * 60 + F.regexp_extract(t, r"^(\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)$", 3).try_cast("double")
    return F.coalesce(number, clock, F.when(t.rlike(r"^\d{4}-"), seconds(iso)), F.when(t.rlike(r"^\d{1,2}/"), seconds(day_first)))


def clock_of(text: Column, unknown: str = "--:--:--") -> Column:
    """HH:mm:ss of a time in any notation of event_time; unknown where there is none."""
    at = F.floor(event_time(text))
    of_day = F.format_string("%02d:%02d:%02d", F.floor(at / 3600), F.floor(at / 60) % 60, at % 60)
    return F.coalesce(F.when(at < 86400, of_day).otherwise(F.date_format(F.timestamp_seconds(at), "HH:mm:ss")), F.lit(unknown))
