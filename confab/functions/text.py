"""Text predicates and transformations: built-in expressions first, Arrow UDFs where Spark has no function."""

from __future__ import annotations

import difflib
import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from confab.functions import wordlists as W

# Marked Latin letters and their plain forms, for lookups of names.
MARKED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def _plain(words) -> list[str]:
    strip = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    return sorted({strip(w) for w in words})


def name_key(name: Column) -> Column:
    """A name's first word in lower case without marks."""
    first = F.regexp_extract(name, r"(?U)^\s*(\S*)", 1)
    return F.translate(F.lower(F.regexp_replace(first, r"\p{M}+", "")), MARKED, PLAIN)


def gender_of(name: Column) -> Column:
    """female or male by the first name, or null; a name of both lists is female."""
    key = name_key(name)
    return F.when(key.isin(_plain(W.FEMALE_NAMES)), "female").when(key.isin(_plain(W.MALE_NAMES)), "male")


def looping(text: Column) -> Column:
    """Whether some phrase of two to six words comes four times in a row."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]", " "), r"\s+", " "))
    return words.rlike(r"(?:^| )(\S++(?: \S++){1,5})(?: \1){3}(?= |$)")


def rejection(text: Column, avg_logprob: Column, no_speech: Column) -> Column:
    """Why a transcription is not speech, by the first rule that holds; null for one that is accepted.

    The echo of the prompt is tested apart (``similarity``).
    """
    lower = F.lower(text)
    bad = F.lit(False)
    for phrase in W.BAD_PHRASES:
        bad = bad | F.contains(lower, F.lit(phrase.lower()))
    parts = F.filter(F.transform(F.split(lower, r"[.!?,;]+"), lambda p: F.trim(p)), lambda p: p != "")
    bare = F.regexp_replace(lower, r"""^[ .!?,;:"'\-\[\]()]+|[ .!?,;:"'\-\[\]()]+$""", "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    return (
        F.when(no_speech > 0.5, "no_speech").when(F.length(text) < 5, "short").when(bad, "phrase")
        .when((F.size(parts) >= 3) & (F.size(F.array_distinct(parts)) == 1), "fragments").when(bare.isin(list(W.EXACT_PHRASES)), "exact")
        .when((F.length(text) < 20) & ((avg_logprob < -0.8) | (no_speech > 0.3)), "doubtful").when(looping(text), "loop")
        .when((F.size(words) <= 1) & (F.length(bare) < 14) & (no_speech > 0.15), "word")
    )


def unreliable(compression: Column, avg_logprob: Column, no_speech: Column) -> Column:
    """Whether a decoded result is to be dropped: repetitive, improbable, or silence."""
    return (compression > 2.4) | (avg_logprob < -2) | ((avg_logprob < -1) & (no_speech > 0.3)) | ((no_speech > 0.6) & ~(avg_logprob > -1))


def introduced_name(text: Column) -> Column:
    """The name that a speaker gives, by the first pattern whose name is acceptable; null if none is."""
    found = []
    for pattern in W.INTRODUCTIONS:
        name = F.nullif(F.regexp_extract(text, f"(?U){pattern}", 1), F.lit(""))
        first = F.lower(F.element_at(F.split(name, r"(?U)\s+"), 1))
        found.append(F.when(name.isNotNull() & ~first.isin(list(W.NOT_NAMES)), name))
    return F.coalesce(*found)


def _valid_name(name: Column) -> Column:
    return (F.length(name) >= 2) & name.rlike(r"^\p{Lu}") & ~F.lower(name).isin(list(W.NOT_VOCATIVES)) & ~name.rlike(r"^(Person_\d+|spk_\d+)$")


def addressee(text: Column) -> Column:
    """The person spoken to: a vocative at the start, then at the end, then an invitation or thanks."""
    out = [F.nullif(F.regexp_extract(text, f"(?U){p}", 1), F.lit("")) for p in W.VOCATIVES]
    out += [F.nullif(F.regexp_extract(text, f"(?iuU){p}", 1), F.lit("")) for p in W.INVITATIONS]
    return F.coalesce(*(F.when(_valid_name(n), n) for n in out))


def mentions(text: Column) -> Column:
    """All names spoken of, in the order of the patterns and of the text, each once."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(1)) for p in W.MENTIONS))
    return F.array_distinct(F.filter(found, _valid_name))


def gender_from_text(text: Column) -> Column:
    """female or male by what a speaker says of themselves; null where the markers balance."""
    lower = F.lower(text)
    count = lambda patterns: sum((lower.rlike(f"(?U){p}").cast("int") for p in patterns[1:]), lower.rlike(f"(?U){patterns[0]}").cast("int"))
    female, male = count(W.FEMALE_MARKERS), count(W.MALE_MARKERS)
    return F.when(female > male, "female").when(male > female, "male")


def without_honorific(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^\s*(sr|sra|dr|dra|mr|mrs|ms)\.?\s+", "")


def normalised(text: Column) -> Column:
    """Lower case without punctuation, for comparing transcript lines."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""))


# ---- Python cores and their Arrow UDFs ---------------------------------------------------------------------------


@lru_cache(50_000)
def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity of two texts without junk heuristics; 1 for two empty ones."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def alike(a: str, b: str, least: float) -> bool:
    """Whether the similarity of two texts is at least so much; cheap upper bounds settle most pairs."""
    total = len(a) + len(b)
    if total and 2 * min(len(a), len(b)) / total < least:
        return False
    if a == b:
        return True
    shared = sum((Counter(a) & Counter(b)).values())
    return (not total or 2 * shared / total >= least) and ratio(a, b) >= least


def title(text: str) -> str:
    """Upper case for the first letter of every run of letters, lower case for the others."""
    return re.sub(r"[^\W\d_]+", lambda m: m.group()[0].upper() + m.group()[1:].lower(), text)


def plain(text: str) -> str:
    """Trimmed, lower case, decomposed, without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.strip().lower()) if unicodedata.category(c) != "Mn")


def slug(text: str) -> str:
    """Letters and digits joined by underscores; "voice" where none is left."""
    return re.sub(r"[^a-z0-9]+", "_", plain(text)).strip("_") or "voice"


def for_gender(name: str, gender: str | None) -> str:
    """The name with a feminine first name where the voice is female; blanks collapse if a gender is known."""
    if gender is None:
        return name
    parts = name.split()
    first = plain(parts[0]) if parts else ""
    if gender == "female" and first in W.FEMININE:
        parts[0] = W.FEMININE[first].capitalize()
    elif gender == "female" and first.endswith("o") and first not in _FEMALE:
        parts[0] = (first[:-1] + "a").capitalize()
    return " ".join(parts)


_FEMALE = frozenset(_plain(W.FEMALE_NAMES))


def compression(text: str) -> float:
    """Bytes over compressed bytes; 0 for an empty text."""
    data = text.encode("utf-8", "replace")
    return len(data) / len(zlib.compress(data)) if data else 0.0


def word_errors(said: str, heard: str) -> tuple[int, int]:
    """(errors, reference words): edits between the words of two texts without case, marks and punctuation."""
    words = lambda t: re.sub(r"[^\w\s]", " ", plain(t)).split()
    a, b = words(said), words(heard)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1], len(a)


def _texts(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


title_case, plain_text, slug_text = _texts(title), _texts(plain), _texts(slug)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(DoubleType())
def compression_ratio(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else compression(x))


@F.pandas_udf(StringType())
def corrected_name(name: pd.Series, gender: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else for_gender(n, g) for n, g in zip(name, gender)], dtype=object)


_ERRORS = StructType([StructField("errors", IntegerType()), StructField("words", IntegerType())])


@F.pandas_udf(_ERRORS)
def word_error_counts(said: pd.Series, heard: pd.Series) -> pd.DataFrame:
    rows = [word_errors(a or "", b or "") for a, b in zip(said, heard)]
    return pd.DataFrame(rows, columns=["errors", "words"])
