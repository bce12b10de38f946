"""Reading JSON text as it is found in the field, with built-in expressions only.

``readable`` turns a text into one plain JSON document: it drops a byte-order
mark and surrounding blanks, unwraps a document that was encoded twice, and
rewrites the literal notation of Python (single quotes, None, True, False).
What can't be read to its end stays unreadable: ``from_json`` then gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings of literals in Python notation and in JSON.
_LITERALS = (("None", "null"), ("True", "true"), ("False", "false"))
_BLANK = " \t\n\r\x0b\x0c\ufeff\u200b\u00a0"
_TOKEN = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++"""
_OPTIONS = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"}


def trimmed(text: Column) -> Column:
    """The text without byte-order mark and surrounding blanks."""
    return F.btrim(text, F.lit(_BLANK))


def parse(text: Column, schema: str) -> Column:
    """``from_json``; null fields where the text is damaged before its end."""
    return F.from_json(text, schema, _OPTIONS)


def strings(text: Column) -> Column:
    """The elements of a JSON list as texts; nested values keep their JSON text."""
    return parse(text, "array<string>")


def entries(text: Column) -> Column:
    """The members of a JSON mapping in the order in which they are written."""
    return F.map_entries(parse(text, "map<string,string>"))


def _from_python(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def token(t: Column) -> Column:
        hexed = lambda c: F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        single = F.concat(F.lit('"'), hexed(F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))), F.lit('"'))
        bare = t
        for python, json in _LITERALS:
            bare = F.regexp_replace(bare, rf"\b{python}\b", json)
        return F.when(F.startswith(t, F.lit("'")), single).when(F.startswith(t, F.lit('"')), hexed(t)).otherwise(bare)

    whole = F.length(F.array_join(tokens, "")) == F.length(text)
    return F.when(whole, F.array_join(F.transform(tokens, token), ""))


def readable(df: DataFrame, *columns: str) -> DataFrame:
    """The table with one plain JSON document in each of the columns, null where the text is null.

    Each step is a projection of its own, so no text is searched twice.
    """
    once = df.withColumns({c: trimmed(F.col(c)) for c in columns})
    unwrapped = lambda c: F.when(F.startswith(c, F.lit('"')), trimmed(F.element_at(strings(F.concat(F.lit("["), c, F.lit("]"))), 1))).otherwise(c)
    twice = once.withColumns({c: unwrapped(F.col(c)) for c in columns})
    return twice.withColumns({c: F.when(F.col(c).rlike(r"^[\{\[]\s*'|^\[\s*\{\s*'"), _from_python(F.col(c))).otherwise(F.col(c)) for c in columns})
