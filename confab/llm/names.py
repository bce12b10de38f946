"""Column builders that bring labels and names to one written form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the plain letters they stand for.
MARKED = "áàâãäåāăąçćčďéèêëēęěíìîïīñńňóòôõöøōőřśšťúùûüūůűýÿžźżÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖØÚÙÛÜÝ"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiinnnoooooooorsstuuuuuuuyyzzzaaaaaaceeeeiiiinoooooouuuuy"
# Roles that the app or a reader adds behind a label.
ROLES = ("externo", "externa", "external", "convidado", "convidada", "guest", "host", "remoto", "remota", "remote", "anfitriao", "moderador", "moderadora")


def plain(text: Column) -> Column:
    """Lower case without marks; letters of other scripts stay as they are."""
    return F.translate(F.lower(F.regexp_replace(text, r"\p{M}+", "")), MARKED, PLAIN)


def compact(text: Column) -> Column:
    """Letters and digits only: equal for labels that differ in case, marks, blanks or punctuation."""
    return F.regexp_replace(plain(text), r"[^\p{L}\p{N}]+", "")


def digits(text: Column) -> Column:
    """The numbers in a text, in order; labels with different numbers are different."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), "/")


def deletions(text: Column) -> Column:
    """The text itself and each form with one letter left out (digits are kept)."""
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.when(~F.substring(text, i, F.lit(1)).rlike(r"\d"), F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))),
    )
    return F.array_distinct(F.array_append(F.array_compact(cut), text))


def one_slip(a: Column, b: Column) -> Column:
    """Whether two different texts are one insertion, deletion, replacement or swap of neighbours apart."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2)
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    turned = F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + 1, F.lit(1)), F.substring(a, at, F.lit(1)), F.substring(a, at + 2, F.length(a)))
    return (F.levenshtein(a, b) <= 1) | (swapped & (turned == b))
