"""Hashes, shapes and spellings of tokens that models of other programs expect, bit by bit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

_MASK = (1 << 64) - 1


def murmur64a(data: bytes, seed: int = 1) -> int:
    """The 64-bit MurmurHash2 for 64-bit machines (public domain definition), as an unsigned number."""
    multiplier, shift = 0xC6A4A7935BD1E995, 47  # fixed values of the hash
    h = (seed ^ len(data) * multiplier) & _MASK
    whole = len(data) // 8 * 8
    for k in np.frombuffer(data[:whole], "<u8").tolist():
        k = k * multiplier & _MASK
        k = (k ^ k >> shift) * multiplier & _MASK
        h = (h ^ k) * multiplier & _MASK
    rest = data[whole:]
    if rest:
        h = (h ^ int.from_bytes(rest, "little")) * multiplier & _MASK
    h = (h ^ h >> shift) * multiplier & _MASK
    return h ^ h >> shift


def bucket_keys(ids: np.ndarray, seed: int) -> np.ndarray:
    """Four 32-bit keys of each unsigned 64-bit id: the 128-bit MurmurHash3 for 64-bit machines (public domain definition) of its eight bytes."""
    start, eight = np.uint64(seed & 0xFFFFFFFF), np.uint64(8)
    turned = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)

    def mixed(x):
        for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # fixed values of the hash
            x = (x ^ x >> np.uint64(33)) * np.uint64(multiplier)
        return x ^ x >> np.uint64(33)

    with np.errstate(over="ignore"):
        first = start ^ turned(np.asarray(ids, np.uint64) * np.uint64(0x87C37B91114253D5), 31) * np.uint64(0x4CF5AD432745937F)  # fixed values of the hash
        a, b = first ^ eight, np.full(len(first), start ^ eight)
        a = a + b
        b = a + b
        a, b = mixed(a), mixed(b)
        a = a + b
        b = a + b
    low = np.uint64(0xFFFFFFFF)
    return np.stack([a & low, a >> np.uint64(32), b & low, b >> np.uint64(32)], axis=1).astype(np.int64)


def word_shape(token: str) -> str:
    """X, x and d for upper case, lower case and digits, runs cut at four; LONG for a hundred letters and more."""
    if len(token) >= 100:
        return "LONG"
    out: list[str] = []
    for c in token:
        sign = ("X" if c.isupper() else "x") if c.isalpha() else "d" if c.isdigit() else c
        if out[-4:] != [sign] * 4:
            out.append(sign)
    return "".join(out)


@F.pandas_udf(LongType())
def token_hash(tokens: pd.Series) -> pd.Series:
    """Signed 64-bit form of the hash of each token's UTF-8 bytes."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return tokens.map(lambda t: None if t is None else signed(murmur64a(t.encode("utf-8", "replace")))).astype("Int64")


@F.pandas_udf(ArrayType(LongType()))
def token_buckets(tokens: pd.Series) -> pd.Series:
    """The bucket keys of each token's hash, with seed 0."""
    rows = bucket_keys(np.array([murmur64a((t or "").encode("utf-8", "replace")) for t in tokens], np.uint64), 0)
    return pd.Series([None if t is None else row for t, row in zip(tokens, rows)], dtype=object)


@F.pandas_udf(StringType())
def shape(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else word_shape(t))


@F.pandas_udf(StringType())
def python_repr(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else repr(t))


# The speakers that each class of the segmentation stands for.
POWERSET = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1))


def powerset(scores: Column) -> Column:
    """Three activity flags from seven class scores; equal scores go to the first class."""
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    table = F.array(*(F.array(*map(F.lit, row)) for row in POWERSET))
    return F.element_at(table, best)


def log_sum_exp(scores: Column) -> Column:
    top = F.array_max(scores)
    return top + F.log(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def preview(samples: Column, seconds: int = 10, rate: int = 16000, level: float = 0.8) -> Column:
    """The first seconds of a signal with its peak at the level; silence as it is."""
    clip = F.slice(samples, F.lit(1), F.lit(seconds * rate))
    top = F.array_max(F.transform(clip, lambda x: F.abs(x)))
    return F.when(top > 0, F.transform(clip, lambda x: x / top * level)).otherwise(clip)


def is_silent(samples: Column, peak: float = 0.01) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0)) < peak


def answered_names(answer: Column) -> Column:
    """Names by speaker in a model's answer: the first flat object of texts; short names and what isn't text are left out."""
    found = F.from_json(F.regexp_extract(answer, r"\{[^}]+\}", 0), "map<string,string>")
    return F.map_filter(found, lambda k, v: v.isNotNull() & (F.length(F.trim(v)) >= 2) & ~v.rlike(r"^[\[{\d-]"))
