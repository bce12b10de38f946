"""Frames of a camera and of a recorder: grey values, regions, labels, what is kept of a stream, token scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a colour, rounded half up."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5))).cast("int")


def region(pixels: Column, width: int, height: int, left: float, top: float, right: float, bottom: float) -> Column:
    """The pixels (row by row) of a part of an image, given by shares of its sides."""
    x1, x2 = int(width * left), min(int(width * right), width)
    y1, y2 = int(height * top), min(int(height * bottom), height)
    rows = [F.slice(pixels, y * width + x1 + 1, max(x2 - x1, 0)) for y in range(y1, y2)]
    return F.concat(*rows) if rows else F.slice(pixels, 1, 0)


def shown(name: Column, score: Column) -> Column:
    """A face's label: name and score."""
    return F.format_string("%s (%.2f)", name, score)


def largest(boxes: DataFrame, frame: list[str], most: int, ties: list[str]) -> DataFrame:
    """The ``most`` largest boxes (x1, y1, x2, y2) of each frame."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    n = F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc(area), *ties))
    return boxes.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a consumer that is behind sees the newest frame only."""
    value = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def retained(scores: DataFrame, track: str, at: str, score: str, seconds: float = 20.0) -> DataFrame:
    """Scores with how many of their track are still held at their time, and their mean; older ones have gone."""
    micros = (F.col(at) * 1e6).cast("bigint")
    held = Window.partitionBy(track).orderBy(micros).rangeBetween(-int(seconds * 1e6), 0)
    return scores.withColumn("held", F.count(score).over(held)).withColumn("mean", F.avg(score).over(held))


def timeline(chunks: DataFrame, key: str, at: str, samples: str, rate: int = 16000, capacity: float = 40.0) -> DataFrame:
    """(key, start, end, held_from): the first chunk fixes the origin, samples add up, the oldest beyond the capacity are overwritten."""
    span = chunks.groupBy(key).agg(F.min(at).alias("start"), (F.sum(samples) / rate).alias("length"))
    end = F.col("start") + F.col("length")
    return span.select(key, "start", end.alias("end"), F.greatest(F.col("start"), end - capacity).alias("held_from"))


def joined_slices(signal: Column, spans: Column) -> Column:
    """The spans (from, to: positions from 0, to excluded) of a signal back to back."""
    return F.flatten(F.transform(spans, lambda s: F.slice(signal, s["from"] + 1, s["to"] - s["from"])))


def masked(scores: Column, never: tuple[int, ...], first: Column, never_first: tuple[int, ...]) -> Column:
    """Token scores with those of suppressed tokens at minus infinity; some are only where the ``first`` token is chosen."""
    gone = lambda i: i.isin(*never) | (first & i.isin(*never_first))
    return F.transform(scores, lambda x, i: F.when(gone(i), F.lit(float("-inf"))).otherwise(x))


def best_token(scores: Column) -> Column:
    """The first of the highest scores, counted from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def drawn_token(scores: Column, temperature: float, chance: Column) -> Column:
    """The token at which the weights exp(score / temperature), added up in order, reach a chance (0 to 1) of their sum."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.when(x == float("-inf"), 0.0).otherwise(F.exp((x - top) / temperature)))
    target = chance * F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    reached = F.transform(weights, lambda x, i: (x > 0) & (F.aggregate(F.slice(weights, F.lit(1), i + 1), F.lit(0.0), lambda s, w: s + w) >= target))
    return F.coalesce((F.array_position(reached, True).try_cast("int") - 1), best_token(scores))


def token_text(tokens: Column) -> Column:
    """The text of base64 tokens, whose borders may cut characters; blanks around it go."""
    data = F.aggregate(F.transform(tokens, lambda t: F.hex(F.unbase64(t))), F.lit(""), lambda s, x: F.concat(s, x))
    return F.trim(F.decode(F.unhex(data), "UTF-8"))
