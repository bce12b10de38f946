"""Identification, clustering and tracking of speakers by their vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.columns import unit
from confab.session import cut

KNOWN_BYTES = 32 << 20  # of known vectors that are sent to every task as one matrix; more are compared in blocks
BLOCK_NAMES, BLOCK_PROBES = 4096, 16384  # names and probes of one block beyond that, about
AT_ONCE = 2048  # probes scored at once


def _matrices(column: pa.ListArray | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length; null and empty vectors and those with null numbers are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    missing = np.append(0, np.cumsum(column.values.is_null().to_numpy(zero_copy_only=False)))
    sizes = np.diff(offsets)
    usable = (sizes > 0) & ~column.is_null().to_numpy(zero_copy_only=False) & (missing[offsets[1:]] == missing[offsets[:-1]])
    for dim in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == dim))
        yield rows, values[offsets[rows][:, None] + np.arange(dim)]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def vector_sums(rows: DataFrame, key: str, vector: str, normalise: bool = False) -> DataFrame:
    """(key, n, total, squares): number, element-wise sum and sum of squared lengths of each key's vectors (of unit length where asked).

    Arrow batches are summed before the shuffle, so one short row for each key,
    length and partition goes over the wire, however many vectors a key has.
    Vectors of another length than the longest of their key count as far as they go.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n bigint, total array<double>, squares double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for at, matrix in _matrices(batch.column(1)):
                matrix = unit_rows(matrix) if normalise else matrix
                order = np.argsort(codes[at], kind="stable")
                own = codes[at][order]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                sums, count = np.add.reduceat(matrix[order], first, axis=0), np.diff(np.append(first, len(own)))
                squares = np.add.reduceat((matrix[order] ** 2).sum(axis=1), first)
                offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(own[first])), pa.array(count), pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1))), pa.array(squares)], [key, "n", "total", "squares"])

    def whole(table: pa.Table) -> pa.Table:
        parts = [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in table.column("total").combine_chunks()]
        total = np.zeros(max(map(len, parts)))
        for part in parts:
            total[: len(part)] += part
        return pa.table({key: table.column(key)[:1], "n": [sum(table.column("n").to_pylist())], "total": [total], "squares": [sum(table.column("squares").to_pylist())]})

    return rows.select(key, vector).mapInArrow(partial, schema).groupBy(key).applyInArrow(whole, schema)


def centroids(rows: DataFrame, name: str, vector: str, normalise: bool = True) -> DataFrame:
    """(name, centroid): element-wise mean of each name's vectors, unit length unless asked otherwise."""
    mean = F.transform("total", lambda x: x / F.col("n"))
    return vector_sums(rows, name, vector).select(name, (unit(mean) if normalise else mean).alias("centroid"))


def _ranked(rows: np.ndarray, known: np.ndarray, top: int | None, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, known row, score, rank): the ``top`` known rows of each row of ``least`` or more; equal scores in order of the known."""
    out = []
    for at in range(0, len(rows), AT_ONCE):
        scored = np.round(rows[at : at + AT_ONCE] @ known.T, 12)
        low = np.full(len(scored), -np.inf if least is None else least)
        if top is not None and known.shape[0] > 4 * top:
            low = np.maximum(low, np.partition(scored, -top, axis=1)[:, -top])
        i, j = np.nonzero(scored >= low[:, None])
        by = np.lexsort((j, -scored[i, j], i))
        i, j = i[by], j[by]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left") + 1
        keep = rank <= (top or len(known))
        out.append((at + i[keep], j[keep], scored[i, j][keep], rank[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, int) for _ in range(4))


def _scored(keys: pa.Array, vectors: pa.Array, names: pa.Array, known: np.ndarray, key: str, name: str, top: int | None, least: float | None) -> Iterator[pa.RecordBatch]:
    for at, matrix in _matrices(vectors):
        # a vector of another length is like nobody
        own = unit_rows(matrix) if matrix.shape[1] == known.shape[1] else np.zeros((len(matrix), known.shape[1]))
        i, j, score, rank = _ranked(own, known, top, least)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[i])), names.take(pa.array(j)), pa.array(score.astype(np.float64)), pa.array(rank.astype(np.int32))], [key, name, "score", "rank"])


def matches(probes: DataFrame, known: DataFrame, key: str, name: str, vector: str, top: int | None = None, least: float | None = None) -> DataFrame:
    """(key, name, score, rank): the known names of each probe by cosine, the best first; equal scores go by name.

    ``known`` has name and centroid, unit vectors of one length.  Up to
    KNOWN_BYTES of them go to every task as one matrix, and probes are not
    shuffled.  Beyond that, blocks of names meet blocks of probes and the best of
    each block are ranked again; nothing is left out.  A probe whose vector is
    null, empty or holds a null has no row.
    """
    kinds = [probes.schema[key].dataType.simpleString(), known.schema[name].dataType.simpleString()]
    schema = f"`{key}` {kinds[0]}, `{name}` {kinds[1]}, score double, rank int"
    known = known.filter(F.col(name).isNotNull()).select(name, F.col("centroid").cast("array<double>").alias("centroid"))
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.size("centroid")), F.lit(0)) * 8).first()
    if size <= KNOWN_BYTES:
        table = known.orderBy(name).toArrow()
        column = table.column("centroid").combine_chunks()
        matrix = column.values.to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
        sent = probes.sparkSession.sparkContext.broadcast((table.column(name).combine_chunks(), matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, rows = sent.value
            for batch in batches:
                if len(names):
                    yield from _scored(batch.column(0), batch.column(1), names, rows, key, name, top, least)

        return probes.select(key, vector).mapInArrow(run, schema)

    # the name's block stands in the probe's row, so a probe meets every name exactly once
    blocks, parts = -(-n // BLOCK_NAMES), max(-(-probes.count() // BLOCK_PROBES), 1)
    left = probes.select(key, vector, F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = known.select(name, "centroid", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))

    def block(rows: pa.Table, names: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and names.num_rows:
            names = names.sort_by(name)
            matrix = names.column("centroid").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(names.num_rows, -1)
            found = list(_scored(rows.column(key).combine_chunks(), rows.column(vector).combine_chunks(), names.column(name).combine_chunks(), matrix, key, name, top, least))
        return pa.Table.from_batches(found) if found else pa.table({key: rows.column(key)[:0], name: names.column(name)[:0], "score": pa.array([], pa.float64()), "rank": pa.array([], pa.int32())})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(block, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), name)))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def nearest_rows(probes: np.ndarray, known: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, known row, score): the most similar known row of each row that has one of ``least`` or more; of equal scores the first.

    Products in single precision leave a row what can still be its best by their error bound; those are scored in double.
    """
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    rough, slack = known.astype(np.float32), probes.shape[1] * 2.5e-7
    for at in range(0, len(probes) if len(known) else 0, AT_ONCE // 2):
        rows = probes[at : at + AT_ONCE // 2]
        likeness = rows.astype(np.float32) @ rough.T
        i, j = np.nonzero(likeness >= (np.maximum(likeness.max(axis=1), least) - slack)[:, None])
        score = np.concatenate([np.einsum("nd,nd->n", rows[i[k : k + AT_ONCE]], known[j[k : k + AT_ONCE]]) for k in range(0, len(i), AT_ONCE)] or [np.zeros(0)]).round(12)
        by = np.lexsort((j, -score, i))
        by = by[score[by] >= least]
        by = by[np.append(True, i[by][1:] != i[by][:-1])[: len(by)]]
        found.append((at + i[by], j[by], score[by]))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(probes: DataFrame, known: DataFrame, keys: list[str], name: str, vector: str, least: float, scaled: Callable[[np.ndarray], np.ndarray] = unit_rows) -> DataFrame:
    """(keys, name, score): the most similar known name (name, centroid) of each probe that has one of ``least`` or more; equal scores go by name.

    The smaller table goes to the tasks KNOWN_BYTES at a time, and the other is
    read once for each such block: no vector is shuffled, no task or driver
    holds more than a block, and nothing is left out.  ``scaled`` brings the
    probes' vectors to the length at which they are compared.
    """
    bytes_of = lambda df, column: df.agg(F.coalesce(F.sum(F.greatest(F.size(column), F.lit(0))), F.lit(0)) * 8).first()[0]
    known = known.filter(F.col(name).isNotNull()).select(name, "centroid")
    probes = probes.select(*keys, vector)
    sizes = bytes_of(known, "centroid"), bytes_of(probes, vector)
    to_probes = sizes[0] <= sizes[1]
    sent, read = (known, probes) if to_probes else (probes, known)
    blocks = max(-(-min(sizes) // KNOWN_BYTES), 1)
    block = F.pmod(F.xxhash64(*sent.columns[:-1]), F.lit(blocks))
    schema = ", ".join([f"`{c}` {(probes if c in keys else known).schema[c].dataType.simpleString()}" for c in [*keys, name]]) + ", score double"

    def task(held: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                yield from _nearest_of(*((table, held.value) if to_probes else (held.value, table)), name, least, scaled)

        return run

    found = []
    for b in range(blocks):
        held = probes.sparkSession.sparkContext.broadcast(sent.filter(block == b).toArrow().combine_chunks())
        found.append(cut(read.mapInArrow(task(held), schema)))
        held.destroy()
    best = F.min(F.struct((-F.col("score")).alias("low"), F.col(name).alias("name"))).alias("best")
    return reduce(DataFrame.union, found).groupBy(*keys).agg(best).select(*keys, F.col("best.name").alias(name), (-F.col("best.low")).alias("score"))


def _nearest_of(probes: pa.Table, known: pa.Table, name: str, least: float, scaled: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    known = known.sort_by(name)
    profiles = {rows.shape[1]: (at, unit_rows(rows)) for at, rows in _matrices(known.column("centroid"))} if known.num_rows else {}
    for at, rows in _matrices(probes.column(probes.num_columns - 1)) if probes.num_rows else ():
        if rows.shape[1] in profiles:
            of, own = profiles[rows.shape[1]]
            i, j, score = nearest_rows(scaled(rows), own, least)
            keys = probes.select(probes.column_names[:-1]).take(pa.array(at[i]))
            yield from keys.append_column(name, known.column(name).take(pa.array(of[j]))).append_column("score", pa.array(score)).combine_chunks().to_batches()


def scores(probes: DataFrame, known: DataFrame, key: str, name: str, vector: str) -> DataFrame:
    """(key, name, score) of every probe against every centroid."""
    return matches(probes, known, key, name, vector).select(key, name, "score")


def identified(probes: DataFrame, known: DataFrame, key: str, name: str, vector: str, threshold: float) -> DataFrame:
    """best_names() of the probes' two best matches."""
    return best_names(matches(probes, known, key, name, vector, top=2), key, name, threshold)


def best_names(scored: DataFrame, key: str, name: str, threshold: float) -> DataFrame:
    """(key, name, score, margin, accepted): the best name of each probe; equal scores go to the first name."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), name)
    ranked = scored.select(key, name, "score", F.row_number().over(order).alias("_place"), F.lead("score").over(order).alias("_second")).filter("_place = 1")
    return ranked.select(key, name, "score", F.coalesce(F.col("score") - F.col("_second"), F.lit(1.0)).alias("margin"), (F.col("score") >= threshold).alias("accepted"))


def diversity(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, diversity): one less the mean cosine of all pairs of unit vectors, from their sum alone; 0 below two."""
    sums = vector_sums(rows, key, vector, normalise=True)
    length = F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x)
    spread = 1 - (length - F.col("squares")) / (F.col("n") * (F.col("n") - 1))
    return sums.select(key, "n", F.when(F.col("n") < 2, 0.0).otherwise(spread).alias("diversity"))


# ---- folds -------------------------------------------------------------------------------------------------------


def _unit(v: np.ndarray, extra: float = 0.0) -> np.ndarray:
    n = np.linalg.norm(v) + extra
    return v / n if n > 0 else v


class HomonymSplitter:
    """Groups the vectors of one name: each joins the closest group from a cosine of 0.20 on, else opens one."""

    same = 0.20

    def __init__(self):
        self.groups: list[list[np.ndarray]] = []
        self.means: list[np.ndarray] = []

    def take(self, v: np.ndarray) -> int:
        likeness = [float(_unit(v) @ m) for m in self.means]
        best = int(np.argmax(likeness)) if likeness else -1
        if best >= 0 and likeness[best] >= self.same:
            self.groups[best].append(v)
            self.means[best] = _unit(np.mean(self.groups[best], axis=0))
            return best
        self.groups.append([v])
        self.means.append(_unit(v))
        return len(self.groups) - 1


class SpeakerTracker:
    """Session speakers by voice: the closest known one within reach, whose vector follows slowly; else a new id."""

    def __init__(self, most: int | None = None, same_gender: float = 0.35, other: float = 0.45, forced: float = 0.20, follow: float = 0.1):
        self.most, self.same_gender, self.other, self.forced, self.follow = most, same_gender, other, forced, follow
        self.voices: dict[str, np.ndarray] = {}
        self.genders: dict[str, str] = {}

    def take(self, v: np.ndarray, gender: str | None = None, without: frozenset[str] = frozenset()) -> str:
        fits = {i: float(v @ known) for i, known in self.voices.items() if i not in without and not (gender and self.genders.get(i) and self.genders[i] != gender)}
        best = max(fits, key=fits.get) if fits else None
        if best is not None:
            least = self.same_gender if gender and self.genders.get(best) == gender else self.other
            if fits[best] >= least:
                self.voices[best] = (1 - self.follow) * self.voices[best] + self.follow * v
                if gender:
                    self.genders.setdefault(best, gender)
                return best
            if self.most and fits[best] >= self.forced and len(self.voices) >= self.most:
                return best
        new = f"spk_{len(self.voices):03d}"
        self.voices[new] = v.copy()
        if gender:
            self.genders[new] = gender
        return new


class Enroller:
    """Whether a vector of a known name is worth keeping: like it, but no copy, not too soon, not too many."""

    def __init__(self, cooldown: float = 300.0, most: int = 8, least: float = 0.65, copy: float = 0.96):
        self.cooldown, self.most, self.least, self.copy = cooldown, most, least, copy
        self.raws: list[np.ndarray] = []
        self.mean: np.ndarray | None = None
        self.last = -np.inf

    def take(self, v: np.ndarray, at: float) -> bool:
        if at - self.last < self.cooldown or len(self.raws) >= self.most:
            return False
        v = _unit(v)
        if self.mean is not None and not self.least <= float(v @ self.mean) <= self.copy:
            return False
        self.raws.append(v)
        self.mean, self.last = _unit(np.mean(self.raws, axis=0)), at
        return True


def split_homonyms(rows: DataFrame, name: str, order: str, vector: str) -> DataFrame:
    """(name, order, key): "Name", "Name 2", … by voice, in the order of the files.  A name's files are few."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, splitter = part.sort_values(order), HomonymSplitter()
        group = [splitter.take(np.asarray(v, np.float64)) for v in part[vector]]
        return pd.DataFrame({name: key[0], order: part[order].to_numpy(), "key": [str(key[0]) if g == 0 else f"{key[0]} {g + 1}" for g in group]})

    return rows.select(name, order, vector).groupBy(name).applyInPandas(run, f"{name} string, {order} bigint, key string")


def track_speakers(rows: DataFrame, session: str, order: str, vector: str, most: int | None = None) -> DataFrame:
    """(session, order, speaker): speakers of each session's segments in order."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, tracker = part.sort_values(order), SpeakerTracker(most)
        ids = [tracker.take(_unit(np.asarray(v, np.float64))) for v in part[vector]]
        return pd.DataFrame({session: key[0], order: part[order].to_numpy(), "speaker": ids})

    return rows.select(session, order, vector).groupBy(session).applyInPandas(run, f"{session} bigint, {order} bigint, speaker string")


def enrolled(rows: DataFrame, name: str, order: str, vector: str, at: str) -> DataFrame:
    """(name, order) of the vectors that are kept for their name."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, gate = part.sort_values(order), Enroller()
        keep = [gate.take(np.asarray(v, np.float64), t) for v, t in zip(part[vector], part[at])]
        return pd.DataFrame({name: key[0], order: part[order].to_numpy()[keep]})

    return rows.select(name, order, vector, at).groupBy(name).applyInPandas(run, f"{name} bigint, {order} bigint")


def consolidate(names: list[str], vectors: dict[str, np.ndarray], generic, least: float = 0.55) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """Merges identities in order where one of a pair is generic and they are alike; a real name absorbs the generic one."""
    vectors, merged = dict(vectors), {}
    for i, a in enumerate(names):
        if a in merged:
            continue
        for b in names[i + 1 :]:
            if b in merged or not (generic(a) or generic(b)) or float(vectors[a] @ vectors[b]) < least:
                continue
            keep, gone = (b, a) if generic(a) and not generic(b) else (a, b)
            vectors[keep] = _unit((vectors[keep] + vectors[gone]) / 2, 1e-8)
            merged[gone] = keep
    return {n: v for n, v in vectors.items() if n not in merged}, merged


def merged_identities(rows: DataFrame, session: str, order: str, name: str, vector: str, least: float = 0.55) -> DataFrame:
    """(session, name, into) of the identities of each session that consolidate() merges into another; a session knows few names."""
    from confab.functions.columns import GENERIC

    pattern = re.compile(GENERIC["registry"])
    kind = rows.schema[session].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        held = {n: _unit(np.asarray(v, np.float64), 1e-8) for n, v in zip(part[name], part[vector])}
        merged = consolidate(list(held), held, lambda n: bool(pattern.match(n)), least)[1]
        return pd.DataFrame([(key[0], gone, kept) for gone, kept in merged.items()], columns=[session, name, "into"])

    return rows.select(session, order, name, vector).groupBy(session).applyInPandas(run, f"`{session}` {kind}, `{name}` string, `into` string")


# ---- agglomerative clustering ------------------------------------------------------------------------------------


def centroid_linkage(points: np.ndarray) -> np.ndarray:
    """Merges (left, right, distance, size) by the closest centroids; the first of equal distances in order of ids."""
    n = len(points)
    d = np.full((2 * n - 1, 2 * n - 1), np.inf)
    d[:n, :n] = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    size, live, out = np.zeros(2 * n - 1), list(range(n)), np.zeros((n - 1, 4))
    size[:n] = 1
    for step in range(n - 1):
        sub = np.triu(d[np.ix_(live, live)], 1)
        sub[np.tril_indices(len(live))] = np.inf
        i, j = np.unravel_index(int(sub.argmin()), sub.shape)
        a, b, new = live[i], live[j], n + step
        gap, na, nb = d[a, b], size[a], size[b]
        out[step] = min(a, b), max(a, b), gap, na + nb
        rest = [k for k in live if k not in (a, b)]
        squared = (na * d[a, rest] ** 2 + nb * d[b, rest] ** 2 - na * nb * gap**2 / (na + nb)) / (na + nb)
        d[new, rest] = d[rest, new] = np.sqrt(np.maximum(squared, 0))
        size[new] = na + nb
        live = [*rest, new]
    return out


def flat_clusters(merges: np.ndarray, heights: np.ndarray, cut: float) -> np.ndarray:
    """Cluster of each point: subtrees whose highest merge is at most ``cut``, numbered from 0 in left-to-right order."""
    n = len(merges) + 1
    highest, leaves = heights.astype(float).copy(), {}
    for r, (a, b) in enumerate(merges[:, :2].astype(int)):
        for child in (a, b):
            if child >= n:
                highest[r] = max(highest[r], highest[child - n])
    labels, number = np.zeros(n, int), -1
    stack: list[tuple[int, bool]] = [(2 * n - 2, False)]
    while stack:
        node, inside = stack.pop()
        if node < n:
            if not inside:
                number += 1
            labels[node] = number
            continue
        r = node - n
        if not inside and highest[r] <= cut:
            number += 1
            inside = True
        a, b = (int(x) for x in merges[r, :2])
        # inner subtrees are walked before single leaves of the same merge
        walk = [c for c in (a, b) if c >= n] + [c for c in (a, b) if c < n]
        stack.extend((c, inside) for c in reversed(walk))
    return labels


def agglomerate(vectors: np.ndarray, cut: float = 0.6, least_size: int = 12, fewest: int = 1, most: int | None = None, wanted: int | None = None) -> np.ndarray:
    """Clusters of unit vectors by centroid linkage; small clusters join the nearest large one.

    With a wanted number of clusters the merge nearest to the cut that gives it, or comes closest, is the stopping point.
    """
    n = len(vectors)
    if n == 1:
        return np.zeros(1, int)
    small = min(least_size, max(1, int(np.rint(0.1 * n))))
    unit_rows = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    merges = centroid_linkage(unit_rows)
    large = lambda labels: [c for c in np.unique(labels) if (labels == c).sum() >= small]
    labels = flat_clusters(merges, merges[:, 2], cut)
    k = len(large(labels))
    target = wanted if wanted is not None else None
    if k < fewest:
        target = fewest
    elif most is not None and k > most:
        target = most
    if target is not None and k != target:
        best, best_k = n - 1, 1
        steps = np.arange(n - 1)
        for it in sorted(range(n - 1), key=lambda i: (abs(merges[i, 2] - cut), i)):
            if merges[it, 3] < small:
                continue
            labels = flat_clusters(merges, steps, it)
            k = len(large(labels))
            if abs(k - target) < abs(best_k - target):
                best, best_k = it, k
            if k == target:
                break
        if best_k != target:
            labels = flat_clusters(merges, steps, best)
    big = large(labels)
    if not big:
        return np.zeros(n, int)
    mean = {c: unit_rows[labels == c].mean(axis=0) for c in np.unique(labels)}
    cosine = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    out = labels.copy()
    for c in set(np.unique(labels)) - set(big):
        out[labels == c] = max(big, key=lambda g: (cosine(mean[g], mean[c]), -big.index(g)))
    return np.unique(out, return_inverse=True)[1]


MOST_POINTS = 3000  # points that one dendrogram takes; its distances fill memory and time beyond


def cluster_groups(rows: DataFrame, group: str, key: str, vector: str, wanted: int | None = None) -> DataFrame:
    """(group, key, cluster) within each group, a clip of at most ``MOST_POINTS`` windows."""

    def run(which: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        if len(part) > MOST_POINTS:
            raise ValueError(f"group {which[0]} has {len(part)} vectors; cut it into clips first")
        labels = agglomerate(np.stack(part[vector].to_list()).astype(np.float64), wanted=wanted)
        return pd.DataFrame({group: which[0], key: part[key].to_numpy(), "cluster": labels})

    return rows.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} bigint, {key} bigint, cluster bigint")
