"""Most similar vectors for every vector, by shifted space-filling curves.

Each unit vector is projected to a short integer sketch and, for several random
rotations and shifts, to a Hilbert key.  All curves together are
range-partitioned by (curve, key); every task walks its sorted rows in blocks
and compares each block with itself and the one before, so a window needs no
group and no key can grow hot.  Windows of all curves merge through their
common rows into neighbourhoods, and one walk reranks these with full vectors:
its blocks meet the block before and after, so a neighbourhood of up to two
blocks is compared as a whole by one walk.  A larger one is walked along
CURVES fresh curves a round; the rounds' candidates merge into one pool, and
rounds go on until a round changes less than SETTLED of all places among the k
most similar, so the windows need not grow with the collection.

Bounds and parameters
  * nothing is fitted: rotations come from a fixed seed, every row is indexed;
  * SKETCH numbers of one byte stand for a vector in the windows; sketches are
    neighbours from a cosine below ``least`` by SURE of their standard error, so
    a pair of cosine ``least`` is seen with probability 0.94 in every window
    that holds both, one 0.05 above it with 0.99;
  * ``least`` of None asks for the k nearest whatever their similarity; the
    whole table is then one neighbourhood.

Defined cases: rows that are not active, of another length, all zero, null, or
with a number that is not finite don't count; copies under another id do, and
equal similarity ranks the smaller id first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.llm.components import components
from confab.session import cut, cut_bare

CURVES, DIMS, BITS = 8, 8, 6
SKETCH, SKETCH_SCALE = 96, 317.0
BLOCK = 2048  # rows of a window's half
SMALL_TABLE = 400_000  # rows of the table of neighbourhoods that may be broadcast (some 25 MB hashed); beyond, it is shuffled
SURE = 1.54  # standard errors of a sketch's cosine by which sketches of neighbours may fall below the least cosine
SETTLED = 0.02  # share of the k most similar that a round over large neighbourhoods may change at last
SEED = 20231


def seen(least: float) -> float:
    """Cosine of two sketches from which their rows are neighbours, for a least cosine of the rows."""
    return least - SURE * (1 - least * least) / SKETCH**0.5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells, one row each with ``bits`` bits a coordinate."""
    axes = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        mask = level - 1
        for k, axis in enumerate(axes):
            upper = (axis & level) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[k]) & mask)
            axes[0] = np.where(upper, axes[0] ^ mask, axes[0]) ^ swap
            if k:
                axes[k] = axes[k] ^ swap
        level >>= 1
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn, level = np.zeros_like(axes[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((axes[-1] & level) != 0, level - 1, 0)
        level >>= 1
    axes = [a ^ turn for a in axes]
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def _unit_rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column("embedding")
    start, end = column.offsets[0].as_py(), column.offsets[len(column)].as_py()
    rows = column.values.slice(start, end - start).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), np.float32(1e-30))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _curve_keys(unit: np.ndarray, rotations: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The Hilbert key of each row on each curve."""
    spread = 1 / (1 + np.exp(-1.702 * (unit @ rotations).astype(np.float64)))  # near the normal distribution's ranks
    keys = np.empty((len(unit), CURVES), np.int64)
    for curve in range(CURVES):
        shifted = (spread[:, curve * DIMS : (curve + 1) * DIMS] + 0.5 * shifts[curve]) / 1.5
        keys[:, curve] = hilbert_keys(np.minimum((shifted * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
    return keys


def _sketcher(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([SEED, dim])
        rotations = rng.standard_normal((dim, CURVES * DIMS)).astype(np.float32)
        shifts = rng.random((CURVES, DIMS))
        project = rng.standard_normal((dim, SKETCH)).astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit_rows(batch, dim)
            short = unit @ project
            short /= np.maximum(np.linalg.norm(short, axis=1, keepdims=True), 1e-12)
            coded = np.clip(np.rint(short * SKETCH_SCALE), -127, 127).astype(np.int8)
            keys = _curve_keys(unit, rotations, shifts)
            offsets = lambda width: pa.array(np.arange(0, width * len(unit) + 1, width, dtype=np.int32))
            sketch = pa.Array.from_buffers(pa.binary(), len(unit), [None, offsets(SKETCH).buffers()[1], pa.py_buffer(coded.tobytes())])
            listed = pa.ListArray.from_arrays(offsets(CURVES), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), sketch, listed], ["node", "sketch", "keys"])

    return run


def usable(vectors: DataFrame, dim: int, modality: int) -> DataFrame:
    """(node, embedding) of the rows that count; the modality is the node's last bit."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter((F.col("is_active") == 1) & (F.size("embedding") == dim)).filter(finite).select((F.col("id") * 2 + modality).alias("node"), "embedding")


def _sketches(rows: DataFrame, dim: int) -> DataFrame:
    return rows.mapInArrow(_sketcher(dim), "node bigint, sketch binary, keys array<bigint>")


def _joined(near: np.ndarray, labels: np.ndarray, first: int) -> np.ndarray:
    """The smallest label that each label is joined to by the near pairs.

    ``near`` tells which columns a row is near to, rows are the columns from
    ``first`` on, and columns of one label are joined already.
    """
    parent, width = np.arange(int(labels.max()) + 1), near.shape[1]
    for at in range(0, len(near), 256):  # bounds the pairs held at once where all rows are near each other
        flat = np.flatnonzero(near[at : at + 256])
        a, b = parent[labels[first + at + flat // width]], parent[labels[flat % width]]
        while (apart := a != b).any():
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(parent, high, low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            a, b = parent[low], parent[high]
    return parent


def _window_links(least_seen: float):
    """Links that connect all rows of a window which are near each other, over one another or not; rows come sorted by curve and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # curve, roots and sketches of the block before

        def compare(curve, nodes, sketches):
            nonlocal before
            roots, others, first = nodes, sketches, 0
            if before is not None and before[0] == curve:
                roots, others, first = np.concatenate([before[1], nodes]), np.concatenate([before[2], sketches]), len(before[1])
            near = (sketches @ others.T) >= least_seen
            known, labels = np.unique(roots, return_inverse=True)
            parent = _joined(near, labels, first)
            before = (curve, known[parent[labels[first:]]], sketches)
            moved = np.flatnonzero(parent != np.arange(len(parent)))
            return known[parent[moved]], known[moved]

        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush(curve, nodes, sketches):
            found = [compare(curve, nodes[at : at + BLOCK], sketches[at : at + BLOCK]) for at in range(0, len(nodes), BLOCK)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            curves, nodes = batch.column("place").to_numpy() >> (DIMS * BITS), batch.column("node").to_numpy()
            column = batch.column("sketch")
            raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, SKETCH).astype(np.float32)
            raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-6)
            cuts = np.flatnonzero(np.diff(curves)) + 1
            for part in np.split(np.arange(len(curves)), cuts):
                curve = int(curves[part[0]])
                if waiting and waiting[0][0] != curve:
                    yield flush(waiting[0][0], *(np.concatenate([w[k] for w in waiting]) for k in (1, 2)))
                    waiting = []
                waiting.append((curve, nodes[part], raw[part]))
                if sum(len(w[1]) for w in waiting) >= 8 * BLOCK:
                    nodes_, raw_ = (np.concatenate([w[k] for w in waiting]) for k in (1, 2))
                    whole = len(nodes_) // BLOCK * BLOCK
                    yield flush(curve, nodes_[:whole], raw_[:whole])
                    waiting = [(curve, nodes_[whole:], raw_[whole:])] if whole < len(nodes_) else []
        if waiting:
            yield flush(waiting[0][0], *(np.concatenate([w[k] for w in waiting]) for k in (1, 2)))

    return run


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def window_links(sketches: DataFrame, least: float = 0.70) -> DataFrame:
    """Links (a, b) that connect the rows which are near in a window of some curve."""
    rows = sketches.select(F.posexplode("keys").alias("c", "key"), "node", "sketch")
    # curve, modality and key in one number: fewer bytes to shuffle
    rows = rows.select(F.shiftleft(F.col("c").cast("bigint") * 2 + F.col("node") % 2, DIMS * BITS).bitwiseOR(F.col("key")).alias("place"), "node", "sketch")
    sorted_rows = rows.repartitionByRange(_partitions(rows), "place").sortWithinPartitions("place", "node")
    return sorted_rows.mapInArrow(_window_links(seen(least)), "a bigint, b bigint")


def _best(nodes: np.ndarray, rows: np.ndarray, others: np.ndarray, other_rows: np.ndarray, k: int, least: float):
    """(node, neighbour, similarity, rank) of the k most similar others of each node, of ``least`` or more.

    Single precision finds what can be among the k, double precision ranks it.
    """
    order = np.argsort(others, kind="stable")
    others, other_rows = others[order], other_rows[order]
    short, top = other_rows.astype(np.float32), min(k, len(others))
    own_at = np.minimum(np.searchsorted(others, nodes), len(others) - 1)
    themselves = others[own_at] == nodes
    close = rows.astype(np.float32) @ short.T
    close[np.flatnonzero(themselves), own_at[themselves]] = -2
    edge = np.partition(close, -top, axis=1)[:, -top] if close.shape[1] > top else close.min(axis=1)
    may = close >= np.maximum(np.maximum(edge, least) - 4e-6, -1.5)[:, None]  # ties at the edge stay in
    few = may.sum(axis=1) <= 8 * k
    out = []
    tied = np.flatnonzero(~few)
    for at in range(0, len(tied), 256):  # rows with many ties, as of copies: whole rows in double precision, columns are in order of ids
        part = tied[at : at + 256]
        exact = np.round(rows[part] @ other_rows.T, 9)
        exact[np.flatnonzero(themselves[part]), own_at[part][themselves[part]]] = -2
        best = np.argsort(-exact, axis=1, kind="stable")[:, :top]
        i, rank = (x.reshape(-1) for x in np.indices(best.shape))
        j = best.reshape(-1)
        keep = exact[i, j] >= max(least, -1.5)
        out.append((nodes[part][i[keep]], others[j[keep]], exact[i[keep], j[keep]], rank[keep] + 1))
    may[~few] = False
    i, j = np.nonzero(may)
    exact = np.round(np.einsum("ij,ij->i", rows[i], other_rows[j]), 9)
    by = np.lexsort((others[j], -exact, i))
    i, j, exact = i[by], j[by], exact[by]
    rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    keep = (rank < k) & (exact >= least)
    out.append((nodes[i[keep]], others[j[keep]], exact[keep], rank[keep] + 1))
    return [np.concatenate(x) for x in zip(*out)]


FOUND = "node bigint, neighbour bigint, similarity double, rank int"


def _as_batch(found: list) -> pa.RecordBatch:
    node, neighbour, similarity, rank = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(neighbour), pa.array(similarity), pa.array(rank.astype(np.int32))], ["node", "neighbour", "similarity", "rank"])


def _segments(batches: Iterator[pa.RecordBatch]):
    """(walk, nodes, unit rows in double precision) piece by piece, in the order of the rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes, column = batch.column("walk").to_numpy(), batch.column("node").to_numpy(), batch.column("embedding")
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
            rows = values[offsets[part[0]] : offsets[part[-1] + 1]].reshape(len(part), -1).astype(np.float64)
            rows = rows / np.abs(rows).max(axis=1, keepdims=True)
            yield keys[part[0]], nodes[part], rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(walk, nodes, unit rows) in blocks of BLOCK rows of one walk; the last one of a walk may be shorter, none is empty."""
    at, nodes, rows, held = None, [], [], 0
    for walk, n, r in _segments(batches):
        if walk != at:
            if held:
                yield at, np.concatenate(nodes), np.concatenate(rows)
            at, nodes, rows, held = walk, [], [], 0
        nodes.append(n)
        rows.append(r)
        held += len(n)
        if held >= BLOCK:
            n, r = np.concatenate(nodes), np.concatenate(rows)
            whole = held // BLOCK * BLOCK
            for start in range(0, whole, BLOCK):
                yield at, n[start : start + BLOCK], r[start : start + BLOCK]
            nodes, rows, held = [n[whole:]], [r[whole:]], held - whole
    if held:
        yield at, np.concatenate(nodes), np.concatenate(rows)


def _walk(k: int, least: float):
    """The k most similar among each block of a walk and the blocks before and after it; rows come sorted by walk and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = None
        found: list = []

        def answer(after):
            around = [b for b in (before, held, after) if b is not None and b[0] == held[0]]
            found.append(_best(held[1], held[2], np.concatenate([b[1] for b in around]), np.concatenate([b[2] for b in around]), k, least))

        for block in _blocks(batches):
            if held is not None:
                answer(block)
                before = held
                if len(found) >= 512 or sum(len(f[0]) for f in found) >= 8 * BLOCK:
                    yield _as_batch(found)
                    found.clear()
            held = block
        if held is not None:
            answer(None)
            yield _as_batch(found)

    return run


def neighbours(tables: dict[int, tuple[DataFrame, int]], k: int = 5, least: float | None = 0.70) -> DataFrame:
    """(node, neighbour, similarity, rank): for each usable row the k most similar others of cosine ``least`` or more.

    ``tables`` maps a modality (0 or 1) to its table and vector length; nodes are
    id * 2 + modality.  Without ``least`` every row has its k nearest.
    """
    rows = [usable(vectors, dim, modality) for modality, (vectors, dim) in tables.items()]
    vectors = rows[0]
    for more in rows[1:]:
        vectors = vectors.unionByName(more)
    if least is None:
        least, groups = -1.0, vectors.select("node", (F.col("node") % 2).alias("component"))
    else:
        sketched = None
        for own, (_, dim) in zip(rows, tables.values()):
            short = _sketches(own, dim)
            sketched = short if sketched is None else sketched.unionByName(short)
        groups = components(window_links(cut(sketched), least))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    placed = cut(groups.join(sizes, "component").select("node", "component", "size"))
    at_once = 2 * BLOCK  # each of two blocks meets the other
    listed = placed.filter(F.col("size") <= at_once).select("node", F.col("component").alias("walk"))
    if listed.count() <= SMALL_TABLE:
        listed = F.broadcast(listed)  # spares a shuffle of the full vectors
    n = _partitions(vectors)
    small = vectors.join(listed, "node").select("walk", "node", "embedding").repartition(n, "walk").sortWithinPartitions("walk", "node")
    near = small.mapInArrow(_walk(k, least), FOUND)
    large = cut(placed.filter(F.col("size") > at_once).select("node", "component"))
    return near if large.isEmpty() else near.unionByName(_large_neighbours(large, vectors, k, least, n))


def _fresh_keys(turn: int):
    """Adds the keys of each row on CURVES curves drawn for the round; vectors of several lengths may come in one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict = {}
        for batch in batches:
            column = batch.column("embedding")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            lengths, keys = np.diff(offsets), np.zeros((batch.num_rows, CURVES), np.int64)
            for dim in np.unique(lengths).tolist():
                if dim not in drawn:
                    rng = np.random.default_rng([SEED, dim, turn + 1])
                    drawn[dim] = rng.standard_normal((dim, CURVES * DIMS)).astype(np.float32), rng.random((CURVES, DIMS))
                own = np.flatnonzero(lengths == dim)
                rows = values[offsets[own][:, None] + np.arange(dim)].astype(np.float32)
                rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), np.float32(1e-30))
                keys[own] = _curve_keys(rows / np.linalg.norm(rows, axis=1, keepdims=True), *drawn[dim])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, CURVES * batch.num_rows + 1, CURVES, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("node"), column, listed], ["component", "node", "embedding", "keys"])

    return run


def _large_neighbours(large: DataFrame, vectors: DataFrame, k: int, least: float, n: int) -> DataFrame:
    """Neighbours in neighbourhoods of more than two blocks, in rounds of fresh curves until they settle.

    Copies collapse first: of equal vectors only the k + 1 smallest ids walk the
    curves, which are all that can be among the k most similar of any row; a
    copy that does not walk has k smaller copies of cosine 1, its answer.  The
    limit by row number runs before the shuffle too, so copies of one vector
    don't meet in one task.
    """
    full = large.join(vectors, "node").withColumn("copy", F.struct("component", F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g")))
    first = Window.partitionBy("copy").orderBy("node")
    walkers = cut(full.select("node", "copy", F.row_number().over(first).alias("place")).filter(F.col("place") <= k + 1))
    walking = cut(walkers.select("node", F.col("copy.component").alias("component")).join(vectors, "node").select("component", "node", "embedding"))
    order = Window.partitionBy("node").orderBy(F.desc("similarity"), "neighbour")
    best, turn = None, 0
    while True:
        keyed = walking.mapInArrow(_fresh_keys(turn), "component bigint, node bigint, embedding array<float>, keys array<bigint>")
        exploded = keyed.select("component", "node", "embedding", F.posexplode("keys").alias("curve", "key")).select(F.xxhash64("component", "curve").alias("walk"), "key", "node", "embedding")
        along = exploded.repartitionByRange(n, "walk", "key").sortWithinPartitions("walk", "key", "node").select("walk", "node", "embedding").mapInArrow(_walk(k + 1, least), FOUND)
        pool = along.select("node", "neighbour", "similarity", F.lit(1).alias("new"))
        if best is not None:
            pool = pool.unionByName(best.select("node", "neighbour", "similarity", F.lit(0).alias("new")))
        pool = pool.groupBy("node", "neighbour").agg(F.max("similarity").alias("similarity"), F.min("new").alias("new"))
        best = cut_bare(pool.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1))
        changed = best.filter(F.col("rank") <= k).agg(F.avg("new")).first()[0]
        if turn and (changed is None or changed < SETTLED):
            break
        turn += 1
    own = best.filter(F.col("rank") <= k)
    rest = full.select("node", "copy").join(walkers.select("node"), "node", "left_anti")
    copies = walkers.filter(F.col("place") <= k).select("copy", F.col("node").alias("neighbour"), F.lit(1.0).alias("similarity"), F.col("place").alias("rank"))
    taken = rest.join(copies, "copy").select("node", "neighbour", "similarity", "rank")
    return own.select("node", "neighbour", "similarity", "rank").unionByName(taken)


def similar_pairs(voice: DataFrame, face: DataFrame, k: int = 5, least: float = 0.70) -> DataFrame:
    """(modality, id_a, id_b), id_a < id_b: pairs of cosine ``least`` or more of which one is among the other's k most similar."""
    near = neighbours({0: (voice, 192), 1: (face, 512)}, k, least)
    pairs = near.select(F.least("node", "neighbour").alias("a"), F.greatest("node", "neighbour").alias("b")).distinct()
    return pairs.select(F.when(F.col("a") % 2 == 0, "voice").otherwise("face").alias("modality"), F.floor(F.col("a") / 2).cast("bigint").alias("id_a"), F.floor(F.col("b") / 2).cast("bigint").alias("id_b"))
