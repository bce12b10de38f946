"""Filling fixed-capacity containers with documents, sized in tokens.

A document of n tokens costs LINEAR * n + QUADRATIC * n * n (attention within
the document).  A sequence is computed to its end, so it costs the sum of its
documents and of its padding, which attends like one document more.  Documents
go, in descending order, to the sequence with room that costs least with the
document in it; as many sequences are open from the start as the tokens need at
least.  The linear costs of all sequences are the same, so what balances is the
attention of the documents against that of the room left.

Packing runs in buckets of about ITEMS documents each, spread by a hash of the
document, so neither a window nor a source can grow hot; a bucket leaves at most
a few containers partly empty.  Documents above the capacity are cut: all full
pieces are containers of their own, and only the remainder is packed.

Defined cases: null and empty texts have no tokens and still are assigned;
repeated doc_ids are packed each; a capacity that is null or below 1 has no
rows; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm.fst import DEFAULT_FOLDER
from confab.llm.tokens import token_counts
from confab.session import cut

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
ITEMS = 16384  # documents of one bucket, about
PACKED = "window_name string, container_id string, doc_id bigint, piece bigint, start_token bigint, tokens bigint"


def assign(sizes: np.ndarray, capacity: int, padding: float = 1.0) -> tuple[np.ndarray, int]:
    """The sequence of each document (sizes in descending order), and how many sequences are used; ``padding`` weighs the padding's cost."""
    least = max(int(-(-sizes.sum() // capacity)), 1)
    smallest = int(sizes[-1]) if len(sizes) else 0
    # the open sequences: number, room as a float (exact for any length of text), attention of the documents
    number, room, cost = np.arange(least), np.full(least, float(capacity)), np.zeros(least)
    opened, placed = least, np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        left = room - size
        padded = cost + padding * (LINEAR * left + QUADRATIC * left * left)
        padded[left < 0] = np.inf
        best = int(padded.argmin()) if len(padded) else -1
        if best < 0 or padded[best] == np.inf:
            number, room, cost, best = np.append(number, opened), np.append(room, capacity), np.append(cost, 0.0), len(number)
            opened += 1
        room[best] -= size
        cost[best] += LINEAR * size + QUADRATIC * size * size
        placed[i] = number[best]
        if i % 256 == 255:  # sequences that take nothing more are closed
            open_ = room >= smallest
            number, room, cost = number[open_], room[open_], cost[open_]
    used, placed = np.unique(placed, return_inverse=True)
    return placed, len(used)


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each document of a bucket, in the order given."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    out[order] = assign(sizes[order], capacity)[0]
    return out


def _pack_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    window, capacity, bucket = key
    rows = rows.sort_values(["doc_id", "piece", "tokens"], kind="stable")
    container = fill(rows["tokens"].to_numpy(np.int64), int(capacity))
    return pd.DataFrame({"window_name": window, "container_id": [f"{bucket}-{c}" for c in container], "doc_id": rows["doc_id"].to_numpy(), "piece": rows["piece"].to_numpy(), "start_token": rows["start_token"].to_numpy(), "tokens": rows["tokens"].to_numpy()})


def pack_documents(documents: DataFrame, windows: DataFrame, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(window_name, container_id, doc_id, piece, start_token, tokens) for every document and window.

    ``windows`` is the table of window sizes, a setting of a few rows; its
    distinct tokenizers are read to choose what to count with.
    """
    tokenizers = [r[0] for r in windows.filter("tokenizer is not null").select("tokenizer").distinct().collect()]
    sizes = None
    for name in sorted(tokenizers):
        own = token_counts(documents, name, folder).withColumn("tokenizer", F.lit(name))
        sizes = own if sizes is None else sizes.unionByName(own)
    if sizes is None:
        return documents.sparkSession.createDataFrame([], PACKED)
    sizes = cut(sizes)
    items = sizes.join(windows.filter("capacity_tokens >= 1").select("window_name", "tokenizer", F.col("capacity_tokens").alias("capacity")), "tokenizer")
    over = F.col("tokens") > F.col("capacity")
    pieces = F.when(over, F.ceil(F.col("tokens") / F.col("capacity"))).otherwise(1).cast("bigint")
    cutted = items.select("window_name", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    cutted = cutted.select("window_name", "capacity", "doc_id", "piece", start.alias("start_token"), F.least("capacity", F.col("tokens") - start).alias("tokens"))
    full = cutted.filter((F.col("tokens") == F.col("capacity")))
    # equal pieces of repeated rows are counted and numbered, so ids don't depend on partitions
    again = full.groupBy("window_name", "doc_id", "piece", "start_token", "tokens").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    whole = again.select("window_name", F.concat_ws("-", F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string"), F.col("copy").cast("string")).alias("container_id"), "doc_id", "piece", "start_token", "tokens")
    rest = cutted.filter(F.col("tokens") < F.col("capacity"))
    counts = rest.groupBy(F.col("window_name").alias("w")).agg(F.ceil(F.count("*") / ITEMS).alias("buckets"))
    spread = rest.join(counts, F.col("window_name") == F.col("w")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")))
    packed = spread.select("window_name", "capacity", "bucket", "doc_id", "piece", "start_token", "tokens").groupBy("window_name", "capacity", "bucket").applyInPandas(_pack_bucket, PACKED)
    return whole.unionByName(packed)
