"""Encoding of the whole corpus with a public tokenizer, and back.

Defined cases: null and empty texts have an empty list of ids; every row has
one row in the result, in no order; lone surrogates count as U+FFFD's stand-in
"?"; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from confab.llm.fst import DEFAULT_FOLDER, counter, transducer


def _lists(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter((i for row in ids for i in row), np.int32, int(ends[-1]))
    if ends[-1] > 2**31 - 1:
        raise ValueError("a batch holds too many tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def token_ids(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(doc_id, ids) of each document, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(tokenizer, folder).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds the lists that Python holds at once
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([encode(t) for t in part.column(1).to_pylist()])], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_texts(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(doc_id, text) of encoded documents; an empty list gives an empty text."""

    @F.pandas_udf(StringType())
    def decode(ids: pd.Series) -> pd.Series:
        back = transducer(tokenizer, folder).decode
        return ids.map(lambda row: "" if row is None else back(row))

    return encoded.select("doc_id", decode("ids").alias("text"))


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(doc_id, tokens) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, folder)
        for batch in batches:
            counts = np.array([count(t) for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, tokens bigint")
