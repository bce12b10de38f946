"""Readers and writers of the session's files: vectors, sounds, stored voices, reports."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StringType, StructField, StructType

RATE = 16000

# ---- codecs ------------------------------------------------------------------------------------------------------


def npy_vector(data: bytes) -> np.ndarray | None:
    """A one-dimensional array of 4- or 8-byte floats from .npy bytes; null for anything else or a damaged file."""
    try:
        v = np.load(io.BytesIO(data), allow_pickle=False)
    except (ValueError, EOFError, OSError):
        return None
    return v.astype(np.float32) if v.ndim == 1 and v.dtype in (np.dtype("<f4"), np.dtype("<f8")) else None


def npy_bytes(vector) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(vector, "<f4"), allow_pickle=False)
    return out.getvalue()


def wav_bytes(samples, rate: int = RATE) -> bytes:
    """16-bit mono sound; samples are clipped to [-1, 1] and cut towards zero."""
    pcm = np.trunc(np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def wav_samples(data: bytes) -> np.ndarray | None:
    """Samples in [-1, 1] of a 16-bit sound, channels averaged; null for a damaged file."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return None
            pcm = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
    except (wave.Error, EOFError):
        return None
    return pcm.mean(axis=1) / 32768


@F.pandas_udf(ArrayType(FloatType()))
def vector_of_npy(content: pd.Series) -> pd.Series:
    return content.map(npy_vector)


@F.pandas_udf(ArrayType(FloatType()))
def vector_of_blob(content: pd.Series) -> pd.Series:
    """Little-endian floats of a blob."""
    return content.map(lambda b: None if b is None else np.frombuffer(bytes(b[: len(b) // 4 * 4]), "<f4"))


@F.pandas_udf(BinaryType())
def blob_of_vector(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(DoubleType()))
def samples_of_wav(content: pd.Series) -> pd.Series:
    return content.map(wav_samples)


@F.pandas_udf(StringType())
def python_json(text: pd.Series) -> pd.Series:
    """JSON text with blanks behind commas and colons and its own letters unescaped, keys in order."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False))


# ---- tables of files ---------------------------------------------------------------------------------------------


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(file, base, vector) of a folder's .npy files; files that can't be read are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.col("_metadata.file_name").alias("file"), vector_of_npy("content").alias("vector")).filter("vector is not null")
    return rows.select("file", F.regexp_replace("file", r"\.npy$", "").alias("base"), "vector")


def read_voices(spark: SparkSession, folder: str) -> DataFrame:
    """(name, embedding) of a folder's stored voices, one JSON document a file; damaged files are left out."""
    schema = StructType([StructField("name", StringType()), StructField("embedding", ArrayType(FloatType()))])
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder).filter("name is not null")


def read_sounds(spark: SparkSession, folder: str) -> DataFrame:
    """(file, samples) of a folder's .wav files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return files.select(F.col("_metadata.file_name").alias("file"), samples_of_wav("content").alias("samples")).filter("samples is not null")


def chunk_rows(sounds: DataFrame, seconds: float = 0.1, rate: int = RATE) -> DataFrame:
    """(file, chunk, start_sec, samples): sounds cut to chunks whose time follows from the samples before them."""
    n = int(seconds * rate)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("samples") / n).cast("int") - 1), lambda i: F.slice("samples", i * n + 1, F.lit(n)))
    rows = sounds.filter("size(samples) > 0").select("file", F.posexplode(cut).alias("chunk", "samples"))
    return rows.select("file", "chunk", (F.col("chunk") * n / rate).alias("start_sec"), "samples")


def write_texts(rows: DataFrame, folder: str, name: str, text: str) -> None:
    """One text for each row, partitioned by its name; an overwrite touches only the names that come again."""
    out = rows.select(F.col(name), F.col(text).alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).text(folder)


def encode_files(rows: DataFrame, key: str, values: str, kind: str) -> DataFrame:
    """(key, content) with the bytes of an .npy or .wav file for each row's numbers."""
    make = {"npy": npy_bytes, "wav": wav_bytes}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "content": [make(v) for v in batch[values]]})

    return rows.select(F.col(key).cast("string").alias(key), values).mapInPandas(run, f"{key} string, content binary")
