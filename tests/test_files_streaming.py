import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.operators import dialogue
from confab.sources import files
from confab.streaming import twins


def test_codecs_round_trip():
    v = np.array([0.5, -1, 2], np.float32)
    assert files.npy_vector(files.npy_bytes(v)).tolist() == v.tolist() and files.npy_vector(b"broken") is None
    back = files.wav_samples(files.wav_bytes([0.0, 0.5, -2.0, 1.0]))
    assert back == pytest.approx([0, 16383 / 32768, -32767 / 32768, 32767 / 32768]) and files.wav_samples(b"RIFF") is None


def test_tables_of_files(spark, tmp_path):
    (tmp_path / "Ana_20240101_101010_auto.npy").write_bytes(files.npy_bytes([1.0, 2.0]))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    (tmp_path / "a.wav").write_bytes(files.wav_bytes(np.zeros(4000)))
    assert [(r.base, r.vector) for r in files.read_vectors(spark, str(tmp_path)).collect()] == [("Ana_20240101_101010_auto", [1.0, 2.0])]
    chunks = files.chunk_rows(files.read_sounds(spark, str(tmp_path))).orderBy("chunk").collect()
    assert [(r.chunk, round(r.start_sec, 3), len(r.samples)) for r in chunks] == [(0, 0.0, 1600), (1, 0.1, 1600), (2, 0.2, 800)]
    blobs = spark.createDataFrame([([1.5, -2.0],)], "v array<float>").select(files.vector_of_blob(files.blob_of_vector("v")).alias("v"))
    assert blobs.first().v == [1.5, -2.0]


def _stream(spark, rows, path, pieces=3):
    for i in range(pieces):
        rows.filter(F.col("seg_index") % 30 >= 10 * i).filter(F.col("seg_index") % 30 < 10 * (i + 1)).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stateful_twin_gives_the_batch_result(spark, tmp_path):
    texts = ["bom dia", "bom dia!", "vamos lá", "Bom dia"]
    rows = spark.createDataFrame([(s, i, s * 100 + i, texts[i % 4], i * 1.5) for s in range(3) for i in range(30)], "session_pk bigint, seg_index bigint, id bigint, text string, at double")
    want = sorted(r.id for r in dialogue.drop_repeats(rows).collect())
    shuffled = sorted(r.id for r in dialogue.drop_repeats(rows.repartition(7).orderBy(F.rand(3))).collect())
    assert shuffled == want
    stream = twins.drop_repeats(_stream(spark, rows, tmp_path / "in"))
    query = stream.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.id for r in spark.table("kept").collect()) == want


def test_zone_counts_match_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id")).alias("at"), F.col("id").cast("bigint").alias("seg_index"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = twins.zone_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "at", "k")
    query = stream.writeStream.format("memory").queryName("zones").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.k, r.zone): r.n for r in spark.table("zones").collect()}
    want = {(r.k, r.zone): r.n for r in rows.groupBy("k", F.window("at", "4 seconds").alias("w")).agg(F.count("*").alias("n")).select("k", F.col("w.start").alias("zone"), "n").collect()}
    assert got and all(want[k] == n for k, n in got.items())
