"""The queries of the language and training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import packing, runs, similar, spam, tokens, turns, variants
from confab.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(table(spark, sf_dir, "voice_embeddings"), table(spark, sf_dir, "face_embeddings"))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar others of every voice vector, ranked."""
    near = similar.neighbours({0: (table(spark, sf_dir, "voice_embeddings"), 192)})
    return near.select((F.col("node") / 2).cast("bigint").alias("id"), "rank", (F.col("neighbour") / 2).cast("bigint").alias("neighbour"), F.round("similarity", 6).alias("similarity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.speaker_runs(table(spark, sf_dir, "segments"))
    return found.select(F.col("entity").alias("session_pk"), F.col("first").alias("first_seg_index"), F.col("last").alias("last_seg_index"))


def p2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as one event with its number of segments and its duration."""
    found = runs.speaker_runs(table(spark, sf_dir, "segments"))
    return found.select(F.col("entity").alias("session_pk"), F.col("label").alias("speaker_key"), F.col("first").alias("first_seg_index"), F.col("last").alias("last_seg_index"), F.col("n").alias("segments"), F.col("duration").alias("duration_s"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_pairs(table(spark, sf_dir, "speakers"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each named speaker with the group of its person or organisation."""
    return variants.variant_groups(table(spark, sf_dir, "speakers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = turns.speaker_turns(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "segments"), with_text=False)
    return built.select("session_pk", "first_line", "last_line")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their speaker and cleaned text."""
    built = turns.speaker_turns(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "segments"))
    return built.select("session_pk", F.col("start").alias("turn_start"), "first_line", "last_line", "speaker", "utterances", "text")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents decoded from their ids: (doc_id, n_chars and digest of the decoded text)."""
    decoded = tokens.token_texts(tokens.token_ids(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_windows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_events, p4_found, p4_groups, p5_found, p5_turns, p6_ids, p6_round_trip, p7_packed, p8_found)
}

#: SQL twins; the other operators are tested against brute force, libraries and round trips.
def _near_sql(table: str, dim: int) -> str:
    """Every usual vector's five most similar others of cosine 0.70 or more: all pairs are compared."""
    return f"""
        SELECT id, neighbour, sim, rank FROM (
            SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.e, b.e), 9) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS rank
            FROM (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {table} WHERE is_active = 1 AND len(embedding) = {dim} AND list_sum(list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE))) > 0) a
            JOIN (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {table} WHERE is_active = 1 AND len(embedding) = {dim} AND list_sum(list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE))) > 0) b ON a.id <> b.id
        ) WHERE sim >= 0.70 AND rank <= 5
    """


ORACLE_SQL: dict[str, str] = {
    "p6_round_trip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
    # exact: every pair of usual vectors is compared
    "p1_nearest": """
        WITH v AS (
            SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM voice_embeddings
            WHERE is_active = 1 AND len(embedding) = 192 AND list_sum(list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE))) > 0
        ), s AS (
            SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.e, b.e), 9) AS sim FROM v a JOIN v b ON a.id <> b.id
        ), r AS (
            SELECT id, neighbour, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM s WHERE sim >= 0.70
        )
        SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, round(sim, 6) AS similarity FROM r WHERE rank <= 5
    """,
    "p1_found": f"""
        SELECT DISTINCT 'voice' AS modality, least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM ({_near_sql('voice_embeddings', 192)})
        UNION ALL SELECT DISTINCT 'face', least(id, neighbour), greatest(id, neighbour) FROM ({_near_sql('face_embeddings', 512)})
    """,
}
