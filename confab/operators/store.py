"""The session store's statements as pure functions over its tables.

Writes return the table as it is after the statement.  Children of a deleted or
replaced row go with it (anti-joins on the key), ids go on after the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confab.functions.columns import half_even, unit
from confab.operators.vectors import vector_sums
from confab.session import cut


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """The rows with their numbers from 1 in order of a column, without bringing them into one task.

    Rows are range-partitioned; each partition counts its own and starts behind
    the partitions before it.  Only one row for each partition is looked at together.
    """
    parts = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.join(before, "_part").withColumn(name, F.col("_before") + own).drop("_part", "_before")


def list_speakers(speakers: DataFrame, voices: DataFrame, faces: DataFrame) -> DataFrame:
    """Speakers with their numbers of active voices and faces; each child is counted before the join."""
    count = lambda df, name: df.filter("is_active = 1").groupBy(F.col("speaker_id").alias("id")).agg(F.count("*").alias(name))
    joined = speakers.join(count(voices, "voice_count"), "id", "left").join(count(faces, "face_count"), "id", "left")
    return joined.select("id", "name", "gender", "created_at", F.coalesce("voice_count", F.lit(0)).alias("voice_count"), F.coalesce("face_count", F.lit(0)).alias("face_count"))


def list_sessions(sessions: DataFrame, segments: DataFrame, validations: DataFrame) -> DataFrame:
    """Sessions with a segment count that, as in the store, multiplies by the session's validations; the latest accuracy."""
    own = segments.groupBy(F.col("session_pk").alias("id")).agg(F.count("*").alias("n"))
    checked = validations.groupBy(F.col("session_pk").alias("id")).agg(F.count("*").alias("v"), F.max_by("accuracy", "id").alias("validated_accuracy"))
    joined = sessions.select("id", "session_id", "started_at").join(own, "id", "left").join(checked, "id", "left")
    fan_out = F.coalesce("n", F.lit(0)) * F.coalesce("v", F.lit(1))
    return joined.select("id", "session_id", "started_at", fan_out.alias("segment_count"), "validated_accuracy")


def segments_of(segments: DataFrame, session_pk: int) -> DataFrame:
    """One session's segments by index; a null record reads as an empty one."""
    return segments.filter(F.col("session_pk") == session_pk).select("id", "seg_index", "speaker_name", "text", "decision_type", "raw_conf", "is_identified", F.coalesce("metrics_json", F.lit("{}")).alias("metrics")).orderBy("seg_index", "id")


def latest_validations(validations: DataFrame) -> DataFrame:
    """The validation with the largest id of each session."""
    kept = F.max_by(F.struct("id", "validated_at", "accuracy", "named_accuracy", "total_lines", "correct", "incorrect"), "id")
    return validations.groupBy("session_pk").agg(kept.alias("v")).select("session_pk", "v.*")


def accuracy_trend(sessions: DataFrame, validations: DataFrame) -> DataFrame:
    """Every session with each of its validations and a fixed part of its summary; a damaged summary has none."""
    schema = "total_segments bigint, totalSegments bigint, fn_rate double, fnRate double, unique_speakers bigint, uniqueSpeakers bigint"
    s = sessions.select(F.col("id").alias("session_pk"), "session_id", F.from_json("summary", schema, {"allowSingleQuotes": "false"}).alias("s"))
    flat = s.select("session_pk", "session_id", F.coalesce("s.total_segments", "s.totalSegments").cast("double").alias("total_segments"), F.coalesce("s.fn_rate", "s.fnRate").alias("fn_rate"), F.coalesce("s.unique_speakers", "s.uniqueSpeakers").cast("double").alias("unique_speakers"))
    v = validations.select("session_pk", F.col("accuracy").alias("validated_accuracy"), "named_accuracy")
    return flat.join(v, "session_pk", "left").drop("session_pk")


def insert_ignore(speakers: DataFrame, incoming: DataFrame) -> DataFrame:
    """Speakers after inserting names (name, gender, ord); a name that is there, or comes twice, keeps its first gender."""
    fresh = incoming.filter("name is not null").groupBy("name").agg(F.min_by("gender", "ord").alias("gender")).join(speakers.select("name"), "name", "left_anti")
    last = speakers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    placed = numbered(fresh, "name", "_n").crossJoin(F.broadcast(last))  # one row
    return speakers.select("id", "name", "gender").unionByName(placed.select((F.col("last") + F.col("_n")).alias("id"), "name", "gender"))


def upsert_sessions(sessions: DataFrame, incoming: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Replace by session_id: old rows go with their children, replaced and new rows get fresh ids.

    ``children`` maps table names to tables with session_pk.
    """
    old = sessions.join(incoming.select("session_id"), "session_id", "left_semi").select("id")
    kept = sessions.join(incoming.select("session_id"), "session_id", "left_anti").select(sessions.columns)
    last = sessions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    fresh = numbered(incoming, "session_id", "_n").crossJoin(F.broadcast(last))  # one row
    fresh = fresh.withColumn("id", F.col("last") + F.col("_n")).drop("_n", "last")
    out = {"sessions": kept.unionByName(fresh.select(kept.columns))}
    for name, child in children.items():
        out[name] = child.join(old.select(F.col("id").alias("session_pk")), "session_pk", "left_anti").select(child.columns)
    return out


def delete_speakers(speakers: DataFrame, gone: Column, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Speakers without those that match, and their embeddings' tables without theirs."""
    ids = speakers.filter(gone).select(F.col("id").alias("speaker_id"))
    return {"speakers": speakers.filter(~F.coalesce(gone, F.lit(False)))} | {n: c.join(ids, "speaker_id", "left_anti").select(c.columns) for n, c in children.items()}


def rename_prefixed(files: DataFrame, old: str, new: str) -> DataFrame:
    """Stored names (base) that are ``old`` or begin with it and an underscore, moved to ``new``."""
    moved = (F.col("base") == old) | F.startswith("base", F.lit(f"{old}_"))
    return files.withColumn("base", F.when(moved, F.concat(F.lit(new), F.substring(F.col("base"), F.lit(len(old) + 1), F.length("base")))).otherwise(F.col("base")))


def mean_embeddings(embeddings: DataFrame, speakers: DataFrame, dim: int) -> DataFrame:
    """(name, mean): the unit mean of each named speaker's active vectors of full length, element by element."""
    rows = embeddings.filter((F.col("is_active") == 1) & (F.size("embedding") == dim)).join(speakers.select(F.col("id").alias("speaker_id"), "name"), "speaker_id")
    return vector_sums(rows, "name", "embedding").select("name", unit(F.transform("total", lambda x: x / F.col("n"))).alias("mean"))


def coerce_segments(records: DataFrame) -> DataFrame:
    """Columns of stored segments from metrics records (id, doc): missing numbers are 0, null stays null, text is 0.0.

    ``doc`` is a variant, which tells a missing field from a null one.
    """
    doc = F.col("doc")
    there = lambda key: F.array_contains(F.json_object_keys(F.to_json(doc)), key)

    def number(key: str) -> Column:
        value = F.try_variant_get(doc, f"$.{key}", "double")
        text = F.variant_get(doc, f"$.{key}", "string")
        return F.when(~there(key), 0.0).when(text.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(value, F.lit(0.0)))

    flag = lambda key: F.coalesce(F.try_variant_get(doc, f"$.{key}", "boolean").cast("int"), F.lit(0))
    text = lambda key: F.variant_get(doc, f"$.{key}", "string")
    name = F.coalesce(F.nullif(text("final_name"), F.lit("")), text("final_speaker"))
    return records.select(
        "id", name.alias("speaker_name"), number("raw_conf").alias("raw_conf"), number("whisper_ms").alias("whisper_ms"), flag("is_identified").alias("is_identified"), flag("is_fn").alias("is_fn"),
        F.coalesce(text("fp_risk"), F.lit("none")).alias("fp_risk"), F.coalesce(text("text"), F.lit("")).alias("text"),
    )


def line_accuracy(validations: DataFrame, lines: DataFrame) -> DataFrame:
    """(validation_id, lines, right, share): predicted against corrected labels of each validation."""
    counted = lines.groupBy("validation_id").agg(F.count("*").alias("lines"), F.count_if(F.col("predicted") == F.col("corrected")).alias("right"))
    return validations.select(F.col("id").alias("validation_id")).join(counted, "validation_id").select("validation_id", "lines", "right", half_even(F.col("right") / F.col("lines"), 4).alias("share"))


# The store's tables; bytes of vectors are arrays of numbers here.
_VECTORS = "id bigint, speaker_id bigint, embedding array<float>, source_file string, created_at string, is_active int"
SCHEMAS = {
    "speakers": "id bigint, name string, gender string, created_at string", "voice_embeddings": _VECTORS, "face_embeddings": _VECTORS,
    "sessions": "id bigint, session_id string, started_at string, config string, summary string, transcript string, audio_file string, created_at string",
    "segments": "id bigint, session_pk bigint, seg_index bigint, timestamp string, speaker_name string, text string, decision string, decision_type string, raw_best_name string, raw_conf double, final_name string, final_speaker string, is_identified int, is_fn int, fp_risk string, audio_gender string, whisper_ms double, verifier_ms double, segment_ms double, metrics_json string",
    "validations": "id bigint, session_pk bigint, validated_at string, accuracy double, named_accuracy double, total_lines int, correct int, incorrect int, details_json string",
    "validation_lines": "id bigint, validation_id bigint, seg_index bigint, predicted string, corrected string",
}
#: Columns by which a table's files are laid out, in place of indexes: readers skip the files of other values.
CLUSTERED = {"voice_embeddings": "speaker_id", "face_embeddings": "speaker_id", "segments": "session_pk", "validations": "session_pk", "validation_lines": "validation_id"}


def create_tables(spark: SparkSession, database: str) -> None:
    """Creates the store's tables in a database, those that are missing only."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in SCHEMAS.items():
        clustered = f" CLUSTERED BY (`{CLUSTERED[name]}`) INTO 64 BUCKETS" if name in CLUSTERED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet{clustered}")


def run_sql(tables: dict[str, DataFrame], statement: str, args: dict | None = None) -> DataFrame:
    """The result of a statement that names its tables in braces and its arguments with a colon."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(statement, args=args or {}, **tables)


def run_script(spark: SparkSession, script: str) -> None:
    """Runs the statements of a script one after the other; semicolons part them, a statement that fails ends it."""
    for statement in (part.strip() for part in script.split(";")):
        if statement:
            spark.sql(statement)
