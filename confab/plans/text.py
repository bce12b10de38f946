"""Queries of the text operators over stored segments and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions import text as T
from confab.functions import wordlists as W
from confab.functions.columns import clean_file_name, half_even
from confab.operators import dialogue
from confab.plans.reports import gender_sql
from confab.session import table


def _scored(spark, d):
    """Segments with the figures of a speech model: derived from the stored confidence, for want of better ones."""
    s = table(spark, d, "segments").filter("text is not null")
    return s.select("id", "session_pk", "seg_index", "text", (F.coalesce("raw_conf", F.lit(0.5)) * 2 - 2).alias("logprob"), F.greatest(F.lit(0.0), 0.6 - F.coalesce("raw_conf", F.lit(0.5))).alias("no_speech"))


def transcript_filter(spark, d):
    return _scored(spark, d).select("id", F.coalesce(T.rejection(F.col("text"), F.col("logprob"), F.col("no_speech")), F.lit("accepted")).alias("verdict"))


def prompt_echo(spark, d):
    likeness = T.similarity(F.lower("text"), F.lit(W.PROMPTS["pt"].lower()))
    return table(spark, d, "segments").filter("text is not null").select("id", half_even(likeness, 6).alias("likeness")).withColumn("echo", F.col("likeness") > 0.6)


def reliability_gate(spark, d):
    return _scored(spark, d).select("id", T.unreliable(F.lit(1.2) + F.col("id") % 5 * 0.4, F.col("logprob"), F.col("no_speech")).cast("int").alias("dropped"))


def self_introductions(spark, d):
    lines = F.concat(F.lit("Boa tarde, meu nome é "), F.initcap(F.regexp_replace("name", r"[^\p{L} ]", "")), F.lit("."))
    rows = table(spark, d, "speakers").select("id", lines.alias("text")).unionByName(table(spark, d, "segments").filter("text is not null").select((F.col("id") + 1_000_000_000).alias("id"), "text"))
    return rows.select("id", F.coalesce(T.introduced_name(F.col("text")), F.lit("")).alias("name")).filter("name <> ''")


def context_names(spark, d):
    s = table(spark, d, "segments").filter("text is not null").select("id", F.coalesce(T.addressee(F.col("text")), F.lit("")).alias("addressee"), F.array_join(T.mentions(F.col("text")), "|").alias("mentioned"))
    return s.filter("addressee <> '' or mentioned <> ''")


def name_gender(spark, d):
    return table(spark, d, "speakers").select("id", F.coalesce(T.gender_of(F.col("name")), F.lit("unknown")).alias("gender"))


def gender_from_text(spark, d):
    rows = table(spark, d, "speakers").select("id", F.concat(F.lit("eu sou "), F.when(F.col("gender") == "female", "a ").otherwise("o "), F.coalesce("name", F.lit(""))).alias("text"))
    return rows.select("id", F.coalesce(T.gender_from_text(F.col("text")), F.lit("unknown")).alias("gender"))


def clean_names(spark, d):
    base = F.regexp_replace("source_file", r"\.(npy|json)$", "")
    return table(spark, d, "voice_embeddings").select("id", clean_file_name(base).alias("name"))


def without_honorific(spark, d):
    return table(spark, d, "speakers").select("id", T.without_honorific(F.col("name")).alias("name"))


def title_and_slug(spark, d):
    return table(spark, d, "speakers").select("id", T.title_case("name").alias("title"), T.slug_text("name").alias("slug"), T.plain_text("name").alias("plain"))


def corrected_names(spark, d):
    return table(spark, d, "speakers").select("id", T.corrected_name("name", "gender").alias("name"))


def compression_ratio(spark, d):
    return table(spark, d, "segments").select("id", half_even(T.compression_ratio("text"), 6).alias("ratio"))


def word_error_rate(spark, d):
    """Predicted against corrected labels of each validation, word by word."""
    lines = table(spark, d, "validation_lines").select("validation_id", T.word_error_counts("corrected", "predicted").alias("w"))
    return lines.groupBy("validation_id").agg(F.sum("w.errors").alias("errors"), F.sum("w.words").alias("words")).withColumn("rate", half_even(F.col("errors") / F.nullif("words", F.lit(0)), 6))


def near_duplicates(spark, d):
    """Segments that stay in the transcript when repeats of the last lines are dropped."""
    return dialogue.drop_repeats(_timed(spark, d)).select("session_pk", "id")


def _timed(spark, d):
    s = table(spark, d, "segments").filter("text is not null and seg_index is not null")
    return s.select("session_pk", "seg_index", "id", "text", (F.col("seg_index") * 2.0).alias("at"))


def context_votes(spark, d):
    s = table(spark, d, "segments").filter("seg_index is not null")
    rows = s.select("session_pk", "seg_index", "id", F.coalesce("final_speaker", F.lit("?")).alias("speaker"), T.addressee(F.col("text")).alias("addressee"), (F.col("seg_index") * 7.0).alias("at"))
    return dialogue.context_votes(rows)


QUERIES = {
    f.__name__: f
    for f in (
        transcript_filter, prompt_echo, reliability_gate, self_introductions, context_names, name_gender, gender_from_text, clean_names, without_honorific, title_and_slug, corrected_names, compression_ratio,
        word_error_rate, near_duplicates, context_votes,
    )
}

_SCORED = "s AS (SELECT id, text, coalesce(raw_conf, 0.5) * 2 - 2 AS lp, greatest(0.0, CAST(0.6 AS DOUBLE) - coalesce(raw_conf, 0.5)) AS ns FROM segments WHERE text IS NOT NULL)"
ORACLE_SQL = {
    "reliability_gate": f"WITH {_SCORED} SELECT id, CAST(CAST(1.2 AS DOUBLE) + (id % 5) * CAST(0.4 AS DOUBLE) > CAST(2.4 AS DOUBLE) OR lp < -2 OR (lp < -1 AND ns > CAST(0.3 AS DOUBLE)) OR (ns > CAST(0.6 AS DOUBLE) AND NOT lp > -1) AS INTEGER) AS dropped FROM s",
    "name_gender": f"SELECT id, coalesce({gender_sql('name')}, 'unknown') AS gender FROM speakers",
    "clean_names": """
        WITH b AS (SELECT id, regexp_replace(regexp_replace(source_file, '\\.(npy|json)$', ''), '(_auto|_fvbind)$', '') AS b FROM voice_embeddings)
        SELECT id, CASE WHEN len(string_split(b, '_')) >= 3 THEN regexp_replace(b, '^(.+)_\\d+_\\d+$', '\\1') ELSE b END AS name FROM b
    """,
    "without_honorific": "SELECT id, regexp_replace(name, '(?i)^\\s*(sr|sra|dr|dra|mr|mrs|ms)\\.?\\s+', '') AS name FROM speakers",
    "gender_from_text": """
        WITH t AS (SELECT id, lower('eu sou ' || CASE WHEN gender = 'female' THEN 'a ' ELSE 'o ' END || coalesce(name, '')) AS t FROM speakers)
        SELECT id, CASE WHEN contains(t, 'sou a ') THEN 'female' WHEN contains(t, 'sou o ') THEN 'male' ELSE 'unknown' END AS gender FROM t
    """,
}


def _filter_sql() -> str:
    bad = " OR ".join(f"contains(t, '{p.lower().replace(chr(39), chr(39) * 2)}')" for p in W.BAD_PHRASES)
    exact = ", ".join(f"'{p}'" for p in W.EXACT_PHRASES)
    same = lambda w: " AND ".join(f"list_slice(ws, s, s + {w} - 1) = list_slice(ws, s + {w} * {k}, s + {w} * {k + 1} - 1)" for k in (1, 2, 3))
    loop = " OR ".join(f"(len(ws) >= {4 * w} AND len(list_filter(range(1, len(ws) - {4 * w} + 2), lambda s: {same(w)})) > 0)" for w in range(2, 7))
    return f"""
        WITH {_SCORED}, p AS (
            SELECT id, text, lower(text) AS t, lp, ns, list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?,;]+'), lambda x: trim(x)), lambda x: x <> '') AS parts,
                   regexp_replace(regexp_replace(lower(text), '^[ .!?,;:"''\\-\\[\\]()]+', ''), '[ .!?,;:"''\\-\\[\\]()]+$', '') AS bare,
                   list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM s
        )
        SELECT id, CASE WHEN ns > CAST(0.5 AS DOUBLE) THEN 'no_speech' WHEN length(text) < 5 THEN 'short' WHEN {bad} THEN 'phrase' WHEN len(parts) >= 3 AND len(list_distinct(parts)) = 1 THEN 'fragments'
            WHEN bare IN ({exact}) THEN 'exact' WHEN length(text) < 20 AND (lp < CAST(-0.8 AS DOUBLE) OR ns > CAST(0.3 AS DOUBLE)) THEN 'doubtful' WHEN {loop} THEN 'loop'
            WHEN len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda x: x <> '')) <= 1 AND length(bare) < 14 AND ns > CAST(0.15 AS DOUBLE) THEN 'word' ELSE 'accepted' END AS verdict FROM p
    """


ORACLE_SQL["transcript_filter"] = _filter_sql()


def sql_pattern(pattern: str) -> str:
    """A pattern for SQL text: white space of any kind, quotes doubled."""
    return pattern.replace("\\s", "[\\s\\x{00A0}]").replace("'", "''")


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _introductions_sql() -> str:
    found = [f"nullif(regexp_extract(text, '{sql_pattern(p)}', 1), '')" for p in W.INTRODUCTIONS]
    first = lambda n: f"lower(regexp_extract({n}, '^[^\\s\\x{{00A0}}]*'))"
    picked = ", ".join(f"CASE WHEN {first(n)} NOT IN ({listed(W.NOT_NAMES)}) THEN {n} END" for n in found)
    return f"""
        WITH t AS (SELECT id, 'Boa tarde, meu nome é ' || array_to_string(list_transform(string_split(regexp_replace(name, '[^\\p{{L}} ]', '', 'g'), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') || '.' AS text FROM speakers
                   UNION ALL SELECT id + 1000000000, text FROM segments WHERE text IS NOT NULL)
        SELECT id, coalesce({picked}) AS name FROM t WHERE coalesce({picked}, '') <> ''
    """


def _context_sql() -> str:
    valid = lambda n: f"(length({n}) >= 2 AND regexp_matches({n}, '^\\p{{Lu}}') AND lower({n}) NOT IN ({listed(W.NOT_VOCATIVES)}) AND NOT regexp_full_match({n}, '(Person_\\d+|spk_\\d+)'))"
    found = [f"nullif(regexp_extract(text, '{sql_pattern(p)}', 1), '')" for p in W.VOCATIVES] + [f"nullif(regexp_extract(text, '(?i){sql_pattern(p)}', 1), '')" for p in W.INVITATIONS]
    called = ", ".join(f"CASE WHEN {valid(n)} THEN {n} END" for n in found)
    spoken = "list_concat(" + ", ".join(f"regexp_extract_all(text, '{sql_pattern(p)}', 1)" for p in W.MENTIONS) + ")"
    return f"""
        WITH t AS (SELECT id, coalesce({called}, '') AS addressee, list_filter({spoken}, lambda m: {valid('m')}) AS m FROM segments WHERE text IS NOT NULL),
        u AS (SELECT id, addressee, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), '|') AS mentioned FROM t)
        SELECT id, addressee, mentioned FROM u WHERE addressee <> '' OR mentioned <> ''
    """


_TRIMMED = "regexp_replace(replace(name, chr(160), ' '), '^\\s+|\\s+$', '', 'g')"
_PLAIN_NAME = f"strip_accents(lower({_TRIMMED}))"
_LETTERS = "string_split(name, '')"
#: SQL text for the column ``name`` in title case.
TITLE = f"CASE WHEN name = '' THEN '' ELSE array_to_string(list_transform({_LETTERS}, lambda c, i: CASE WHEN i = 1 OR NOT regexp_full_match({_LETTERS}[i - 1], '\\p{{L}}') THEN upper(c) ELSE lower(c) END), '') END"
ORACLE_SQL |= {
    "self_introductions": _introductions_sql(),
    "context_names": _context_sql(),
    "title_and_slug": f"""
        SELECT id, {TITLE} AS title,
               coalesce(nullif(regexp_replace(regexp_replace({_PLAIN_NAME}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'voice') AS slug, {_PLAIN_NAME} AS plain FROM speakers WHERE name IS NOT NULL
        UNION ALL SELECT id, NULL, NULL, NULL FROM speakers WHERE name IS NULL
    """,
}

