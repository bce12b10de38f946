"""Queries of vector identification, clustering and the decision cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from confab.functions.columns import half_even, unit
from confab.operators import decide, pipeline, vectors
from confab.session import table


def _split(spark, d):
    e = table(spark, d, "embeddings").withColumn("name", F.format_string("P%d", "label"))
    return vectors.centroids(e.filter("vec_id % 5 <> 0"), "name", "embedding"), e.filter("vec_id % 5 = 0")


def _identified(spark, d):
    known, probes = _split(spark, d)
    return vectors.identified(probes, known, "vec_id", "name", "embedding", 0.5)


def speaker_identify(spark, d):
    return _identified(spark, d).select("vec_id", "name", half_even(F.col("score"), 6).alias("score"), "accepted")


def speaker_candidates(spark, d):
    known, probes = _split(spark, d)
    return vectors.matches(probes, known, "vec_id", "name", "embedding", least=0.05).select("vec_id", "rank", "name", half_even(F.col("score"), 6).alias("score"))


def margin_rule(spark, d):
    return _identified(spark, d).select("vec_id", F.when(F.col("margin") >= 0.04, F.col("name")).otherwise("Unknown").alias("name"), half_even(F.col("margin"), 6).alias("margin"))


def buffer_diversity(spark, d):
    s = vectors.diversity(table(spark, d, "embeddings"), "label", "embedding")
    return s.select("label", "n", half_even(F.col("diversity"), 6).alias("diversity"))


def cluster_assign(spark, d):
    """Every vector to the nearest raw mean of all labels."""
    e = table(spark, d, "embeddings").withColumn("name", F.format_string("P%d", "label"))
    means = vectors.centroids(e, "name", "embedding", normalise=False).select("name", unit(F.col("centroid")).alias("centroid"))
    return vectors.identified(e, means, "vec_id", "name", "embedding", 0.0).select("vec_id", "name", half_even(F.col("score"), 6).alias("score"))


def homonym_split(spark, d):
    return vectors.split_homonyms(_voices(spark, d).withColumn("name", F.concat(F.lit("V"), (F.col("speaker_id") % 7).cast("string"))).withColumn("name", F.concat("name", F.lit("-"), (F.col("speaker_id") % 50).cast("string"))), "name", "id", "embedding")


def _voices(spark, d):
    return table(spark, d, "voice_embeddings").filter("is_active = 1 and size(embedding) = 192").filter(F.exists("embedding", lambda x: x != 0))


def session_tracker(spark, d):
    return vectors.track_speakers(_voices(spark, d).withColumn("session", F.col("id") % 20), "session", "id", "embedding", 6)


def auto_enroll(spark, d):
    return vectors.enrolled(_voices(spark, d).withColumn("at", F.col("id") * 120.0), "speaker_id", "id", "embedding", "at")


def agglomerative_clusters(spark, d):
    return vectors.cluster_groups(_voices(spark, d).withColumn("clip", F.floor(F.col("id") / 100)), "clip", "id", "embedding")


def _evidence(spark, d):
    s = table(spark, d, "segments").filter("raw_conf is not null")
    face = F.concat(F.lit("spk_"), (F.col("id") % 4).cast("string"))
    face_name = F.when(F.col("id") % 5 == 0, "Person_1").when(F.col("id") % 5 < 3, F.col("final_name"))
    nothing = F.lit(None).cast("string")
    return s.select(
        "id", F.col("raw_best_name").alias("raw_name"), "raw_conf", F.when(F.col("raw_conf") >= 0.6, F.col("raw_best_name")).alias("best_name"), F.col("raw_conf").alias("best_conf"), F.when(F.col("id") % 3 == 0, F.col("raw_conf") - 0.02).alias("second_conf"),
        F.col("audio_gender").alias("gender"), F.when(F.col("id") % 6 == 1, face).alias("active_person"), F.when(F.col("id") % 6 == 1, face_name).alias("active_name"), F.when(F.col("id") % 2 == 0, face).alias("guess_person"), face_name.alias("guess_name"),
        (F.col("id") % 8 != 0).alias("guess_ok"), (F.col("id") % 3).cast("int").alias("faces"), F.when(F.col("id") % 3 == 1, face).alias("face_person"), F.when(F.col("id") % 3 == 1, face_name).alias("face_name"),
        F.when(F.col("id") % 7 < 4, F.col("final_speaker")).alias("hint"), F.when(F.col("id") % 7 < 2, face).alias("hint_face"), F.when(F.col("id") % 7 == 0, F.col("final_name")).otherwise(nothing).alias("hint_name"), F.when(F.col("id") % 4 != 0, F.lit(1)).alias("expected"), F.lit(True).alias("activity"),
        F.array(F.struct(face.alias("person"), face_name.alias("name")), F.struct(F.lit("spk_9").alias("person"), F.lit("Carolina Lemos").alias("name"))).alias("people"), (F.col("id") % 2 == 0).alias("settled"),
    )


def decision_cascade(spark, d):
    return decide.cascade(_evidence(spark, d)).select("id", "decision", F.coalesce("speaker_name", F.lit("")).alias("speaker_name"))


def gender_passes(spark, d):
    done = decide.gender_passes(decide.cascade(_evidence(spark, d)))
    return done.select("id", "final_decision", F.coalesce("final_name", F.lit("")).alias("final_name"))


def segment_pipeline(spark, d):
    """Accepted segments with who said them, what was missed, and the decision type of their metrics record."""
    c = F.col
    s = table(spark, d, "segments").filter("text is not null and raw_conf is not null").select(
        "id", "timestamp", "text", "final_speaker", "segment_ms", "whisper_ms", "verifier_ms", (c("raw_conf") * 2 - 2).alias("avg_logprob"), F.greatest(F.lit(0.0), 0.6 - c("raw_conf")).alias("avg_no_speech"), (F.coalesce(c("segment_ms"), F.lit(0.0)) / 1000).alias("duration_s"),
        F.array(F.struct(F.coalesce("raw_best_name", F.lit("Unknown")).alias("name"), c("raw_conf").alias("score"))).alias("candidates"), F.lit(False).alias("known"), F.lit(1).alias("identified"), F.lit(4).alias("expected_speakers"),
    )
    done = pipeline.attributed(_evidence(spark, d).join(s, "id"))
    return done.select("id", "final_decision", F.coalesce("final_name", F.lit("")).alias("final_name"), "label", F.array_join("missed", "|").alias("missed"), F.get_json_object("record", "$.decision_type").alias("recorded"))


def merged_identities(spark, d):
    """Identities, one for each voice file, in sessions of two hundred files, with what absorbed them: anonymous ones join the identity that they sound like."""
    name = F.concat(F.when(F.col("id") % 2 == 0, "Person_").otherwise("Voz "), F.col("id").cast("string"))
    v = _voices(spark, d).select(F.floor(F.col("id") / 200).alias("session"), F.col("id").alias("ord"), name.alias("name"), "embedding")
    return vectors.merged_identities(v, "session", "ord", "name", "embedding")


QUERIES = {
    f.__name__: f for f in (speaker_identify, speaker_candidates, margin_rule, buffer_diversity, cluster_assign, homonym_split, session_tracker, auto_enroll, agglomerative_clusters, decision_cascade, gender_passes, segment_pipeline, merged_identities)
}

_SCORES = """
    e AS (SELECT vec_id, printf('P%d', label) AS name, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    m AS (SELECT name, pos, avg(CAST(x AS DOUBLE)) AS x FROM e {known} GROUP BY name, pos), n AS (SELECT name, sqrt(sum(x * x)) AS n FROM m GROUP BY name),
    p AS (SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM e {probes}), q AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM p GROUP BY vec_id),
    s AS (SELECT vec_id, m.name, sum(p.x * m.x) / (any_value(q.n) * any_value(n.n)) AS score FROM p JOIN m USING (pos) JOIN q USING (vec_id) JOIN n ON n.name = m.name GROUP BY vec_id, m.name),
    r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, name))
"""
_HELD_OUT = _SCORES.format(known="WHERE vec_id % 5 <> 0", probes="WHERE vec_id % 5 = 0")
ORACLE_SQL = {
    "speaker_identify": f"WITH {_HELD_OUT} SELECT vec_id, name, round_even(score * 1e6, 0) / 1e6 AS score, score >= 0.5 AS accepted FROM r WHERE rank = 1",
    "speaker_candidates": f"WITH {_HELD_OUT} SELECT vec_id, CAST(rank AS INTEGER) AS rank, name, round_even(score * 1e6, 0) / 1e6 AS score FROM r WHERE score >= CAST(0.05 AS DOUBLE)",
    "margin_rule": f"WITH {_HELD_OUT} SELECT vec_id, CASE WHEN score - second >= CAST(0.04 AS DOUBLE) THEN name ELSE 'Unknown' END AS name, round_even((score - second) * 1e6, 0) / 1e6 AS margin FROM r WHERE rank = 1",
    "buffer_diversity": """
        WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), q AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM e GROUP BY vec_id),
        u AS (SELECT label, pos, sum(x / n) AS s, sum((x / n) * (x / n)) AS q, count(*) AS n FROM e JOIN q USING (vec_id) GROUP BY label, pos), t AS (SELECT label, sum(s * s) AS s2, sum(q) AS q, max(n) AS n FROM u GROUP BY label)
        SELECT label, n, round_even(CASE WHEN n < 2 THEN 0 ELSE 1 - (s2 - q) / (n * (n - 1)) END * 1e6, 0) / 1e6 AS diversity FROM t
    """,
    "cluster_assign": f"WITH {_SCORES.format(known='', probes='')} SELECT vec_id, name, round_even(score * 1e6, 0) / 1e6 AS score FROM r WHERE rank = 1",
}


def _cascade_sql() -> str:
    """The cascade over the same evidence as one CASE in SQL."""
    from confab.plans.reports import _GENERIC, gender_sql

    generic = lambda n: f"coalesce({_GENERIC.format(n)}, true)"
    differs = lambda n: f"coalesce(g <> ({gender_sql(n)}), false)"
    return f"""
        s AS (SELECT *, 'spk_' || (id % 4) AS face, CASE WHEN id % 5 = 0 THEN 'Person_1' WHEN id % 5 < 3 THEN final_name END AS fname FROM segments WHERE raw_conf IS NOT NULL),
        e AS (SELECT id, raw_best_name AS rn, raw_conf AS rc, CASE WHEN raw_conf >= CAST(0.6 AS DOUBLE) THEN raw_best_name END AS bn, raw_conf AS bc, CASE WHEN id % 3 = 0 THEN raw_conf - CAST(0.02 AS DOUBLE) END AS sc, audio_gender AS g,
                     CASE WHEN id % 6 = 1 THEN face END AS ap, CASE WHEN id % 6 = 1 THEN fname END AS an, CASE WHEN id % 2 = 0 THEN face END AS gp, fname AS gn, id % 8 <> 0 AS gok, id % 3 AS faces, CASE WHEN id % 3 = 1 THEN fname END AS fn,
                     CASE WHEN id % 7 < 4 THEN final_speaker END AS hint, CASE WHEN id % 7 < 2 THEN face END AS hf, CASE WHEN id % 7 = 0 THEN final_name END AS hn, coalesce(CASE WHEN id % 4 <> 0 THEN 1 END <= 1, true) AS alone FROM s),
        c AS (SELECT *, bn IS NOT NULL AND (coalesce(bc - sc, 1) >= CAST(0.04 AS DOUBLE) OR g IS NOT NULL) AS clear FROM e),
        k AS (SELECT *, CASE WHEN clear THEN bn END AS ch, CASE WHEN clear THEN bc ELSE 0 END AS cc, rn IS NOT NULL AND rn <> 'Unknown' AND rc >= CAST(0.65 AS DOUBLE) AND NOT {differs('rn')} AS weak,
                     CASE WHEN hint IS NULL THEN 'SESSION_TRACKER' WHEN hf IS NOT NULL AND hn IS NOT NULL THEN 'SESSION_FACE' ELSE 'SESSION_HINT' END AS ses FROM c),
        d AS (SELECT *, CASE
            WHEN ch IS NOT NULL AND cc >= CAST(0.7 AS DOUBLE) AND (cc >= CAST(0.9 AS DOUBLE) OR NOT {differs('ch')}) THEN 'VERIFIER_HIGH' WHEN ch IS NOT NULL AND cc >= CAST(0.8 AS DOUBLE) AND (cc >= CAST(0.9 AS DOUBLE) OR NOT {differs('ch')}) THEN 'VERIFIER_MOD'
            WHEN weak AND (ap IS NOT NULL OR coalesce(({gender_sql('rn')}) = g, false)) THEN 'VERIFIER_WEAK' WHEN ap IS NOT NULL THEN 'ASD'
            WHEN weak AND faces = 1 AND NOT {generic('fn')} THEN 'FACE_ONLY' WHEN weak AND faces = 1 THEN 'SINGLE_FACE' WHEN weak THEN ses
            WHEN faces = 1 AND NOT {generic('fn')} AND alone THEN 'FACE_ONLY' WHEN faces = 1 AND rc >= CAST(0.35 AS DOUBLE) AND alone THEN 'SINGLE_FACE'
            WHEN faces > 0 AND gp IS NOT NULL AND gok THEN 'ASD_GUESS' ELSE ses END AS decision FROM k)
    """


def _passes_sql() -> str:
    """The passes by the voice's gender over the cascade's decisions."""
    from confab.plans.reports import _GENERIC, gender_sql

    generic = lambda n: f"coalesce({_GENERIC.format(n)}, true)"
    return f"""
        WITH {_cascade_sql()},
        n AS (SELECT *, id % 2 = 0 AND g IS NOT NULL AS active, regexp_matches(decision, '^(ASD|FACE_ONLY|SINGLE_FACE|SESSION_HINT)') AS visual, 'spk_' || (id % 4) AS face,
                     CASE WHEN decision IN ('VERIFIER_HIGH', 'VERIFIER_MOD') THEN ch WHEN decision = 'VERIFIER_WEAK' THEN regexp_replace(rn, '[\\s\\x{{00A0}}]+\\d+$', '') WHEN decision = 'ASD' THEN an
                          WHEN decision IN ('FACE_ONLY', 'SINGLE_FACE') THEN fn WHEN decision = 'ASD_GUESS' THEN gn WHEN decision = 'SESSION_FACE' THEN hn END AS name,
                     CASE WHEN decision = 'ASD' THEN ap WHEN decision IN ('FACE_ONLY', 'SINGLE_FACE') THEN CASE WHEN id % 3 = 1 THEN 'spk_' || (id % 4) END WHEN decision = 'ASD_GUESS' THEN gp WHEN decision = 'SESSION_FACE' THEN hf WHEN decision = 'SESSION_HINT' THEN hint END AS person,
                     coalesce(NOT {generic('gn')} AND ({gender_sql('gn')}) = g, false) AS m1, coalesce('female' = g, false) AS m2 FROM d),
        o AS (SELECT *, m1 AND face IS DISTINCT FROM person AS o1, m2 AND 'spk_9' IS DISTINCT FROM person AS o2, CASE WHEN m1 AND NOT m2 THEN gn WHEN m2 AND NOT m1 THEN 'Carolina Lemos' END AS only_name,
                     coalesce(name IS NOT NULL AND NOT {generic('name')} AND ({gender_sql('name')}) <> g, false) AS wrong FROM n),
        p AS (SELECT *, active AND decision IN ('SESSION_HINT', 'SESSION_TRACKER') AND only_name IS NOT NULL AS f1, active AND visual AND name IS NOT NULL AND {generic('name')} AND starts_with(decision, 'ASD') AND only_name IS NOT NULL AS f2,
                     active AND visual AND wrong AND (o1 OR o2) AS f3, coalesce(active AND visual AND wrong AND rc >= CAST(0.15 AS DOUBLE) AND ({gender_sql('rn')}) = g, false) AS f4, active AND visual AND wrong AS f5 FROM o)
        SELECT id, CASE WHEN f1 THEN 'GENDER_FACE' WHEN f2 OR f3 THEN 'GENDER_REROUTE' WHEN f4 THEN 'GENDER_VERIFIER_HINT' WHEN f5 THEN 'GENDER_OVERRIDE' ELSE decision END AS final_decision,
               coalesce(CASE WHEN f1 OR f2 THEN only_name WHEN f3 THEN CASE WHEN o1 THEN gn ELSE 'Carolina Lemos' END WHEN f4 THEN rn WHEN f5 THEN NULL ELSE name END, '') AS final_name FROM p
    """


def _pipeline_sql() -> str:
    """The cascade and its passes over the accepted segments, with label and reasons."""
    from confab.plans.reports import _GENERIC
    from confab.plans.text import ORACLE_SQL as TEXTS

    generic = f"coalesce({_GENERIC.format('p.final_name')}, true)"
    return f"""
        SELECT p.id, p.final_decision, p.final_name, '(' || CASE WHEN p.final_name <> '' AND NOT {generic} THEN p.final_name ELSE coalesce(s.final_speaker, '?') END || ')' AS label,
               CASE WHEN starts_with(p.final_decision, 'VERIFIER') THEN '' WHEN s.raw_best_name <> 'Unknown' AND s.raw_conf >= CAST(0.45 AS DOUBLE) AND s.raw_conf < CAST(0.8 AS DOUBLE) THEN 'BELOW_THRESHOLD' ELSE '' END AS missed, p.final_decision AS recorded
        FROM ({_passes_sql()}) p JOIN segments s USING (id) JOIN ({TEXTS['transcript_filter']}) f USING (id) WHERE f.verdict = 'accepted'
    """


ORACLE_SQL["gender_passes"] = _passes_sql()
ORACLE_SQL["segment_pipeline"] = _pipeline_sql()
ORACLE_SQL["decision_cascade"] = f"""
    WITH {_cascade_sql()}
    SELECT id, decision, coalesce(CASE WHEN decision IN ('VERIFIER_HIGH', 'VERIFIER_MOD') THEN ch WHEN decision = 'VERIFIER_WEAK' THEN regexp_replace(rn, '[\\s\\x{{00A0}}]+\\d+$', '') WHEN decision = 'ASD' THEN an
        WHEN decision IN ('FACE_ONLY', 'SINGLE_FACE') THEN fn WHEN decision = 'ASD_GUESS' THEN gn WHEN decision = 'SESSION_FACE' THEN hn END, '') AS speaker_name FROM d
"""
