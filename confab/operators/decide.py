"""Who said a segment: the decision cascade over an evidence row, as one ordered CASE.

Evidence columns: raw_name, raw_conf, best_name, best_conf, second_conf (null
for a single candidate), gender, active_person and active_name (the face that
moves), guess_person, guess_name, guess_ok, faces (visible people), face_person
and face_name (where one is visible), hint, hint_face (the face bound to the
voice session), hint_name, expected (speakers expected, null for unknown),
activity (whether an activity detector runs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.columns import is_generic, strip_homonym
from confab.functions.text import gender_of

MARGIN, WEAK, SINGLE, VERY_SURE, HINT = 0.04, 0.65, 0.35, 0.90, 0.15


def _chosen() -> tuple[Column, Column]:
    """The best candidate, if it is clear of the second or the voice's gender is known."""
    margin = F.coalesce(F.col("best_conf") - F.col("second_conf"), F.lit(1.0))
    clear = F.col("best_name").isNotNull() & ((margin >= MARGIN) | F.col("gender").isNotNull())
    return F.when(clear, F.col("best_name")), F.when(clear, F.col("best_conf")).otherwise(0.0)


def cascade(evidence: DataFrame, threshold: float = 0.80, least: float = 0.70) -> DataFrame:
    """Evidence with decision (the rule that holds first), speaker_name and person (null where a new id is to be made)."""
    c = F.col
    name, conf = _chosen()
    e = evidence.withColumn("chosen", name).withColumn("chosen_conf", conf)
    differs = lambda n: F.coalesce(c("gender") != gender_of(n), F.lit(False))
    voice_ok = (c("chosen_conf") >= VERY_SURE) | ~differs(c("chosen"))
    weak_ok = c("raw_name").isNotNull() & (c("raw_name") != "Unknown") & (c("raw_conf") >= WEAK) & ~differs(c("raw_name"))
    supported = c("active_person").isNotNull() | F.coalesce(gender_of(c("raw_name")) == c("gender"), F.lit(False))
    one = c("faces") == 1
    named_face = one & ~is_generic(c("face_name"))
    alone = F.coalesce(c("expected") <= 1, F.lit(True))
    session = F.when(c("hint").isNull(), "SESSION_TRACKER").when(c("hint_face").isNotNull() & c("hint_name").isNotNull(), "SESSION_FACE").otherwise("SESSION_HINT")
    decision = (
        F.when(c("chosen").isNotNull() & (c("chosen_conf") >= least) & voice_ok, "VERIFIER_HIGH")
        .when(c("chosen").isNotNull() & (c("chosen_conf") >= threshold) & voice_ok, "VERIFIER_MOD")
        .when(weak_ok & supported, "VERIFIER_WEAK")
        .when(c("active_person").isNotNull(), "ASD")
        .when(weak_ok & named_face, "FACE_ONLY").when(weak_ok & one, "SINGLE_FACE").when(weak_ok, session)
        .when(named_face & alone, "FACE_ONLY")
        .when(one & (c("raw_conf") >= SINGLE) & alone, "SINGLE_FACE")
        .when((c("faces") > 0) & c("activity") & c("guess_person").isNotNull() & c("guess_ok"), "ASD_GUESS")
        .otherwise(session)
    )
    e = e.withColumn("decision", decision)
    pick = lambda voice, weak, active, face, guess, bound, hint: (
        F.when(c("decision").isin("VERIFIER_HIGH", "VERIFIER_MOD"), voice).when(c("decision") == "VERIFIER_WEAK", weak).when(c("decision") == "ASD", active)
        .when(c("decision").isin("FACE_ONLY", "SINGLE_FACE"), face).when(c("decision") == "ASD_GUESS", guess).when(c("decision") == "SESSION_FACE", bound).when(c("decision") == "SESSION_HINT", hint)
    )
    nothing = F.lit(None).cast("string")
    e = e.withColumn("speaker_name", pick(c("chosen"), strip_homonym(c("raw_name")), c("active_name"), c("face_name"), c("guess_name"), c("hint_name"), nothing))
    return e.withColumn("person", pick(nothing, nothing, c("active_person"), c("face_person"), c("guess_person"), c("hint_face"), c("hint")))


def gender_passes(decided: DataFrame) -> DataFrame:
    """Decisions after the voice's gender has its say; ``people`` is an array of (person, name) of the visible faces.

    ``settled`` tells whether all speakers are identified or the gender is unique in the meeting.
    """
    c = F.col
    same = F.filter("people", lambda p: ~is_generic(p["name"]) & (gender_of(p["name"]) == c("gender")))
    only = F.when(F.size(same) == 1, F.get(same, F.lit(0)))
    assigned = c("speaker_name")
    visual = c("decision").rlike("^(ASD|FACE_ONLY|SINGLE_FACE|SESSION_HINT)")
    active = c("settled") & c("gender").isNotNull()
    others = F.filter(same, lambda p: ~p["person"].eqNullSafe(c("person")))
    wrong = assigned.isNotNull() & ~is_generic(assigned) & gender_of(assigned).isNotNull() & (gender_of(assigned) != c("gender"))
    face = active & c("decision").isin("SESSION_HINT", "SESSION_TRACKER") & (F.size("people") >= 2) & only.isNotNull()
    reroute_generic = active & visual & assigned.isNotNull() & is_generic(assigned) & F.startswith(c("decision"), F.lit("ASD")) & only.isNotNull()
    reroute = active & visual & wrong & (F.size(others) > 0)
    hinted = active & visual & wrong & (c("raw_conf") >= HINT) & (gender_of(c("raw_name")) == c("gender"))
    label = F.when(face, "GENDER_FACE").when(reroute_generic | reroute, "GENDER_REROUTE").when(hinted, "GENDER_VERIFIER_HINT").when(active & visual & wrong, "GENDER_OVERRIDE").otherwise(c("decision"))
    name = F.when(face | reroute_generic, only["name"]).when(reroute, F.get(others, F.lit(0))["name"]).when(hinted, c("raw_name")).when(active & visual & wrong, F.lit(None).cast("string")).otherwise(assigned)
    return decided.withColumn("final_decision", label).withColumn("final_name", name)
