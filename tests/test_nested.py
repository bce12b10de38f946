import json

import pytest

from confab.operators import nested

SEGMENTS = "id bigint, metrics_json string, parent_id bigint, candidates string"  # the last two clash with names of the result


def rows(spark, docs):
    df = spark.createDataFrame([(i, d, 7, "x") for i, d in enumerate(docs)], SEGMENTS)
    return sorted(tuple(r) for r in nested.all_children(df, True).collect())


def test_notations_of_one_record_agree(spark):
    record = {"candidates": [["A", 0.5], None, ["B's \"x\"", 0.4]], "fn_reasons": ["ONE"], "fp_reasons": []}
    plain = json.dumps(record)
    variants = [plain, "﻿" + json.dumps(record, indent=1) + "\n", json.dumps(plain), repr(record), plain.replace("candidates", "candidates")]
    got = rows(spark, variants)
    one = [("candidate", "0"), ("candidate", "2"), ("fn_reason", "0")]
    assert got == sorted((c, i, p) for i in range(len(variants)) for c, p in one)


@pytest.mark.parametrize(
    ("value", "positions"),
    [
        ([], []), (None, []), ({"name": "A", "score": 1}, ["0"]), ({"A": 0.1, "B": None, "C": 0.2}, ["0", "2"]), ('[["A", 0.5], ["B", 0.2]]', ["0", "1"]), (["A", 0.5], ["0"]), ("A | B", ["0", "1"]),
        ([{"name": "A"}, None, {"name": "B"}], ["0", "2"]),
    ],
)
def test_forms_of_candidates(spark, value, positions):
    assert [p for _, _, p in rows(spark, [json.dumps({"candidates": value})])] == positions


def test_damaged_null_and_blank_texts_have_no_rows(spark):
    whole = json.dumps({"candidates": [["A", 0.5]], "fn_reasons": ["ONE", "TWO"]})
    assert rows(spark, [whole[:k] for k in range(0, len(whole))] + [None, "", "  ", "null", "[]", "7"]) == []


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_sessions_children_and_positions(spark):
    summary = {"decisionCounts": [{"type": "ASD", "count": 2}, {"type": "FACE", "count": 1}], "face": {"faceFnEvents": [{"event": "enroll"}, None, {"event": "enroll", "votes": {"A": 1, "B": 2}}]}}
    config = {"devices": {"device": "mesa", "channels": {"no": 0, "gainDb": 1.5}}}
    df = spark.createDataFrame([(1, json.dumps(summary), json.dumps(config)), (2, None, "{"), (3, json.dumps({"decision_counts": {"ASD": 4}, "face": None}), json.dumps({"devices": [{"device": "a", "channels": [{"no": 0}, {"no": 1}]}]}))], "id bigint, summary string, config string")
    got = sorted(tuple(r) for r in nested.all_children(df, False).collect())
    assert got == sorted(
        [("decision_count", 1, "ASD"), ("decision_count", 1, "FACE"), ("face_event", 1, "0"), ("face_event", 1, "2"), ("face_vote", 1, "2.0"), ("face_vote", 1, "2.1"), ("device", 1, "0"), ("channel", 1, "0.0")]
        + [("decision_count", 3, "ASD"), ("device", 3, "0"), ("channel", 3, "0.0"), ("channel", 3, "0.1")]
    )
    gains = nested.child_table(df, "channel").select("parent_id", "gain_db").collect()
    assert (1, 1.5) in [tuple(r) for r in gains]
    votes = [tuple(r) for r in nested.child_table(df, "face_vote").select("event_pos", "name", "n").collect()]
    assert sorted(votes) == [("2", "A", 1), ("2", "B", 2)]


def test_tables_agree_with_all_children(spark, data):
    segments, sessions = spark.read.parquet(f"{data}/segments.parquet"), spark.read.parquet(f"{data}/sessions.parquet")
    links = nested.child_links(segments, sessions)
    for child in (*nested.SEGMENT_CHILDREN, *nested.SESSION_CHILDREN):
        own = nested.child_table(segments if child in nested.SEGMENT_CHILDREN else sessions, child).select("parent_id", "pos")
        assert own.exceptAll(links.filter(f"child = '{child}'").select("parent_id", "pos")).count() == 0
