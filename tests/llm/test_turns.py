from collections import Counter

import pytest

from confab.llm import turns as T

SESSIONS = "id bigint, transcript string, session_pk bigint, speaker string"
SEGMENTS = "id bigint, session_pk bigint, seg_index bigint, speaker_name string, text string, timestamp string, block int"


def found(spark, transcripts, segments=()):
    sessions = spark.createDataFrame([(i, t, 5, "z") for i, t in transcripts.items()], SESSIONS)
    segs = spark.createDataFrame([(i, s, k, n, x, None, 0) for i, (s, k, n, x) in enumerate(segments)], SEGMENTS)
    return sorted((r.session_pk, r.first_line, r.last_line) for r in T.speaker_turns(sessions, segs).collect())


LAYOUTS = {
    "bracket": "[10:00:00] Ana Lima: bom dia\n[10:00:05] Ana: hmm\n[10:00:09] Bruno Sá: [risos]\n[10:00:12] ana lima: continuando\n    e mais isto\n[10:00:20] Bruno: certo então",
    "behind": "Ana Lima (10:00:00): bom dia\nAna (10:00:05): hmm\nBruno Sá (10:00:09): [risos]\nana lima (10:00:12): continuando\n    e mais isto\nBruno (10:00:20): certo então",
    "dash": "(10:00) Ana Lima - bom dia\n(10:00) Ana - hmm\n(10:00) Bruno Sá - [risos]\n(10:00) ana lima - continuando\n    e mais isto\n(10:01) Bruno - certo então",
    "bars": "10:00:00 | Ana Lima | bom dia\n10:00:05 | Ana | hmm\n10:00:09 | Bruno Sá | [risos]\n10:00:12 | ana lima | continuando\n    e mais isto\n10:00:20 | Bruno | certo então",
    "plain": "Ana Lima: bom dia\nAna: hmm\nBruno Sá: [risos]\nana lima: continuando\n    e mais isto\nBruno: certo então",
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_layouts(spark, layout, end):
    assert found(spark, {1: LAYOUTS[layout].replace("\n", end)}) == [(1, 0, 4), (1, 5, 5)]


def test_voice_tags_headings_and_cues(spark):
    vtt = "WEBVTT\n\n1\n00:00:00.000 --> 00:00:02.000\n<v Ana Lima>bom dia</v>\n\n2\n00:00:03.000 --> 00:00:04.000\n<v Bruno>certo\nvamos lá"
    marks = "# Session 2\nParticipantes: Ana Lima, Bruno Sá\n\n[00:00:00]\nAna Lima: bom dia\n♪♪\n[00:00:30]\nBruno: certo"
    assert found(spark, {1: vtt, 2: marks}) == [(1, 4, 4), (1, 8, 9), (2, 4, 4), (2, 7, 7)]


def test_order_of_time_and_midnight(spark):
    late = "[23:59:50] Ana: antes\n[00:00:10] Bruno: depois\n[00:00:05] Ana: entre\n[00:00:20] Bruno: fim"
    assert found(spark, {1: late}) == [(1, 0, 2), (1, 1, 3)]


def test_segments_take_the_place_of_lines(spark):
    segs = [(1, 0, "Ana", "oi"), (1, 1, "ana.", "[música]"), (1, 2, "Bia", "uhum"), (1, 3, "ANA", "sim"), (1, 3, "Bia", "repetida"), (1, 4, None, "quem"), (1, 5, None, "sou"), (1, 6, "Ana", None), (2, 0, "Ana", "com transcrito")]
    assert found(spark, {1: None, 2: "Ana: fala"}, segs) == [(1, 0, 3), (1, 4, 4), (1, 5, 5), (2, 0, 0)]


def test_empty_and_odd_transcripts(spark):
    long = "Ana: " + "palavra " * 200_000
    assert found(spark, {1: "", 2: "   \n\n", 3: "sem rótulo algum", 4: long, 5: "Ana: hmm, hã..."}) == [(4, 0, 0)]
    assert found(spark, {}) == []


def test_turns_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    segs = [(1, k, "Ana" if k < 11 else "Bia" if k < 13 else "Ana", "fala") for k in range(15)]
    assert found(spark, {1: None}, segs) == [(1, 0, 10), (1, 11, 12), (1, 13, 14)]


def test_labels_of_one_participant():
    labels = Counter({"juliana melbangre suquanclan": 3, "juliana": 2, "j melbangre": 1, "suquanclan": 1, "juliana m": 1, "julianna melbangre": 1, "bruno 2": 2, "bruno": 2, "spk 001": 1, "spk 002": 1})
    home = T.resolve(labels, [])
    assert len({home[k] for k in labels if k.startswith(("ju", "j ", "suq"))}) == 1
    assert len({home["bruno 2"], home["bruno"], home["spk 001"], home["spk 002"]}) == 4


@pytest.mark.parametrize(("text", "left"), [("[risos] bom (aplausos) dia", "bom dia"), ("Hmm, vamos ♪♪ lá", "vamos lá"), ("um cabo novo", "um cabo novo"), ("ééé... hã?", ""), ("[texto incerto] certo", "certo")])
def test_cleaning(text, left):
    assert T.clean(text).rstrip("?.! ") == left and T.has_speech(text) == bool(left)
