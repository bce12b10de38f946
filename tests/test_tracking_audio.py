import itertools

import numpy as np
import pytest

from confab.functions import audio
from confab.operators import tracking as K
from confab.operators.dialogue import RepeatFilter, VoteBox


def test_hungarian_is_cheapest():
    rng = np.random.default_rng(3)
    for n in range(1, 6):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        got = K.hungarian(cost)
        assert sorted(got) == list(range(n)) and sum(cost[i, got[i]] for i in range(n)) == pytest.approx(best)


def test_pairs_below_the_limit():
    pairs, rows, cols = K.match_pairs(np.array([[0.1, 0.9], [0.8, 0.95]]), 0.7)
    assert pairs == [(0, 0)] and rows == [1] and cols == [1]
    assert K.match_pairs(np.zeros((0, 2)), 0.5) == ([], [], [0, 1])


def test_tracker_keeps_ids_and_needs_a_second_sight():
    t, box = K.FaceTracker(), np.array([[0.0, 0, 50, 80]])
    assert [x.id for x in t.take(box, np.array([0.9]))] == [1]
    two = np.array([[2.0, 1, 52, 81], [200, 0, 250, 80]])
    assert [x.id for x in t.take(two, np.array([0.9, 0.8]))] == [1]
    assert [x.id for x in t.take(two + 1, np.array([0.9, 0.8]))] == [1, 2]
    assert t.take(np.zeros((0, 4)), np.zeros(0)) == [] and t.frame == 3
    assert [x.id for x in t.take(two[:1] + 2, np.array([0.3]))] == [1]  # a faint detection keeps a track
    assert [x.id for x in t.take(two + 3, np.array([0.05, 0.9]))] == [2]  # too faint to count
    assert sorted(x.id for x in t.take(two + 5, np.array([0.9, 0.9]))) == [1, 2]  # a lost track comes back under its id


def test_suppression():
    boxes = np.array([[0.0, 0, 10, 10], [1, 1, 11, 11], [50, 50, 60, 60]])
    assert K.suppress(boxes, np.array([0.8, 0.9, 0.5])) == [1, 2]


def test_names_need_five_frames_and_strangers_enrol():
    a, b = np.array([1.0, 0, 0]), np.array([0.0, 0, 1.0])
    n = K.FaceNamer(known={"Ana": a})
    names = [n.take(i / 30, {1: a})[1][0] for i in range(6)]
    assert names == ["Unknown"] * 4 + ["Ana"] * 2
    assert n.take(1.0, {1: a, 2: a})[2][0] == "Unknown"  # one name, one face
    for i in range(120):
        last = n.take(2 + i / 30, {3: b})[3][0]
    assert last == "Person_1" and "Person_1" in n.known


@pytest.mark.parametrize(("hz", "gender"), [(110, "male"), (220, "female"), (148, None)])
def test_pitch_gender(hz, gender):
    t = np.arange(16000) / 16000
    assert audio.voice_gender(0.4 * np.sin(2 * np.pi * hz * t) + 0.1 * np.sin(4 * np.pi * hz * t)) == gender


def test_short_signals_have_no_gender():
    assert audio.voice_gender(np.zeros(100)) is None


def test_loudness():
    x = np.full(1000, 0.5)
    assert np.sqrt(np.mean(audio.loudness(x) ** 2)) == pytest.approx(0.1)
    spike = np.zeros(100000)
    spike[5] = 1.0
    assert np.abs(audio.loudness(spike)).max() <= 1 and (audio.loudness(np.zeros(10)) == 0).all()


def test_speech_spans():
    p = np.array([0.1] * 10 + [0.9] * 40 + [0.1] * 30 + [0.9] * 20)
    spans = audio.speech_spans(p, len(p) * 512)
    assert len(spans) == 2 and spans[0][0] == 10 * 512 - 4800 and spans[-1][1] == len(p) * 512
    assert audio.speech_spans(np.zeros(50), 50 * 512) == []
    assert len(audio.speech_spans(np.full(200, 0.9), 200 * 512, most_s=2.0)) > 1


def test_repeats_are_dropped_only_soon():
    f = RepeatFilter()
    assert f.keep(0, "Bom dia a todos") and not f.keep(2, "bom dia, a todos!") and f.keep(32, "Bom dia a todos")


def test_votes_name_the_next_speaker():
    v = VoteBox()
    assert v.take(0, "a", "Bia") is None
    assert v.take(5, "b", None) is None  # two votes
    assert v.take(6, "a", "Bia") is None and v.take(9, "b", None) == "Bia"
    late = VoteBox()
    late.take(0, "a", "Bia")
    late.take(40, "b", None)
    assert late.votes == {}
