import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.functions import codes
from confab.operators import naming as N


def test_murmur_of_known_texts():
    assert codes.murmur64a(b"", 1) != codes.murmur64a(b"a", 1) and 0 <= codes.murmur64a(b"coffee is good", 1) < 1 << 64
    assert codes.murmur64a(b"", 0) == 0


@pytest.mark.parametrize(("token", "shape"), [("Ana", "Xxx"), ("reunião", "xxxx"), ("C3PO", "XdXX"), ("2024-01", "dddd-dd"), ("a" * 100, "LONG"), ("", "")])
def test_shape(token, shape):
    assert codes.word_shape(token) == shape


def test_powerset_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0],), ([0.0] * 6 + [2.0],)], "s array<double>")
    assert [r[0] for r in df.select(codes.powerset(F.col("s"))).collect()] == [[1, 0, 0], [0, 1, 1]]


def test_speaking_needs_time():
    s = N.Speaking()
    assert [s.take(t, 0.9) for t in (0.0, 0.2, 0.3)] == [False, False, True]
    assert [s.take(t, 0.1) for t in (0.4, 0.6, 0.9, 1.0)] == [True, True, False, False]


def test_turns_split_when_the_voice_changes():
    m, a, b = N.TurnMerger(), np.array([1.0, 0]), np.array([0.0, 1])
    assert [m.take(0, a), m.take(0, a), m.take(0, None), m.take(0, b), m.take(1, b)] == [0, 0, 0, 1, 2]


def test_face_names_upgrade_placeholders():
    f = N.FaceNames()
    p = f.take(1, 7, "Unknown")
    assert f.take(2, 7, "Person_3") == p and f.names[p] == "Person_3"
    assert f.take(3, 7, "Ana Lima") == p and f.names[p] == "Ana Lima" and f.take(4, 9, "Ana Lima") == p


def test_answers_never_override(spark):
    named = spark.createDataFrame([(1, "spk_000", "Ana Lima"), (1, "spk_001", "Person_1")], "session_pk bigint, speaker string, name string")
    answers = spark.createDataFrame([(1, 'x {"spk_000": "bia", "spk_001": "maria souza", "spk_002": "ana lima", "spk_003": 7} y'), (2, None), (3, "nada")], "session_pk bigint, answer string")
    assert [tuple(r) for r in N.answered(answers, named).collect()] == [(1, "spk_001", "Maria Souza")]


def test_last_speaker_is_deduced(spark):
    named = spark.createDataFrame([(1, "a", "Ana"), (1, "b", "Bia"), (1, "c", "spk_002"), (2, "a", "Ana"), (2, "b", "spk_1"), (2, "c", "spk_2")], "session_pk bigint, speaker string, name string")
    heard = spark.createDataFrame([(1, "Ana"), (1, "Caio"), (2, "Caio")], "session_pk bigint, name string")
    assert [tuple(r) for r in N.last_speakers(named, heard, 3).collect()] == [(1, "c", "Caio")]
