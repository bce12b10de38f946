import pytest
from pyspark.sql import functions as F

from confab.functions import text as T


@pytest.mark.parametrize(
    ("text", "logprob", "silence", "accepted"),
    [
        ("Thank you. Thank you. Thank you.", -0.2, 0.0, False), ("Thank you. Thanks a lot. Thank you.", -0.2, 0.0, True), ("Música.", -0.2, 0.0, False), ("Yes, right.", -1.2, 0.0, False), ("Yes, right.", -0.2, 0.4, False),
        ("Yes, right.", -0.2, 0.1, True), ("a de a parte de a parte de a parte de a parte fim", -0.2, 0.0, False), ("Bom", -0.1, 0.0, False), ("Legendas pela comunidade", -0.1, 0.0, False), ("A reunião começa às nove horas", -0.1, 0.6, False),
    ],
)
def test_transcript_filter(spark, text, logprob, silence, accepted):
    row = spark.createDataFrame([(text, logprob, silence)], "t string, l double, n double").select(T.rejection(F.col("t"), F.col("l"), F.col("n")).alias("r")).first()
    assert (row.r is None) == accepted


def test_ratio_has_no_junk_heuristics():
    assert T.ratio("", "") == 1.0
    assert T.ratio("abcd", "bcde") == 0.75
    assert T.ratio("a" * 300, "a" * 300 + "b") > 0.99


def test_python_spellings():
    assert T.title("d'artagnan maria-clara") == "D'Artagnan Maria-Clara"
    assert T.slug("  João & Maria!") == "joao_maria" and T.slug("***") == "voice"
    assert T.for_gender("Manoel Souza", "female") == "Manuela Souza" and T.for_gender("Bruno  Lima", "female") == "Bruna Lima"
    assert T.for_gender("Bruno  Lima", None) == "Bruno  Lima"
    assert T.word_errors("a casa é azul", "a casa azul") == (1, 4) and T.word_errors("", "x") == (1, 0)


def test_names_in_text(spark):
    rows = spark.createDataFrame([("Olá, meu nome é Laura Dias.",), ("eu sou Professor aqui",), ("I'm David, hello",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.introduced_name(F.col("t"))).collect()] == ["Laura Dias", None, "David", None]
    rows = spark.createDataFrame([("Arthur, pode falar",), ("Pode falar, Arthur.",), ("Yeah, sure",), ("fala Manu",), ("a parte do Kauan",)], "t string")
    assert [r[0] for r in rows.select(T.addressee(F.col("t"))).collect()][:3] == ["Arthur", "Arthur", None]
    assert rows.select(T.mentions(F.col("t")).alias("m")).collect()[4].m == ["Kauan"]


def test_gender_of_first_name(spark):
    rows = spark.createDataFrame([("João Silva",), ("MARIA  Lima",), ("Zorbrel",), (None,), ("",)], "n string")
    assert [r[0] for r in rows.select(T.gender_of(F.col("n"))).collect()] == ["male", "female", None, None, None]
