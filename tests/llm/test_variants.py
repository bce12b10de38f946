import pytest

from confab.llm import variants as V

SAME = [
    ["Juliana Melbangre Suquanclan", "juluana melbangre suquanclan", "Ju Melbangte Siquanclan", "SR. JULIANA MELBANGRE", "Suquanclan, Juliana Melbangre", "Juliana de Melbangre Suquanclan"],
    ["Roberto Dorerel Bachindel", "ROBERTO BACHINDEL DOREREL", "rdorerel", "Robertho Dorerel", 'Roberto "Beto" Dorerel'],
    ["Instituto Gimorror e Vibifan Comércio Ltda", "INSTITUTO GIMORROR & VIBIFAN COEMRCIO LTDA", "Instotuto Gimorror-Vibifan"],
    ["Henrique Sorjorgin Fejutrin Júnior", "Henrique Sorjorgin Fejutrin Junior"],
]
APART = ["Ingrid Melbangre Suquanclan", "Henrique Sorjorgin Fejutrin", "Person_1", "Person_2", "spk_001", "Unknown_3", "Desconhecido_7", "", "   ", None, "***", "Zuleica Gorprusa"]


def test_groups(spark):
    names = [n for g in SAME for n in g] + APART
    df = spark.createDataFrame([(i, n, "a", "b", 1) for i, n in enumerate(names)], "id bigint, name string, key string, person string, form int")
    got = {(r.id_a, r.id_b) for r in V.variant_pairs(df).collect()}
    want, at = set(), 0
    for g in SAME:
        ids = range(at, at + len(g))
        want |= {(a, b) for a in ids for b in ids if a < b}
        at += len(g)
    assert got == want


def test_equal_spellings_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "Ana Brinta"), (2, "ana  brinta"), (2, "ana  brinta"), (3, "Bia Corvo Delta")], "id bigint, name string")
    assert {(r.id_a, r.id_b) for r in V.variant_pairs(df).collect()} == {(1, 2)}
    assert V.variant_pairs(spark.createDataFrame([], "id bigint, name string")).count() == 0


@pytest.mark.parametrize(("a", "b", "same"), [("Ana Prelbro Dantelu", "Ana Dantelu Prelbro", 2), ("Ana Prelbro Dantelu", "A. Prelbro Dantelu", 1), ("Ana Prelbro Dantelu", "Bia Prelbro Dantelu", 0), ("Ana Prelbro Dantelu", "Ana Prelbro Dantelu Neto", 0), ("Ana Prelbro Dantelu", "Ana Prelbro Zorlifan", 0), ("Ana Prelbro", "Ana Prelbro Dantelu", 1)])
def test_comparison(a, b, same):
    assert V.compare(V.parse(a.lower()), V.parse(b.lower())) == same


def test_common_forms_need_the_second_family_name(spark, monkeypatch):
    monkeypatch.setattr(V, "RARE", 2)
    names = [f"Ana Silva {x}" for x in ("Corvoleta", "Dantelurro", "Erlimbado", "Fortunquel")] + ["Ana Silva Corvolleta"]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    assert {(r.id_a, r.id_b) for r in V.variant_pairs(df).collect()} == {(0, 4)}


def test_common_forms_lose_no_pair(spark, monkeypatch):
    names = ["Ana Silva", "A. Silva", "asilva", "Ana Sillva", "Antonio Silva", "Abel Silva Neto", "Andreia Silva", "Ana Silva Corvoleta", "Ana Silva Corvolleta", "Ana Silva Corvoleta Neto", "Ana Sliva Crvoleta", "Robert Silva Dantelu", "Roberto Silva Dantelu", "Rober Silva", "Silva Corvo Ltda", "Silva & Corvo Ltda.", "Ana Dorerel", "adorerel", "Ana Dorrerel"]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    keys = V.spellings(df)[0].cache()
    spelled = {r.key: r.spelling for r in keys.collect()}
    alike = lambda: {(r.a, r.b) for r in V.candidates(keys).collect() if V.compare(V.parse(spelled[r.a]), V.parse(spelled[r.b]))}
    small, want = alike(), {(r.id_a, r.id_b) for r in V.variant_pairs(df).collect()}
    monkeypatch.setattr(V, "RARE", 2)
    assert alike() == small and {(0, 1), (7, 8), (16, 17)} <= small
    assert {(r.id_a, r.id_b) for r in V.variant_pairs(df).collect()} == want


def test_more_than_64_spellings_of_a_form(spark):
    family = [f"Silva{a}{b}" for a in "bcdfgjlm" for b in "aeiou"]
    names = [f"Ana Dorerel {f.lower()}" for f in family] + [f"Bia Dorerel {f.lower()}x" for f in family] + [f"Alice Dorerel {f.lower()}r" for f in family] + ["Augusto Dorerel", "Augustto Dorerel"]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    assert (120, 121) in {(r.id_a, r.id_b) for r in V.variant_pairs(df).collect()}
