import random

import pytest

from confab.llm import spam as S

GOODS = ["webcam 4k", "cabo hdmi", "mesa de som", "tripé dobrável", "barra de vídeo"]
WORDS = ["comprar", "barato", "oferta", "frete grátis", "promoção", "loja"]
SENTENCES = ["A diretoria pediu para validar tudo na segunda.", "O cabo da câmera ficou confuso no auditório.", "Quem vai medir o tempo de resposta antes da visita?", "Sem o plano de testes, o sistema confunde duas pessoas."]
rng = random.Random(8)
key = lambda: f"{rng.choice(GOODS)} {rng.choice(WORDS)}" if rng.random() < 0.6 else rng.choice(GOODS)
SPAM = {
    "list": "\n".join(key() for _ in range(40)), "bars": " | ".join(key() for _ in range(60)), "one": "tripé dobrável " * 40,
    "sentences": " ".join(f"Procurando {g}? Temos {g} comprar, {g} barato e {g} oferta." for g in GOODS * 3),
    "links": "\n".join(f"{k}. {key()}: https://loja{k}.example/a/b?id={k}" for k in range(20)), "tags": "Tags: " + ", ".join(key().replace(" ", "_") for _ in range(30)),
    "hash": " ".join("#" + key().title().replace(" ", "") for _ in range(30)), "menu": "\n".join(f"Categorias > {rng.choice(GOODS)} > {rng.choice(GOODS)}" for _ in range(20)),
    "prices": "\n".join(f"{key()} | Ref. BR-{k}12 | R$ {k}23,90 | {k}% off" for k in range(15)), "masked": "\n".join(key().replace("a", "@").replace("o", "0") for _ in range(40)),
}
FINE = {
    "prose": " ".join(rng.choice(SENTENCES) for _ in range(20)), "attendance": "Presentes\n" + "\n".join(f"{k}. Ana Corvo{k} - {rng.choice(['ok', 'presente', 'remoto'])}" for k in range(1, 20)),
    "parameters": "\n".join(f"vad_{w}_{k} = {k}.5" for k in range(10) for w in ("pad", "window")), "review": "Webcam 4k\n\n" + " ".join("O preço de webcam 4k subiu, mas ainda vale comprar para salas pequenas." for _ in range(6)),
    "ends in tags": " ".join(rng.choice(SENTENCES) for _ in range(10)) + "\n\nTags: webcam 4k, cabo hdmi, mesa de som", "ends in links": " ".join(rng.choice(SENTENCES) for _ in range(10)) + "\n\n- https://a.example/b\n- https://c.example/d",
    "glossary": "\n".join(f"{g}: {rng.choice(SENTENCES)}" for g in GOODS * 2), "agenda": "Pauta\n" + "\n".join(f"09:{k:02d} {rng.choice(SENTENCES)} (Ana)" for k in range(10, 20)), "chat": "\n".join(["Ana: ok, ok.", "Bia: sim, sim, sim."] * 8),
}


@pytest.mark.parametrize("kind", SPAM)
def test_spam_share(kind):
    assert S.keyword_share(SPAM[kind])[0] > 0.5


@pytest.mark.parametrize("kind", FINE)
def test_fine_share(kind):
    assert S.keyword_share(FINE[kind])[0] <= 0.5


def test_table(spark):
    rows = [(i, "pt", t) for i, t in enumerate([*SPAM.values(), *FINE.values()] + [" ".join(rng.choice(SENTENCES) for _ in range(rng.randint(2, 30))) for _ in range(80)])]
    rows += [(1000, "pt", SPAM["list"]), (1001, None, SPAM["bars"]), (1002, "xx", None), (1003, "pt", ""), (1004, "pt", "  \n"), (None, "pt", "oi"), (1005, "pt", "cabo hdmi"), (1006, "pt", "comprar cabo hdmi barato oferta " * 20_000)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id bigint, lang string, text string, words int, ends double")
    got = {r.doc_id for r in S.spam_pages(df).collect()}
    assert got == {*range(len(SPAM)), 1000, 1001, 1006}
    assert S.spam_pages(df.limit(0)).count() == 0
