import os
import random

import numpy as np
import pytest
import tiktoken

from confab.llm import fst, packing, tokens

DOCS = "doc_id bigint, text string, tokens bigint, tokenizer string, lang string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    ranks = fst.load_ranks(os.path.join(fst.DEFAULT_FOLDER, "byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_agrees_with_the_library(library):
    own, rng = fst.transducer("byte_bpe_50k"), random.Random(5)
    alphabet = "abcdeéçãÀ  \n\t 　 12²½Ⅷ٣漢字カ🙂👩‍👧​.,!?-_'\"’s't're<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["a" * 20000, " " * 3000, "<|endoftext|>", "x" * 7 + "\n" * 50]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t


def test_other_rank_file():
    own = fst.transducer("byte_bpe_multi_50k")
    assert own.decode(own.encode("Olá, 世界! नमस्ते")) == "Olá, 世界! नमस्ते"


def test_utf8_machine_matches_python_on_any_cut():
    rng = random.Random(6)
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        m, out, at = fst.Utf8Machine(), [], 0
        while at < len(data):
            step = rng.randint(1, 3)
            out.append(m.feed(data[at : at + step]))
            at += step
        assert "".join([*out, m.end()]) == data.decode("utf-8", "replace")


def test_ids_of_a_table(spark, library):
    texts = ["Olá mundo", "", None, "   ", "palavra " * 50_000, "Olá mundo"]
    df = spark.createDataFrame([(i, t, 0, "t", "pt") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokens.token_ids(df.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in tokens.token_texts(tokens.token_ids(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["word_bpe_49k", "piece_bpe_32k", "byte_bpe_50k"])
def test_counts_by_every_tokenizer(spark, name):
    df = spark.createDataFrame([(1, "Olá mundo", 0, "", ""), (2, None, 0, "", "")], DOCS)
    got = {r.doc_id: r.tokens for r in tokens.token_counts(df, name).collect()}
    assert got[1] > 0 and got[2] == 0
    with pytest.raises(ValueError, match="no public tokenizer"):
        fst.counter("other")


def test_packing_is_valid_and_tight(spark):
    rng = random.Random(7)
    texts = ["", None, "palavra " * 3000] + [" ".join(rng.choice(["cabo", "sala", "mesa", "voz"]) for _ in range(rng.randint(1, 400))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 0, "x", "pt") for i, t in enumerate(texts)], DOCS)
    windows = spark.createDataFrame([("small", "byte_bpe_50k", 256), ("large", "byte_bpe_50k", 2048), ("none", "byte_bpe_50k", None), ("zero", "byte_bpe_50k", 0)], "window_name string, tokenizer string, capacity_tokens bigint")
    rows = packing.pack_documents(df, windows).toPandas()
    assert set(rows.window_name) == {"small", "large"}
    count = fst.counter("byte_bpe_50k")
    for name, capacity in (("small", 256), ("large", 2048)):
        own = rows[rows.window_name == name]
        fill = own.groupby("container_id").tokens.sum()
        assert fill.max() <= capacity and fill.sum() / (len(fill) * capacity) > 0.97
        for i, part in own.groupby("doc_id"):
            n, part = count(texts[i]), part.sort_values("piece")
            assert part.tokens.sum() == n and (len(part) == 1 or n > capacity)
            assert part.start_token.tolist() == np.concatenate([[0], part.tokens.cumsum()[:-1]]).tolist()
    assert packing.pack_documents(df.limit(0), windows).count() == 0
    assert packing.pack_documents(df, windows.limit(0)).count() == 0


def test_containers_balance_cost():
    sizes = np.array([9, 8, 7, 6, 5, 4, 3, 2, 2, 2])
    placed, used = packing.assign(-np.sort(-sizes), 12, 1.0)
    loads = np.bincount(placed, weights=-np.sort(-sizes))
    assert used <= 5 and loads.max() <= 12 and loads.sum() == sizes.sum()


def test_repeated_long_documents_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(i, "palavra " * 600, 0, "x", "pt") for i in (1, 1, 2, None)], DOCS)
    windows = spark.createDataFrame([("w", "byte_bpe_50k", 256)], "window_name string, tokenizer string, capacity_tokens bigint")
    first, second = (packing.pack_documents(df.repartition(n), windows).toPandas() for n in (1, 3))
    full = first[first.tokens == 256]
    assert len(full) == full.container_id.nunique() and set(first.container_id) == set(second.container_id)
    assert first.groupby("container_id").tokens.sum().max() <= 256


def test_the_cost_rule_leaves_little_room():
    rng = np.random.default_rng(9)
    for capacity in (256, 2048):
        sizes = np.minimum(rng.lognormal(4.5, 1.0, 4000).astype(np.int64) + 1, capacity - 1)
        placed, used = packing.assign(-np.sort(-sizes), capacity)
        assert np.bincount(placed, weights=-np.sort(-sizes)).max() <= capacity and used <= 1.005 * -(-sizes.sum() // capacity)
