"""Queries that SQL can't say well, against plain Python over the whole smallest tables."""

import difflib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from confab.functions import codes
from confab.functions import wordlists as W
from confab.plans import catalogue

QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def tables(data):
    return lambda name: pd.read_parquet(f"{data}/{name}.parquet")


def rows(spark, data, name, *columns):
    got = QUERIES[name](spark, data).toPandas()
    return sorted(map(tuple, got[list(columns)].astype(object).where(got[list(columns)].notna(), None).to_numpy().tolist()), key=str)


def unit(v):
    return np.asarray(v, float) / np.linalg.norm(v)


def usable(tables, name="voice_embeddings", dim=192):
    v = tables(name)
    return v[[a == 1 and e is not None and len(e) == dim and np.any(e) for a, e in zip(v.is_active, v.embedding)]].sort_values("id")


def likeness(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_near_duplicates(spark, data, tables):
    s, want = tables("segments"), []
    s = s[s.text.notna() & s.seg_index.notna()].sort_values(["seg_index", "id"], kind="stable")
    for pk, part in s.groupby("session_pk"):
        kept = []
        for i, at, text in zip(part.id, part.seg_index * 2.0, part.text):
            bare = re.sub(r"[^\w\s]", "", text.lower()).strip()
            if not any(at - t <= 5 and likeness(bare, other) >= 0.8 for t, other in kept[-6:]):
                kept.append((at, bare))
                want.append((pk, i))
    assert rows(spark, data, "near_duplicates", "session_pk", "id") == sorted(want, key=str)


def test_prompt_echo(spark, data, tables):
    s = tables("segments").dropna(subset=["text"])
    got = QUERIES["prompt_echo"](spark, data).toPandas().set_index("id")
    for i, text in zip(s.id, s.text):
        assert got.likeness[i] == pytest.approx(likeness(text.lower(), W.PROMPTS["pt"].lower()), abs=1e-6) and got.echo[i] == (got.likeness[i] > 0.6)


def test_compression_ratio(spark, data, tables):
    s, got = tables("segments"), QUERIES["compression_ratio"](spark, data).toPandas().set_index("id").ratio
    for i, text in zip(s.id, s.text):
        data_ = (text or "").encode()
        assert pd.isna(got[i]) if text is None else got[i] == pytest.approx(len(data_) / len(zlib.compress(data_)) if data_ else 0, abs=1e-6)


def edits(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return int(d[-1, -1])


def words(text):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").strip().lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"\w+", plain)


def test_word_error_rate(spark, data, tables):
    lines, got = tables("validation_lines"), QUERIES["word_error_rate"](spark, data).toPandas().set_index("validation_id")
    for v, part in lines.groupby("validation_id"):
        errors, n = sum(edits(words(c), words(p)) for c, p in zip(part.corrected, part.predicted)), sum(len(words(c)) for c in part.corrected)
        assert (got.errors[v], got.words[v]) == (errors, n) and (n == 0 or got["rate"][v] == pytest.approx(errors / n, abs=1e-6))


def test_session_tracker(spark, data, tables):
    v, want = usable(tables), []
    for session, part in v.groupby(v.id % 20):
        voices = []
        for i, e in zip(part.id, part.embedding):
            fits = [float(unit(e) @ k) for k in voices]
            best = int(np.argmax(fits)) if fits else -1
            if best >= 0 and fits[best] >= 0.45:
                voices[best] = 0.9 * voices[best] + 0.1 * unit(e)
            elif not (best >= 0 and len(voices) >= 6 and fits[best] >= 0.2):
                voices.append(unit(e))
                best = len(voices) - 1
            want.append((session, i, f"spk_{best:03d}"))
    assert rows(spark, data, "session_tracker", "session", "id", "speaker") == sorted(want, key=str)


def test_auto_enroll(spark, data, tables):
    v, want = usable(tables), []
    for speaker, part in v.groupby("speaker_id"):
        kept, last = [], None
        for i, e in zip(part.id, part.embedding):
            mean = unit(np.mean(kept, axis=0)) if kept else None
            if (last is None or i * 120 - last >= 300) and len(kept) < 8 and (mean is None or 0.65 <= float(unit(e) @ mean) <= 0.96):
                kept.append(unit(e))
                last = i * 120
                want.append((speaker, i))
    assert rows(spark, data, "auto_enroll", "speaker_id", "id") == sorted(want, key=str)


def test_homonym_split(spark, data, tables):
    v, want = usable(tables), []
    v = v.assign(name=[f"V{s % 7}-{s % 50}" for s in v.speaker_id])
    for name, part in v.groupby("name"):
        groups = []
        for i, e in zip(part.id, part.embedding):
            fits = [float(unit(e) @ unit(np.mean(g, axis=0))) for g in groups]
            best = int(np.argmax(fits)) if fits else -1
            if best < 0 or fits[best] < 0.2:
                groups.append([])
                best = len(groups) - 1
            groups[best].append(np.asarray(e, float))
            want.append((name, i, name if best == 0 else f"{name} {best + 1}"))
    assert rows(spark, data, "homonym_split", "name", "id", "key") == sorted(want, key=str)


def test_merged_turns(spark, data, tables):
    v, want = tables("embeddings").sort_values("vec_id"), []
    for session, part in v.groupby(v.vec_id % 10):
        group, slot, head = -1, None, None
        for i, e in zip(part.vec_id, part.embedding):
            own, voice = i // 30 % 2, np.asarray(e, float) if i % 9 else None
            if group < 0 or own != slot or not (head is None or voice is None or float(voice @ head) >= 0.4):
                group, slot, head = group + 1, own, voice
            want.append((session, i, group))
    assert rows(spark, data, "merged_turns", "session", "ord", "group_no") == sorted(want, key=str)


def test_merged_identities_join_like_ones(spark, data, tables):
    v = usable(tables)
    held = {f"{'Voz ' if i % 2 else 'Person_'}{i}": unit(e) for i, e in zip(v.id, v.embedding)}
    got = QUERIES["merged_identities"](spark, data).toPandas()
    assert len(got) and not got.name.duplicated().any() and set(got.name) <= set(held)
    assert all(a.startswith("Person_") or b.startswith("Person_") for a, b in zip(got.name, got.into))


def test_box_suppression_leaves_no_overlap(spark, data):
    got = QUERIES["box_suppression"](spark, data).toPandas()
    assert len(got) and not got.duplicated(["frame", "det"]).any()


def murmur3(data, seed):
    mask, rot = (1 << 64) - 1, lambda x, r: (x << r | x >> 64 - r) & ((1 << 64) - 1)

    def mix(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & mask
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & mask
        return h ^ h >> 33

    a = b = seed
    k = int.from_bytes(data, "little")
    a ^= rot(k * 0x87C37B91114253D5 & mask, 31) * 0x4CF5AD432745937F & mask
    a, b = a ^ len(data), b ^ len(data)
    a = a + b & mask
    b = a + b & mask
    a, b = mix(a), mix(b)
    a = a + b & mask
    b = a + b & mask
    return [a & 0xFFFFFFFF, a >> 32, b & 0xFFFFFFFF, b >> 32]


def test_bucket_keys():
    ids = [0, 1, 2**64 - 1, 0x0123456789ABCDEF]
    for seed in (0, 8, 15):
        assert codes.bucket_keys(np.array(ids, np.uint64), seed).tolist() == [murmur3(i.to_bytes(8, "little"), seed) for i in ids]


def test_token_codes(spark, data, tables):
    got = QUERIES["token_codes"](spark, data).toPandas()
    s = tables("speakers").set_index("id").name
    assert all(ast == repr(re.split(r"[ \t\n\x0b\x0c\r]+", s[i])[n]) for i, n, ast in zip(got.id, got.n, got["repr"]))
    assert all(len(h.split("/")) == 4 for h in got.buckets)
