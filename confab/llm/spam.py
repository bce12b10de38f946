"""Keyword-stuffed pages, link lists, menus and product tags.

Measure: a text is cut into blocks; each block's compression ratio is compared
with that of all blocks of its language and length in the corpus (median and
spread by language and length class, pre-aggregated over all documents).  A
document with a block whose redundancy is extreme for its length and language
is flagged, and confirmed where it has few sentence ends for its words; an end
that comes again behind the same word counts once, so sentences that repeat a
key phrase don't pass for prose.  Both must hold.

An exact check follows: a confirmed document is read entry by entry - repeated
words of entries that end no sentence, links, marked tags, prices and sentences
that repeat their own phrases against words in other sentences - and is spam
where the former are the most.  It knows layout and repetition only, no words
of any subject.  It runs in the same pass over the texts as the measure, for
texts with few sentence ends, so texts are read once and never shuffled.

Defined cases: null, empty, blank and very short texts are never spam; copies
are judged alike; null or unknown languages form a class of their own; lists
that hold data - attendance, agendas, parameters, reports - are not key words.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.session import cut

BLOCK_CHARS = 1500  # characters of one block
REDUNDANT = 0.9  # spreads above the median of its language and length that make a block extreme
FEW_ENDS = 0.06  # different sentence ends a word below which a text hardly has sentences
LEAST_WORDS = 5
PROSE = (1.0, 12, 0.13)  # compression ratio of ordinary prose at a length class, and its growth a class; the most that a class's median may be
PRIOR = 50  # blocks of all languages that a language and length class counts beside its own
MOST_OF = 0.5
DENSE = (5, 0.05)  # how often, and with what share of the words, a text is full of a word

INVISIBLE = re.compile("[­͏؜᠎​‌‍⁠﻿]")
URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
MARKUP = re.compile(r"<a\s[^>]*>|</a>|\]\(|<[^<>]{1,200}>")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
END = re.compile(r"[.!?…][\"'”»)\]]*$")
CUT = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+")
SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[.*_\-][^\W_]){2,}(?![^\W_])")
PRICE = re.compile(r"(?:r\$|us\$|\$|€|£)\s?\d|\d\s?(?:€|eur\b|usd\b|brl\b)|\d+\s?%\s?(?:off|desc)|\bref\.?\s?[a-z0-9-]{3,}", re.I)
DATA = re.compile(r"^\s*(?:[\w.]+\s*=\s*\S+.*|\[?\d{1,2}:\d{2}.*|\d+[.)]\s+(?:[A-ZÀ-Ý][\w'’.-]+\s+){1,5}[-–—]\s*\w+.*|.*\b\w+=\S+\s+\w+=\S+.*|={5,}|-{5,}|[-*]?\s*\d+\s*x\s+.*)$")
LEET = str.maketrans("013457@$", "oieastas")
ENDING = re.compile(r"[.!?…]+[\"'”»)\]]*(?=\s|$)")
ENDED = re.compile(r"([^\W\d_]{2,})[\"'”»)\]]*$")
ABBREVIATIONS = frozenset("ref art sr sra dr dra prof vs etc nr no tel max min aprox approx".split())
SEPARATORS = re.compile(r"\s*[,;|•·»>/\n]\s*|\s+[-–—]\s+")


APART = re.compile(r"[.*_\-][^\W_][.*_\-]")
MASKED = re.compile(r"[^\W\d_][013457@$]|[013457@$][^\W\d_]")
DISGUISED = re.compile(r"[\w@$]*[013457@$][\w@$]*")
COUNTED = re.compile(r"^\d+[a-z]{1,2}$|\d{2}")  # "4k" and "1080p" are no disguise
MARKS = re.compile("[\u0300-\u036f]+")  # the only ones before U+0483


def unmasked(text: str) -> str:
    """The text as a reader sees it: compatible forms, no invisible signs, letters for look-alike digits inside words."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if APART.search(text) is not None:
        text = SPELLED.sub(lambda m: re.sub(r"[.*_\-]", "", m.group()) if re.search(r"[^\W\d_]", m.group()) else m.group(), text)
    if MASKED.search(text) is None:
        return text
    return DISGUISED.sub(lambda m: m.group().translate(LEET) if MASKED.search(m.group()) and not COUNTED.search(m.group()) else m.group(), text)


def _fold(text: str) -> str:
    low = text.lower()
    if low.isascii():
        return low
    apart = MARKS.sub("", unicodedata.normalize("NFKD", low))
    return apart if max(apart, default="") < "\u0483" else "".join(c for c in apart if not unicodedata.combining(c))


def _repeats(words: list[str]) -> float:
    """Share of words that are not new in a list of words."""
    return 1 - len(set(words)) / len(words) if words else 0.0


def _piles_up(sentence: list[str], dense: set[str]) -> bool:
    """Whether a sentence says the same thing three times - twice where the whole text is full of it - and hardly anything else."""
    if len(sentence) == len(set(sentence)):
        return False
    pairs = list(zip(sentence, sentence[1:]))
    twice = Counter(p for p in pairs if max(map(len, p)) >= 4)
    once = Counter(w for w in sentence if len(w) >= 5)
    most = max([*twice.values(), *once.values(), 0])
    if most < 2 or most < 3 and not any(n > 1 and w in dense for w, n in once.items()):
        return False
    covered = [once[w] >= 2 for w in sentence]
    for k, p in enumerate(pairs):
        if twice[p] >= 2:
            covered[k] = covered[k + 1] = True
    return sum(covered) >= 0.38 * len(sentence)


def keyword_share(text: str) -> tuple[float, int]:
    """(share of words in key words, links, menus and tags; number of words) of one text."""
    shown = unmasked(text)
    junk = total = 0
    entries: list[list[str]] = []  # short entries without an end, judged together
    sentences: list[list[str]] = []
    for line in shown.split("\n"):
        line = line.strip().rstrip("`*_~ \t")
        if not line:
            continue
        links = len(URL.findall(line)) if "://" in line or "www." in line.lower() else 0
        if links:
            rest = MARKUP.sub(" ", URL.sub(" ", re.sub(r"<a\s[^>]*>", lambda m: " ", line)))
            words = WORD.findall(_fold(rest))
            if len(words) <= 10 * links or not END.search(rest.strip()):
                junk += len(words) + 3 * links
                total += len(words) + 3 * links
                continue
            line = rest.strip()
        low = _fold(line)
        words = WORD.findall(low)
        if not words:
            continue
        tagged = re.findall(r"(?<!\w)#\w+", line) if "#" in line else ()
        if len(tagged) >= 3 and 2 * len(tagged) >= len(line.split()):
            junk += len(words)
            total += len(words)
            continue
        if ("|" in line or " - " in line or "•" in line) and PRICE.search(low) and not re.search(r"[^\W\d_]{3,}[.!?]$", line):
            junk += len(words)
            total += len(words)
            continue
        if (line[0] in "[-*" or line[0].isdigit() or "=" in line) and DATA.match(line):
            total += len(words)
            continue
        if not END.search(line):
            items = [i for i in SEPARATORS.split(line) if i]
            if len(words) >= 9 and (len(items) >= 4 and len(words) <= 6 * len(items) or not re.search(r"[.!?…]\s", line)):
                underscored = len(re.findall(r"\w+[_-]\w+", line)) / len(items) if items else 0
                total += len(words)
                if _repeats(words) >= 0.2 or underscored >= 0.5:
                    junk += len(words)
                continue
        asked: list[str] = []  # a short question goes with the sentence that answers it
        parts = CUT.split(line)
        for part in parts:
            own = WORD.findall(_fold(part)) if len(parts) > 1 else words
            if not own:
                continue
            if not END.search(part) or len(own) < 3:
                entries.append(own)
            elif part.rstrip("\"'”»)]").endswith("?") and len(own) <= 6:
                if asked:
                    sentences.append(asked)
                asked = own
            else:
                sentences.append(asked + own)
                asked = []
        if asked:
            sentences.append(asked)
    # short entries are key words where many of them come again; a few entries are headings
    flat = [w for own in entries for w in own]
    total += len(flat)
    if len(entries) >= 5 and len(flat) <= 8 * len(entries) and _repeats(flat) >= 0.3:
        junk += len(flat)
    # a sentence is made of key phrases where it says the same thing again and again
    spoken = Counter(w for s in sentences for w in s)
    total += sum(map(len, sentences))
    dense = {w for w, n in spoken.items() if n >= DENSE[0] and n >= DENSE[1] * total}
    junk += sum(len(s) for s in sentences if _piles_up(s, dense))
    return (junk / total if total else 0.0), total


def block_ratios(text: str) -> list[tuple[int, float]]:
    """(length, compression ratio) of each block of a text."""
    if "://" in text or "www." in text.lower():
        text = URL.sub("https://", text)  # an address is one sign of the page; its letters say nothing about redundancy
    out = []
    for at in range(0, len(text), BLOCK_CHARS):
        data = text[at : at + BLOCK_CHARS].encode("utf-8", "replace")
        if len(data) >= 20:
            out.append((len(data), len(data) / len(zlib.compress(data, 6))))
    return out


def sentence_ends(text: str, words: int) -> float:
    """Different sentence ends a word; numbers of lists and abbreviations end nothing."""
    if "://" in text or "www." in text.lower():
        text = URL.sub(" ", text)
    ends = set()
    for m in ENDING.finditer(text):
        at = m.start()
        last = ENDED.search(text[max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1 : at])
        if last is not None:
            ends.add(last.group(1).lower())
    return len(ends - ABBREVIATIONS) / max(1, words)


MEASURED = "doc_id bigint, lang string, sizes array<int>, ratios array<double>, confirmed boolean, read boolean"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ratios, confirmed, read = [], [], [], []
        for text in batch.column("text").to_pylist():
            blocks = block_ratios(text)
            sizes.append([n for n, _ in blocks])
            ratios.append([r for _, r in blocks])
            words = len(WORD.findall(text))
            few = words >= LEAST_WORDS and sentence_ends(text, words) < FEW_ENDS
            share, counted = keyword_share(text) if few else (0.0, 0)
            confirmed.append(few)
            read.append(counted >= LEAST_WORDS and share > MOST_OF)
        arrays = [batch.column("doc_id"), batch.column("lang"), pa.array(sizes, pa.list_(pa.int32())), pa.array(ratios, pa.list_(pa.float64())), pa.array(confirmed), pa.array(read)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "sizes", "ratios", "confirmed", "read"])


def length_class(size: Column) -> Column:
    """Half octaves of bytes."""
    return F.floor(F.log2(F.greatest(size, F.lit(1))) * 2)


def redundancy(documents: DataFrame) -> DataFrame:
    """(doc_id, excess, confirmed, read): the largest excess of a block's compression over its language and length class, in spreads.

    Medians are at most what PROSE says.  A language's quartiles in a length class are drawn to those of all languages
    of that length with the weight of PRIOR blocks, so rare classes have figures
    too.  ``confirmed`` tells few sentence ends, ``read`` the exact check.
    """
    texts = documents.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"), F.col("text").cast("string").alias("text"))
    measured = cut(texts.mapInArrow(_measure, MEASURED))
    blocks = measured.select("doc_id", "lang", "confirmed", "read", F.inline(F.arrays_zip("sizes", "ratios"))).select("doc_id", "lang", "confirmed", "read", length_class(F.col("sizes")).alias("cls"), F.col("ratios").alias("ratio"))
    quartiles = F.percentile_approx("ratio", [0.25, 0.5, 0.75], 200)
    own = blocks.groupBy("lang", "cls").agg(quartiles.alias("q"), F.count("*").alias("n"))
    whole = blocks.groupBy("cls").agg(quartiles.alias("all_q"))
    drawn = [(F.col("n") * F.col("q")[k] + PRIOR * F.col("all_q")[k]) / (F.col("n") + PRIOR) for k in range(3)]
    # a class filled with spam or copies must not set its own yardstick
    median = F.least(drawn[1], PROSE[0] + PROSE[2] * (F.col("cls") - PROSE[1]))
    usual = own.join(whole, "cls").select("lang", "cls", median.alias("median"), F.least(F.greatest((drawn[2] - drawn[0]) / 1.349, median * 0.02), median * 0.1).alias("spread"))
    excess = (F.col("ratio") - F.col("median")) / F.col("spread")
    return blocks.join(usual, ["lang", "cls"]).groupBy("doc_id").agg(F.max(excess).alias("excess"), F.max("confirmed").alias("confirmed"), F.max("read").alias("read"))


def spam_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the pages that are extremely redundant, have few sentence ends, and consist for the most part of key words, links or tags."""
    return redundancy(documents).filter((F.col("excess") >= REDUNDANT) & F.col("confirmed") & F.col("read")).select("doc_id")
