"""Speech transcripts to clean turns of one speaker each, in spoken order.

A transcript is read line by line in the layout that most of its lines have: a
layout's marks say where a label stands.  One Aho-Corasick automaton finds the
words of sound annotations and the hesitation sounds, whatever their length, in
one pass over a text (letters drawn out count once); an automaton of the
headings' first words reads headings, and one of the session's own labels tells
labels from speech before a colon.  Rules on what stands around a match decide
doubtful ones (a hesitation is a whole word, an annotation has brackets or is a
note of music); the matched spans are subtracted from the line's span, and what
is left is speech.  Labels are resolved among the participants of their
session, and windows over the utterances - blocks of bounded size, joined at
their borders - build the turns.

Defined cases
  * utterances without speech are removed first and separate nothing;
  * a line that begins no utterance goes on with the one above it; before the
    first utterance it is a heading;
  * where the transcript is null, the distinct segments in order of seg_index
    take the place of lines; a spoken segment with a null label is its own turn;
  * empty and blank transcripts, unknown sessions and empty tables: no turns.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from confab.llm.labels import label_keys
from confab.llm.runs import BLOCK, canonical_events

# Hesitation sounds, without marks and with repeated letters once.
HESITATIONS = "hm hum uhum uhm aham aha ahn ah an ha han e eh er erm uh um mhm mm mm-hm m hn hein uhn ahm eee oh o".split()
# Words inside brackets that describe sounds or the state of the record.
ANNOTATIONS = (
    "blank_audio blank audio inaudivel inaudible unintelligible ininteligivel silencio silence musica music risos risada riso laughter laughs laugh aplausos applause clapping pausa pause tosse tosses cough coughs coughing ruido ruidos noise "
    "vozes ao fundo crosstalk background voices texto incerto uncertain text conversa paralela sobreposicao overlapping suspiro sigh espirro sneeze porta telefone phone"
).split()
# Words that head a list of people or a document.
HEADINGS = ("participantes", "participants", "participante", "presentes", "attendees", "present", "transcricao da sessao", "transcript of session", "session", "sessao", "webvtt", "kind", "language", "note", "style", "region")

CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d{1,3}))?"
LAYOUTS = {
    "bracket": re.compile(rf"^\s*\[{CLOCK}\]\s*([^:]+?)\s*:(?!\d)\s?(.*)$"),
    "behind": re.compile(rf"^\s*([^:]+?)\s*[\(\[]{CLOCK}[\)\]]\s*:\s?(.*)$"),
    "voice": re.compile(r"^\s*<v(?:\.[\w.]+)?\s+([^>]+?)\s*>(.*?)(?:</v>)?\s*$"),
    "dash": re.compile(rf"^\s*\({CLOCK}\)\s*(.+?)\s+[-–—]\s(.*)$"),
    "bars": re.compile(rf"^\s*{CLOCK}\s*\|\s*([^|]+?)\s*\|\s?(.*)$"),
    "plain": re.compile(r"^\s*([^\s\d\[\(<*{♪:#=][^:]*?)\s*:\s(.*)$"),
}
OPENINGS = {"[": "bracket", "(": "dash", "<": "voice"}  # the layout that a line's first sign tells
MARK = re.compile(rf"^\s*[\[\(]?{CLOCK}[\]\)]?\s*$")
MOST_HEADING = max(map(len, HEADINGS))
CUE = re.compile(rf"^\s*{CLOCK}\s*-->\s*{CLOCK}")
ROLE = re.compile(r"\s*[\(\[][^\(\)\[\]]*[\)\]]\s*$")
BRACKETS = re.compile(r"\(\([^()]*\)\)|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\*[^*\n]+\*|♪[^♪]*♪|[♪♫♬]+")
WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
DAY = 86400
AT_ONCE = 256  # transcripts whose utterances Python holds at once


_FOLD = {
    cp: base for cp in range(0x250) if (base := unicodedata.normalize("NFKD", chr(cp).lower())[:1]) and not unicodedata.combining(base) and base != chr(cp) and len(chr(cp).lower()) == 1
}  # letters with marks by their plain ones, position by position


def folded(text: str) -> str:
    """Lower case without marks; each character stays one character."""
    return text.translate(_FOLD)


def _automaton(words) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def _squeezed(word: str) -> str:
    return DOUBLED.sub(r"\1", word)


DOUBLED = re.compile(r"(.)\1+", re.S)
OUTSIDE = re.compile(r"(?<![^\W_])[-'’]|[-'’](?![^\W_])|[^\w'’-]|_")  # what is no part of a word
DOUBTFUL = frozenset(("um", "e", "o", "a", "an", "ha", "er", "oh", "ah", "m", "mm"))  # sounds that are words too
_HEADS = _automaton(HEADINGS)


def _signs() -> ahocorasick.Automaton:
    """Whole words of annotations and hesitation sounds, each between blanks, with repeated letters once."""
    automaton = ahocorasick.Automaton()
    for kind, words in (("note", ANNOTATIONS), ("sound", HESITATIONS)):
        for w in words:
            automaton.add_word(f" {_squeezed(w)} ", (kind, len(_squeezed(w))))
    automaton.make_automaton()
    return automaton


_SIGNS = _signs()


def _matches(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The folded text, and (kind, from, to) of each whole word that the automaton knows; one pass over the text."""
    low = folded(text)
    spaced = " " + OUTSIDE.sub(" ", low) + " "
    runs = [(m.start(), m.end() - m.start() - 1) for m in DOUBLED.finditer(spaced)]
    short = DOUBLED.sub(r"\1", spaced) if runs else spaced
    found, run, gone = [], 0, 0
    for end, (kind, length) in _SIGNS.iter(short):
        first, last = end - length, end - 1  # the word without its blanks, in the shortened text
        while run < len(runs) and runs[run][0] < first + gone:  # letters left out before the word
            gone += runs[run][1]
            run += 1
        inside, k = 0, run
        while k < len(runs) and runs[k][0] <= last + gone + inside:
            inside += runs[k][1]
            k += 1
        found.append((kind, first + gone - 1, last + gone + inside))
    return low, found


def _is_note(low: str, found: list[tuple[str, int, int]], a: int, b: int) -> bool:
    """Whether the bracketed text from a to b describes a sound: words of the list, and little else."""
    letters = sum(c.isalpha() for c in low[a:b])
    if not letters:
        return True
    known = sum(sum(c.isalpha() for c in low[x:y]) for kind, x, y in found if kind == "note" and a <= x and y <= b)
    inner = low[a:b].strip("()[]{}<>*")
    return known > letters / 2 or len(inner.split()) <= 2 and bool(re.match(r"^\s*[\w-]+(\s[\w-]+)?\s*$", inner))


def speech_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the text that are speech: the whole minus annotations and hesitation sounds."""
    low, found = _matches(text)
    sounds = [(a, b) for kind, a, b in found if kind == "sound"]
    brackets = [m.span() for m in BRACKETS.finditer(text)]
    cut = [(a, b) for a, b in brackets if text[a] in "♪♫♬" or text[a] == "*" and not re.search(r"[.!?]\s", text[a:b]) or _is_note(low, found, a, b)]
    only_sounds = None
    for a, b in sounds:
        if low[a:b] in DOUBTFUL:
            # a sound that is a word too, unless drawn out: set off by punctuation on both sides, or nothing else is said
            before, after = low[:a].rstrip(), low[b:].lstrip()
            if not ((not before or before[-1] in ".,;!?…-") and (not after or after[0] in ".,;!?…-")):
                if only_sounds is None:
                    only_sounds = not re.search(r"[^\W_]", _left(low, sounds + brackets))
                if not only_sounds:
                    continue
        cut.append((a, b))
    return _subtract(len(text), cut)


def _subtract(length: int, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The span from 0 to ``length`` minus the spans to cut."""
    spans, at = [], 0
    for a, b in sorted(cut):
        if a > at:
            spans.append((at, a))
        at = max(at, b)
    if at < length:
        spans.append((at, length))
    return spans


def _left(text: str, cut: list[tuple[int, int]]) -> str:
    return " ".join(text[a:b] for a, b in _subtract(len(text), cut))


def clean(text: str) -> str:
    """The speech of a text; repeated blanks and stranded punctuation go with what is cut."""
    left = " ".join(text[a:b] for a, b in speech_spans(text))
    left = re.sub(r"\s+([,.;!?…])", r"\1", left)
    return re.sub(r"^[\s,.;!?…-]+|\s+$", "", re.sub(r"\s{2,}", " ", left))


def has_speech(text: str) -> bool:
    """Whether anything is said: a word outside brackets that the automaton doesn't know settles it, doubtful texts are read in full."""
    low, found = _matches(text)
    if re.search(r"[^\W_]", _left(low, [m.span() for m in BRACKETS.finditer(text)] + [(a, b) for kind, a, b in found if kind == "sound"])):
        return True
    return any(re.search(r"[^\W_]", text[a:b]) for a, b in speech_spans(text))


def _seconds(groups) -> float | None:
    h, m, s, f = groups
    if h is None:
        return None
    return int(h) * 3600 + int(m) * 60 + int(s or 0) + (int(f) / 10 ** len(f) if f else 0)


def _parts(layout: str, m: re.Match) -> tuple[str, float | None, str]:
    g = m.groups()
    if layout in ("bracket", "dash", "bars"):
        return g[4], _seconds(g[:4]), g[5]
    if layout == "behind":
        return g[0], _seconds(g[1:5]), g[5]
    return g[0], None, g[1]


def _is_heading(line: str) -> bool:
    low = folded(line).strip(" #=*-_\t")
    if line.lstrip().startswith(("#", "==")) or not low:
        return True
    return any(end + 1 == len(w) and not low[len(w) : len(w) + 1].isalpha() for end, w in _HEADS.iter(low[:MOST_HEADING]))


def read_transcript(text: str) -> tuple[list[tuple[str, float | None, list[tuple[int, str]]]], list[str]]:
    """Utterances (label, seconds, [(line, text)]) in order of lines, and the labels of the participant list."""
    lines = [ln.rstrip("\r") for ln in text.split("\n")]
    votes: Counter = Counter()
    for ln in lines:
        bare = ln.lstrip()
        name = OPENINGS.get(bare[:1]) or ("bars" if bare[:1].isdigit() else "behind")
        if LAYOUTS[name].match(ln):
            votes[name] += 1
        elif name == "behind" and LAYOUTS["plain"].match(ln) and not _is_heading(ln):
            votes["plain"] += 0.5
    layout = votes.most_common(1)[0][0] if votes else "plain"
    pattern = LAYOUTS[layout]
    matches = [pattern.match(ln) for ln in lines]
    known: Counter = Counter()
    if layout == "plain":
        for ln, m in zip(lines, matches):
            if m and not _is_heading(ln):
                known[label_key(m.group(1))] += 1
    own = _automaton(f"\n{key}\n" for key, n in known.items() if n > 1)  # the session's own labels
    utterances: list = []
    listed: list[str] = []
    mark = None
    for k, ln in enumerate(lines):
        if not ln.strip() or (layout == "voice" and re.match(r"^\s*\d+\s*$", ln)):
            continue
        if "-->" in ln and (c := CUE.match(ln)) is not None:
            mark = _seconds(c.groups()[:4])
            continue
        if len(ln.strip()) <= 16 and (c := MARK.match(ln)) is not None:  # no time mark is longer
            mark = _seconds(c.groups())
            continue
        m = matches[k]
        heading = (not utterances or ln.lstrip().startswith(("#", "=="))) and _is_heading(ln)
        if heading and (m is None or layout in ("plain", "voice")):
            head, _, rest = ln.partition(":")
            if folded(head).strip() in ("participantes", "participants", "presentes", "attendees", "present", "participante"):
                listed += [p for p in re.split(r"\s*[,;]\s*", rest) if p.strip()]
            continue
        if m is not None and layout == "plain" and not _label_like(m.group(1)) and not (len(own) and any(own.iter(f"\n{label_key(m.group(1))}\n"))):
            m = None  # speech with a colon
        if m is not None:
            label, at, said = _parts(layout, m)
            utterances.append((label, mark if at is None else at, [(k, said)]))
        elif utterances:
            utterances[-1][2].append((k, re.sub(r"</v>\s*$", "", ln)))
    return utterances, listed


def _label_like(label: str) -> bool:
    words = label.split()
    return len(words) <= 6 and not re.search(r"[.!?;]\s", ROLE.sub("", label) + " " if len(words) > 4 else "")


@lru_cache(100_000)
def label_key(label: str) -> str:
    """Letters and digits of a label without its role; blanks and dots between words stay as one blank."""
    bare = folded(ROLE.sub("", label))
    return " ".join(re.findall(r"[^\W_]+", bare))


@lru_cache(200_000)
def _slips(a: str, b: str, most: int) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1] <= most


def _numbers(key: str) -> tuple[str, ...]:
    return tuple(t.lstrip("0") or "0" for t in re.findall(r"\d+", key))


def _words(key: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", key)


# First words of labels that the app makes itself, and particles of names.
APP_LABELS = frozenset("person spk speaker unknown desconhecido pessoa participante falante".split())
PARTICLES = frozenset("de da do dos das e".split())


@lru_cache(400_000)
def fits(short: str, long: str) -> float:
    """How well a label stands for a longer one: 0 for not at all, else a score that prefers more shared letters."""
    if _numbers(short) != _numbers(long):
        return 0
    if short.replace(" ", "") == long.replace(" ", ""):
        return 100
    a, b = [w for w in _words(short) if w not in PARTICLES], [w for w in _words(long) if w not in PARTICLES]
    if not a or not b:
        return 0
    joined_a, joined_b = "".join(a), "".join(b)
    if a[0] in APP_LABELS or b[0] in APP_LABELS:
        return 90 if _slips(joined_a, joined_b, 1) and bool(_numbers(short)) else 0
    if len(joined_a) >= 5 and _slips(joined_a, joined_b, 2 if min(len(joined_a), len(joined_b)) >= 12 else 1):
        return 95
    left, score, full = list(b), 0.0, 0
    for w in sorted(a, key=len, reverse=True):
        hit = next((u for u in left if u == w), None)
        if hit is None and len(w) >= 4:
            hit = next((u for u in left if len(u) >= 4 and _slips(w, u, 2 if min(len(w), len(u)) >= 8 else 1)), None)
        if hit is None and len(w) == 1:
            hit = next((u for u in left if u[0] == w), None)
        if hit is None:
            hit = next((u for u in left if len(u) == 1 and u == w[0]), None)
        if hit is None:
            return 0
        left.remove(hit)
        if len(w) > 1 and len(hit) > 1:
            full += 1
            score += 10 if w == hit else 8
        else:
            score += 3
    return score + len(a) - 0.5 * len(left) if full else 0


def resolve(labels: Counter, listed: list[str]) -> dict[str, str]:
    """The participant of each label key of a session: the fullest label that it fits best.

    Full labels come first; a shorter one joins the participant whom it fits,
    the more frequent one where it fits several; labels that fit nobody are
    participants of their own.
    """
    weight = Counter({label_key(p): 0 for p in listed if label_key(p)})
    weight.update(labels)
    # well written labels lead: by full words, then by how often they stand there, then by text
    order = sorted(weight, key=lambda k: (-sum(len(w) > 1 for w in _words(k) if w not in PARTICLES), k not in {label_key(p) for p in listed}, -weight[k], k))
    heads: dict[str, list[str]] = {}
    home: dict[str, str] = {}
    count: Counter = Counter()
    for k in order:
        best, who = 0.0, None
        for head, members in heads.items():
            s = max((max(fits(k, m), fits(m, k) * 0.99) for m in members), default=0)
            if s > best or s == best and s and count[head] > count[who]:
                best, who = s, head
        if who is None:
            heads[k], who = [k], k
        else:
            heads[who].append(k)
        home[k] = who
        count[who] += weight[k]
    return home


def _utterances(batches: Iterator[pd.DataFrame], with_text: bool = True) -> Iterator[pd.DataFrame]:
    columns = ["session_pk", "order", "first_line", "last_line", "speaker", "text"]
    for part in (batch.iloc[at : at + AT_ONCE] for batch in batches for at in range(0, len(batch), AT_ONCE)):
        out = []
        for pk, text in zip(part["session_pk"], part["transcript"]):
            said, listed = read_transcript(text)
            keys = [label_key(u[0]) or "?" for u in said]
            home = resolve(Counter(keys), listed)
            times = [u[1] for u in said if u[1] is not None]
            late = times and max(times) - min(times) > DAY / 2  # passes midnight
            rows = []
            for n, ((_, at, parts), key) in enumerate(zip(said, keys)):
                spoken = [(k, t) for k, t in parts if has_speech(t)]
                if spoken:
                    at = -1.0 if at is None else at + DAY if late and at < DAY / 2 else at
                    rows.append((at, n, spoken[0][0], spoken[-1][0], home[key], " ".join(clean(t) for _, t in spoken) if with_text else ""))
            rows.sort(key=lambda r: (r[0], r[1]))
            out += [(pk, i, r[2], r[3], r[4], r[5]) for i, r in enumerate(rows)]
        yield pd.DataFrame(out, columns=columns)


@F.pandas_udf(StringType())
def _clean_texts(texts: pd.Series) -> pd.Series:
    return pd.Series([clean(t) if t is not None and has_speech(t) else None for t in texts], index=texts.index, dtype=object)


UTTERANCE = "session_pk bigint, `order` bigint, first_line bigint, last_line bigint, speaker string, text string"


def transcript_utterances(sessions: DataFrame, with_text: bool = True) -> DataFrame:
    """Spoken utterances of the transcripts, in order: (session_pk, order, first_line, last_line, speaker, text)."""
    rows = sessions.filter("transcript is not null and id is not null").select(F.col("id").alias("session_pk"), "transcript")
    return rows.mapInPandas(lambda batches: _utterances(batches, with_text), UTTERANCE)


@F.pandas_udf(StringType())
def _mark_speech(texts: pd.Series) -> pd.Series:
    return pd.Series(["" if t is not None and has_speech(t) else None for t in texts], index=texts.index, dtype=object)


def segment_utterances(sessions: DataFrame, segments: DataFrame, with_text: bool = True) -> DataFrame:
    """Spoken segments of sessions without a transcript, in the same columns; null labels stay null."""
    silent = sessions.filter("transcript is null and id is not null").select(F.col("id").alias("session_pk"))
    own = segments.join(silent, "session_pk", "left_semi")
    labels = canonical_events(own, "session_pk", "seg_index", "speaker_name").select(F.col("entity").alias("session_pk"), F.col("position").alias("order"), F.col("label").alias("speaker"))
    once = own.filter("seg_index is not null").groupBy("session_pk", F.col("seg_index").alias("order")).agg(F.min_by("text", "id").alias("text"))
    spoken = once.withColumn("text", (_clean_texts if with_text else _mark_speech)("text")).filter("text is not null")
    return spoken.join(labels, ["session_pk", "order"]).select("session_pk", "order", F.col("order").alias("first_line"), F.col("order").alias("last_line"), "speaker", "text")


def build_turns(utterances: DataFrame) -> DataFrame:
    """Turns: longest series of utterances of one speaker; (session_pk, turn_start, first_line, last_line, speaker, utterances, text).

    Windows run inside blocks of ``BLOCK`` orders; a second window joins the
    blocks' first and last turns, so no task holds a whole endless session.
    """
    rows = utterances.withColumn("block", F.floor(F.col("order") / BLOCK))
    inside = Window.partitionBy("session_pk", "block").orderBy("order")
    begins = F.when((F.lag("order").over(inside).isNotNull()) & (F.lag("speaker").over(inside) == F.col("speaker")), 0).otherwise(1)
    parts = rows.withColumn("begins", begins).withColumn("part", F.sum("begins").over(inside))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), " ")
    pieces = parts.groupBy("session_pk", "block", "part").agg(
        F.min("order").alias("start"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.first("speaker").alias("speaker"), F.count("*").alias("utterances"), said.alias("text")
    )
    # only pieces at a block's border can go on; the others are turns already
    width = Window.partitionBy("session_pk", "block")
    edged = pieces.withColumn("edge", (F.col("part") == 1) | (F.col("part") == F.max("part").over(width)))
    across = Window.partitionBy("session_pk").orderBy("start")
    goes_on = (F.col("part") == 1) & (F.lag("speaker").over(across) == F.col("speaker"))
    border = edged.filter("edge").withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("turn", F.sum("new").over(across))
    joined = border.groupBy("session_pk", "turn").agg(
        F.min("start").alias("start"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.first("speaker").alias("speaker"), F.sum("utterances").alias("utterances"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    columns = ["session_pk", "start", "first_line", "last_line", "speaker", "utterances", "text"]
    return edged.filter("not edge").select(columns).unionByName(joined.select(columns))


def speaker_turns(sessions: DataFrame, segments: DataFrame, with_text: bool = True) -> DataFrame:
    """All turns of all sessions, from the transcript or, where it is null, from the segments; without text where only lines are asked for."""
    return build_turns(transcript_utterances(sessions, with_text).unionByName(segment_utterances(sessions, segments, with_text)))
