"""Variant spellings of names typed by people, linked by their canonical rewritings.

Every name is rewritten to all of its canonical forms: honorifics, roles and
legal forms go, nicknames become given names, initials stand for names, logins,
joined names and "family, given" turn back to token order, sounds that are
spelled in several ways get one spelling, and each family name appears with
letters left out.  Forms are exploded and equi-joined.  Complete names meet by a
given name, a family name and an end of the other one; shortened ones (an
initial, one family name, a login) meet all others by a family name and the
given name or its initial.  A pair's score is the rarity of its rarest shared
rewriting: the logarithm of all spellings over those that share it.

An exact check compares the candidates token by token.  Complete names link
directly; a shortened one joins the person whom it fits best - first by the
check, then by the score - and nobody where two fit equally.

Defined cases: null, blank and generic labels of the app match nothing; equal
spellings match each other; suffixes of descent and different given names tell
people apart; repeated ids count once; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confab.llm.components import components
from confab.session import cut

RARE = 256  # spellings of a form on one side of a task; those of a commoner form are dealt into parts, none is left out
AT_ONCE = 1024  # spellings whose forms Python holds at once
JOINED = 10  # letters from which a word may be a whole name without blanks
LEAST = 4  # letters of a family name that may be misspelled

# Given names in Portuguese and English, without marks.
GIVEN = """
adriana alexandre alice alberto amanda ana andre andrea anna antonia antonio aparecida arthur augusto baltazar beatriz bernardo bruna bruno caio
camila carla carlos carolina cecilia celia charles claudia claudio conceicao cristina cristiane daniel daniela david debora denise diego diogo
edson eduarda eduardo edward elaine elena eliana elizabeth emma fabiana fabio felipe fernanda fernando flavia flavio francisca francisco
gabriel gabriela george gilberto guilherme gustavo heitor helena henrique hugo ines ingrid isabel isabela jacqueline james jane joao joaquim
john jorge jose joseph julia juliana juliano julio jussara karen katherine larissa laura leandro leonardo leticia lucas lucia luciana luciano
luis luisa luiza marcela marcelo marcia marcio marco marcos margaret margarida maria mariana marina mario marta mary mateus mauricio michael
miguel milena mirela monica nancy natalia nicolau noemia olivia otavio palmira patricia paula paulo pedro peter rafael rafaela raquel regina renata
renato ricardo rita robert roberto rodrigo rosangela ruth samuel sandra sarah sebastiao sergio silvia simone sofia soraia sonia susan tatiana
teresa thomas tiago ulisses valeria vanessa vera vicente victor vinicius vitoria viviane wagner william yolanda zuleica
""".split()  # fmt: skip

# Nicknames and the given names that they stand for.
NICKNAMES = {
    "ale": "alexandre", "xande": "alexandre", "bel": "isabel", "bela": "isabel", "isa": "isabel", "beto": "roberto alberto gilberto", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth",
    "bia": "beatriz", "bill": "william", "will": "william", "bob": "robert roberto", "rob": "robert", "balta": "baltazar", "caca": "carlos", "cadinho": "ricardo carlos", "carlinhos": "carlos",
    "carol": "carolina", "cida": "aparecida", "celo": "marcelo", "ceica": "conceicao", "cecinha": "conceicao", "chico": "francisco", "kiko": "francisco", "cris": "cristina cristiane", "dani": "daniel daniela", "deb": "debora",
    "debinha": "debora", "digo": "rodrigo", "dri": "adriana", "drica": "adriana", "dudu": "eduardo", "edu": "eduardo", "gabi": "gabriela gabriel", "guga": "gustavo", "gui": "guilherme", "guida": "margarida",
    "guto": "augusto", "gus": "gustavo", "ju": "juliana julia", "jussa": "jussara", "kate": "katherine", "kathy": "katherine", "lele": "leticia", "lena": "helena", "leo": "leonardo", "lipe": "felipe", "lu": "luciana lucia luiza",
    "lulu": "luciana", "mag": "margaret", "maggie": "margaret", "peggy": "margaret", "mila": "camila", "mike": "michael", "mi": "michele", "nanda": "fernanda", "nando": "fernando", "ned": "edward", "ted": "edward", "ed": "edward",
    "nico": "nicolau", "paty": "patricia", "pati": "patricia", "paulinho": "paulo", "quim": "joaquim", "rafa": "rafael rafaela", "rick": "ricardo", "rique": "henrique", "rosa": "rosangela", "serginho": "sergio", "so": "soraia",
    "tati": "tatiana", "tavinho": "otavio", "tete": "teresa", "tiao": "sebastiao", "tom": "thomas", "tonho": "antonio", "toninho": "antonio", "val": "valeria", "vini": "vinicius", "vivi": "vitoria viviane", "vic": "victor vitoria",
    "xico": "francisco", "yoli": "yolanda", "ze": "jose", "zeca": "jose", "zuzu": "zuleica", "zu": "zuleica", "mari": "mariana", "gabriel": "gabriel", "lelo": "marcelo", "no": "noemia", "nono": "noemia", "mo": "monica", "tita": "tatiana",
}

# Words that carry no identity.
HONORIFICS = set("sr sra srta dr dra prof profa professor professora eng enga engenheiro mr mrs ms miss sir dom dona senhor senhora".split())
PARTICLES = set("de da do das dos del della e y van von la le di du of the and".split())
DESCENT = {"neto": "neto", "netto": "neto", "filho": "filho", "junior": "junior", "jr": "junior", "fo": "filho", "no": "neto", "sobrinho": "sobrinho", "neta": "neta", "ii": "ii", "iii": "iii", "segundo": "ii", "senior": "senior"}
LEGAL = {"ltda": "ltda", "limitada": "ltda", "eireli": "eireli", "me": "me", "microempresa": "me", "mei": "mei", "epp": "epp", "sa": "sa", "inc": "inc", "llc": "llc", "corp": "corp", "ltd": "ltda", "gmbh": "gmbh", "anonima": "sa"}
KINDS = {"associacao": "assoc", "assoc": "assoc", "companhia": "cia", "cia": "cia", "cooperativa": "coop", "coop": "coop", "fundacao": "fund", "fund": "fund", "grupo": "grupo", "gr": "grupo", "instituto": "inst", "inst": "inst", "laboratorio": "lab", "lab": "lab", "empresa": "emp", "sociedade": "soc"}
SECTORS = {
    "audiovisual": "av", "av": "av", "comercio": "com", "com": "com", "consultoria": "cons", "cons": "cons", "engenharia": "eng", "industria": "ind", "ind": "ind", "logistica": "log", "log": "log", "servicos": "serv", "servico": "serv",
    "serv": "serv", "tecnologia": "tec", "tec": "tec", "telecomunicacoes": "telecom", "telecom": "telecom", "tel": "telecom",
}
GENERIC = re.compile(r"^(person|pessoa|spk|speaker|unknown|desconhecid[oa]|participante|participant|usuario|user|guest|convidad[oa]|falante|anonimo|anonymous|voz|face)?[\s_#.-]*\d*$")
SOUNDS = [("ph", "f"), ("sh", "x"), ("ch", "x"), ("th", "t"), ("qu", "k"), ("gu", "g"), ("ck", "k"), ("ca", "ka"), ("co", "ko"), ("cu", "ku"), ("cl", "kl"), ("cr", "kr"), ("w", "v"), ("y", "i"), ("z", "s"), ("c", "k"), ("h", "")]


def _letters(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()


@lru_cache(200_000)
def sound(token: str) -> str:
    """One spelling for letters that sound alike; doubled letters count once."""
    for written, said in SOUNDS:
        token = token.replace(written, said)
    return re.sub(r"(.)\1+", r"\1", token)


@lru_cache(200_000)
def _letter_set(word: str) -> int:
    return sum({1 << (ord(c) & 63) for c in word})


def distance(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, replacements and swaps of neighbours from a to b; most + 1 where it is more."""
    x, y = _letter_set(a), _letter_set(b)  # each change brings at most one letter that the other word lacks
    if abs(len(a) - len(b)) > most or (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return most + 1
    return _distance(a, b, most)


@lru_cache(200_000)
def _distance(a: str, b: str, most: int) -> int:
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


_SOUND_GIVEN: dict[str, set[str]] = {}
for _name in GIVEN:
    _SOUND_GIVEN.setdefault(sound(_name), set()).add(_name)
for _nick, _names in NICKNAMES.items():
    if len(_nick) >= 3:
        _SOUND_GIVEN.setdefault(sound(_nick), set()).update(_names.split())


@lru_cache(200_000)
def givens(token: str) -> frozenset[str]:
    """Given names that a token may stand for: itself, a nickname's, or those one slip (two in long names) away."""
    if token in GIVEN:
        return frozenset([token])
    if token in NICKNAMES:
        return frozenset(NICKNAMES[token].split())
    said = sound(token)
    if said in _SOUND_GIVEN:
        return frozenset(_SOUND_GIVEN[said])
    if len(token) < 4:
        return frozenset()
    for most in (1, 2) if len(token) >= 6 else (1,):
        near = {n for n in GIVEN if distance(token, n, most) <= most or (len(said) >= 4 and distance(said, sound(n), most) <= most)}
        near |= {g for k, v in NICKNAMES.items() if len(k) >= 4 and distance(token, k, 1) <= 1 for g in v.split()}
        if near:
            return frozenset(near)
    return frozenset()


def _word(token: str, words: dict[str, str]) -> str | None:
    """The class of a word in a list of fixed values, slips of long words included."""
    return words[token] if token in words else _near_word(token, id(words)) if len(token) >= 6 else None


@lru_cache(200_000)
def _near_word(token: str, which: int) -> str | None:
    words = next(w for w in (DESCENT, LEGAL, KINDS, SECTORS) if id(w) == which)
    for w, kind in words.items():
        if len(w) >= 6 and distance(token, w, 2) <= (2 if len(w) >= 9 else 1):
            return kind
    return None


@lru_cache(100_000)
def parse(name: str) -> tuple | None:
    """('org', tokens, legal, sector) or ('person', givens, given token, family tokens, descent), else None."""
    text = _letters(name).strip()
    bare = re.sub(r"[^\w\s#.-]", "", text).strip(" .:;-")
    if not re.search(r"[^\W\d_]", text) or GENERIC.match(bare):
        return None
    text = re.sub(r"\bs\s*[./]\s*a\b\.?", " sa ", text)
    text = re.sub(r"\bm\s*\.\s*e\b\.?", " me ", text)
    inner = re.sub(r"\([^()]*\)|\"[^\"]*\"|\[[^\[\]]*\]|“[^”]*”", " ", text)
    text = inner if re.search(r"[^\W\d_]{2}", inner) else re.sub(r"[()\"\[\]“”]", " ", text)
    marks = bool(re.search(r"&|\w\s+e\s+\w", text))
    shortened = text.rstrip().endswith(".")  # an abbreviation at the end
    comma = text.split(",", 1)
    tokens = re.findall(r"[^\W_]+", text)
    kinds, legal, sector, rest = [], None, [], []
    for i, t in enumerate(tokens):
        k, g, s = _word(t, KINDS) if i == 0 or len(t) > 3 else None, _word(t, LEGAL) if i else None, _word(t, SECTORS) if i and (len(t) > 2 or i >= len(tokens) - 2) else None
        if shortened and not s and i and i == len(tokens) - 1 and len(t) >= 3:
            s = next((c for w, c in SECTORS.items() if 3 <= len(w) <= 5 and distance(t, w, 1) <= 1), None)
        if k and not rest:
            kinds.append(k)
        elif g and i >= 1:
            legal = g
        elif s and rest:
            sector.append(s)
        else:
            rest.append(t)
    if (legal or kinds or sector) and (legal or kinds or marks or len(rest) >= 2) and not (len(kinds) == 1 and not legal and not sector and len(rest) < 2):
        own = tuple(sorted(sound(t) for t in rest if t not in PARTICLES))
        if own and (legal or kinds or (sector and not any(givens(t) for t in rest))):
            return ("org", own, legal, tuple(sector))
    if len(comma) == 2 and re.search(r"[^\W\d_]", comma[1]):
        tokens = re.findall(r"[^\W_]+", comma[1]) + re.findall(r"[^\W_]+", comma[0])
    while len(tokens) > 1 and tokens[0] in HONORIFICS:
        tokens = tokens[1:]
    tokens = [t for i, t in enumerate(tokens) if not i or t not in PARTICLES]  # "e" and "y" in front are initials
    if not tokens:
        return None
    descent, kept = None, []
    for i, t in enumerate(tokens):
        d = _word(t, DESCENT) if i and len(t) > 1 else None
        if d and i >= max(1, len(tokens) - 1):
            descent = d
        else:
            kept.append(t)
    tokens = kept
    if len(tokens) == 1 and len(tokens[0]) >= 6 and not givens(tokens[0]):  # a login: initial and family name
        return ("person", frozenset(), tokens[0][0], (tokens[0][1:], tokens[0]), descent, True)
    # the given name: the first token that is one, whichever the order; else the first
    at = 0
    if not givens(tokens[0]) or (len(tokens[0]) > 1 and tokens[0] not in GIVEN and tokens[0] not in NICKNAMES):
        exact = [i for i, t in enumerate(tokens) if t in GIVEN or (t in NICKNAMES and len(t) > 2)]
        near = [i for i, t in enumerate(tokens) if givens(t)]
        if len(tokens[0]) > 1 or exact:
            at = (exact or near or [0])[0] if (exact or near) else 0
        if len(tokens[0]) == 1 and len(tokens) >= 2 and not exact:
            at = 0
    given = tokens[at]
    family = tuple(t for i, t in enumerate(tokens) if i != at)
    return ("person", givens(given), given, family, descent, False)


def _alike(a: str, b: str) -> bool:
    """Whether two family names are one, slips included."""
    if a == b:
        return True
    x, y = sound(a), sound(b)
    if x == y:
        return len(x) > 1
    short = min(len(x), len(y))
    if short < LEAST:
        return False
    most = 1 if short < 6 else 2
    return distance(x, y, most) <= most or distance(a, b, most) <= most


def heads(p: tuple) -> set[str]:
    """First letters of the given names that a name may stand for, as written and as said."""
    return {h for n in (*p[1], p[2]) for h in (n[0], sound(n)[:1]) if h}


def joined(p: tuple) -> str:
    """A person's name without blanks."""
    return p[2] + "".join(p[3])


def complete(p: tuple) -> bool:
    """A name that stands for one person by itself: a full given name and two full family names, or an organisation."""
    if p[0] == "org":
        return len(p[1]) >= 2
    return not p[5] and len(p[2]) > 1 and sum(len(f) > 1 for f in p[3]) >= 2


def compare(a: tuple, b: tuple) -> int:
    """0: different; 1: may be the same, if no one else fits; 2: the same."""
    if a[0] != b[0]:
        return 0
    if a[0] == "org":
        x, y = list(a[1]), list(b[1])
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        left, hit = list(long), 0
        for t in short:
            best = min(((distance(t, u, 2), u) for u in left), default=(9, ""))
            if best[0] <= (2 if min(len(t), len(best[1])) >= 6 else 1) and min(len(t), len(best[1])) >= 2:
                left.remove(best[1])
                hit += 1
        if hit < len(short) or hit < min(2, len(long)):
            return 0
        return 2 if hit >= 2 else 1
    if a[4] != b[4]:
        return 0
    # given names
    initial = len(a[2]) == 1 or len(b[2]) == 1 or a[5] or b[5]
    if initial:
        if not heads(a) & heads(b):
            return 0
    elif a[1] and b[1]:
        if not a[1] & b[1]:
            cut = a[2] != b[2] and (a[2].startswith(b[2]) or b[2].startswith(a[2])) and abs(len(a[2]) - len(b[2])) == 1
            if not cut:
                return 0
            initial = True  # Robert for Roberto: only if nobody else fits
    elif not _alike(a[2], b[2]):
        return 0
    # family names, in any order
    x, y = [t for t in a[3] if len(t) > 1], [t for t in b[3] if len(t) > 1]
    if a[5] or b[5]:
        login, other = (x, y) if a[5] else (y, x)
        if a[5] and b[5]:
            return 2 if distance(x[1], y[1], 1) <= 1 else 0
        if len(login[1]) >= JOINED and distance(sound(login[1]), sound(joined(b if a[5] else a)), 2) <= 2:
            return 2
        return 1 if any(_alike(login[0], t) for t in other) else 0
    left, hits, missed = list(y), 0, []
    for t in x:
        found = next((u for u in left if t == u), None) or next((u for u in left if _alike(t, u)), None)
        if found is None:
            missed.append(t)
        else:
            left.remove(found)
            hits += 1
    if not hits:
        return 0
    ix, iy = [t for t in a[3] if len(t) == 1], [t for t in b[3] if len(t) == 1]
    for initials, others in ((ix, left), (iy, missed)):
        for c in initials:
            match = next((u for u in others if u[0] == c or sound(u)[:1] == sound(c)[:1]), None)
            if match is not None:
                others.remove(match)
                hits += 0.5
            elif others:
                return 0
    if left and missed:
        return 0
    if initial:
        return 1
    return 2 if hits >= 2 else 1


def sameness(a: tuple, b: tuple) -> int:
    """How many family names agree: two for each spelled alike, one for each that only sounds alike."""
    own = lambda p: [t for t in (p[3] if p[0] == "person" else p[1]) if len(t) > 1]
    x, y = own(a), own(b)
    alike = set(x) & set(y)
    heard = {sound(t) for t in x} & {sound(t) for t in y}
    return 2 * len(alike) + len(heard - {sound(t) for t in alike})


def _without(word: str, most: int) -> set[str]:
    """A word, and the word with up to ``most`` letters left out; short words stay as they are."""
    out = {word}
    if len(word) >= LEAST:
        out |= {word[:i] + word[i + 1 :] for i in range(len(word))}
    if most > 1 and len(word) >= 6:
        out |= {word[:i] + word[i + 1 : j] + word[j + 1 :] for i in range(len(word)) for j in range(i + 1, len(word))}
    return out


def forms(p: tuple) -> tuple[set[str], set[str]]:
    """All canonical rewritings of a parsed name as join keys: those by which complete names meet, and those that shortened names share with any."""
    if p[0] == "org":
        own = [t for t in p[1] if len(t) > 1]
        single = {f"o:{c}" for t in own for c in _without(t, 1)}
        return single, single
    said = sorted({sound(t) for t in p[3] if len(t) > 1})
    given = sorted(p[1]) or [sound(p[2])]
    whole = set()
    if not p[5]:
        for t in said:
            ends = {e for u in said if u != t for e in (f"<{u[0]}", f"{u[-1]}>")}
            whole |= {f"{g}:{c}:{e}" for g in given for c in _without(t, 1) for e in ends}
    short = {f"{h}:{c}" for h in heads(p) for t in (*said, *(t for t in p[3] if len(t) > 1)) for c in _without(t, 1)}
    short |= {f"{g}::{c}" for g in p[1] for t in said for c in _without(t, 2)}
    name = p[3][1] if p[5] else joined(p)
    if len(name) >= JOINED:
        short |= {f"j:{c}" for c in _without(sound(name), 1)}
    return whole, short


CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")


def _spelling(name: str) -> str:
    bare = unicodedata.normalize("NFC", name).strip()
    if not re.search(r"\s", bare):
        bare = CAMEL.sub(" ", bare)  # a name typed without blanks
    return " ".join(_letters(bare).split())


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["name", "spelling", "complete", "loose", "whole", "short"]
    for part in (batch.iloc[at : at + AT_ONCE] for batch in batches for at in range(0, len(batch), AT_ONCE)):
        rows = []
        for name in part["name"]:
            spelling = _spelling(name)
            if (p := parse(spelling)) is None:
                continue
            full = complete(p)
            whole, short = forms(p)
            # a given name that no list knows may be misspelled, so it meets others like a shortened one
            rows.append((name, spelling, full, not full or p[0] == "person" and not p[1], sorted(whole) if full else [], sorted(short)))
        yield pd.DataFrame(rows, columns=columns)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["same"] = [compare(parse(a), parse(b)) for a, b in zip(batch["spelling_a"], batch["spelling_b"])]
        batch = batch[batch["same"] > 0].copy()
        batch["exact"] = [sameness(parse(a), parse(b)) for a, b in zip(batch["spelling_a"], batch["spelling_b"])]
        yield batch[["a", "b", "same", "exact", "score", "whole_a", "whole_b"]]


REWRITTEN = "name string, spelling string, complete boolean, loose boolean, whole array<string>, short array<string>"


def spellings(speakers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, spelling, complete, loose, whole, short) once for each written form, forms as hashes, and (id, key) of every row that bears a name.

    Each name is rewritten once, however many rows bear it.
    """
    rows = speakers.select(F.col("id").cast("bigint").alias("id"), F.col("name").cast("string").alias("name")).filter("id is not null and name is not null")
    names = rows.groupBy("name").agg(F.min("id").alias("first"))
    n = max(int(speakers.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x)).alias(c)
    read = names.select("name").repartition(n, F.xxhash64("name")).mapInPandas(_rewrite, REWRITTEN).select("name", "spelling", "complete", "loose", hashed("whole"), hashed("short"))
    read = cut(read.join(names, "name"))
    best = lambda c: F.min_by(c, "first").alias(c)
    keys = cut(read.groupBy("spelling").agg(F.min("first").alias("key"), *(best(c) for c in ("complete", "loose", "whole", "short"))))
    written = read.select("name", "spelling").join(keys.select("spelling", "key"), "spelling")
    return keys, rows.join(written, "name").select("id", "key").distinct()


def _pairs(left: DataFrame, right: DataFrame, both: bool) -> DataFrame:
    """(a, b, n) of a key of ``left`` and one of ``right`` (key, form) that share a form; n is how many keys of ``right`` share it.

    A common form's left keys are dealt into parts, and its right keys go to each
    part, so no task holds all pairs of a form.  With ``both``, the sides are the same.
    """
    sizes = right.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1")
    # merge joins: what is small as shuffled bytes is large as a broadcast table, and grows with the names
    few = left.groupBy("form").agg(F.ceil(F.count("*") / RARE).alias("parts")).hint("merge").join(sizes.hint("merge"), "form").hint("merge")
    one = left.join(few, "form").select("form", F.col("key").alias("a"), F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"))
    other = right.join(few, "form").select("form", F.col("key").alias("b"), "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    met = one.hint("merge").join(other.hint("merge"), ["form", "part"]).filter("a < b" if both else "a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")


def candidates(keys: DataFrame) -> DataFrame:
    """(a, b, score) of spellings that share a form, scored by the rarity of the rarest one; two complete names meet by their own forms only."""
    total = math.log(max(keys.count(), 2))
    whole, short = keys.select("key", F.explode("whole").alias("form")), keys.select("key", "loose", F.explode("short").alias("form"))
    met = _pairs(whole, whole, True).unionByName(_pairs(short.filter("loose").select("key", "form"), short.select("key", "form"), False))
    return met.groupBy("a", "b").agg((F.lit(total) - F.log(F.min("n"))).alias("score"))


def variant_groups(speakers: DataFrame) -> DataFrame:
    """(id, person): rows that name the same person or organisation share the smallest key of their group."""
    keys, members = spellings(speakers)
    named = lambda side: keys.select(F.col("key").alias(side), F.col("spelling").alias(f"spelling_{side}"), F.col("complete").alias(f"whole_{side}"))
    met = candidates(keys).join(named("a"), "a").join(named("b"), "b")
    judged = cut(met.mapInPandas(_judge, "a bigint, b bigint, same int, exact int, score double, whole_a boolean, whole_b boolean"))
    firm = components(judged.filter("same = 2 and whole_a and whole_b").select("a", "b"))
    person = keys.select("key", "complete").join(firm.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "complete", F.coalesce("component", "key").alias("person"))
    whole = person.filter("complete").select(F.col("key").alias("whole"), "person")
    # shortened names: those that fit one person only join it
    short = judged.filter("whole_a <> whole_b").select(F.when(F.col("whole_a"), F.col("b")).otherwise(F.col("a")).alias("key"), F.when(F.col("whole_a"), F.col("a")).otherwise(F.col("b")).alias("whole"), F.struct("same", "exact", F.round("score", 6).alias("score")).alias("fit"))
    fits = short.join(whole, "whole").groupBy("key", "person").agg(F.max("fit").alias("fit"))
    strength = Window.partitionBy("key")
    # a family name spelled alike goes before one that needs a slip, a rarer rewriting before a common one
    best = fits.withColumn("top", F.max("fit").over(strength)).filter("fit = top").groupBy("key").agg(F.count("*").alias("persons"), F.min("person").alias("person"))
    joined = cut(best.filter("persons = 1").select("key", "person"))
    # what is left links among itself where the given names and a family name are full
    alone = keys.filter("not complete").select("key").join(best.select("key"), "key", "left_anti")
    loose = judged.filter("not whole_a and not whole_b").join(alone.select(F.col("key").alias("a")), "a", "left_semi").join(alone.select(F.col("key").alias("b")), "b", "left_semi")
    rest = components(loose.select("a", "b")).select(F.col("node").alias("key"), F.col("component").alias("person"))
    resolved = person.filter("complete").select("key", "person").unionByName(joined).unionByName(rest)
    return members.join(resolved, "key", "left").select("id", F.coalesce("person", "key").alias("person"))


def variant_pairs(speakers: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each pair of rows that name the same person or organisation."""
    groups = variant_groups(speakers)
    left, right = groups.select("person", F.col("id").alias("id_a")), groups.select("person", F.col("id").alias("id_b"))
    return left.join(right, "person").filter("id_a < id_b").select("id_a", "id_b")
