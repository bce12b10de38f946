"""Byte-pair encoding as a finite-state transducer that is made deterministic as it runs.

The encoding of a prefix ends in one token, and two tokens may follow each
other exactly if merging their joined bytes gives the two back.  So reading a
byte needs only the positions from which a token can still grow (the live
positions, no further back than the longest token) and the tokens that lead to
them.  That is a state.  A transition is worked out once, from the vocabulary,
and kept; tokens that all live positions share are emitted at once, so output
lags behind input by a bounded lookahead.  Pieces seen before skip the
transducer through a bounded table.

``Utf8Machine`` is the way back: bytes come in tokens of any cut, text comes out
as soon as a character is complete.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from functools import lru_cache

# Fixed value: where the public tokenizers' files lie unless a caller names another place.
DEFAULT_FOLDER = os.environ.get("CONFAB_TOKENIZERS", "/opt/tokenizers")
MOST_STATES = 300_000  # the table of states starts anew beyond this
MOST_PIECES = 400_000  # so does the table of pieces
MOST_PAIRS = 2_000_000  # and that of tokens that may follow each other


@lru_cache(1)
def split_pattern() -> re.Pattern:
    """The pattern that cuts text into pieces before merging, with the letters and numbers of Unicode written out."""

    def ranges(kind: str) -> str:
        out, start = [], None
        for cp in range(sys.maxunicode + 2):
            inside = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] == kind
            if inside and start is None:
                start = cp
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{cp - 1:08x}" if cp - 1 > start else f"\\U{start:08x}")
                start = None
        return "".join(out)

    letter, number = ranges("L"), ranges("N")
    blank = r" \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # fixed value: white space by the Unicode property
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{letter}]+|[{number}]+|[^{blank}{letter}{number}]+)|[{blank}]+(?![^{blank}])|[{blank}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Token ids of texts for a vocabulary in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        children: list[dict[int, int]] = [{}]
        ends: list[int | None] = [None]
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                nxt = children[at].get(byte)
                if nxt is None:
                    nxt = children[at][byte] = len(children)
                    children.append({})
                    ends.append(None)
                at = nxt
            ends[at] = rank
        self.children, self.ends = children, ends
        self.follows: dict[tuple[int | None, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: live positions, oldest first, each with its trie node, last token and path of tokens not emitted yet
        start = ((0, None, ()),)
        self.numbers = {start: 0}
        self.states = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.finals: list[tuple[int, ...]] = [()]

    def _merged(self, data: bytes) -> list[bytes]:
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, last: int | None, token: int) -> bool:
        key = (last, token)
        known = self.follows.get(key)
        if known is None:
            wanted = [self.tokens[token]] if last is None else [self.tokens[last], self.tokens[token]]
            if len(self.follows) >= MOST_PAIRS:
                self.follows.clear()
            known = self.follows[key] = self._merged(b"".join(wanted)) == wanted
        return known

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition of a state on a byte, worked out from the vocabulary."""
        arrived, kept = None, []
        for node, last, path in self.states[number]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.ends[nxt]
            if arrived is None and token is not None and self.may_follow(last, token):
                arrived = (0, token, (*path, token))
            if self.children[nxt]:
                kept.append((nxt, last, path))
        if arrived is None:
            raise ValueError("a byte is missing from the vocabulary")
        kept.append(arrived)
        paths = [k[2] for k in kept]
        shared, shortest = 0, min(map(len, paths))
        while shared < shortest and all(p[shared] == paths[0][shared] for p in paths):
            shared += 1
        state = tuple((node, last, path[shared:]) for node, last, path in kept)
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.finals.append(state[-1][2])
        move = self.moves[number][byte] = (to, paths[0][:shared])
        return move

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece, emitted while its bytes are read."""
        out: list[int] = []
        if len(self.states) > MOST_STATES:
            self._reset()
        at, moves = 0, self.moves
        for byte in data:
            step = moves[at].get(byte)
            at, emitted = step if step is not None else self._move(at, byte)
            if emitted:
                out.extend(emitted)
        out.extend(self.finals[at])
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty list for null and empty texts."""
        out: list[int] = []
        if not text:
            return out
        pieces, ok, held = self.pieces, False, None
        # a blank between two other signs begins a piece, whatever stands around it: texts are cut there, and what is known is not read again
        for word in text.split(" "):
            if held is None:
                held = word
            elif ok and word and not word[0].isspace():
                ids = pieces.get(held)
                out.extend(self._encode_part(held) if ids is None else ids)
                held = " " + word
            else:
                held += " " + word
            ok = word != "" and not word[-1].isspace()
        ids = pieces.get(held)
        out.extend(self._encode_part(held) if ids is None else ids)
        return out

    def _encode_part(self, part: str) -> tuple[int, ...]:
        pieces, out = self.pieces, []
        for piece in split_pattern().findall(part):
            ids = pieces.get(piece)
            if ids is None:
                ids = tuple(self.encode_bytes(piece.encode("utf-8", "replace")))
                self._keep(piece, ids)
            out.extend(ids)
        self._keep(part, tuple(out))
        return out

    def _keep(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self.pieces) >= MOST_PIECES:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = ids

    def decode(self, ids) -> str:
        """The text of ids, read token by token."""
        machine = Utf8Machine()
        return "".join([*(machine.feed(self.tokens[i]) for i in ids), machine.end()])


class Utf8Machine:
    """Incremental UTF-8: text of the characters complete so far; malformed bytes become U+FFFD."""

    def __init__(self) -> None:
        self.missing = self.value = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.missing:
                if self.low <= byte <= self.high:
                    self.value, self.missing = self.value << 6 | byte & 0x3F, self.missing - 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.value))
                    continue
                self.missing = 0
                self.low, self.high = 0x80, 0xBF
                out.append("�")
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.missing, self.value = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.missing, self.value = 2, byte & 0x0F
                self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
            elif 0xF0 <= byte <= 0xF4:
                self.missing, self.value = 3, byte & 0x07
                self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.missing = self.missing, 0
        return "�" if left else ""


@lru_cache(4)
def transducer(name: str, folder: str = DEFAULT_FOLDER) -> Transducer:
    """The transducer of a rank file, made once in each Python worker."""
    return Transducer(load_ranks(os.path.join(folder, f"{name}.tiktoken")))


RANKED = ("byte_bpe_50k", "byte_bpe_multi_50k")  # fixed values: vocabularies that come as rank files


def counter(name: str, folder: str = DEFAULT_FOLDER):
    """A function from a text to its number of tokens by any of the public tokenizers."""
    if name in RANKED:
        return lambda text: len(transducer(name, folder).encode(text))
    if name == "word_bpe_49k":
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
        known.encode_special_tokens = True
        return lambda text: len(known.encode(text, add_special_tokens=False).ids) if text else 0
    if name == "piece_bpe_32k":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
        return lambda text: len(pieces.encode(text)) if text else 0
    raise ValueError(f"no public tokenizer is named {name}")
