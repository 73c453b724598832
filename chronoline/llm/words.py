"""Vectorised splitting of texts into the words of a byte-pair tokenizer, and a bounded table of encoded words."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from chronoline.llm.shared import Weights, ragged_take

OTHER, LETTER, NUMBER, SPACE, SPECIAL = range(5)
#: Code points with the Unicode property White_Space (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WEIGHTS = Weights(0x2545F4914F6CDD1D)
PIECES = 4_000_000


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its class, and whether a normalizer (NFC, lower case) may change how its neighbours split."""
    kind, shifty = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        cat = unicodedata.category(c)
        if cat[0] == "L":
            kind[i] = LETTER
        elif cat[0] == "N":
            kind[i] = NUMBER
        if cat[0] in "MC" or i >= 0x3000 or (i > 127 and cat[0] in "LSNP" and (len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c)) or 0x1100 <= i < 0x1200:
            shifty[i] = True
    kind[WHITE] = SPACE
    shifty[[9, 10, 11, 12, 13]] = False
    return kind, shifty


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with row offsets as code points with row offsets."""
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), heads[offsets]


def split(cp: np.ndarray, bounds: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words. spaced: white space is kept and a space joins the word after it; else white space is dropped and digits stand alone."""
    kind = tables()[0][cp]
    n = len(cp)
    new = np.ones(n + 1, bool)
    new[1:n] = kind[1:] != kind[:-1]
    new[bounds] = True
    if spaced:
        ends = np.flatnonzero(new[1:]) + 1
        ends = ends[(kind[ends - 1] == SPACE)]
        inner = np.zeros(n + 1, bool)
        inner[bounds] = True
        ends = ends[~inner[ends]]
        new[ends - 1] = True
        new[ends[cp[ends - 1] == 32]] = False
        at = np.flatnonzero(new)
        return at[:-1], at[1:]
    new[:n] |= kind == NUMBER
    at = np.flatnonzero(new)
    keep = kind[at[:-1]] != SPACE
    return at[:-1][keep], at[1:][keep]


def odd_rows(cp: np.ndarray, bounds: np.ndarray, normalized: bool) -> np.ndarray:
    """Rows whose words need the exact pattern: a contraction may stand in them or, if a normalizer runs, a shifty code point."""
    bad = np.zeros(len(cp), bool)
    if len(cp) > 1:
        at = np.flatnonzero(cp[:-1] == 39)
        bad[at] = np.isin(cp[at + 1] | 32, [ord(c) for c in "strvmld"])
    bad |= cp == 0x17F
    if normalized:
        bad |= tables()[1][cp]
    total = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(bad, out=total[1:])
    return total[bounds[1:]] > total[bounds[:-1]]


class WordTable:
    """Encoded distinct words by a hash of 128 bits, emptied when it holds `most` words or PIECES ids: memory stays bounded whatever the vocabulary."""

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.second = [np.zeros(0, np.uint64)]
        self.start, self.size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.flat: list[np.ndarray] = []
        self.total = 0

    def ids(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, concatenated, and the number of ids of each word."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first_hash, second_hash = WEIGHTS.spans(cp, starts, ends)
        code, names = pd.factorize(first_hash)
        second = np.zeros(len(names), np.uint64)
        second[code] = second_hash
        if (second[code] != second_hash).any():  # two words of the batch share 64 bits: tell them apart by all 128, and keep neither
            both, code = np.unique(np.stack([first_hash, second_hash], axis=1), axis=0, return_inverse=True)
            names, second, code = both[:, 0] ^ both[:, 1], both[:, 1], code.ravel()
            self.clear()
        elif len(self.row) + len(names) > self.most or self.total > PIECES:
            self.clear()
        rows = np.array([self.row.get(h, -1) for h in names.tolist()], np.int64)
        if len(self.second[0]):
            rows[(rows >= 0) & (self.second[0][rows] != second)] = -1  # another word of the same 64 bits gives way
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            first = np.full(len(names), len(code), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            s, e = starts[first[fresh]], ends[first[fresh]]
            sub = cp[ragged_take(s, e - s)].astype("<u4").tobytes().decode("utf-32-le")
            cuts = np.concatenate([[0], np.cumsum(e - s)]).tolist()
            flat, size = self.encode([sub[a:b] for a, b in zip(cuts, cuts[1:])])
            base = len(self.second[0])
            rows[fresh] = base + np.arange(len(fresh))
            self.row.update(zip(names[fresh].tolist(), range(base, base + len(fresh))))
            self.second = [np.concatenate([self.second[0], second[fresh]])]
            self.start.append(self.total + np.cumsum(size) - size)
            self.size.append(size)
            self.flat.append(flat)
            self.total += len(flat)
            self.start, self.size, self.flat = [np.concatenate(self.start)], [np.concatenate(self.size)], [np.concatenate(self.flat)]
        rows = rows[code]
        size = self.size[0][rows]
        return self.flat[0][ragged_take(self.start[0][rows], size)], size
