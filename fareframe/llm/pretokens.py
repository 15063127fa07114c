"""Cuts texts into the byte-level tokenizer's pieces with array operations only, no regular expression.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Read as an automaton over
character classes, the state after a character depends on that character and its left neighbour alone: every composed
transition function is constant after two steps. The associative scan over transition functions therefore closes
after one neighbour to the left, and, for the look-ahead of ``\\s+(?!\\S)`` and the contractions, a few to the right.
All boundaries of a batch come from comparisons of shifted class arrays.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers that Unicode 16 added to the 15.1 tables of Python 3.13's unicodedata.
UNICODE_16_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
UNICODE_16_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for kind, ranges in ((LETTER, UNICODE_16_LETTERS), (NUMBER, UNICODE_16_NUMBERS)):
        for low, high in ranges:
            out[low : high + 1] = kind
    out[WHITE_SPACE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 bytes, and the byte position of each."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.int32)
    cp = b.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.flatnonzero((b >= low) & (b < high))
        if len(at):
            v = b[at] & mask
            for k in range(1, more + 1):
                v = (v << 6) | (padded[lead[at] + k] & 0x3F)
            cp[at] = v
    return cp, lead


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pieces, and the first piece of each document (length n + 1)."""
    cp, lead = code_points(data)
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    doc = np.zeros(n + 1, bool)
    doc[np.searchsorted(lead, offs)] = True
    c = classes()[cp]
    prev = np.full(n, 255, np.uint8)  # 255: nothing before
    prev[1:] = c[:-1]
    prev[doc[:-1]] = 255
    nxt = np.full(n, 255, np.uint8)
    nxt[:-1] = c[1:]
    nxt[doc[1:]] = 255
    after_blank = np.zeros(n, bool)
    after_blank[1:] = cp[:-1] == 0x20
    after_blank[doc[:-1]] = False
    space = c == SPACE
    start = np.where(space, (prev != SPACE) | ((nxt != SPACE) & (nxt != 255)), (c != prev) & ~after_blank)
    start |= doc[:-1]
    quote = np.flatnonzero((cp == 0x27) & (prev != OTHER) & ~after_blank)
    if len(quote):
        ahead = np.concatenate([cp, np.zeros(3, cp.dtype)])
        ends = np.concatenate([doc, np.ones(3, bool)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        one = np.where(ends[quote + 1], 0, one)
        two = np.where(ends[quote + 2], 0, two)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, k in ((quote[short], 1), (quote[long & ~short], 2)):
            start[at] = True
            start[at + 1] = False
            rest = at + 1 + k
            start[rest[rest < n]] = True
    first = np.flatnonzero(start)
    starts = lead[first].astype(np.int64)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offs)
