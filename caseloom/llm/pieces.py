"""Pre-tokens of the usual byte-level pattern, found with array steps.

The pattern splits contractions, letters, numbers and other signs, each with one
leading space, and white space. All its choices are local, so the starts follow
from each character's class and its neighbours.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            at = np.arange(run.start(), run.end())
            table[np.where(at < 0xD800, at, at + 0x800)] = kind
    # fixed values: the code points of White_Space
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each UTF-8 character begins, and its code point."""
    if int(data.max()) < 0x80:
        return np.arange(len(data)), data
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    cp = first.astype(np.uint32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        at = np.flatnonzero((first >= low) & (first < high))
        if len(at):
            value = cp[at] & mask
            for k in range(1, more + 1):
                value = (value << 6) | (data[lead[at] + k] & 0x3F)
            cp[at] = value
    return lead, cp


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of all pre-tokens of all rows; they cover every byte."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead, cp = code_points(data)
    n = len(lead)
    kind = classes()[cp]
    head = np.zeros(n + 3, dtype=bool)
    head[np.searchsorted(lead, off)] = True
    head[n:] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    joined = np.zeros(n, dtype=bool)
    joined[1:] = (cp[:-1] == 0x20) & (kind[1:] != SPACE) & ~head[1:n]
    start &= ~joined
    last = np.zeros(n, dtype=bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n]
    start |= last
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        ahead = np.concatenate((cp, np.zeros(2, cp.dtype)))
        one, two = ahead[quote + 1], ahead[quote + 2]
        one = np.where(head[quote + 1], 0, one)
        two = np.where(head[quote + 1] | head[quote + 2], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        after = np.concatenate((quote[short] + 2, quote[long] + 3))
        start[after[after < n]] = True
    starts = lead[start]
    return starts, np.append(starts[1:], len(data))
