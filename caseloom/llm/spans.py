"""Whole text columns as byte arrays: words, spans and their hashes, in numpy.

An Arrow string column is one buffer and its offsets, so a task handles a batch
without making a Python string per document or word. ``slices`` keeps the
temporaries of a step to a few megabytes; only one document longer than that
makes a larger step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_BYTES = 2 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

#: The bytes that separate words: tab to carriage return, and space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(off) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row makes its own range."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def runs(kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero ``kind`` that do not cross a row: starts and ends."""
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[off] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """White-space separated words: starts and ends."""
    return runs((~SPACE[data]).view(np.uint8), off)


def rows_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row that each position belongs to."""
    return np.searchsorted(off, starts, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, min(SLICE_BYTES, 2 * n))
        _POWERS = tuple(
            np.concatenate(([U64(1)], np.multiply.accumulate(np.full(size - 1, x, dtype=U64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))
        )
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U64), np.zeros(0, U64))
_BASE = 0x9E3779B97F4A7C15


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap.

    Differences of a running polynomial give it, over a slice at a time; a span
    longer than a slice is summed slice by slice. The value depends on the
    span's bytes alone.
    """
    size = ends - starts
    out = np.empty(len(starts), dtype=U64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right"))
        lo = int(starts[first])
        if last <= first:
            value, place = 0, 1
            for at in range(lo, int(ends[first]), SLICE_BYTES):
                part = data[at : min(at + SLICE_BYTES, int(ends[first]))]
                value += int((_BYTE[part] * _powers(len(part))[0]).sum()) * place
                place = place * pow(_BASE, len(part), 1 << 64) & (1 << 64) - 1
            out[first] = value & (1 << 64) - 1
            first += 1
            continue
        hi = int(ends[last - 1])
        power, inverse = _powers(hi - lo)
        total = np.empty(hi - lo + 1, dtype=U64)
        total[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * power, out=total[1:])
        at = starts[first:last] - lo
        out[first:last] = (total[ends[first:last] - lo] - total[at]) * inverse[np.minimum(at, hi - lo - 1)]
        first = last
    return mix64(out + size.astype(U64))


def _edge_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last 8 bytes of each span as integers, twice all bytes of a span of fewer; ``data`` has 8 bytes at least."""
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    bits = np.minimum(ends - starts, 8).astype(U64) * U64(8)
    at = np.minimum(starts, len(data) - 8)
    first = (words[at] >> (starts - at).astype(U64) * U64(8)) << (U64(64) - bits)
    return first, np.where(bits < 64, first, words[np.maximum(ends - 8, 0)])


def numbered_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal for equal bytes only, and the first span of each number.

    Spans of one hash are compared with the first of them; some bytes, such as a
    Thue-Morse text and its swap, share their hash without being equal.
    """
    which, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), dtype=np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    size = ends - starts
    like = first[which]
    again = np.flatnonzero(like != np.arange(len(which)))
    other = [again[size[again] != size[like[again]]]]
    again = again[size[again] == size[like[again]]]
    if len(data) >= 8:
        # two words hold spans of up to 16 bytes
        short, again = again[size[again] <= 16], again[size[again] > 16]
        begin, end = _edge_words(data, starts, ends)
        other.append(short[(begin[short] != begin[like[short]]) | (end[short] != end[like[short]])])
    for a, b in slices(np.concatenate(([0], np.cumsum(size[again]))), SLICE_BYTES // 2):
        part = again[a:b]
        n = size[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wrong = data[np.repeat(starts[part], n) + at] != data[np.repeat(starts[like[part]], n) + at]
        other.append(part[np.unique(np.repeat(np.arange(len(part)), n)[wrong])])
    more: dict[bytes, int] = {}
    new_first = []
    for k in np.sort(np.concatenate(other)).tolist():
        text = data[starts[k] : ends[k]].tobytes()
        if text not in more:
            more[text] = len(distinct) + len(more)
            new_first.append(k)
        which[k] = more[text]
    return which, np.concatenate((first, np.array(new_first, dtype=np.int64)))


def per_row(counts_of: np.ndarray, n: int) -> np.ndarray:
    """How many items each of ``n`` rows has, from the items' rows."""
    return np.bincount(counts_of, minlength=n)
