"""Edit distance and agreement of activity sequences.

Distances run over Arrow batches: bit-parallel rows, one integer of as many bits as
the target has events, and each distinct (target, suffix) of a batch once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def aligned(a: bytes, b: bytes) -> int:
    """Optimal string alignment of two sequences of 32-bit codes; code -1 equals nothing.

    The bits of a row say where it grows or falls by one; a row follows from the
    one before it by a few operations on whole integers, however long they are.
    """
    x, y = np.frombuffer(a, "<i4").tolist(), np.frombuffer(b, "<i4").tolist()
    if not x or not y:
        return len(x) + len(y)
    places: dict[int, int] = {}
    for k, c in enumerate(x):
        if c >= 0:
            places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(x)) - 1
    last = 1 << (len(x) - 1)
    up, down, diagonal, match_before = full, 0, 0, 0
    distance = len(x)
    for c in y:
        match = places.get(c, 0)
        swapped = (((~diagonal & full) & match) << 1) & match_before
        diagonal = ((((match & up) + up) ^ up) | match | down | swapped) & full
        grows = down | (~(diagonal | up) & full)
        falls = diagonal & up
        distance += bool(grows & last) - bool(falls & last)
        grows = (grows << 1 | 1) & full
        falls = (falls << 1) & full
        up = falls | (~(diagonal | grows) & full)
        down = grows & diagonal
        match_before = match
    return distance


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … for ``size`` numbers each, one after the other."""
    size = size.astype(np.int64)
    return np.repeat(start.astype(np.int64) - np.cumsum(size) + size, size) + np.arange(size.sum())


def aligned_all(own: np.ndarray, lengths: np.ndarray, row: np.ndarray, other: np.ndarray, start: np.ndarray, size: np.ndarray, vocab: int) -> np.ndarray:
    """:func:`aligned` for many pairs side by side: targets of at most 64 events, one 64-bit word a row.

    ``own`` holds the targets one after the other; pair i compares target ``row[i]``
    with ``size[i]`` codes of ``other`` from ``start[i]``.
    """
    word, one = np.uint64, np.uint64(1)
    places = np.zeros((len(lengths), vocab + 1), word)  # the last column stands for what equals nothing
    of = np.repeat(np.arange(len(lengths)), lengths)
    bit = one << _ranges(np.zeros(len(lengths)), lengths).astype(word)
    real = own >= 0
    np.bitwise_or.at(places, (of[real], own[real]), bit[real])
    order = np.argsort(-size, kind="stable")  # pairs that still run come first
    row, start, ends = row[order], start[order], size[order]
    m = lengths[row].astype(word)
    shift = np.where(m > 0, m - (m > 0).astype(word), 0).astype(word)
    full = np.where(m > 0, ~word(0) >> (word(63) - shift), word(0))
    last = np.where(m > 0, one << shift, word(0))
    up, down, diagonal, before = full.copy(), np.zeros_like(full), np.zeros_like(full), np.zeros_like(full)
    distance = lengths[row].astype(np.int32)
    for k in range(int(ends[0]) if len(ends) else 0):
        n = int(np.searchsorted(-ends, -k, "left"))
        match = places[row[:n], other[start[:n] + k]]
        f, u, d, g = full[:n], up[:n], down[:n], diagonal[:n]
        swapped = (((~g & f) & match) << one) & before[:n]
        g = ((((match & u) + u) ^ u) | match | d | swapped) & f
        grows, falls = d | (~(g | u) & f), g & u
        distance[:n] += ((grows & last[:n]) > 0).astype(np.int32) - ((falls & last[:n]) > 0)
        grows, falls = (grows << one | one) & f, (falls << one) & f
        up[:n], down[:n] = falls | (~(g | grows) & f), grows & g
        diagonal[:n], before[:n] = g, match
    distance = np.where(m > 0, distance, ends).astype(np.int32)
    out = np.empty_like(distance)
    out[order] = distance
    return out


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]


def _list_distances(targets: pa.Array, suffixes: pa.Array) -> pa.Array:
    """Per row the distances of a target to each of its suffixes; null where a side is null."""
    inner = suffixes.values
    words = pa.concat_arrays([targets.values.cast(pa.string()), inner.values.cast(pa.string())]).dictionary_encode().indices
    codes = words.fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4")
    own, other = codes[: len(targets.values)], codes[len(targets.values) :]
    t_off, s_off, i_off = _offsets(targets), _offsets(suffixes), _offsets(inner)
    t_null, s_null = targets.is_null().to_pylist(), suffixes.is_null().to_pylist()
    i_null = inner.is_null().to_numpy(zero_copy_only=False)
    vocab = int(codes.max(initial=-1)) + 1
    lengths, each = np.diff(t_off), np.diff(i_off)
    whole = np.zeros(len(inner), np.int32)
    nothing = np.array(t_null, dtype=bool) | np.array(s_null, dtype=bool)
    counts = np.where(nothing, 0, np.diff(s_off))
    rows_at_once = max(1, min(512, (1 << 21) // (vocab + 1)))
    for low in range(0, len(targets), rows_at_once):
        rows = np.arange(low, min(low + rows_at_once, len(targets)))
        short = rows[(lengths[rows] <= 64) & (counts[rows] > 0)]
        if len(short):
            pair = _ranges(s_off[short], counts[short])
            row = np.repeat(np.arange(len(short)), counts[short])
            place = _ranges(t_off[short], lengths[short])
            whole[pair] = aligned_all(own[place], lengths[short], row, other, i_off[pair].astype(np.int64), each[pair], vocab)
        for k in rows[(lengths[rows] > 64) & (counts[rows] > 0)].tolist():
            target = own[t_off[k] : t_off[k + 1]].tobytes()
            for j in range(s_off[k], s_off[k + 1]):
                whole[j] = aligned(target, other[i_off[j] : i_off[j + 1]].tobytes())
    found = pa.array(whole, pa.int32(), mask=i_null)
    return pa.ListArray.from_arrays(pa.array(s_off, pa.int32()), found, mask=pa.array(nothing))


def edit_distances(target: Column, suffixes: Column) -> Column:
    """Insert, delete, replace, or swap two neighbours: distance of a target to each of several sequences."""

    @F.arrow_udf("array<int>")
    def distances(a: pa.Array, b: pa.Array) -> pa.Array:
        return _list_distances(a, b)

    return distances(target, suffixes)


def edit_distance(a: Column, b: Column) -> Column:
    """Insert, delete, replace, or swap two neighbours (optimal string alignment)."""
    return F.get(edit_distances(a, F.array(b)), F.lit(0))


def _similar(distance: Column, target: Column, predicted: Column) -> Column:
    return 1 - distance / F.greatest(F.size(target), F.size(predicted), F.lit(1))


def similarity(target: Column, predicted: Column) -> Column:
    """1 − distance / longer length; two empty sequences agree."""
    return _similar(edit_distance(target, predicted), target, predicted)


def similarities(target: Column, suffixes: Column) -> Column:
    """Similarity of a target to each of several sequences."""
    return F.zip_with(edit_distances(target, suffixes), suffixes, lambda d, s: _similar(d, target, s))


def exact_match(target: Column, predicted: Column) -> Column:
    return F.when(target == predicted, 1.0).otherwise(0.0)


def token_accuracy(target: Column, predicted: Column) -> Column:
    """Positions that agree over the longer length."""
    longest = F.greatest(F.size(target), F.size(predicted))
    hits = F.aggregate(
        F.zip_with(target, predicted, lambda x, y: F.when(x == y, 1).otherwise(0)),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return F.when(longest == 0, F.lit(0.0)).otherwise(hits / longest)
