"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts elsewhere too.

Suffixes are first sorted out by content, then each task builds suffix arrays by
the difference-cover algorithm over the suffixes that may repeat.

1. Anchors. The least hash of the grams within each string (the right-most of
   equals) marks its anchor; equal strings have equal anchors at equal offsets. The
   strings of an anchor are split by offset into two halves, so that all of a half
   share known bytes: its key. With strings of 400 bytes grams have 64, keys share
   232 and about two in 337 bytes are anchors; with 101 bytes it is 16, 58 and 86.
   Half and key decide which task compares them; its context is all their bytes.
   Keys are counted first: an anchor whose key occurs once holds no repeat and goes
   no further.
2. Contexts that occur as a whole more than once are settled by counting: each
   string in them repeats. Keys with one context hold no repeat.
3. The rest, one row per distinct context of a key, go to the key's task, which
   settles eighths of their offsets in the same way. For what is left it sorts
   sampled triples, recurses on their names, merges the remaining suffixes
   (``suffix_array``) and compares the ``length``-byte prefixes of adjacent suffixes.
4. Ranges of repeated starts go back to their documents.

A key with more than ``GROUP`` distinct contexts is dealt again by an eighth of
its offsets, with so much longer keys; what is then still larger is counted
string by string. So no task holds an unbounded group, and nothing is left out.

Texts are UTF-8 bytes; null is empty; matches never cross documents. Strings are
judged on the input. Rows equal in id and text are two documents that share one
decision (all of such a text repeats, from ``length`` bytes on).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.bpe import spread
from caseloom.llm.exact import BLOCK_BITS, _bit
from caseloom.llm.spans import _BYTE, _powers, mix64, slices, text_bytes
from caseloom.llm.tables import fresh, held, join_groups, lean, stored, text_of

#: bytes of a string, unless a caller says otherwise
LENGTH = 400
EIGHTHS = 8
GROUP = 4096
#: bits for each repeated key in the filter of anchors
KEY_BITS = 16
BATCH = 1 << 20
#: bytes of text whose anchors are found at a time; smaller arrays stay in the cache as well
PIECE = 1 << 18


@dataclass(frozen=True)
class Strings:
    """Strings of ``length`` bytes (16 at least), and the grams that anchor them."""

    length: int = LENGTH

    def __post_init__(self) -> None:
        if self.length < 16:
            raise ValueError("strings have 16 bytes at least")

    @property
    def gram(self) -> int:
        """The largest power of two up to a sixth of the length."""
        return 1 << ((self.length // 6).bit_length() - 1)

    @property
    def window(self) -> int:
        return self.length - self.gram + 1

    @property
    def sides(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """Offsets of a string's start before its anchor: the near half (side 0) and the far half (side 1)."""
        half = self.window // 2
        return (0, half), (half + 1, self.length - self.gram)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the gram that starts at each byte, by doubling."""
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    k = 1
    while k < gram:
        h = h[:-k] * np.uint32(0x85EBCA77) + (h[k:] ^ (h[k:] >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(13)
        k *= 2
    return h


def window_anchors(data: np.ndarray, strings: Strings) -> np.ndarray:
    """Anchor of the string that starts at each byte: right-most least gram."""
    h = gram_hashes(data, strings.gram)
    n, window = len(h), strings.window
    key = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    key[:n] = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    tiles = key.reshape(-1, window)
    before = np.minimum.accumulate(tiles, axis=1).ravel()
    after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - window + 1], before[window - 1 : n])
    return (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


class Ranges:
    """64-bit hashes of any byte ranges of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.inverse = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[:-1], out=self.total[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix64((self.total[high] - self.total[low]) * self.inverse[low] + (high - low).astype(np.uint64))


def anchor_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray, valid: np.ndarray, strings: Strings, after: int = -1) -> dict[str, np.ndarray]:
    """Rows (doc, at, side, key, context) for the anchors of the ``valid`` string starts.

    ``start`` and ``end`` bound each document in ``data``; anchors up to ``after`` are left out.
    """
    a = window_anchors(data, strings)[valid]
    new = np.append(True, a[1:] != a[:-1]) & (a > after) if len(a) else np.zeros(0, bool)
    a = a[new]
    doc = np.searchsorted(start, a, "right") - 1
    ranges = Ranges(data)
    out: dict[str, list] = {"doc": [], "at": [], "side": [], "key": [], "context": []}
    length = strings.length
    for side, (near, far) in enumerate(strings.sides):
        fits = (a - near >= start[doc]) & (a - far + length <= end[doc])
        at, d = a[fits], doc[fits]
        key = ranges.of(at - near, at - far + length) ^ np.uint64(side)
        low, high = np.maximum(start[d], at - far), np.minimum(end[d], at - near + length)
        context = mix64(ranges.of(low, high) ^ mix64(key + (at - low).astype(np.uint64)))
        for name, value in zip(out, (d, at - start[d], np.full(len(at), side), key.view(np.int64), context.view(np.int64)), strict=True):
            out[name].append(value)
    return {k: np.concatenate(v) for k, v in out.items()}


def text_anchors(data: np.ndarray, off: np.ndarray, strings: Strings, piece: int = PIECE) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(first row, anchor rows) of a text column, ``piece`` bytes at a time: the arrays take some 60 bytes for each of text."""
    length = strings.length
    for a, b in slices(off, piece):
        lo, hi = int(off[a]), int(off[b])
        size = np.diff(off[a : b + 1])
        if hi - lo <= piece:
            long = np.flatnonzero(size >= length)
            if not len(long):
                continue
            start, room = off[a:b][long] - lo, size[long] - length + 1
            valid = np.arange(int(room.sum())) + np.repeat(start - (np.cumsum(room) - room), room)
            rows = anchor_rows(data[lo:hi], start, start + size[long], valid, strings)
            rows["doc"] = long[rows["doc"]]
            yield a, rows
            continue
        last = -1
        for low in range(0, hi - lo - length + 1, piece):
            high = min(low + piece, hi - lo - length + 1)
            begin, stop = max(0, low - length), min(hi - lo, high + 2 * length)
            rows = anchor_rows(data[lo + begin : lo + stop], np.array([0]), np.array([stop - begin]), np.arange(low - begin, high - begin), strings, last - begin)
            rows["at"] = rows["at"] + begin
            if len(rows["at"]):
                last = max(last, int(rows["at"].max()))
            yield a, rows


def anchors(rows: DataFrame, strings: Strings) -> DataFrame:
    """uid, at, side, key, context of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            uid = batch.column(0).to_numpy()
            for first, found in text_anchors(data, off, strings):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[first + found["doc"]]), pa.array(found["at"]), pa.array(found["side"].astype(np.int32)), pa.array(found["key"]), pa.array(found["context"])],
                    ["uid", "at", "side", "key", "context"],
                )

    return rows.mapInArrow(lean(run), "uid long, at long, side int, key long, context long")


def anchor_keys(rows: DataFrame, strings: Strings) -> DataFrame:
    """The keys of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in text_anchors(*text_bytes(batch.column(0)), strings):
                yield pa.RecordBatch.from_arrays([pa.array(found["key"])], ["key"])

    return rows.select("text").mapInArrow(lean(run), "key long")


def possible_anchors(rows: DataFrame, strings: Strings, broadcast_mb: int = 64) -> DataFrame:
    """All anchors whose key occurs twice or more, and the few whose key falls on the same bit as one of those.

    Repeated keys become bitmaps of ``KEY_BITS`` bits a key, which are broadcast
    while they have at most ``broadcast_mb``; beyond that anchors meet the keys by
    a shuffle, keys of many anchors apart.
    """
    keys = held(anchor_keys(rows, strings).groupBy("key").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"))
    count, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("uses"), F.lit(0))).first()
    every = anchors(rows, strings)
    blocks = max(1, -(-count * KEY_BITS // BLOCK_BITS))
    if blocks * BLOCK_BITS // 8 > broadcast_mb << 20:
        return join_groups(every, keys, "key", "uses", total).drop("uses")
    block, place = F.pmod(F.col("key"), F.lit(blocks)), F.pmod(F.xxhash64("key"), F.lit(BLOCK_BITS)).cast("int")
    bitmaps = keys.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(place.cast("long")).alias("bits"))
    return every.withColumn("block", block).join(F.broadcast(bitmaps), "block").where(_bit(F.col("bits"), place)).drop("block", "bits")


# ---- the suffix array of one batch


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``s`` (values from 1) by the difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    text = np.concatenate((s.astype(np.int64), [0, 0, 0]))
    # sampled triples; a text of length 1 modulo 3 has one more, of zeros
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    width = int(text.max()) + 1
    if width < 1 << 20:
        triple = (text[sample] * width + text[sample + 1]) * width + text[sample + 2]
        order = np.argsort(triple, kind="stable")
        differ = np.append(True, triple[order][1:] != triple[order][:-1])
    else:
        order = np.lexsort((text[sample + 2], text[sample + 1], text[sample]))
        t = sample[order]
        differ = np.append(True, (text[t[1:]] != text[t[:-1]]) | (text[t[1:] + 1] != text[t[:-1] + 1]) | (text[t[1:] + 2] != text[t[:-1] + 2]))
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(differ)
    if not differ.all():
        order = suffix_array(names)
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sorted_sample] = np.arange(1, len(sorted_sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    # the remaining suffixes, by their first letter and the rank behind it
    rest = np.arange(0, n, 3)
    scale = len(sample) + 2
    rest = rest[np.argsort(text[rest] * scale + rank[rest + 1], kind="stable")]
    # merge: how many sampled suffixes of each residue come before
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(text[first] * scale + rank[first + 1], text[rest] * scale + rank[rest + 1])
    pair = lambda i: (text[i] * width + text[i + 1]) * scale + rank[i + 2]
    before = before + np.searchsorted(pair(second), pair(rest))
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(rest))
    taken = np.zeros(n, dtype=bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = sorted_sample
    return out


def repeated_starts(symbols: np.ndarray, starts: np.ndarray, size: np.ndarray, name: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the ``starts`` begin a string of ``size`` symbols that also begins at another (name, place).

    Strings of one first few symbols must have one size: those of a group do, and each holds the group's symbol.
    """
    order = suffix_array(symbols)
    index = np.full(len(symbols), -1)
    index[starts] = np.arange(len(starts))
    line = index[order]
    line = line[line >= 0]
    if not len(line):
        return np.zeros(0, dtype=bool)
    p, q = starts[line[:-1]], starts[line[1:]]
    room = size[line]
    same = np.flatnonzero(room[:-1] == room[1:])
    joined = np.zeros(len(line), dtype=bool)
    for k in range(int(size.max())):
        done = room[same] <= k
        joined[same[done] + 1] = True
        same = same[~done]
        same = same[symbols[p[same] + k] == symbols[q[same] + k]]
    joined[same + 1] = True
    heads = np.flatnonzero(~joined)
    owner = np.cumsum(~joined) - 1
    # several: a start of the string differs from the string's first one
    head = line[heads][owner]
    other = (name[line] != name[head]) | (place[line] != place[head])
    several = np.bincount(owner[other], minlength=len(heads)) > 0
    out = np.zeros(len(starts), dtype=bool)
    out[line] = several[owner]
    return out


CONTEXT = "key long, uid long, low long, near int, far int, anchor long, bytes binary"


def cut_contexts(wanted: DataFrame, rows: DataFrame, strings: Strings) -> DataFrame:
    """Bytes of the wanted contexts; those of large keys in eighths of their offsets."""
    length, sides = strings.length, strings.sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(2))
            uid = batch.column(0).to_pylist()
            for k, items in enumerate(batch.column(1)):
                text = data[off[k] : off[k + 1]]
                out: list[tuple] = []
                for item in items.as_py():
                    at, key = item["at"], item["key"]
                    near, far = sides[item["side"]]
                    if not item["large"]:
                        low = max(0, at - far)
                        out.append((key, uid[k], low, near, far, at, text[low : min(len(text), at - near + length)].tobytes()))
                        continue
                    width = -(-(far - near + 1) // EIGHTHS)
                    for n in range(near, far + 1, width):
                        f = min(n + width - 1, far)
                        if at - n < 0 or at - f + length > len(text):
                            continue
                        shared = hashlib.blake2b(text[at - n : at - f + length].tobytes(), digest_size=8, key=bytes([n // width])).digest()
                        low = max(0, at - f)
                        out.append((int.from_bytes(shared, "little", signed=True), uid[k], low, n, f, at, text[low : min(len(text), at - n + length)].tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, o, strict=True)) for o in out], schema=SCHEMA)

    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("key", "at", "side", "large")).alias("items"))
    return lists.join(rows, "uid").select("uid", "items", "text").mapInArrow(lean(run), CONTEXT)


NAMES = ["key", "uid", "low", "near", "far", "anchor", "bytes"]
SCHEMA = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("low", pa.int64()), ("near", pa.int32()), ("far", pa.int32()), ("anchor", pa.int64()), ("bytes", pa.binary())])


def starts_in(row: dict, length: int) -> tuple[int, int]:
    """First and last start, within the context, of its half's strings."""
    first = max(0, row["anchor"] - row["far"] - row["low"])
    last = min(row["anchor"] - row["near"] - row["low"], len(row["bytes"]) - length)
    return first, last


def sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """Ranges (uid, low, high) of repeated starts; whole keys, a batch at a time, through one suffix array."""

    def batches_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held, size, group, key = [], 0, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != key:
                    held += group if len(group) > 1 else []
                    size += sum(len(r["bytes"]) for r in group) if len(group) > 1 else 0
                    group, key = [], row["key"]
                    if size >= BATCH:
                        yield held
                        held, size = [], 0
                group.append(row)
        held += group if len(group) > 1 else []
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of_keys(batches):
            yield ranges_batch(*batch_repeats(rows, length))

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), RANGE)


def condensed(flat: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, stop: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of bytes as symbols, one after the other, and where each begins.

    The bytes from ``left`` to ``right``, the same in all ranges of a group, become the group's symbol.
    """
    before, behind = left - start, stop - right
    size = before + 1 + behind
    room = np.cumsum(size) - size
    symbols = np.empty(int(size.sum()), dtype=np.int64)
    middle = room + before
    symbols[middle] = group + 257
    rest = np.ones(len(symbols), dtype=bool)
    rest[middle] = False
    # the two byte runs of each range, in order
    symbols[rest] = spread(flat, np.stack((start, right), axis=1).ravel(), np.stack((before, behind), axis=1).ravel()).astype(np.int64) + 1
    return symbols, room


def batch_repeats(rows: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, place) of the repeated starts in the contexts of some whole keys.

    Each context is taken in eighths of its offsets: an eighth whose bytes all
    occur again is settled, one whose shared bytes occur nowhere else is out, and
    the distinct rest goes into one suffix array, where the bytes that the eighths of
    one group share are one symbol: only what stands around them has to be sorted.
    """
    flat = np.frombuffer(b"".join(r["bytes"] for r in rows), dtype=np.uint8)
    size = np.array([len(r["bytes"]) for r in rows])
    base = np.cumsum(size) - size
    uid, low = np.array([r["uid"] for r in rows]), np.array([r["low"] for r in rows])
    near, far = np.array([r["near"] for r in rows]), np.array([r["far"] for r in rows])
    anchor = np.array([r["anchor"] for r in rows]) - low
    width = -(-(far - near + 1) // EIGHTHS)
    ranges, parts = Ranges(flat), []
    for k in range(EIGHTHS):
        n = near + k * width
        f = np.minimum(n + width - 1, far)
        row = np.flatnonzero((n <= far) & (anchor - n >= 0) & (anchor - f + length <= size))
        n, f, a = n[row], f[row], anchor[row]
        start, stop = np.maximum(0, a - f), np.minimum(size[row], a - n + length)
        left, right = a - n, a - f + length
        shared = ranges.of(base[row] + left, base[row] + right) ^ mix64((n << 16 | f).astype(np.uint64))
        whole = mix64(ranges.of(base[row] + start, base[row] + stop) ^ mix64(shared + (a - start).astype(np.uint64)))
        parts.append((row, start, left, right, stop, shared, whole))
    row, start, left, right, stop, shared, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(row):
        return uid[:0], low[:0]
    _, one, kind, uses = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    _, group = np.unique(shared[one], return_inverse=True)
    open_group = (np.bincount(group) > 1) & (np.bincount(group, uses == 1) > 0)
    settled = uses[kind] > 1
    last = stop - length
    count = np.where(settled, np.maximum(last - start + 1, 0), 0)
    of = np.repeat(np.arange(len(row)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]
    found_uid, found_place = [uid[row[of]]], [place + low[row[of]]]
    chosen = open_group[group]
    pick = one[chosen]
    if len(pick):
        r, first = row[pick], start[pick]
        symbols, room = condensed(flat, base[r] + first, base[r] + left[pick], base[r] + right[pick], base[r] + stop[pick], group[chosen])
        count = np.maximum(stop[pick] - length - first + 1, 0)
        of = np.repeat(np.arange(len(pick)), count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = inside + first[of] + low[r][of]
        string = length - (right - left)[pick] + 1
        hit = repeated_starts(symbols, room[of] + inside, string[of], uid[r][of], at)
        found_uid.append(uid[r][of][hit])
        found_place.append(at[hit])
    name, at = np.concatenate(found_uid), np.concatenate(found_place)
    order = np.lexsort((at, name))
    name, at = name[order], at[order]
    new = np.append(True, (name[1:] != name[:-1]) | (at[1:] != at[:-1])) if len(name) else np.zeros(0, bool)
    return name[new], at[new]


RANGE = "uid long, low long, high long"


def ranges_batch(uid: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring places as ranges."""
    new = np.append(True, (uid[1:] != uid[:-1]) | (place[1:] != place[:-1] + 1)) if len(uid) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(uid)) - 1 if len(heads) else heads
    return pa.RecordBatch.from_arrays([pa.array(uid[heads], pa.int64()), pa.array(place[heads], pa.int64()), pa.array(place[tails], pa.int64())], ["uid", "low", "high"])


def counted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """The same ranges for keys of any size, string by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], dtype=np.uint8)
                first, last = starts_in(row, length)
                if last < first:
                    continue
                at = np.arange(first, last + 1)
                h = Ranges(data).of(at, at + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(at), row["uid"])), pa.array(at + row["low"])], ["h", "uid", "low"])

    strings = stored(contexts.mapInArrow(lean(run), "h long, uid long, low long").distinct(), "strings")
    counts = stored(strings.groupBy("h").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "counts")
    return join_groups(strings, counts, "h", "uses", strings.count()).select("uid", "low", F.col("low").alias("high"))


def repeated_ranges(rows: DataFrame, group: int = GROUP, length: int = LENGTH) -> DataFrame:
    """uid and the list of ranges of its repeated starts, from rows (uid, text)."""
    strings = Strings(length)
    sides = strings.sides
    found = stored(possible_anchors(rows, strings), "anchors")
    contexts = found.groupBy("context").agg(
        F.count(F.lit(1)).alias("uses"), F.first("key").alias("key"), F.first("uid").alias("uid"), F.first("at").alias("at"), F.first("side").alias("side")
    )
    contexts = stored(contexts, "contexts")
    total = found.count()
    # settled: whole contexts that repeat
    repeated = contexts.where("uses > 1").select("context", "uses")
    near = F.when(F.col("side") == 0, sides[0][0]).otherwise(sides[1][0])
    far = F.when(F.col("side") == 0, sides[0][1]).otherwise(sides[1][1])
    settled = join_groups(found.select("uid", "at", "side", "context"), repeated, "context", "uses", total)
    settled = settled.select("uid", (F.col("at") - far).alias("low"), (F.col("at") - near).alias("high"))
    # open: keys with several contexts, one of which occurs once
    keys = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("uses").alias("fewest")).where("members > 1 and fewest = 1")
    keys = held(keys.select("key", "members"))
    wanted = join_groups(contexts.select("key", "uid", "at", "side"), keys, "key", "members", total).withColumn("large", F.col("members") > group)
    open_ = stored(cut_contexts(wanted, rows, strings), "open")
    sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    # without a larger key there is nothing to count: no tables are written for it, and all keys are compared as they are
    if (sizes.agg(F.max("members")).first()[0] or 0) <= group:
        every = settled.unionByName(sorted_repeats(open_, length))
    else:
        large = stored(sizes.where(F.col("members") > group), "large")
        compared = sorted_repeats(open_.join(large.select("key"), "key", "left_anti"), length)
        counted = counted_repeats(open_.join(large.select("key"), "key", "left_semi"), length)
        every = settled.unionByName(compared).unionByName(counted)
    return every.groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def removed_spans(size: int, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed runs (start, end) of a text of ``size`` bytes."""
    low, high = np.maximum(low, 0), np.minimum(high, size - length)
    keep = low <= high
    low, high = low[keep], high[keep] + length
    if not len(low):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > high[:-1])
    heads = np.flatnonzero(new)
    return np.stack((low[heads], high[np.append(heads[1:], len(low)) - 1]), axis=1)


def spans_by_row(batch_ranges: pa.Array, sizes: np.ndarray, length: int = LENGTH) -> Iterator[np.ndarray]:
    for size, ranges in zip(sizes.tolist(), batch_ranges, strict=True):
        values = ranges.values
        if values is None or not len(values):
            yield np.zeros((0, 2), dtype=np.int64)
        else:
            yield removed_spans(size, values.field("low").to_numpy(), values.field("high").to_numpy(), length)


def kept_bytes(text: np.ndarray, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text.tobytes()
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[edges[k] : edges[k + 1]].tobytes() for k in range(0, len(edges), 2))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), text_of(docs, text)).alias("uid"), text_of(docs, text).alias("text"))
    ranges = repeated_ranges(rows.select("uid", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            size = np.diff(off)
            spans = list(spans_by_row(batch.column(2), size))
            sha = [hashlib.sha256(kept_bytes(data[off[k] : off[k + 1]], s)).hexdigest() for k, s in enumerate(spans)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(size), pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                    pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    whole = rows.join(ranges, "uid", "left").select("doc_id", "text", "ranges")
    return whole.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """All rows and columns, with the bytes of repeated strings of ``length`` bytes cut from the text.

    Bytes of a character that is only partly removed go too. Texts stay as they
    are, null included, when nothing in them repeats.
    """
    uid = fresh("uid")
    marked = docs.withColumn(uid, F.xxhash64(F.col(doc_id), text_of(docs, text)))
    find = repeated_ranges if length == LENGTH else partial(repeated_ranges, length=length)
    ranges = find(marked.select(F.col(uid).alias("uid"), text_of(docs, text).alias("text"))).select(F.col("uid").alias(uid), F.col("ranges").alias("ranges" + uid))
    names = docs.columns
    where = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(where))
            spans = list(spans_by_row(batch.column(len(names)), np.diff(off), length))
            old = batch.column(where)
            new = [kept_bytes(data[off[k] : off[k + 1]], s).decode("utf-8", "ignore") if len(s) else old[k].as_py() for k, s in enumerate(spans)]
            columns = list(batch.columns[: len(names)])
            columns[where] = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    whole = marked.join(ranges, uid, "left").select(*[F.col(f"`{c}`") for c in names], "ranges" + uid)
    out = whole.mapInArrow(lean(run), docs.schema)
    if n_chars in names:
        out = out.withColumn(n_chars, F.when(F.col(text).isNotNull(), F.char_length(text)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return out
