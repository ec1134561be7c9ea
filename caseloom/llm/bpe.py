"""Byte-level BPE by a rank queue, and its decoding.

The queue has one bucket per merge rank. A bucket holds the places of pairs in
linked lists of tokens; a hierarchical bitmap of non-empty buckets gives the
lowest rank by find-first-set. An entry whose pair has changed meanwhile is stale
and skipped. One queue serves all distinct pre-tokens of a batch: lists of
different pre-tokens never meet, and within each the lowest rank still goes
first, so the ids are those of merging each alone. A very long pre-token costs
its length times the logarithm of its merges.

Null and empty texts give no ids. No cap on text or pre-token length.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.pieces import pieces
from caseloom.llm.spans import numbered_spans, slices, span_hashes, text_bytes
from caseloom.llm.tables import lean

NONE = np.int64(1 << 40)
#: Texts whose pre-tokens share one queue; more would save a few steps for more memory.
STEP_BYTES = 16 << 20


class RankSet:
    """Set of small integers as bitmaps over bitmaps; the least member in a few steps."""

    def __init__(self, size: int) -> None:
        self.levels: list[list[int]] = []
        while True:
            size = -(-size // 64)
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, x: int) -> None:
        for level in self.levels:
            level[x >> 6] |= 1 << (x & 63)
            x >>= 6

    def discard(self, x: int) -> None:
        for level in self.levels:
            level[x >> 6] &= ~(1 << (x & 63))
            if level[x >> 6]:
                return
            x >>= 6

    def least(self) -> int | None:
        if not self.levels[-1][0]:
            return None
        x = 0
        for level in reversed(self.levels):
            word = level[x]
            x = x << 6 | (word & -word).bit_length() - 1
        return x


class Bpe:
    """Vocabulary as ranks: token bytes to id, where a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        get = ranks.get
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = get(token[:k]), get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], NONE)

    @staticmethod
    def load(path: str) -> Bpe:
        return _load(path)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, end to end, and how many each has.

        Equal ranks in one pre-token merge together unless a merge brings up a
        lower rank there; such pre-tokens are done again one merge at a time.
        """
        size = ends - starts
        first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.int64)
        n = int(size.sum())
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        index = np.arange(n, dtype=np.int64) - np.repeat(first - starts, size)
        ids = self.byte_id[data[index]]
        after = np.arange(1, n + 1, dtype=np.int64)
        before = np.arange(-1, n - 1, dtype=np.int64)
        after[first[size > 0] + size[size > 0] - 1] = -1
        before[first[size > 0]] = -1
        alive = np.ones(n, dtype=bool)
        rank = np.full(n, NONE)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.rank_of(ids[inner], ids[inner + 1])
        buckets: dict[int, list[np.ndarray]] = defaultdict(list)
        ready = RankSet(self.size)

        def push(places: np.ndarray) -> None:
            places = places[rank[places] < NONE]
            if not len(places):
                return
            r = rank[places]
            if len(places) > 1:
                order = np.argsort(r, kind="stable")
                places, r = places[order], r[order]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                bounds = [0, *cuts.tolist(), len(r)]
            else:
                bounds = [0, 1]
            heads = r[bounds[:-1]].tolist()
            for k, x in enumerate(heads):
                if x not in buckets:
                    ready.add(x)
                buckets[x].append(places[bounds[k] : bounds[k + 1]])

        push(inner)
        again: set[int] = set()
        while (r := ready.least()) is not None:
            ready.discard(r)
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                chained = np.zeros(len(at), dtype=bool)
                chained[1:] = after[at[:-1]] == at[1:]
                if single:
                    piece = np.searchsorted(first, at, "right")
                    lead = np.ones(len(at), dtype=bool)
                    lead[1:] = piece[1:] != piece[:-1]
                    later, at = at[~lead], at[lead]
                    if len(later):
                        push(later)
                elif chained.any():
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
            gone = after[at]
            ids[at] = r
            alive[gone] = False
            rank[gone] = NONE
            beyond = after[gone]
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            rank[at] = NONE
            right = at[inside]
            rank[right] = self.rank_of(ids[right], ids[after[right]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.rank_of(ids[left], ids[after[left]])
            touched = np.concatenate((right, left)) if len(at) == 1 else np.unique(np.concatenate((right, left)))
            if not single and len(at) > 1 and len(touched) and int(rank[touched].min()) < r:
                low = np.unique(np.searchsorted(first, touched[rank[touched] < r], "right"))
                done = np.searchsorted(first, at, "right")
                many, times = np.unique(done, return_counts=True)
                again.update(np.intersect1d(low, many[times > 1]).tolist())
            push(touched)
        places = np.flatnonzero(alive)
        owner = np.searchsorted(first, places, "right") - 1
        if len(size) and (size == 0).any():
            owner = np.repeat(np.arange(len(size)), size)[places]
        count = np.bincount(owner, minlength=len(size))
        flat = ids[places]
        if again:
            odd = np.array(sorted(again), dtype=np.int64) - 1
            redone, lengths = self.encode(data, starts[odd], ends[odd], single=True)
            flat, count = _replace(flat, count, odd, redone, lengths)
        return flat, count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        low = self.bounds[ids]
        return spread(self.flat, low, self.bounds[ids + 1] - low)


def spread(flat: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Copy the ranges (low, size) of ``flat`` end to end."""
    total = int(size.sum())
    if total == 0:
        return flat[:0]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    return flat[np.arange(total, dtype=np.int64) + np.repeat(low - first, size)]


def _replace(flat, count, odd, redone, lengths):
    parts, out = np.split(flat, np.cumsum(count)[:-1]), count.copy()
    for k, part in zip(odd.tolist(), np.split(redone, np.cumsum(lengths)[:-1]), strict=True):
        parts[k] = part
        out[k] = len(part)
    return np.concatenate(parts), out


@lru_cache(maxsize=2)
def _load(path: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Batch:
    """Pre-tokens of a batch of texts: each distinct one once."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.off = off
        hashes, starts, ends, rows = [], [], [], []
        for a, b in slices(off):
            lo, hi = int(off[a]), int(off[b])
            s, e = pieces(data[lo:hi], off[a : b + 1] - lo)
            hashes.append(span_hashes(data[lo:hi], s, e))
            starts.append(s + lo)
            ends.append(e + lo)
            rows.append(np.searchsorted(s, off[a:b] - lo))
            rows[-1] += sum(len(x) for x in hashes[:-1])
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        #: first pre-token of each row, and one beyond the last
        self.row = np.append(np.concatenate(rows), len(starts)) if rows else np.zeros(1, np.int64)
        self.which, at = numbered_spans(data, starts, ends, self.hashes)
        self.starts, self.ends = starts[at], ends[at]

    def assemble(self, flat: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each row, from the ids of the distinct pre-tokens."""
        low = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else np.zeros(0, np.int64)
        for a, b in slices(self.row, 1 << 20):
            which = self.which[self.row[a] : self.row[b]]
            size = count[which]
            ids = spread(flat, low[which], size)
            ends = np.concatenate(([0], np.cumsum(size)))[self.row[a : b + 1] - self.row[a]]
            for k in range(a, b):
                yield k, ids[ends[k - a] : ends[k - a + 1]]


def encode_texts(column: pa.Array, bpe: Bpe) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) for each text of a column."""
    data, off = text_bytes(column)
    for a, b in slices(off, STEP_BYTES):
        part = data[off[a] : off[b]]
        batch = Batch(part, off[a : b + 1] - off[a])
        for k, ids in batch.assemble(*bpe.encode(part, batch.starts, batch.ends)):
            yield a + k, ids


def bpe_round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for _, ids in encode_texts(batch.column(1), bpe):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
