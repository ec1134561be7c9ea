"""Language-model scores: a hidden Markov model trained by Baum-Welch on all training texts.

A hidden state gives the class of the next word, and the class gives the word:
P(word | state) = P(class | state) * P(word | class). A word's class follows from
its last letters and length, so new words have one too; the table of classes has at
least twice as many places as the training words have distinct classes. Words are split
at ASCII white space, A-Z in lower case; one end closes each text and is a token.

Four steps, all of them over all rows:

1. Texts become blocks of word codes with the block's distinct words (written once).
2. Word counts of the training texts are summed by word and joined back to the
   blocks' distinct words, so a common word costs one row per block, not per use.
3. Baum-Welch: every task sums expected counts over its blocks, Spark sums them by
   class, and the next round starts from the sums. Long texts are cut into
   segments here only. The first model has the class counts of all training texts,
   each weighed by a seeded random factor per state; no text is sampled or cut short.
4. The scaled forward recursion gives each whole text's exact likelihood.

Base counts c are smoothed as (c + 0.5) / (N + 0.5 (V + 1)); within a class the
same form holds with the class's own N and V. Null and empty texts are the end
alone. Without training rows, N = 0 and every token is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from caseloom.llm.spans import LOWER, mix64, rows_of, slices, span_hashes, text_bytes, words
from caseloom.llm.tables import lean, remainder, stored

#: least size of the table of classes
CLASSES = 1 << 15
KEYS = (1 << 31) - 1
END = 0
BLOCK_BYTES = 4 << 20
SEGMENT = 256
PAD = 136

BLOCK = "block long, docs array<long>, train binary, sizes binary, codes binary, hashes binary, classes binary, uses binary"


def word_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Key of each word's class: short words by themselves, others by ending and length."""
    size = ends - starts
    tail = np.zeros(len(starts), dtype=np.uint64)
    for k in range(1, 5):
        use = (size >= k) & ((k < 4) | (size == 4))
        tail[use] |= data[ends[use] - k].astype(np.uint64) << np.uint64(8 * k)
    tail |= np.searchsorted([5, 8, 12], size, "right").astype(np.uint64)
    return (mix64(tail) % np.uint64(KEYS)).astype(np.int32)


def table_size(distinct: int) -> int:
    """Places in the table of classes for so many distinct classes of training words."""
    return max(CLASSES, 1 << (2 * distinct - 1).bit_length() if distinct else 0)


def in_table(keys: np.ndarray, table: int) -> np.ndarray:
    """Class of each key, from 1."""
    return keys % np.int32(table - 1) + np.int32(1)


def planes(code: np.ndarray) -> np.ndarray:
    """32-bit codes with their first bytes together, then their second bytes and so on: small codes compress."""
    return np.ascontiguousarray(code.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def to_blocks(docs: DataFrame, held_out: tuple[int, int], doc_id: str, text: str) -> DataFrame:
    """Blocks of coded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = text_bytes(batch.column(2))
            names = batch.column(0).to_pylist()
            train = ~np.array(batch.column(1).to_pylist(), dtype=bool)
            for a, b in slices(off, BLOCK_BYTES):
                part = LOWER[data[off[a] : off[b]]]
                o = off[a : b + 1] - off[a]
                starts, ends = words(part, o)
                hashes = np.concatenate([span_hashes(part[o[i] : o[j]], *_between(starts, ends, o[i], o[j])) for i, j in slices(o)]) if len(o) > 1 else np.zeros(0, np.uint64)
                code, distinct = pd.factorize(hashes)
                at = np.zeros(len(distinct), dtype=np.int64)
                at[code[::-1]] = np.arange(len(code))[::-1]
                row = rows_of(starts, o)
                uses = np.bincount(code[train[a:b][row]], minlength=len(distinct))
                columns = [train[a:b].astype(np.uint8), np.bincount(row, minlength=b - a).astype(np.int32), planes(code), distinct, word_classes(part, starts[at], ends[at]), uses.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([names[a:b]], pa.list_(pa.int64())), *[pa.array([c.tobytes()], pa.binary()) for c in columns]],
                    ["block", "docs", "train", "sizes", "codes", "hashes", "classes", "uses"],
                )
                block += 1

    parts, left_out = held_out
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (remainder(doc_id, parts) == left_out).alias("held"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(lean(run), BLOCK), "hmm-blocks", "zstd")


def _between(starts, ends, low, high):
    part = slice(np.searchsorted(starts, low), np.searchsorted(starts, high))
    return starts[part] - low, ends[part] - low


def entries(blocks: DataFrame) -> DataFrame:
    """Distinct words of each block: block, place, word, class, uses in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, classes, uses in zip(*(batch.column(k) for k in range(4)), strict=True):
                h = np.frombuffer(hashes.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(h), block.as_py(), dtype=np.int64)),
                        pa.array(np.arange(len(h), dtype=np.int32)),
                        pa.array(h),
                        pa.array(np.frombuffer(classes.as_buffer(), dtype=np.int32)),
                        pa.array(np.frombuffer(uses.as_buffer(), dtype=np.int32)),
                    ],
                    ["block", "place", "word", "class", "uses"],
                )

    return blocks.select("block", "hashes", "classes", "uses").mapInArrow(lean(run), "block long, place int, word long, class int, uses int")


@dataclass
class Hmm:
    """start (K), step (K, K), emit (classes, K): P(class | state)."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def from_counts(start: np.ndarray, step: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
        """Smoothed parameters; ``prior`` (classes) is the overall share of each class."""
        k = len(start)
        emit = emit + 50.0 * prior[:, None]
        return Hmm((start + 1) / (start.sum() + k), (step + 1) / (step.sum(axis=1, keepdims=True) + k), emit / emit.sum(axis=0))

    def rest(self) -> np.ndarray:
        """Long-run share of the states."""
        x = np.full(len(self.start), 1 / len(self.start))
        for _ in range(64):
            x = x @ self.step
        return x / x.sum()


def over_states(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Sums of the columns, neighbouring rows first: whole rows are added, which is faster than many short columns."""
    while len(x) > 2 and len(x) % 2 == 0:
        x = x[0::2] + x[1::2]
    return np.add(x[0], x[1], out=out) if len(x) == 2 else x.sum(axis=0, out=out)


class Counts:
    """Expected counts of one task."""

    def __init__(self, k: int, table: int = CLASSES) -> None:
        self.start, self.step, self.emit, self.log10 = np.zeros(k), np.zeros((k, k)), np.zeros((table, k)), 0.0
        self.room, self.columns = (np.zeros(0, dtype=np.float32), np.zeros((k, 0))), 0

    def add(self, model: Hmm, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """One pass forward and backward over texts, cut into segments that run side by side."""
        pieces = -(-sizes // SEGMENT)
        place = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(starts, pieces) + place * SEGMENT
        length = np.minimum(np.repeat(sizes, pieces) - place * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        begin, length, opening = begin[order], length[order], place[order] == 0
        for low in range(0, len(begin), 1024):
            self._segments(model, classes, begin[low : low + 1024], length[low : low + 1024], opening[low : low + 1024])

    def _segments(self, model, classes, begin, length, opening) -> None:
        """Each step has its tables, a row per state and a column per segment; steps lie one after the other and are filled in place."""
        k = len(model.start)
        emit, step = np.ascontiguousarray(model.emit.T, dtype=np.float32), model.step.T.astype(np.float32)
        alive = np.searchsorted(-length, -np.arange(int(length[0])), "left").tolist()
        total = sum(alive)
        which = classes[np.concatenate([begin[:n] + t for t, n in enumerate(alive)])].astype(np.int64)
        alphas, seen, scales, gamma = self._room(total, k)
        steps, low = [], 0
        for n in alive:
            high = low + n
            steps.append((low, high, alphas[k * low : k * high].reshape(k, n), seen[k * low : k * high].reshape(k, n), scales[low:high]))
            low = high
        previous = np.where(opening, model.start[:, None], model.rest()[:, None]).astype(np.float32)
        for low, high, alpha, b, c in steps:
            np.take(emit, which[low:high], axis=1, out=b, mode="clip")
            if low == 0:
                np.multiply(previous, b, out=alpha)
            else:
                np.matmul(step, previous[:, : high - low], out=alpha)
                alpha *= b
            over_states(alpha, out=c)
            alpha /= c
            previous = alpha
        self.log10 += float(np.log10(scales, dtype=np.float64).sum())
        ahead = np.zeros((k, 0), np.float32)
        for low, high, alpha, b, c in reversed(steps):
            later = ahead.shape[1]
            beta = np.ones((k, high - low), np.float32)
            if later:
                # copies, as the product's rounding depends on how its sides lie
                self.step += model.step * (np.ascontiguousarray(alpha[:, :later].T).T @ np.ascontiguousarray(ahead.T))
                np.matmul(step.T, ahead, out=beta[:, :later])
            alpha *= beta
            np.divide(alpha, over_states(alpha), out=alpha)
            gamma[:, low:high] = alpha
            b *= beta
            b /= c
            ahead = b
        self.start += np.ascontiguousarray(gamma[:, : alive[0]][:, opening].T, dtype=np.float32).sum(axis=0)
        for j in range(k):
            self.emit[:, j] += np.bincount(which, gamma[j], minlength=len(self.emit))

    def _room(self, columns: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Room for two tables and a row of so many columns, and a table of doubles, in memory that is used again."""
        if self.columns < columns:
            self.columns = columns
            # rows a power of two apart would meet in the same lines of the processor's cache
            self.room = np.empty(columns * (2 * k + 1), dtype=np.float32), np.empty((k, columns + PAD))
        flat, table = self.room
        return flat[: k * columns], flat[k * columns : 2 * k * columns], flat[2 * k * columns : (2 * k + 1) * columns], table[:, :columns]


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, one at a time: a row is a block of megabytes."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def coded(row: dict, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token with the ends, and each text's start and size, and training flag."""
    sizes = np.frombuffer(row["sizes"], dtype=np.int32).astype(np.int64)
    codes = from_planes(row["codes"])
    classes = in_table(np.frombuffer(row["classes"], dtype=np.int32), table)
    full = sizes + 1
    starts = np.cumsum(full) - full
    out = np.full(int(full.sum()), END, dtype=np.int32)
    if len(codes):
        at = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
        out[at] = classes[codes]
    return out, starts, full, np.frombuffer(row["train"], dtype=np.uint8) > 0


def expected(blocks: DataFrame, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all training texts, summed by class in Spark."""
    table, k = model.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(k, table)
        for batch in batches:
            for row in each_row(batch):
                classes, starts, sizes, train = coded(row, table)
                if train.any():
                    counts.add(model, classes, starts[train], sizes[train])
        # rows: a class, or below zero the start (-1) and the steps (-2 - state)
        used = np.flatnonzero(counts.emit.any(axis=1))
        rows = np.concatenate((counts.emit[used], counts.start[None], counts.step))
        keys = np.concatenate((used, [-1], -2 - np.arange(k)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(rows[:, j]) for j in range(k)]], ["key", *[f"s{j}" for j in range(k)]])

    schema = "key long, " + ", ".join(f"s{j} double" for j in range(k))
    sums = blocks.select("sizes", "codes", "classes", "train").mapInArrow(lean(run), schema).groupBy("key").sum(*[f"s{j}" for j in range(k)])
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((table, k))
    for row in sums.collect():
        if row[0] >= 0:
            emit[row[0]] = row[1:]
        elif row[0] == -1:
            start[:] = row[1:]
        else:
            step[-2 - row[0]] = row[1:]
    return start, step, emit


def first_model(k: int, prior: np.ndarray, seed: int = 1) -> Hmm:
    """States that mostly stay, so that they part early, each with the shares of all training words times a random factor per class."""
    factor = np.random.default_rng(seed).standard_gamma(1.0, (len(prior), k))
    return Hmm.from_counts(np.ones(k), np.ones((k, k)) + 20 * k * np.eye(k), 1000 * prior[:, None] * factor, prior)


def forward(model: Hmm, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each text's classes by the scaled forward recursion, whole texts."""
    order = np.argsort(-sizes, kind="stable")
    begin, length = starts[order], sizes[order]
    total = np.zeros(len(sizes))
    one = np.ones(len(model.start))
    for low in range(0, len(begin), 4096):
        b, n = begin[low : low + 4096], length[low : low + 4096]
        alive = np.searchsorted(-n, -np.arange(int(n[0])), "left")
        log = np.zeros(len(b))
        alpha = model.start[None]
        for t, m in enumerate(alive.tolist()):
            alpha = (alpha if t == 0 else alpha[:m] @ model.step) * model.emit[classes[b[:m] + t]]
            c = alpha @ one  # a plain sum of so short rows takes longer than all the rest
            alpha /= c[:, None]
            log[:m] += np.log10(c)
        total[order[low : low + 4096]] = log
    return total


def language_scores(docs: DataFrame, held_out: tuple[int, int] = (5, 1), states: int = 8, rounds: int = 10, seed_docs: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``seed_docs`` has no effect any more: the first model is not drawn from single texts.
    """
    blocks = to_blocks(docs, held_out, doc_id, text)
    known = entries(blocks)
    counts = stored(known.where("uses > 0").groupBy("word").agg(F.sum("uses").alias("c"), F.min("class").alias("class")), "hmm-counts")
    table = table_size(counts.select("class").distinct().count())
    by_class = np.zeros((table, 2))
    for row in counts.groupBy((F.col("class") % (table - 1) + 1).alias("class")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        by_class[row[0]] = row[1:]
    ends = blocks.select(F.explode("docs").alias("d")).where((remainder("d", held_out[0]) != held_out[1])).count()
    tokens = float(by_class[:, 0].sum() + ends)
    distinct = float(by_class[:, 1].sum() + (ends > 0))
    share = np.append([0.0], by_class[1:, 0]) + 0.5
    share[END] += ends
    prior = share / share.sum()

    model = first_model(states, prior)
    for _ in range(rounds):
        model = Hmm.from_counts(*expected(blocks, model), prior)

    # two plain lists of one aggregate, so in one order: a list of pairs takes three times the room
    looked = known.select("word", "block", "place").join(counts.select("word", "c"), "word")
    looked = looked.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("c").alias("found"))
    whole = blocks.select("block", "docs", "train", "sizes", "codes", "classes").join(looked, "block", "left")
    base_log = -np.log10(tokens + 0.5 * (distinct + 1))
    class_log = -np.log10(by_class[:, 0] + 0.5 * (by_class[:, 1] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                one = {c: row.column(c)[0].as_py() for c in ("docs", "train", "sizes", "codes", "classes")}
                classes, starts, sizes, train = coded(one, table)
                own = in_table(np.frombuffer(one["classes"], dtype=np.int32), table)
                c = np.zeros(len(own))
                places, found = row.column("places")[0].values, row.column("found")[0].values
                if places is not None and len(places):
                    c[places.to_numpy()] = found.to_numpy()
                codes = from_planes(one["codes"])
                doc = np.repeat(np.arange(len(sizes)), sizes - 1)
                n = len(sizes)
                base = np.bincount(doc, (np.log10(c + 0.5) + base_log)[codes], minlength=n) + np.log10(ends + 0.5) + base_log
                inside = np.bincount(doc, (np.log10(c + 0.5) + class_log[own])[codes], minlength=n)
                seen = np.bincount(doc, (c > 0)[codes], minlength=n).astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one["docs"], pa.int64()), pa.array(~train), pa.array(sizes), pa.array(seen),
                        pa.array(np.full(n, int(tokens), dtype=np.int64)), pa.array(base), pa.array(inside + forward(model, classes, starts, sizes)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.mapInArrow(lean(run), schema)
