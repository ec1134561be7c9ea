"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text are its words and runs of signs, alone and in pairs, and
triples of their shapes (case, kind of sign, repetition), hashed to a fixed table.
A feature's value is its share of the text, so a score is one sparse dot product.

Training reads at most ``sample`` labelled rows (the ids with the smallest hash),
split over ``parts`` models by a hash; each runs follow-the-regularised-leader
updates over its rows, and the weights are averaged in Spark. A text without words gets the score of
the intercept. Rows without a label do not train; of several labels of one id the
largest counts. Without any label every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.spans import SPACE, mix64, rows_of, runs, slices, span_hashes, text_bytes
from caseloom.llm.tables import lean, remainder

BITS = 18
SIZE = 1 << BITS
GROUPS = 3
THRESHOLD = 0.7

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, table index and value of every occurrence of a feature."""
    starts, ends = runs(_KIND[data], off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row = rows_of(starts, off)
    h = span_hashes(data, starts, ends)
    size = ends - starts
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    caps = upper[ends] - upper[starts]
    word = _KIND[data[starts]] == 1
    shape = np.where(word, (caps > 0).astype(np.int64) + (caps > 1) + (caps == size), 8 + 4 * data[starts].astype(np.int64) + np.minimum(size, 3))
    again = np.zeros(len(h), dtype=np.int64)
    again[1:] |= (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    shape = (shape * 2 + again).astype(np.uint64)
    out_row, out_index, out_value = [], [], []
    pair = h[:-1] * np.uint64(31) + h[1:]
    triple = mix64(shape[:-2] * np.uint64(1 << 32) + shape[1:-1] * np.uint64(1 << 16) + shape[2:])
    for group, (values, width) in enumerate(((h, 1), (pair, 2), (triple, 3))):
        at = np.arange(len(values))
        keep = row[at] == row[at + width - 1]
        at = at[keep]
        if not len(at):
            continue
        r = row[at]
        out_row.append(r)
        out_index.append((mix64(values[keep] + np.uint64(group)) >> np.uint64(64 - BITS)).astype(np.int64))
        out_value.append(8.0 / np.bincount(r)[r])
    return np.concatenate(out_row), np.concatenate(out_index), np.concatenate(out_value)


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    alpha: float = 0.4
    beta: float = 0.1
    l1: float = 1e-4
    l2: float = 1e-3

    def __post_init__(self) -> None:
        self.z = np.zeros(SIZE + 1)
        self.n = np.zeros(SIZE + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_out: tuple[int, int], sample: int, doc_id: str, text: str, value: int | None = None) -> DataFrame:
    """At most ``sample`` training rows (text, y): the ids with the smallest hash."""
    parts, left_out = held_out
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(remainder("doc_id", parts) != left_out)
    known = known.groupBy("doc_id").agg(F.max(target).alias("y"))
    if value is not None:
        known = known.where(F.col("y") == value)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), "doc_id")


def train(rows: DataFrame, parts: int = 8, epochs: int = 6, slices_out: int = 16) -> np.ndarray:
    """Averaged weights over training rows (doc_id, text, y); the last one is the intercept.

    Rows go to ``parts`` models by a hash, whatever the number of partitions; the
    models are averaged a slice at a time in Spark, so one vector reaches the driver.
    """

    def run(table: pa.Table) -> pa.Table:
        examples = []
        for batch in table.to_batches():
            data, off = text_bytes(batch.column("text"))
            y = batch.column("y").to_pylist()
            for a, b in slices(off):
                row, index, value = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                key, at = np.unique(row << BITS | index, return_inverse=True)
                total = np.bincount(at, value, minlength=len(key))
                cuts = np.searchsorted(key >> BITS, np.arange(b - a + 1))
                for k in range(b - a):
                    part = slice(cuts[k], cuts[k + 1])
                    index_k = np.append(key[part] & (SIZE - 1), SIZE).astype(np.int32)
                    examples.append((index_k, np.append(total[part], 1.0).astype(np.float32), float(y[a + k])))
        examples.sort(key=lambda e: (zlib.crc32(e[0].tobytes()), e[2], e[0].tobytes(), e[1].tobytes()))
        model = Ftrl()
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(examples))
            for k in order:
                model.step(*examples[k])
        cut = np.array_split(model.weights().astype(np.float32), slices_out)
        return pa.table({"slice": pa.array(range(slices_out), pa.int32()), "w": pa.array([w.tobytes() for w in cut], pa.binary())})

    def average(table: pa.Table) -> pa.Table:
        found = np.stack([np.frombuffer(w, dtype=np.float32) for w in table["w"].to_pylist()])
        # sums do not depend on the order in which models arrive
        mean = np.sort(found, axis=0).mean(axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"slice": table["slice"].slice(0, 1), "w": pa.array([mean.tobytes()], pa.binary())})

    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("part"), "text", F.col("y").cast("double").alias("y"))
    found = dealt.groupBy("part").applyInArrow(run, "slice int, w binary").groupBy("slice").applyInArrow(average, "slice int, w binary")
    table = sorted((r["slice"], r["w"]) for r in found.collect())
    return np.frombuffer(b"".join(w for _, w in table), dtype=np.float32) if table else np.zeros(SIZE + 1, np.float32)


def score_texts(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    data, off = text_bytes(column)
    out = np.full(len(off) - 1, float(weights[SIZE]))
    for a, b in slices(off):
        row, index, value = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
        out[a:b] += np.bincount(row, weights[index] * value, minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, target: str = "quality", held_out: tuple[int, int] = (4, 2), sample: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    weights = train(labelled_sample(docs, labels, target, held_out, sample, doc_id, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), weights))], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts, left_out = held_out
    scored = rows.mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", (remainder("doc_id", parts) == left_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
