"""Toxicity: a bidirectional gated recurrent network with attention over windows.

Each word enters with a word part (two rows of a hashed table) and a character
part (its hashed character triples). Two recurrent passes, forward and backward,
read a window of 32 words; attention pools their states into one logit. Windows
overlap by half and cover the whole text; a document's score is its highest
window's. Everything is numpy, in float32.

Training takes at most ``sample`` labelled documents of each class (the ids with
the smallest hash), in one task. Only the document is labelled, so a toxic
document trains on its most suspicious windows, at first by the odds of its words
and characters, later by the network; a clean one on random and on its highest
windows. A text without words scores 0. Without both labels every score is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.quality import THRESHOLD, labelled_sample
from caseloom.llm.spans import LOWER, mix64, rows_of, runs, slices, span_hashes, text_bytes
from caseloom.llm.tables import lean, remainder

WORD_BITS, CHAR_BITS = 16, 14
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
WINDOW, STRIDE = 32, 16
BATCH = 4096

_WORD = np.zeros(256, dtype=np.uint8)
_WORD[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Words:
    """The words of some texts: a code for each, and what the network reads of each distinct one."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends = runs(_WORD[data], off)
        self.row = rows_of(starts, off)
        h = span_hashes(data, starts, ends)
        self.code, distinct = pd.factorize(h)
        at = np.zeros(len(distinct), dtype=np.int64)
        at[self.code[::-1]] = np.arange(len(h))[::-1]
        self.count = np.bincount(self.row, minlength=len(off) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.word = np.stack([(mix64(distinct + np.uint64(k)) >> np.uint64(64 - WORD_BITS)).astype(np.int32) for k in (0, 1)], axis=1)
        # triples of each distinct word, with one mark before and one after it
        size = ends[at] - starts[at]
        room = np.concatenate(([0], np.cumsum(size)))
        inside = np.arange(int(room[-1])) + np.repeat(starts[at] - room[:-1], size)
        mid = data[inside].astype(np.uint64) if len(inside) else np.zeros(0, np.uint64)
        left = np.concatenate(([0], mid[:-1])).astype(np.uint64) if len(mid) else mid
        right = np.concatenate((mid[1:], [0])).astype(np.uint64) if len(mid) else mid
        left[room[:-1]] = 1
        if len(mid):
            right[room[1:] - 1] = 2
        self.triple = (mix64((left << np.uint64(16)) | (mid << np.uint64(8)) | right) >> np.uint64(64 - CHAR_BITS)).astype(np.int32)
        self.room, self.size = room, size

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and row of each window of the rows that have at least one word."""
        n = self.count
        number = np.where(n == 0, 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1))
        row = np.repeat(np.arange(len(n)), number)
        place = np.arange(int(number.sum())) - np.repeat(np.concatenate(([0], np.cumsum(number)[:-1])), number) if len(n) else row
        start = np.minimum(place * STRIDE, np.maximum(n[row] - WINDOW, 0)) + self.first[row]
        return start, row

    def codes(self, start: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Codes of the windows' words, -1 where a short text has none: (window, WINDOW)."""
        at = start[:, None] + np.arange(WINDOW)
        beyond = at >= self.first[row + 1][:, None]
        return np.where(beyond, -1, self.code[np.minimum(at, max(len(self.code) - 1, 0))])

    def only(self, codes: np.ndarray) -> tuple[Words, np.ndarray]:
        """Just the distinct words of some windows, and the windows in their codes."""
        used = np.unique(codes[codes >= 0])
        part = object.__new__(Words)
        part.word, part.size = self.word[used], self.size[used]
        part.room = np.concatenate(([0], np.cumsum(part.size)))
        part.triple = self.triple[np.arange(int(part.room[-1])) + np.repeat(self.room[:-1][used] - part.room[:-1], part.size)]
        return part, np.where(codes >= 0, np.searchsorted(used, codes), -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        give = lambda *s: (rng.standard_normal(s) * (0.5 / np.sqrt(s[0]) if len(s) > 1 else 0.1)).astype(np.float32)
        dim = WORD_DIM + CHAR_DIM
        self.p = {
            "word": (rng.standard_normal((1 << WORD_BITS, WORD_DIM)) * 0.05).astype(np.float32),
            "char": (rng.standard_normal((1 << CHAR_BITS, CHAR_DIM)) * 0.1).astype(np.float32),
            "wf": give(dim, 3 * HIDDEN), "uf": give(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32),
            "wb": give(dim, 3 * HIDDEN), "ub": give(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32),
            "wa": give(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": give(ATTENTION),
            "wo": give(2 * HIDDEN), "bo": np.zeros(1, np.float32),
        }

    def inputs(self, words: Words) -> np.ndarray:
        """Input of each distinct word: word part, character part."""
        w = self.p["word"]
        word = w[words.word[:, 0]] + w[words.word[:, 1]]
        char = np.zeros((len(words.size), CHAR_DIM), np.float32)
        if len(words.size):
            char = np.add.reduceat(self.p["char"][words.triple], words.room[:-1]) / np.sqrt(words.size)[:, None].astype(np.float32)
        return np.concatenate((word, char), axis=1)

    def pass_over(self, x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, back: bool, keep: list | None = None) -> np.ndarray:
        """States of one recurrent pass over projected inputs (time, window, 3 * HIDDEN)."""
        steps, n = x.shape[:2]
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            hu = h @ u
            zr = sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
            new = c + z * (h - c)
            h = new if mask is None else np.where(mask[t][:, None], new, h)
            out[t] = h
        return out

    def project(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        x = self.inputs(words)
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        return np.concatenate((x @ self.p["wf"] + self.p["bf"], pad)), np.concatenate((x @ self.p["wb"] + self.p["bb"], pad))

    def pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple:
        u = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = u @ self.p["va"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        c = np.einsum("tn,tnk->nk", a, states)
        return u, a, c, c @ self.p["wo"] + self.p["bo"][0]

    def logits(self, words: Words, start: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Logit of each window."""
        forward, backward = self.project(words)
        out = np.empty(len(start), np.float32)
        short = words.count[row] < WINDOW
        for group in (np.flatnonzero(~short), np.flatnonzero(short)):
            for low in range(0, len(group), BATCH):
                at = group[low : low + BATCH]
                code = words.codes(start[at], row[at]).T
                mask = None if not short[at[0]] else code >= 0
                states = np.concatenate(
                    (self.pass_over(forward[code], self.p["uf"], mask, False), self.pass_over(backward[code], self.p["ub"], mask, True)), axis=2
                )
                out[at] = self.pool(states, mask)[3]
        return out

    def gradients(self, words: Words, code: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean log loss over some windows, by back-propagation through time."""
        p, code = self.p, code.T
        mask = code >= 0
        forward, backward = self.project(words)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate(
            (self.pass_over(forward[code], p["uf"], mask, False, kept["f"]), self.pass_over(backward[code], p["ub"], mask, True, kept["b"])), axis=2
        )
        u, a, c, logit = self.pool(states, mask)
        d = (sigmoid(logit) - y) / len(y)
        g = {"wo": c.T @ d, "bo": np.array([d.sum()], np.float32)}
        dc = d[:, None] * p["wo"]
        da = np.einsum("nk,tnk->tn", dc, states)
        ds = a[:, :, None] * dc
        de = a * (da - (a * da).sum(axis=0))
        du = de[:, :, None] * p["va"] * (1 - u * u)
        g["va"] = np.einsum("tn,tnk->k", de, u)
        g["ba"] = du.sum(axis=(0, 1))
        g["wa"] = np.einsum("tni,tnj->ij", states, du)
        ds = ds + du @ p["wa"].T
        dx_all = np.zeros((len(words.size) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x = np.concatenate((self.inputs(words), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)))
        for side, cut in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            uu, w = p["u" + side], p["w" + side]
            dh = np.zeros((len(y), HIDDEN), np.float32)
            gu, gw, gb = np.zeros_like(uu), np.zeros_like(w), np.zeros(3 * HIDDEN, np.float32)
            for t, h, z, r, cand, hun in reversed(kept[side]):
                dh = dh + ds[t, :, cut]
                live = mask[t][:, None]
                dn = np.where(live, dh, 0)
                dz = dn * (h - cand) * z * (1 - z)
                dcand = dn * (1 - z) * (1 - cand * cand)
                dr = dcand * hun * r * (1 - r)
                dpre = np.concatenate((dz, dr, dcand), axis=1)
                dhu = np.concatenate((dz, dr, dcand * r), axis=1)
                gu += h.T @ dhu
                gw += x[code[t]].T @ dpre
                gb += dpre.sum(axis=0)
                np.add.at(dx_all, code[t], dpre @ w.T)
                dh = np.where(live, dn * z + dhu @ uu.T, dh)
            g["u" + side], g["w" + side], g["b" + side] = gu, gw, gb
        dx = dx_all[:-1]
        g["word"] = (words.word.ravel(), np.repeat(dx[:, :WORD_DIM], 2, axis=0))
        scaled = dx[:, WORD_DIM:] / np.sqrt(words.size)[:, None].astype(np.float32)
        g["char"] = (words.triple, np.repeat(scaled, words.size, axis=0))
        return g


class Adam:
    def __init__(self, network: Network, rate: float = 0.01) -> None:
        self.net, self.rate, self.t = network, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in network.p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            if isinstance(x, tuple):
                at, where = np.unique(x[0], return_inverse=True)
                total = np.stack([np.bincount(where, x[1][:, j], minlength=len(at)) for j in range(x[1].shape[1])], axis=1)
                used = np.abs(total).max(axis=1) > 0
                at, x = at[used], total[used].astype(np.float32)
            else:
                at = slice(None)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * x
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * x * x
            self.net.p[k][at] -= scale * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-6)


def odds(words: Words, y: np.ndarray) -> np.ndarray:
    """How much more often a word's form or characters occur in toxic rows, per distinct word."""
    toxic = max(int(y.sum()), 1)
    clean = max(len(y) - int(y.sum()), 1)

    def of(row: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
        seen = np.unique(row.astype(np.int64) * size + item)
        positive = y[seen // size] > 0
        t, c = np.bincount((seen % size)[positive], minlength=size), np.bincount((seen % size)[~positive], minlength=size)
        return np.log((t + 0.5) / toxic) - np.log((c + 0.5) / clean)

    n = len(words.size)
    form = of(words.row, words.code, n)
    pair = np.unique(words.row.astype(np.int64) * n + words.code)
    size = words.size[pair % n]
    at = np.arange(int(size.sum())) + np.repeat(words.room[:-1][pair % n] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    triple = of(np.repeat(pair // n, size), words.triple[at], 1 << CHAR_BITS)
    return np.maximum(form, np.maximum.reduceat(triple[words.triple], words.room[:-1]))


def fit(data: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 256, seed: int = 11) -> Network:
    words, net, rng = Words(data, off), Network(), np.random.default_rng(seed)
    start, row = words.windows()
    if not len(start):
        return net
    best = odds(words, y)
    suspicion = np.append(best, -np.inf)[words.codes(start, row)].max(axis=1)
    adam = Adam(net)
    for epoch in range(epochs):
        if epoch in (2, 4, 6):
            suspicion = net.logits(words, start, row)
        order = np.lexsort((-suspicion, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        top = order[rank < np.where(y[row[order]] > 0, 2, 3)]
        clean = np.flatnonzero(y[row] == 0)
        some = rng.choice(clean, min(len(clean), len(top)), replace=False) if len(clean) else clean
        chosen = rng.permutation(np.concatenate((top, some)))
        size = int(np.clip(len(chosen) // 40, 8, batch))
        for low in range(0, len(chosen), size):
            at = chosen[low : low + size]
            adam.step(net.gradients(*words.only(words.codes(start[at], row[at])), y[row[at]].astype(np.float32)))
        adam.rate *= 0.8
    return net


def score_texts(column: pa.Array, net: Network) -> np.ndarray:
    """Highest window of each text; 0 without words."""
    data, off = text_bytes(column)
    out = np.zeros(len(off) - 1)
    for a, b in slices(off):
        words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        start, row = words.windows()
        if len(start):
            p = sigmoid(np.clip(net.logits(words, start, row), -30, 30).astype(np.float64))
            at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[a + row[at]] = np.maximum.reduceat(p, at)
    return out


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int], sample: int, doc_id: str = "doc_id", text: str = "text", target: str = "toxic") -> Network | None:
    """The network, or None without labels of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        if len(set(y)) < 2:
            return
        order = sorted(range(len(y)), key=lambda k: (texts[k], y[k]))
        data, off = text_bytes(pa.array([texts[k] for k in order], pa.large_string()))
        net = fit(data, off, np.array([y[k] for k in order]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], ["net"])

    both = [labelled_sample(docs, labels, target, held_out, sample, doc_id, text, value) for value in (0, 1)]
    rows = both[0].unionByName(both[1]).select("text", F.col("y").cast("int").alias("y")).repartition(1)
    found = rows.mapInArrow(lean(run), "net binary").collect()
    if not found:
        return None
    net = Network()
    net.p = pickle.loads(found[0][0])
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), sample: int = 1500, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    net = train(docs, labels, held_out, sample, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts, left_out = held_out
    scored = rows.mapInArrow(lean(scorer(net, 1)), "doc_id long, score double")
    return scored.select("doc_id", (remainder("doc_id", parts) == left_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scorer(net: Network | None, text_column: int):
    """Function for mapInArrow: the columns before ``text_column`` and the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(batch.column(text_column), net) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_column], pa.array(score)], [*batch.schema.names[:text_column], "score"])

    return run
