"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

Documents are tokenised and range-partitioned by min-hashes of their pre-tokens,
so that alike texts come to the same task; within a key ties go by id, and a key
of any size spreads over many tasks. A task streams its rows in shards of bounded
size. Each shard has its own inverted index, weighted by the counts of all documents
(documents, documents with each id, mean length; summed in Spark): whole windows of
a document stand alone, then each document's rest in turn is a seed, and the index
returns its nearest unused neighbours by all ids they share, which fill the window
greedily. Neighbours that fit go in whole; one is cut to close the window, and what
is left of it stays unused. The end id is no term. Candidates are the documents of
the seed's shard; the README has the measured share of the whole table's nearest
that this reaches.

Every id lies in exactly one piece. Windows are full but for a shard's last rest,
which is cut into lengths that are powers of two, so nothing is padded. Null and
empty texts have the end id alone. Rows that repeat are packed as they are.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from caseloom.llm.bpe import Batch
from caseloom.llm.spans import slices, text_bytes
from caseloom.llm.tables import lean, stored

K1, B = 1.2, 0.75
NEIGHBOURS = 24
SHARD_DOCS, SHARD_TOKENS = 2048, 1 << 20
#: bytes of text tokenised at a time: its arrays take up to 150 bytes for each, and two workers run beside each executor's heap
STEP_BYTES = 1 << 19
#: a code point that is no character; it stands between the pre-tokens of one call
SEPARATOR = "\U0010ffff"

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1)
def _encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # whole pre-tokens come in, so the pattern takes each as it is
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={SEPARATOR: max(ranks.values()) + 1})


def piece_ids(encoder: tiktoken.Encoding, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens, end to end, and how many each has: one call for all, or one for each where the separator is in them."""
    mark = SEPARATOR.encode()
    flat = encoder.encode_to_numpy(mark.join([*parts, b""]).decode(), allowed_special={SEPARATOR})
    is_mark = flat == encoder.encode_single_token(mark)
    ends = np.flatnonzero(is_mark)
    if len(ends) == len(parts):
        return flat[~is_mark], np.diff(ends, prepend=-1) - 1
    each = [encoder.encode_ordinary(part.decode()) for part in parts]
    return np.array([x for ids in each for x in ids], dtype=np.uint32), np.array([len(ids) for ids in each], dtype=np.int64)


@lru_cache(maxsize=1)
def added_tokens(path: str) -> dict[bytes, int]:
    """Added tokens of the vocabulary, from the tokenizer file beside its ranks; none without that file."""
    file = Path(path).with_suffix(".json")
    if not file.exists():
        return {}
    found = json.loads(file.read_text(encoding="utf-8"))["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError(f"{file}: added tokens that take in or look at their neighbours are not supported")
    return {t["content"].encode(): t["id"] for t in found if t["content"]}


def split_at(raw: bytes, off: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the rows between and at added tokens: bounds, each row's first segment (and one beyond), added id or -1.

    The left-most token counts, the longest of several at one place; none crosses rows.
    """
    if not any(token in raw for token in added):
        return off, np.arange(len(off)), np.full(len(off) - 1, -1)
    pattern = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))
    bounds, first, ids = [], [], []
    for low, high in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        first.append(len(ids))
        at = low
        for m in pattern.finditer(raw, low, high):
            bounds += [at, m.start()]
            ids += [-1, added[m.group()]]
            at = m.end()
        bounds.append(at)
        ids.append(-1)
    return np.array([*bounds, int(off[-1])], dtype=np.int64), np.array([*first, len(ids)]), np.array(ids, dtype=np.int64)


def token_steps(batch: pa.RecordBatch, encoder: tiktoken.Encoding, added: dict[bytes, int], end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    """doc_id, k1, k2, ids of a batch of (doc_id, text), ``STEP_BYTES`` of text at a time; a longer text makes its own step."""
    data, off = text_bytes(batch.column(1))
    for a, b in slices(off, STEP_BYTES):
        raw = data[off[a] : off[b]].tobytes()
        bounds, first, special = split_at(raw, off[a : b + 1] - off[a], added)
        parts = Batch(np.frombuffer(raw, dtype=np.uint8), bounds)
        flat, count = piece_ids(encoder, [raw[i:j] for i, j in zip(parts.starts.tolist(), parts.ends.tolist(), strict=True)])
        pieces = [x if s < 0 else np.array([s], np.uint32) for (_, x), s in zip(parts.assemble(flat, count), special.tolist(), strict=True)]
        ids = [np.concatenate((*pieces[i:j], [np.uint32(end_id)])).astype(kind).tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        low, high = min_keys(parts.hashes, parts.row[first])
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(low), pa.array(high), pa.array(ids, pa.binary())], ["doc_id", "k1", "k2", "ids"])


def tokenised(docs: DataFrame, ranks_path: str, end_id: int, kind: str, doc_id: str, text: str) -> DataFrame:
    """doc_id, two min-hash keys and the ids with the end id, as little-endian integers of ``kind``.

    Ids are those of the vocabulary's tokenizer file: its added tokens are cut out of a text before pre-tokens are.
    """
    added = added_tokens(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from token_steps(batch, _encoder(ranks_path), added, end_id, kind)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, k1 long, k2 long, ids binary")


def min_keys(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two min-hashes of each row's pre-tokens; equal for alike rows with the odds of their likeness."""
    n = len(row) - 1
    full = row[1:] > row[:-1]
    out = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        key = np.zeros(n, dtype=np.int64)
        if full.any():
            mixed = hashes * np.uint64(odd)
            key[full] = (np.minimum.reduceat(mixed, row[:-1][full]) >> np.uint64(1)).astype(np.int64)
        out.append(key)
    return out[0], out[1]


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents: how many, how many hold each id, mean length without the end id."""

    docs: int
    df: np.ndarray
    mean: float

    @staticmethod
    def of(docs: list[np.ndarray]) -> Corpus:
        held = [np.unique(d[:-1]) for d in docs]
        return Corpus(len(docs), np.bincount(np.concatenate(held).astype(np.int64)) if held else np.zeros(0, np.int64), sum(len(d) - 1 for d in docs) / max(len(docs), 1))


def corpus_counts(rows: DataFrame, kind: str) -> Corpus:
    """Counts of the tokenised rows, by id within tasks and then in Spark; as many rows come back as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, df = 0, 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                held = np.unique(np.frombuffer(ids.as_buffer(), dtype=kind)[:-1]).astype(np.int64)
                n += 1
                size += len(ids.as_buffer()) // np.dtype(kind).itemsize - 1
                if len(held):
                    if held[-1] >= len(df):
                        df = np.append(df, np.zeros(held[-1] + 1 - len(df), dtype=np.int64))
                    df[held] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [n, size]))], ["id", "n"])

    sums = rows.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n, size = (int(sums.n[sums.id == k].sum()) for k in (-1, -2))
    df = np.zeros(max(int(sums.id.max()), 0) + 1 if len(sums) else 1, dtype=np.int64)
    df[sums.id[sums.id >= 0]] = sums.n[sums.id >= 0]
    return Corpus(n, df, size / max(n, 1))


class Bm25:
    """Inverted index over one shard, with the best unused neighbours of a member."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus) -> None:
        n = len(docs)
        size = np.array([len(d) - 1 for d in docs], dtype=np.int64)
        tokens = np.concatenate([d[:-1] for d in docs]).astype(np.int64)
        pair, tf = np.unique(np.repeat(np.arange(n), size) << 32 | tokens, return_counts=True)
        doc, term = pair >> 32, pair & 0xFFFFFFFF
        every = np.bincount(term)
        terms = np.flatnonzero(every)
        here = every[terms]
        at = (np.cumsum(every > 0) - 1)[term]
        df = corpus.df[terms]
        idf = np.log1p((corpus.docs - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(corpus.mean, 1.0))
        weight = idf[at] * tf * (K1 + 1) / (tf + norm[doc])
        # two-byte numbers are sorted by their digits
        order = np.argsort(at.astype(np.uint16) if len(terms) <= 1 << 16 else at, kind="stable")
        self.n, self.docs, self.weights = n, doc[order], weight[order]
        self.posting = np.concatenate(([0], np.cumsum(here)))
        # terms in many documents have their weights as a row of a matrix, which sums faster than postings
        wide = here > max(n // 8, 1)
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)
        self.matrix = np.zeros((int(wide.sum()), n))
        often = wide[at]
        self.matrix[self.row[at[often]], doc[often]] = weight[often]
        # the query of a document: all its terms that occur elsewhere
        shared = here[at] > 1
        self.query_terms = at[shared]
        self.query_row = np.searchsorted(doc[shared], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every member for all ids of the seed."""
        query = self.query_terms[self.query_row[seed] : self.query_row[seed + 1]]
        wide = self.row[query]
        use = np.zeros(len(self.matrix))
        use[wide[wide >= 0]] = 1
        score = use @ self.matrix
        few = query[wide < 0]
        if len(few):
            low, count = self.posting[few], self.posting[few + 1] - self.posting[few]
            at = np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)
            score += np.bincount(self.docs[at], self.weights[at], minlength=self.n)
        return score

    def neighbours(self, score: np.ndarray, unused: np.ndarray, k: int = NEIGHBOURS) -> list[int]:
        score = np.where(unused, score, 0)
        best = np.argpartition(-score, k)[:k] if self.n > k else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


def pack_shard(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard; without ``corpus`` the shard is all there is."""
    out, sequence = [], 0
    start = [0] * len(docs)
    left = [len(d) for d in docs]
    for k in range(len(docs)):
        while left[k] >= window:
            out.append((k, start[k], window, sequence, 0))
            start[k] += window
            left[k] -= window
            sequence += 1
    unused = np.array(left) > 0
    index = Bm25(docs, corpus or Corpus.of(docs)) if int(unused.sum()) > 1 else None
    following = 0

    def put(k: int, n: int, offset: int) -> None:
        out.append((k, start[k], n, sequence, offset))
        start[k] += n
        left[k] -= n
        unused[k] = left[k] > 0

    for seed in range(len(docs)):
        if not unused[seed]:
            continue
        filled = left[seed]
        put(seed, filled, 0)
        score = index.scores(seed) if index and filled < window else None
        while filled < window:
            near = index.neighbours(score, unused) if index else []
            if not near:
                while following < len(docs) and not unused[following]:
                    following += 1
                if following == len(docs):
                    break
                near = [following]
            for k in near:
                if left[k] <= window - filled:
                    n = left[k]
                    put(k, n, filled)
                    filled += n
            rest = [k for k in near if unused[k]]
            if filled < window and rest:
                put(rest[0], window - filled, filled)
                filled = window
        if filled < window:
            out, sequence = _powers(out, sequence, filled)
        sequence += 1
    return out


def _powers(out: list, sequence: int, filled: int) -> tuple[list, int]:
    """Cut the last, partly filled sequence into sequences whose lengths are powers of two."""
    kept = [p for p in out if p[3] != sequence]
    pieces = [p for p in out if p[3] == sequence]
    room = offset = 0
    number = sequence - 1
    todo = filled
    for doc, start, length, _, _ in pieces:
        while length:
            if room == 0:
                room = 1 << (todo.bit_length() - 1)
                todo -= room
                number += 1
                offset = 0
            n = min(room, length)
            kept.append((doc, start, n, number, offset))
            start, length, room, offset = start + n, length - n, room - n, offset + n
    return kept, number


def pack_documents(docs: DataFrame, ranks_path: str, window: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        names, docs, tokens = [], [], 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(np.frombuffer(ids.as_buffer(), dtype=kind))
                names.append(name)
                tokens += len(docs[-1])
                if len(docs) == SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield names, docs
                    names, docs, tokens = [], [], 0
        if docs:
            yield names, docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for names, docs in shards(batches):
            rows = pack_shard(docs, window, corpus.value)
            crc = [zlib.crc32(docs[k][a : a + n].astype("<u4").tobytes()) for k, a, n, _, _ in rows]
            table = np.array(rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[k] for k in table[:, 0].tolist()], pa.int64()),
                    pa.array(table[:, 1]),
                    pa.array(table[:, 2]),
                    pa.array(crc, pa.int64()),
                    pa.array(np.array([len(d) for d in docs], dtype=np.int64)[table[:, 0]]),
                    pa.array(table[:, 3] + sequence),
                    pa.array(table[:, 4]),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += int(table[:, 3].max()) + 1

    kind = "<u2" if max(_encoder(ranks_path).n_vocab - 1, end_id + 1, *(i + 1 for i in added_tokens(ranks_path).values())) <= 1 << 16 else "<u4"
    # written once: the ranges are drawn from the keys alone, without tokenising again
    rows = stored(tokenised(docs, ranks_path, end_id, kind, doc_id, text).withColumn("tie", F.xxhash64("doc_id", "ids")), "token-ids")
    corpus = docs.sparkSession.sparkContext.broadcast(corpus_counts(rows, kind))
    near = rows.repartitionByRange("k1", "k2", "tie").sortWithinPartitions("k1", "k2", "tie", "doc_id")
    return near.select("doc_id", "ids").mapInArrow(lean(run), COLUMNS)
