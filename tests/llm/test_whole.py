"""Cases in which an operator once did less than its whole job."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from caseloom.llm import hmm, jaccard, license, license_texts, packing, suffix
from caseloom.llm.bpe import bpe_round_trip
from caseloom.llm.queries import RANKS
from caseloom.llm.spans import text_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def without(texts, length):
    uses = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if uses[b[i : i + length]] > 1:
                gone[i : i + length] = True
        yield bytes(x for x, g in zip(b, gone, strict=True) if not g)


@pytest.mark.parametrize(("length", "group"), [(101, 4096), (101, 3), (37, 4096), (16, 4096)])
def test_repeats_of_any_length(spark, length, group, monkeypatch):
    rnd = random.Random(length)
    base = "".join(rnd.choice("abcdefg hij") for _ in range(3000))
    texts = ["", base[:1000], base[900 : 1000 + length], "x" * 300, "ab" * 150]
    texts += ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 200))) + base[: length + rnd.choice([-1, 0, 1, 30])] for _ in range(25)]
    whole = suffix.repeated_ranges
    monkeypatch.setattr(suffix, "repeated_ranges", lambda rows, length: whole(rows, group, length))
    got = {r.doc_id: r.text for r in suffix.without_repeats(table(spark, texts), length=length).collect()}
    assert [got[k].encode() for k in range(len(texts))] == list(without([t.encode() for t in texts], length))


def test_pipeline_cuts_passages_of_over_50_words(spark):
    passages = [" ".join("abcdefghijklmnopqrstuvwxyz"[(k * k + s) % 26] for k in range(51)) for s in (0, 7)]
    passages.append(" ".join(f"word{k}" for k in range(51)))
    texts = [f"{name} {p} {name}" for name in ("one", "TWO") for p in passages]
    for r in corpus_pipeline.cut_repeats(spark, table(spark, texts), "").collect():
        assert passages[r.doc_id % 3] not in r.text and len(r.text) < 20


def test_packing_has_the_library_ids(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"don{end}'t  {end}\n x", f"<|endoftext{end}", "é" + end + " é", "no such token", "", None]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(table(spark, texts), RANKS).collect()
    for d, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(ids)


def bm25(seed, docs, n, df, mean):
    """Scores by the formula, over all distinct ids of the seed that another document of ``docs`` has."""
    out = np.zeros(len(docs))
    for t in set(docs[seed][:-1].tolist()):
        if sum(t in d[:-1] for d in docs) > 1:
            for k, d in enumerate(docs):
                tf = int((d[:-1] == t).sum())
                idf = math.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
                out[k] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(d) - 1) / mean))
    return out


def test_bm25_counts_all_documents_and_all_shared_terms():
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, rng.choice([12, 90, 400]), rng.integers(0, 120)), 0).astype("<u2") for _ in range(40)]
    whole = packing.Corpus.of(docs)
    df = np.array([sum(t in d[:-1] for d in docs) for t in range(400)])
    for part in (docs, docs[:15]):
        index = packing.Bm25(part, whole)
        for seed in range(len(part)):
            want = bm25(seed, part, 40, df, np.mean([len(d) - 1 for d in docs]))
            assert np.allclose(index.scores(seed), want)
            near = [k for k in np.lexsort((np.arange(len(part)), -want)) if want[k] > 0][: packing.NEIGHBOURS]
            assert np.allclose(want[index.neighbours(index.scores(seed), np.ones(len(part), bool))], want[near])


def test_bm25_term_beyond_the_24_heaviest():
    # the seed shares 25 rare ids with filler documents; only an id of less weight leads to the last one
    seed = np.array([*range(100, 125), 5, 0], "<u2")
    docs = [seed, *[np.array([t, 0], "<u2") for t in range(100, 125)], *[np.array([5, 5, 5, 0], "<u2")] * 3]
    score = packing.Bm25(docs, packing.Corpus.of(docs)).scores(0)
    assert (score > 0).all()


def test_corpus_counts(spark):
    docs = [np.array(x, "<u2") for x in ([7, 7, 9, 0], [7, 0], [0], [3, 9, 9, 9, 0])]
    rows = spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "ids binary").repartition(3)
    got = packing.corpus_counts(rows, "<u2")
    assert (got.docs, got.mean, {int(t): int(got.df[t]) for t in np.flatnonzero(got.df)}) == (4, 2.0, {3: 1, 7: 2, 9: 2})
    assert packing.corpus_counts(rows.limit(0), "<u2").docs == 0


def test_language_model_learns_from_whole_texts(spark, monkeypatch):
    # every Baum-Welch round counts every training token, the first one included
    texts = ["tail " * 40 + f"w{k} " * (1500 if k == 3 else 5) for k in range(12)]
    train = [len(t.split()) + 1 for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1]
    seen, expected = [], hmm.expected

    def watched(blocks, model):
        start, step, emit = expected(blocks, model)
        seen.append((round(float(start.sum()), 2), round(float(emit.sum()))))
        return start, step, emit

    monkeypatch.setattr(hmm, "expected", watched)
    local = []
    monkeypatch.setattr(hmm.Counts, "add", lambda self, *a, add=hmm.Counts.add: (local.append(1), add(self, *a))[1])
    assert hmm.language_scores(table(spark, texts), rounds=4).count() == 12
    assert seen == [(len(train), sum(train))] * 4
    assert not local, "Baum-Welch on the driver"


def test_table_of_classes_grows():
    assert hmm.table_size(0) == hmm.CLASSES
    assert all(hmm.table_size(n) >= 2 * n for n in (1, 20_000, 1 << 20, (1 << 20) + 1))
    keys = np.array([0, 1, hmm.KEYS - 1], np.int32)
    assert hmm.in_table(keys, 1 << 17).min() >= 1 and hmm.in_table(keys, 1 << 17).max() < 1 << 17


def test_licenses_at_any_length(spark):
    notice = "Licensed under the MIT License."
    texts = [f"some code\n{sign * n} {notice} {sign * n}\nmore" for n in (80, 2000) for sign in "*-"]
    long = ["plain words here " * 300 + w + " and so on" for w in ("licence", "license", "other")]
    got = {r.doc_id: r for r in license.license_scan(table(spark, [*texts, *long])).collect()}
    assert [got[k].notices for k in range(len(texts))] == ["MIT"] * len(texts)
    a, b, c = (got[len(texts) + k].canonical_sha256 for k in range(3))
    assert a == b != c


@pytest.mark.skipif(not Path("/usr/share/common-licenses/Apache-2.0").exists(), reason="no copies of the texts")
def test_long_licenses(spark):
    texts = [Path("/usr/share/common-licenses", n).read_text(encoding="utf-8") for n in ("Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0")]
    texts.append("Copyright 2021 A. Person\n" + re.sub(r"\bLICENSE\b", "LICENCE", texts[0].upper()))
    texts.append(texts[0] + " more")
    got = {r.doc_id: r.license for r in license.license_scan(table(spark, texts)).collect()}
    assert [got[k] for k in range(6)] == ["Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Apache-2.0", None]
    assert len(license_texts.LONG_DIGESTS) == 13


def test_near_copies_with_repeated_and_null_ids(spark):
    words = [f"w{k}" for k in range(80)]
    near = [" ".join([*words[:40], x, *words[40:]]) for x in "abc"]
    alone = "nothing like the others at all"
    for ids in ([5, 5, 5, 5], [None] * 4, [None, 4, 4, 9], [7, None, None, 7]):
        left = [(r.doc_id, r.text) for r in jaccard.drop_near_copies(table(spark, [*near, alone], ids)).collect()]
        kept = [d for d, t in left if t != alone]
        assert len(left) == 2 and (ids[3], alone) in left
        assert kept == [min((i for i in ids[:3] if i is not None), default=None)]


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_texts_of_one_hash_keep_their_ids(spark, size):
    from caseloom.llm.spans import span_hashes

    a, b = thue_morse(size, "ab"), thue_morse(size, "ba")
    data = np.frombuffer((a + b).encode(), np.uint8)
    h = span_hashes(data, np.array([0, size]), np.array([size, 2 * size]))
    assert h[0] == h[1]  # the case this test is about
    texts = [a, b, b, a, f"{a} {b}", f"{b} {a}", "ab"]
    multi = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(multi, "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe_round_trip(table(spark, texts).coalesce(1), multi).collect():
        want = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(table(spark, texts).coalesce(1), RANKS).collect()
    for d, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for p in (p for p in pieces if p.doc_id == d):
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


@pytest.mark.parametrize("length", [37, 101, 400])
def test_anchors_do_not_depend_on_the_piece(length):
    rnd = random.Random(length)
    texts = ["".join(rnd.choice("abc ") for _ in range(n)) for n in (0, 9000, 50, 20_000, 400)]
    data, off = text_bytes(pa.array(texts))

    def rows(piece):
        out = set()
        for first, found in suffix.text_anchors(data, off, suffix.Strings(length), piece):
            out |= {(first + d, a, s, k, c) for d, a, s, k, c in zip(*(found[n].tolist() for n in ("doc", "at", "side", "key", "context")), strict=True)}
        return out

    assert rows(3000) == rows(1 << 20)


@pytest.mark.parametrize("broadcast_mb", [64, -1])
def test_anchors_of_repeated_keys_stay(spark, broadcast_mb):
    shared = " ".join(f"passage{k}" for k in range(30))
    rows = spark.createDataFrame([(k, f"{'x' * k} own{k} " + (shared if k % 3 else "") + " ".join(f"t{k}n{j}" for j in range(60))) for k in range(12)], "uid long, text string")
    strings = suffix.Strings(101)
    every = [tuple(r) for r in suffix.anchors(rows, strings).collect()]
    uses = collections.Counter(r[3] for r in every)
    want = {r for r in every if uses[r[3]] > 1}
    columns = ["uid", "at", "side", "key", "context"]
    got = {tuple(r) for r in suffix.possible_anchors(rows, strings, broadcast_mb).select(*columns).collect()}
    assert want and want <= got <= set(every)
    assert broadcast_mb > 0 or got == want


@pytest.mark.parametrize("length", [37, 101, 400])
def test_suffix_arrays_leave_out_what_a_group_shares(length, monkeypatch):
    rnd = random.Random(length)
    strings = suffix.Strings(length)
    _, far = strings.sides[0]
    shared = bytes(rnd.choices(range(97, 123), k=length - far))
    left, right = bytes(rnd.choices(range(97, 123), k=far)), bytes(rnd.choices(range(97, 123), k=far))
    rows = []
    for k in range(60):
        keep = rnd.randint(0, far), rnd.randint(0, far)
        text = bytes([65 + k] * (far - keep[0])) + left[far - keep[0] :] + shared + right[: keep[1]] + bytes([65 + k] * (far - keep[1]))
        rows.append({"key": 1, "uid": k, "low": 5 * k, "near": 0, "far": far, "anchor": 5 * k + far, "bytes": text})
    sizes, build = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s: (sizes.append(len(s)), build(s))[1])
    uid, place = suffix.batch_repeats(rows, length)
    starts = [(r["uid"], r["low"] + i, r["bytes"][i : i + length]) for r in rows for i in range(far + 1)]
    uses = collections.Counter(b for *_, b in starts)
    want = [(u, i) for u, i, b in starts if uses[b] > 1]
    assert want and list(zip(uid.tolist(), place.tolist(), strict=True)) == want
    assert sizes[0] < len(starts)


@pytest.mark.parametrize("k", [2, 5, 8])
def test_expected_counts_of_segments_in_reused_memory(k):
    rng = np.random.default_rng(k)
    table, sizes = 40, np.array([1, 3, 256, 700, 5, 1])
    starts = np.cumsum(sizes) - sizes
    classes = rng.integers(0, table, int(sizes.sum())).astype(np.int32)
    model = hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(table), k).T.copy())
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((table, k))
    log10 = 0.0
    for at, n in zip(starts, sizes, strict=True):
        for low in range(0, n, hmm.SEGMENT):
            x = classes[at + low : at + min(low + hmm.SEGMENT, n)]
            alpha, c = [], []
            for t, o in enumerate(x):
                a = ((model.start if low == 0 else model.rest()) if t == 0 else alpha[-1] @ model.step) * model.emit[o]
                c.append(a.sum())
                alpha.append(a / c[-1])
            beta = np.ones(k)
            for t in range(len(x) - 1, -1, -1):
                if t < len(x) - 1:
                    ahead = model.emit[x[t + 1]] * beta / c[t + 1]
                    step += model.step * np.outer(alpha[t], ahead)
                    beta = model.step @ ahead
                emit[x[t]] += alpha[t] * beta / (alpha[t] @ beta)
            start += alpha[0] * beta / (alpha[0] @ beta) if low == 0 else 0
            log10 += np.log10(c).sum()
    counts, rooms = hmm.Counts(k, table), set()
    for part in (slice(3, 4), slice(0, 3), slice(4, 6)):  # the longest first: the others find its memory
        counts.add(model, classes, starts[part], sizes[part])
        rooms.add(id(counts.room[0]))
    assert len(rooms) == 1
    # a little more than the memory at hand
    hmm.Counts.add(more := hmm.Counts(k, table), model, classes, starts[:3], sizes[:3])
    more.add(model, classes, starts[2:3], sizes[2:3] + 20)
    assert math.isclose(more.emit.sum(), sizes[:3].sum() + 276, rel_tol=1e-5)
    assert np.allclose(counts.start, start, rtol=1e-4) and np.allclose(counts.step, step, rtol=1e-4, atol=1e-4)
    assert np.allclose(counts.emit, emit, rtol=1e-4, atol=1e-4) and math.isclose(counts.log10, log10, rel_tol=1e-5)
    x = rng.random((k, 7)).astype(np.float32)
    assert np.allclose(hmm.over_states(x), x.sum(axis=0), rtol=1e-6)
