"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; each against brute force."""

import base64
import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from caseloom.llm import ann, exact, hmm, jaccard, license, license_texts, packing, quality, suffix, toxic
from caseloom.llm.bpe import Bpe, bpe_round_trip, encode_texts
from caseloom.llm.graph import components
from caseloom.llm.queries import MULTI_RANKS, QUERIES, RANKS, SQL

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_bytes int, score string, uid string, ids int, ranges int"

rnd = random.Random(5)
BASE = "".join(rnd.choice("abcdefg hij") for _ in range(5000))
WORDS = [f"w{k}" for k in range(60)]
TEXTS = [
    None, "", " \n\t", "a", "Ab", "aB", "ÀB", "àB", "one two three four", "ONE two three four", " ".join(WORDS),
    " ".join(WORDS), " ".join([*WORDS[:59], "other"]), " ".join([*WORDS[:30], "x", *WORDS[31:]]), BASE[:1000], BASE[300:1500],
    "x" * 900, "ab" * 700, "é" * 300 + BASE[2000:2600], BASE[2000:2600] + "ü" * 300, "don't 're've  'll\r\n x'", "<|endoftext|>", "word " * 9000,
]


def table(spark, texts=TEXTS, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, None, None, "k", 1, "s", "u", 3, 4) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    # the last rows repeat a row, and have null ids
    return table(spark, [*TEXTS, TEXTS[14], "none", None], [*range(len(TEXTS)), 14, None, None])


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_exact(docs):
    rows = docs.collect()
    norm = lambda t: (t or "").translate(LOWER)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    want = []
    for r in rows:
        ids = groups[norm(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(norm(r.text).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in exact.exact_groups(docs).collect()))) == sorted(map(str, want))
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert collections.Counter(norm(r.text) for r in left.collect()) == collections.Counter(groups.keys())


def test_jaccard(docs):
    rows = docs.where("doc_id is not null").collect()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := tokens(r.text)) else frozenset() for r in rows]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min([least[i], *(least[j] for j in near[i])]) for i in range(len(rows))]
    want = sorted((r.doc_id, rows[least[i]].doc_id, len(near[i])) for i, r in enumerate(rows))
    got = jaccard.jaccard_groups(docs.where("doc_id is not null"))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == want
    assert jaccard.jaccard_groups(docs).count() == docs.count()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def ranks_of(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe(docs):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(MULTI_RANKS), special_tokens={})
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((r.doc_id, len(ids), sha, hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe_round_trip(docs, MULTI_RANKS).collect()))) == sorted(map(str, want))


def test_bpe_random():
    bpe = Bpe.load(MULTI_RANKS)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(MULTI_RANKS), special_tokens={})
    texts = ["".join(rnd.choice(" \n\t'stdrelvmABab09.,!é日👍½  ß") for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += ["a" * 100_000, "abc" * 20_000]
    for k, ids in encode_texts(pa.array(texts), bpe):
        assert ids.tolist() == enc.encode_ordinary(texts[k])
    # one merge at a time gives the same
    data = np.frombuffer(b"aaaaabababcabc", dtype=np.uint8)
    one = bpe.encode(data, np.array([0]), np.array([len(data)]), single=True)[0]
    assert one.tolist() == bpe.encode(data, np.array([0]), np.array([len(data)]))[0].tolist()


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 6)).round(1)
    v[7] = v[3]
    v[9] = 0
    rows = [(i, [float(x) for x in r], 0, 1) for i, r in enumerate(v)]
    rows += [(1000, None, 0, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 1), (1002, [math.nan] * 6, 0, 1), (1003, [math.inf] * 6, 0, 1), (None, [1.0] * 6, 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, q int")
    want = []
    for q in range(0, 300, 50):
        s = {}
        for i in range(300):
            if i != q and v[i].any() and v[q].any():
                s[i] = ann.ordered_sum(v[q : q + 1] * v[i : i + 1])[0] / np.sqrt(ann.ordered_sum(v[q : q + 1] ** 2)[0] * ann.ordered_sum(v[i : i + 1] ** 2)[0])
        want += [(q, n + 1, i, s[i]) for n, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:5])]
    for tile in (4096, 40):
        got = ann.nearest(df, df.where("vec_id % 50 = 0"), tile=tile)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_licenses(spark):
    mit = license_texts.TEXTS["MIT"]
    texts = ["Copyright (c) 2020 A. Person\n" + mit.upper().replace("\n\n", "\n \n"), "x" + mit, mit.replace("copy of", "copy of"), license_texts.TEXTS["Zlib"].replace("acknowledgment", "acknowledgement"), "Licensed under CC BY-NC 4.0.\nmore", None, ""]
    got = {r.doc_id: (r.license, r.notices) for r in license.license_scan(table(spark, texts)).collect()}
    assert got == {0: ("MIT", ""), 1: (None, ""), 2: ("MIT", ""), 3: ("Zlib", ""), 4: (None, "CC-BY-NC-4.0"), 5: (None, ""), 6: (None, "")}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    bad = ["!! $$ " * 20 + f"THAN!! {i}" for i in range(60)]
    good = [" ".join(rnd.choice(WORDS) for _ in range(40)) for _ in range(60)]
    rude = [" ".join([*g.split()[:20], "idiotic", *g.split()[20:]]) for g in good]
    df = table(spark, [*bad, *good, *rude, None, ""])
    labels = labels_of(spark, [(i, int(i >= 60), int(120 <= i < 180)) for i in range(180)] + [(None, 1, 1), (5, None, None)])
    for scores, column, parts, out in ((quality.quality_scores(df, labels), 1, 4, 2), (toxic.toxicity_scores(df, labels), 2, 3, 1)):
        got = scores.toPandas().set_index("doc_id")
        assert len(got) == 182 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
        assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % parts == out) for i in got.index)
        held = got[got.held_out & (got.index < 180)]
        truth = [int(i >= 60) if column == 1 else int(i >= 120) for i in held.index]
        assert (held.predicted == truth).mean() > 0.9
    assert set(quality.quality_scores(df, labels.limit(0)).toPandas().score) == {0.5}
    assert set(toxic.toxicity_scores(df, labels.limit(0)).toPandas().score) == {0.0}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 7, 10, 200):
        for letters in (1, 2, 5):
            s = rng.integers(1, letters + 1, n)
            assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def removed(rows):
    uses = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        uses.update(b[i : i + 400] for i in range(len(b) - 399))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 399):
            if uses[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("group", [4096, 3])
def test_repeats(spark, docs, group, monkeypatch):
    whole = suffix.repeated_ranges
    monkeypatch.setattr(suffix, "repeated_ranges", lambda rows: whole(rows, group))
    hot = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 300))) + BASE[: rnd.choice([380, 395, 410, 430])] for _ in range(30)]
    df = docs.unionByName(table(spark, hot, range(100, 130)))
    got = sorted(map(str, map(tuple, suffix.remove_repeats(df).collect())))
    assert got == removed([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    cut = suffix.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == df.count()


def test_language_model(docs):
    rows = docs.collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = collections.Counter()
    for r in rows:
        if not held(r.doc_id):
            c.update([*tokens(r.text), None])
    n, v = sum(c.values()), len(c)
    want = sorted(str((r.doc_id, held(r.doc_id), len(t) + 1, sum(c[x] > 0 for x in [*t, None]), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*t, None]), 4))) for r in rows for t in [tokens(r.text)])
    got = hmm.language_scores(docs, seed_docs=20).collect()
    assert sorted(str((*tuple(r)[:5], round(r.base_score, 4))) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_forward_is_exact():
    rng = np.random.default_rng(2)
    emit = np.zeros((hmm.CLASSES, 2))
    emit[:3] = [[0.2, 0.5], [0.5, 0.2], [0.3, 0.3]]
    model = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), emit)
    x = rng.integers(0, 3, 7)
    total = 0.0
    for path in np.ndindex(*(2,) * 7):
        p = model.start[path[0]] * emit[x[0], path[0]]
        for a, b, o in zip(path, path[1:], x[1:], strict=False):
            p *= model.step[a, b] * emit[o, b]
        total += p
    assert math.isclose(hmm.forward(model, x, np.array([0]), np.array([7]))[0], math.log10(total), rel_tol=1e-9)


def pieces_are_whole(pieces, texts):
    """texts: (doc_id, text) with distinct ids."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start):
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += p.length
        assert at == len(ids)
    lengths = collections.Counter()
    for s in {p.sequence_id for p in pieces}:
        row = sorted((p.offset, p.length) for p in pieces if p.sequence_id == s)
        assert [o for o, _ in row] == np.cumsum([0, *(n for _, n in row)])[:-1].tolist()
        lengths[sum(n for _, n in row)] += 1
    assert all(n <= 1024 and n & (n - 1) == 0 for n in lengths)


def test_packing(spark):
    df = table(spark)
    pieces_are_whole(packing.pack_documents(df, RANKS).collect(), [(r.doc_id, r.text) for r in df.collect()])


def test_empty_tables(spark):
    none = table(spark, [])
    labels = labels_of(spark, [])
    for df in (
        exact.exact_groups(none), exact.drop_copies(none), jaccard.jaccard_groups(none), jaccard.drop_near_copies(none), bpe_round_trip(none, MULTI_RANKS),
        license.license_scan(none), quality.quality_scores(none, labels), toxic.toxicity_scores(none, labels), suffix.remove_repeats(none),
        suffix.without_repeats(none), hmm.language_scores(none), packing.pack_documents(none, RANKS),
    ):
        assert df.count() == 0


def test_pipeline(spark, docs):
    out = docs.drop("uid")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.drop("uid").columns, name
        out = spark.createDataFrame(out.collect(), out.schema)
    assert out.where("doc_id = 12").count() + out.where("doc_id = 11").count() <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() > 0


def test_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(SQL) <= set(QUERIES)
    json.dumps(SQL)


def test_ftrl_and_scores_are_plain_sums(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["Good", "bad", "x!", "¿y?", "AAA", "1"]) for _ in range(rnd.randint(0, 30))) for _ in range(40)] + ["", "one", "é" * 50]
    rows = spark.createDataFrame([(i, t, int("Good" in t)) for i, t in enumerate(texts)], "doc_id long, text string, y int")
    got = quality.train(rows, parts=1, epochs=2)
    assert np.array_equal(got, quality.train(rows.repartition(7), parts=1, epochs=2))

    def bag(text):
        data, off = quality.text_bytes(pa.array([text]))
        _, index, value = quality.features(data, off)
        out = collections.defaultdict(float)
        for i, v in zip(index.tolist(), value.tolist(), strict=True):
            out[i] += v
        return out

    # follow the regularised leader, a coordinate at a time
    alpha, beta, l1, l2 = 0.4, 0.1, 1e-4, 1e-3
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    examples = []
    for t in texts:
        b = bag(t)
        examples.append((sorted(b.items()), float("Good" in t)))

    def order(e):
        index, value = np.array([*[i for i, _ in e[0]], quality.SIZE], np.int32), np.array([*[v for _, v in e[0]], 1], np.float32)
        return zlib.crc32(index.tobytes()), e[1], index.tobytes(), value.tobytes()

    keyed = sorted(examples, key=order)
    for epoch in range(2):
        for k in np.random.default_rng(epoch).permutation(len(keyed)):
            items, y = keyed[k]
            items = [*[(i, float(np.float32(v))) for i, v in items], (quality.SIZE, 1.0)]
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weight(i) * v for i, v in items)))))
            for i, v in items:
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * weight(i)
                n[i] += g * g
    for i in [*z, 5]:
        assert math.isclose(got[i], weight(i), rel_tol=1e-4, abs_tol=1e-6)
    for t, s in zip(texts, quality.score_texts(pa.array(texts), got), strict=True):
        total = float(got[quality.SIZE]) + sum(float(got[i]) * v for i, v in bag(t).items())
        assert math.isclose(s, 1 / (1 + math.exp(-total)), rel_tol=1e-6)
