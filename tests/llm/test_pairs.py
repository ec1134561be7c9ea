"""Decontamination and hard negatives on odd rows, against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from caseloom.llm import contamination, negatives

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, uid string, n_words int, n_hit string, win int, item string, key long, size int"
ITEMS = "item_id long, text string, win string, ws int, doc_id int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contaminated(docs, items, size=10):
    wins = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), size)
        for s in range(len(w) - n + 1) if w else ():
            wins[tuple(w[s : s + n])].add("" if item is None else str(item))
    for doc, text in docs:
        w = words(text)
        hit, held = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    held |= wins[tuple(w[s : s + n])]
        sha = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        yield (doc, len(w), len(hit), len(held), sha, bool(hit))


def texts_and_items():
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(6)] + ["É", "é", "naïve", "x1", "日本"]

    def text(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    items = [(k, text(rnd.choice([10, 11, 12, 25]))) for k in range(12)]
    items += [(20, "alpha"), (21, "Alpha  beta"), (22, "a b c d e f g h i"), (23, None), (24, " .,;"), (None, "null id item has words"), (None, "another one of them here")]
    items += [(3, "same id other words " * 4), (25, "the " * 12), items[0], (102, items[1][1])]
    known = [t for _, t in items if t]
    docs = [(k, f"{text(rnd.randint(0, 40))} {rnd.choice(known)}-{text(5)}") for k in range(40)]
    docs += [(50, None), (51, ""), (52, "."), (53, "ALPHA"), (54, "alpha beta"), (55, "the " * 9), (56, "the\n" * 50), (57, "a b c d e f g h"), (58, "a.b.c.D.e.f.g.h.i")]
    docs += [(None, known[0]), (None, known[0]), (None, "x"), docs[3], docs[3], (60, "gap " * 60_000 + known[2] + " gap" * 60_000)]
    return docs, items


@pytest.mark.parametrize("most", [10_000, 0])
def test_decontamination(spark, most):
    docs, items = texts_and_items()
    a = spark.createDataFrame([(d, t, "u", 1, "h", 2, "i", 3, 4) for d, t in docs], DOCS)
    b = spark.createDataFrame([(d, t, "w", 5, 6) for d, t in items], ITEMS)
    want = collections.Counter(contaminated(docs, items))
    got = contamination.decontaminate(a, b, most=most)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert 10 < sum(r[-1] for r in want) < len(docs)


def test_decontamination_of_empty_tables(spark):
    docs, items = texts_and_items()
    a = spark.createDataFrame([(d, t, "u", 1, "h", 2, "i", 3, 4) for d, t in docs], DOCS)
    b = spark.createDataFrame([(d, t, "w", 5, 6) for d, t in items], ITEMS)
    assert contamination.decontaminate(a.limit(0), b).count() == 0
    for none in (b.limit(0), b.where("item_id = 24")):
        rows = contamination.decontaminate(a, none).collect()
        assert len(rows) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in rows)


def mined(rows, k=5):
    rows = list(dict.fromkeys((i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows))
    for i, lab, v in rows:
        if i % 100:
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if j != i and len(v) == len(w)]
        score.sort(key=lambda r: (-r[0], r[1]))
        for p, j, _ in [r for r in score if r[2] == lab][:k]:
            near = [r for r in score if r[2] != lab and 80 * p <= 100 * r[0] <= 100 * p][:k]
            for rank, (s, n, _) in enumerate(near, 1):
                yield (i, j, rank, n, p, s)


SCHEMA = "vec_id long, embedding array<double>, label int, uid string, v int, tops int, share string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "u", 1, 2, "s", 3) for i, lab, v in rows], SCHEMA)


@pytest.mark.parametrize(("seed", "scale"), [(0, 1.0), (1, 0.02), (2, 1000.0), (3, 200_000.0)])
def test_hard_negatives(spark, monkeypatch, seed, scale):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((500, 40))
    v = scale * v / np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[300]
    v[8:20] = v[100]
    v[200] = 0
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in r]) for i, r in enumerate(v)]
    rows += rows[5:9] + [rows[100], (600, 3, [1.0, 2.0]), (601, 3, [1.0, 2.0]), (602, 1, [1.0, 1.5])]
    odd = [(700, 1, None), (800, None, rows[0][2]), (900, 1, [math.nan] * 40), (901, 1, [math.inf] * 40), (902, 1, [None, *rows[0][2][1:]]), (None, 1, rows[0][2]), (1000, 1, [])]
    monkeypatch.setattr(negatives, "ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    want = [*mined(rows)]
    got = negatives.hard_negatives(vectors(spark, rows + odd))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 20


def test_hard_negatives_of_few_rows(spark):
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(0, 1, [1.0])])).count() == 0
    # all equal: every score is a tie, and ids decide
    rows = [(i, i % 2, [0.5, 0.5]) for i in range(300)]
    assert sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows)).collect())) == sorted(mined(rows))


def test_pruned_products_lose_no_pair():
    rng = np.random.default_rng(4)
    for dims in (1, 15, 16, 17, 64):
        a, x = np.rint(rng.standard_normal((20, dims)) * 100), np.rint(rng.standard_normal((200, dims)) * 100)
        full = (a @ x.T).astype(np.int64)
        for share in (0.9, 0.4, 0.1, 0.0, -0.5):
            least = (share * np.sqrt((a * a).sum(axis=1)) * 100 * np.sqrt(dims)).astype(np.int64)
            i, j, s = negatives.survivors(a, x, least)
            assert {*zip(i.tolist(), j.tolist(), s.tolist(), strict=True)} == {(p, q, int(full[p, q])) for p, q in zip(*np.nonzero(full >= least[:, None]), strict=True)}
        assert len(negatives.survivors(a, x, np.full(20, negatives.NONE))[0]) == full.size


def test_nearest_of_mixed_lengths_and_repeated_ids(spark):
    from caseloom.llm import ann

    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0, 0.0]), (50, [1.0, 0.1, 0.0]), (3, []), (4, None), (5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in ann.nearest(df, df.where("vec_id % 50 = 0"), k=5).collect())
    assert got == [(0, 1, 5), (0, 2, 1), (0, 3, 1), (50, 1, 2)]
