"""Spelling variants against brute force: odd rows, every way of splitting, long words."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from caseloom.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, word string, n int, form string, root int, id string, run int, h long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, times=10):
    form, out = {}, {}
    for w, n in words.items():
        best = sorted((-words[x], x) for x in words if near(w, x))
        out[w] = len(best)
        if best and -best[0][0] >= times * n:
            form[w] = best[0][1]
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        yield (w, f, root, n, out[w], words[f] if f else None)


def counted(docs):
    uses = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                uses[run] += 1
    return {w: n for w, n in uses.items() if n >= 2}


def some_words(seed, letters, count, longest):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(count)}
    return {w: rnd.choice([1, 1, 2, 3, 30, 300, 3000]) for w in words}


@pytest.mark.parametrize("seed", range(6))
def test_acceptor_pairs(seed):
    for letters, longest in (("a", 30), ("ab", 8), ("abcé日", 6)):
        words = some_words(seed, letters, 150, longest)
        names = list(words)
        zero = np.zeros(len(names), np.int64)
        row, count, best = variants.partners(zero, zero, zero, names, np.array([words[w] for w in names]))
        want = {}
        for w in names:
            if others := sorted((-words[x], x) for x in names if near(w, x)):
                want[w] = (len(others), others[0][1])
        assert {names[r]: (int(c), names[b]) for r, c, b in zip(row, count, best, strict=True)} == want


@pytest.mark.parametrize("most", [100_000, 40, 3])
def test_groups_however_split(spark, most):
    words = some_words(7, "abé", 300, 7)
    words |= {"shared" * 3 + w: n for w, n in some_words(8, "xyz", 150, 4).items()}
    words |= {"z" * n: 10**k for k, n in enumerate((40, 41, 42, 44))}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in variants.variant_groups(df, most=most).collect()]
    assert sorted(map(str, got)) == sorted(map(str, grouped(words)))


def test_vocabulary_and_whole_query(spark):
    rnd = random.Random(2)
    base = ["Example", "VARIANT", "naïveté", "kÄfigen", "wörtern", "sentence", "examples"]
    docs = [(k, " ".join(rnd.choice(base) + rnd.choice(["", "", ",", "1", "s"]) for _ in range(rnd.randint(1, 120)))) for k in range(60)]
    docs += [(70, None), (71, ""), (72, " .1"), (73, "x" * 5000 + " " + "x" * 5000), (74, "x" * 5001), (75, "x" * 5001), (None, docs[0][1]), (None, docs[0][1]), docs[1], docs[1]]
    docs += [(80, "÷×÷×÷×÷ ÷×÷×÷×÷ short Straße-straße straßes straßes")]
    df = spark.createDataFrame([(d, t, "w", 1, "f", 2, "i", 3, 4) for d, t in docs], DOCS)
    want = counted(docs)
    assert {r.word: r.n for r in variants.vocabulary(df).collect()} == want
    got = [tuple(r) for r in variants.variant_groups(variants.vocabulary(df)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, grouped(want)))
    assert any(r[1] for r in got)
    assert variants.variant_groups(variants.vocabulary(df.limit(0))).count() == 0
