"""Hashes and distances of many keys at once agree with one at a time."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from caseloom.functions.hashes import Keys
from caseloom.functions.similarity import _list_distances, aligned


def test_draws_are_those_of_md5():
    keys = [("k" * n + "|é").encode() for n in range(70)] * 2
    who = np.array([k for k in range(len(keys)) if k % 3])
    for tail in (b"|0|17", b"|12|17"):
        want = [int(hashlib.md5(keys[k] + tail).hexdigest()[:13], 16) / 16**13 for k in who.tolist()]
        assert Keys(keys).uniform(who, tail).tolist() == want


def test_distances_side_by_side():
    draw = random.Random(3)
    word = lambda most: [draw.choice(["a", "b", "c", None, "d"]) for _ in range(draw.randint(0, most))]
    targets = [word(70) for _ in range(40)] + [word(5) for _ in range(700)] + [None, [], ["a"] * 64, ["a"] * 65]
    lists = [[word(draw.choice([4, 70])) for _ in range(draw.randint(0, 4))] for _ in targets]
    lists[3], lists[9] = None, [["a"], None, []]
    a, b = pa.array(targets, pa.list_(pa.string())), pa.array(lists, pa.list_(pa.list_(pa.string())))

    def one(x, y):
        code = {v: k for k, v in enumerate("abcd")}
        return aligned(*(np.array([code.get(v, -1) for v in s], "<i4").tobytes() for s in (x, y)))

    want = [None if t is None or s is None else [None if y is None else one(t, y) for y in s] for t, s in zip(targets, lists, strict=True)]
    assert _list_distances(a, b).to_pylist() == want
    assert _list_distances(a.slice(5), b.slice(5)).to_pylist() == want[5:]


def test_samples_stay_in_the_row_of_their_prefix(spark):
    from caseloom.operators.predict import collect_samples, count_model, decode_samples
    from caseloom.operators.cases import prefix_suffix_pairs
    from caseloom.operators.ordering import sequence_log

    rows = [(str(c), "abc"[(c * k + k) % 3], k) for c in range(12) for k in range(5)]
    log = sequence_log(spark.createDataFrame(rows, "case_id string, activity string, us bigint"), ["us"])
    from pyspark.sql import functions as F

    pairs = prefix_suffix_pairs(log, 20, 5).withColumn("limit", F.lit(6))
    model = count_model(log)
    apart = collect_samples(pairs, decode_samples(pairs, model, 6, 4))
    near = collect_samples(pairs, decode_samples(pairs, model, 6, 4, together=True))
    assert near.columns == [*pairs.columns, "decoded_suffixes", "mode"]
    names = sorted(near.columns)
    assert sorted(map(str, near.select(names).collect())) == sorted(map(str, apart.select(names).collect()))
    assert near.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
