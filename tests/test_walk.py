"""Guided decoding inside tasks against the step-wise decode."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from caseloom.catalog import predict as queries
from caseloom.functions.distributions import Guidance
from caseloom.operators import boost, guide, predict
from caseloom.operators.cases import prefix_suffix_pairs
from caseloom.operators.mine import ModelConfig
from caseloom.operators.ordering import sequence_log


@pytest.fixture(scope="module")
def world(spark):
    """Cases over four activities, one without a decision; limits cut some walks off."""
    rnd = random.Random(3)
    rows = [(str(c), rnd.choice("abcd"), k) for c in range(12) for k in range(6)]
    log = sequence_log(spark.createDataFrame(rows, "case_id string, activity string, us bigint"), ["us"])
    pairs = prefix_suffix_pairs(log, 20, 5).withColumn("limit", 8 - F.col("prefix_len").cast("int"))
    z = [("a", "p_a", {"a": 0.2, "b": 0.8}), ("b", "p_b", {"c": 0.5, "d": 0.3, "EOS": 0.2}), ("c", "p_c", {"a": 0.1, "x": 0.9})]
    context = spark.createDataFrame(z, "activity string, place string, z map<string,double>")
    return predict.count_model(log), pairs, predict.Decisions(context, Guidance(support_threshold=0.25))


def told(rows):
    return sorted(tuple(str(r[c]) for c in ("case_id", "prefix_len", "sample", "target_suffix", "suffix", "trace")) for r in rows.collect())


def test_samples_of_tasks_are_those_of_the_stepwise_decode(world, monkeypatch):
    model, pairs, decide = world
    got = guide.guided_samples(pairs, model, 7, decide, 7)
    assert "_drawn" in got._jdf.queryExecution().toString()
    monkeypatch.setattr(guide, "walk_samples", lambda *_: None)
    want = told(guide.guided_samples(pairs, model, 7, decide, 7))
    assert told(got) == want and len(want) == 7 * pairs.count() and any("place='p_b'" in r[5] for r in want)


def test_every_prefix_gets_all_samples(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    rows = [(c * 10 + k, c, "FOP"[(c + k) % 3], 100.0 * c + k, day + datetime.timedelta(days=k), "abc"[(c * k + k) % 3]) for c in range(30) for k in range(4)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/orders.parquet")
    people = [(c, c % 5, 1.0, "AB"[c % 2]) for c in range(30)]
    spark.createDataFrame(people, "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    out = queries.guided_sampled_suffixes(spark, str(tmp_path))
    each = out.groupBy("case_id", "prefix_len").agg(F.collect_set("sample").alias("s"), F.count("*").alias("n"), F.sum("decision_steps").alias("d")).collect()
    assert each and all(sorted(r["s"]) == list(range(1, queries.SAMPLES + 1)) and r["n"] == queries.SAMPLES for r in each)
    assert queries.SAMPLES == 100 and sum(r["d"] for r in each) > 0


CATS, NUMS, STATICS = ["st"], ["amt"], ["seg"]
FEATURES = ["seg", "st", "st_past_mode"], ["amt", "amt_past_avg"]


@pytest.fixture(scope="module")
def scored_world(spark):
    """Cases with a category, a number and a fixed category, some missing, and models of two places."""
    rnd = random.Random(5)
    maybe = lambda v: None if rnd.random() < 0.15 else v
    rows = []
    for c in range(25):
        seg = maybe(rnd.choice("AB"))
        rows += [(str(c), rnd.choice("abc"), k, maybe(rnd.choice("xyz")), maybe(rnd.uniform(-2, 2)), seg) for k in range(7)]
    schema = "case_id string, activity string, us bigint, st string, amt double, seg string"
    log = sequence_log(spark.createDataFrame(rows, schema), ["us"], dyn_cat=CATS, dyn_num=NUMS, sta_cat=STATICS)
    seen = []
    for place in ("p_a", "p_b"):
        for k in range(400):
            amt, avg, st, mode, seg = maybe(rnd.uniform(-2, 2)), rnd.uniform(-1, 1), maybe(rnd.choice("xyz")), rnd.choice("xyz"), rnd.choice("AB")
            target = "a" if (amt or 0) > 0.3 else "b" if st == "x" or avg > 0.2 else "c" if mode == "y" else "EOS"
            seen.append((place, target, k % 7 == 0, seg, st, mode, amt, avg))
    seen += [("p_c", "a", False, "A", "x", "x", 1.0, 1.0)] * 60
    df = spark.createDataFrame(seen, "place string, target string, holdout boolean, seg string, st string, st_past_mode string, amt double, amt_past_avg double")
    nodes = boost.fit_places(df, *FEATURES, ModelConfig(rounds=15, min_leaf=10, learning_rate=0.3))
    score = boost.score_places(spark, boost.forests(nodes, *FEATURES), *FEATURES, "z")
    context = spark.createDataFrame([("a", "p_a"), ("b", "p_b"), ("c", "p_c"), ("d", "nowhere")], "activity string, place string")
    pairs = prefix_suffix_pairs(log, 20, 5, [*CATS, *NUMS, *STATICS]).withColumn("limit", 9 - F.col("prefix_len").cast("int"))
    state = predict.start_state_features(pairs, CATS, NUMS).withColumns({c: F.element_at(c, -1) for c in STATICS})
    return predict.count_model(log), state, context, score, predict.attribute_model(log, CATS, NUMS)


def close(a, b):
    if isinstance(a, dict):
        return list(a) == list(b) and all(close(a[k], b[k]) for k in a)
    return math.isclose(a, b, rel_tol=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize(
    "cfg, monotone",
    [
        (Guidance(support_threshold=0.2), []),
        (Guidance(support_threshold=0.3, min_base_entropy=0.8, min_decision_confidence=0.6, max_guided_steps=3), ["amt"]),
        (Guidance(beta_max=0.0), []),
    ],
)
def test_decode_inside_tasks_is_the_stepwise_decode(scored_world, monkeypatch, cfg, monotone):
    model, state, context, score, attributes = scored_world
    decide = guide.state_decisions(context, cfg, score, attributes, CATS, NUMS, STATICS, monotone=monotone)

    def told():
        done = guide.guided_mode(state, model, 8, decide)
        return sorted(done.select("case_id", "prefix_len", "target_suffix", "suffix", "trace").collect(), key=lambda r: r[:2])

    got = told()
    monkeypatch.setattr(guide, "walk_best", lambda *_: None)
    want = told()
    assert len(got) == len(want) == state.count() and sum(len(r["trace"]) for r in want) > 100
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and len(a["trace"]) == len(b["trace"])
        for x, y in zip(a["trace"], b["trace"], strict=True):
            assert all(close(x[c], y[c]) for c in y.asDict()), (x, y)


def test_few_jobs_and_no_rewriting_of_the_frontier(spark, scored_world, monkeypatch):
    model, state, context, score, attributes = scored_world
    decide = guide.state_decisions(context, Guidance(), score, attributes, CATS, NUMS, STATICS)
    monkeypatch.setattr(predict, "cut", lambda *_: pytest.fail("the frontier is written"))
    assert guide.guided_mode(state, model, 8, decide).count() == state.count()
