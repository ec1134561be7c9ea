"""Models of all places at once, against plain row loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import boost
from caseloom.operators.mine import MiningResult, ModelConfig, guards, leaf_rules, load_results, predict, save_results
from caseloom.session import cut, scratch_path

SCHEMA = "case_id string, place string, ord int, target string, holdout boolean, colour string, amount double, extra string"
CFG = ModelConfig(rounds=40, min_leaf=10)


def some_rows(places=3, n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for p in range(places):
        for k in range(n):
            colour, amount = rnd.choice(["red", "blue", None, "green"]), rnd.choice([None, rnd.uniform(-2, 2), rnd.uniform(-2, 2)])
            if colour == "red":
                target = "A"
            elif amount is not None and amount > 0.5:
                target = "B"
            else:
                target = rnd.choice("CCCCA")
            rows.append((f"c{k}", f"p{p}", k, target, k % 7 == 0, colour, amount, "same"))
    rows += [(f"c{k}", "one class", k, "A", False, "red", float(k), "same") for k in range(60)]
    rows += [(f"c{k}", "constant", k, "AB"[k % 2], False, "red", 1.0, "same") for k in range(60)]
    return rows


@pytest.fixture(scope="module")
def mined(spark):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    nodes = cut(boost.fit_places(df, ["colour", "extra"], ["amount"], CFG))
    skipped = spark.createDataFrame([("empty place",)], "place string")
    return MiningResult(nodes, skipped, ["colour", "extra"], ["amount"], CFG, {"amount": (3.0, 2.0)})


def walk(nodes, row):
    """Leaf of a row by one step after the other; ``row`` has None for missing numbers."""
    at = nodes[0]
    while at["left"] >= 0:
        if at["value"] is not None:
            right = (row[at["feature"]] or "__MISSING__") == at["value"]
        else:
            right = row[at["feature"]] is not None and row[at["feature"]] > at["threshold"]
        at = nodes[at["right"] if right else at["left"]]
    return at


def test_scores_are_sums_over_trees(spark, mined):
    table = mined.nodes.collect()
    rows = [r for r in some_rows(seed=2) if r[2] < 25]
    rows += [("x", "p0", 1, "A", False, "never seen", 9.0, "new"), ("x", "no such place", 1, "A", False, "red", 1.0, "same"), ("x", None, 1, "A", False, None, None, None)]
    got = predict(spark.createDataFrame(rows, SCHEMA), mined).collect()
    assert len(got) == len(rows)
    kinds = {r["place"]: r["value"] for r in table if r["part"] == "place"}
    assert kinds == {"p0": "boosted", "p1": "boosted", "p2": "boosted", "one class": "prior", "constant": "prior"}
    trees = {}
    for r in table:
        if r["part"] == "base":
            trees.setdefault((r["place"], r["tree"]), {})[r["node"]] = r
    for r in got:
        own = [t for (p, no), t in trees.items() if p == r["place"] and no]
        if r["place"] not in kinds:
            assert r["z"] is None
            continue
        about = next(t for t in table if t["part"] == "place" and t["place"] == r["place"])
        if kinds[r["place"]] == "prior":
            assert r["z"] == dict(zip(about["labels"], about["values"], strict=True))
            continue
        row = {"colour": r["colour"], "extra": r["extra"], "amount": r["amount"]}
        score = np.array(trees[r["place"], 0][0]["values"]) + sum(np.array(walk(t, row)["values"]) for t in own)
        p = np.exp(score) / np.exp(score).sum()
        assert set(r["z"]) == set(about["labels"]) and all(math.isclose(r["z"][lab], v, rel_tol=1e-9) for lab, v in zip(about["labels"], p, strict=True))


def test_models_learn_the_rules(spark, mined):
    rows = [r for r in some_rows(seed=3) if r[1] == "p1" and (r[5] == "red" or (r[6] or 0) > 0.6)]
    for r in predict(spark.createDataFrame(rows, SCHEMA), mined).collect():
        assert max(r["z"], key=r["z"].get) == r["target"]


def test_leaf_statistics_count_rows(spark, mined):
    rows = [dict(zip(("case", "place", "ord", "target", "holdout", "colour", "amount", "extra"), r, strict=True)) for r in some_rows()]
    base = {(r["place"], r["case_id"]): r["z"] for r in predict(spark.createDataFrame(some_rows(), SCHEMA), mined).collect()}
    leaves = leaf_rules(mined.nodes).collect()
    assert {r["place"] for r in leaves} == {"p0", "p1", "p2"}
    for leaf in leaves:
        inside = []
        for r in rows:
            colour, amount = r["colour"] or "__MISSING__", r["amount"] if r["amount"] is not None else 0.0
            tests = [c.split(" ") for c in leaf["raw_rule"].strip("()").split(") AND (")]
            ok = r["place"] == leaf["place"]
            for name, op, at in tests:
                value = float(colour == name.partition("=")[2]) if "=" in name else amount
                ok = ok and (value <= float(at) if op == "<=" else value > float(at))
            if ok:
                inside.append(r)
        # thresholds are told to six digits
        assert abs(len(inside) - leaf["support"]) <= 1
        if len(inside) == leaf["support"]:
            assert math.isclose(leaf["prob_emp"], sum(r["target"] == leaf["label"] for r in inside) / len(inside))
            assert math.isclose(leaf["prob_model"], sum(base[r["place"], r["case"]][leaf["label"]] for r in inside) / len(inside), rel_tol=1e-9)
    rules = guards(mined).collect()
    for g in rules:
        if g["rule"] != "(true)":
            prior = sum(r["target"] == g["label"] for r in rows if r["place"] == g["place"]) / sum(r["place"] == g["place"] for r in rows)
            assert math.isclose(g["lift"], g["prob_model"] / prior, rel_tol=1e-9)
            assert g["support"] >= CFG.min_leaf_support and g["prob_model"] >= CFG.min_leaf_prob and g["lift"] >= CFG.min_leaf_lift
    assert {(g["place"], g["label"]) for g in rules if g["rule"] == "(true)"} == {("one class", "A"), ("constant", "A"), ("constant", "B")}


def test_one_round_is_a_newton_step():
    rnd = np.random.default_rng(5)
    code = rnd.integers(0, 6, (200, 2))
    target, n = rnd.integers(0, 3, 200), rnd.integers(1, 4, 200).astype(float)
    cfg = ModelConfig(rounds=1, min_leaf=5, depth=2)
    start, trees, score = boost.boost(boost.Grid(code, np.array([True, False])), target, n, np.zeros(200, bool), 3, cfg)
    p = boost.softmax(np.tile(start, (200, 1)))
    (tree, leaf) = trees[0]
    for node, (f, _, left, right) in enumerate(tree):
        if f >= 0:
            assert left > node and right == left + 1
            continue
        own = []
        for k in range(200):
            at = 0
            while tree[at][0] >= 0:
                f2, c, a, b = tree[at]
                at = b if (code[k, f2] == c if f2 == 0 else code[k, f2] > c) else a
            if at == node:
                own.append(k)
        assert n[own].sum() >= 5
        g = (n[own, None] * (p[own] - np.eye(3)[target[own]])).sum(axis=0)
        h = (n[own, None] * p[own] * (1 - p[own])).sum(axis=0)
        assert np.allclose(leaf[node], -cfg.learning_rate * g / (h + cfg.l2))
        assert np.allclose(score[own], start + leaf[node])


def test_rounds_stop_on_the_holdout():
    rnd = np.random.default_rng(6)
    code, n = rnd.integers(0, 20, (400, 3)), np.ones(400)
    noise = rnd.integers(0, 2, 400)  # nothing to learn: the holdout soon gets worse
    cfg = ModelConfig(rounds=300, min_leaf=2, learning_rate=0.3, patience=10)
    holdout = np.arange(400) % 4 == 0
    _, trees, _ = boost.boost(boost.Grid(code, np.zeros(3, bool)), noise, n, holdout, 2, cfg)
    assert len(trees) < 20
    _, trees, _ = boost.boost(boost.Grid(code, np.zeros(3, bool)), (code[:, 0] > 9).astype(int), n, holdout, 2, cfg)
    assert len(trees) > 20


def test_coarse_cells_and_jobs(spark):
    def jobs(places):
        spark.sparkContext.setJobGroup(f"places {places}", "")
        df = spark.createDataFrame(some_rows(places, 120), SCHEMA)
        nodes = boost.fit_places(df, ["colour"], ["amount"], ModelConfig(rounds=5, max_cells=12)).collect()
        assert sum(r["part"] == "place" for r in nodes) == places + 2
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"places {places}"))

    assert jobs(2) == jobs(12)
    none = spark.createDataFrame([], SCHEMA)
    assert boost.fit_places(none, ["colour"], ["amount"], CFG).count() == 0


def test_store_and_load(spark, mined):
    path = scratch_path(spark, "store")
    rules = guards(mined)
    incoming = spark.createDataFrame([("p0", "t", "A")], "place string, tid string, label string")
    save_results(mined, rules, incoming, path)
    back, told = load_results(spark, path)
    assert (back.cats, back.nums, back.config, back.fitted) == (mined.cats, mined.nums, mined.config, mined.fitted)
    text = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert text(told) == text(rules)
    rows = spark.createDataFrame(some_rows(seed=4)[:300], SCHEMA)
    assert text(predict(rows, back)) == text(predict(rows, mined))
    half = scratch_path(spark, "half")
    for part in ("guards", "guards_flat", "places", "skipped", "scalers"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{half}/{part}")
    with pytest.raises(ValueError, match="partial"):
        load_results(spark, half)
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{half}/manifest")
    with pytest.raises(ValueError, match="models is missing"):
        load_results(spark, half)
    mined.nodes.where("part <> 'rule'").write.parquet(f"{half}/models")
    with pytest.raises(ValueError, match="not what its manifest says"):
        load_results(spark, half)
    assert back.skipped.collect() == [("empty place",)] and back.places.where(F.col("kind") == "boosted").count() == 3


def test_bins_of_several_sizes_come_from_one_lookup(monkeypatch):
    rng = np.random.default_rng(3)
    values = [f"v{k}" for k in rng.permutation(127)]
    bins = boost.Binning(["c"], ["x"], {("p", "x"): rng.permutation(np.arange(127) / 2)}, {("p", "c"): values})
    columns = {"c": np.array([f"v{k}" for k in rng.integers(0, 140, 500)], dtype=object), "x": np.where(rng.random(500) < 0.1, np.nan, rng.integers(-4, 140, 500) / 2)}
    lookups, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, side="left": (lookups.append(len(v)), search(a, v, side))[1])
    got = bins.codes("p", columns, boost.SIZES)
    for j, size in enumerate(boost.SIZES):
        edges = sorted(bins.borders["p", "x"][:size])
        want = [0 if x != x else sum(e < x for e in edges) + 1 for x in columns["x"].tolist()]
        assert got[:, j, 1].tolist() == want
        assert got[:, j, 0].tolist() == [values[:size].index(v) + 1 if v in values[:size] else 0 for v in columns["c"]]
    assert lookups.count(500) == 1
    assert bins.codes("q", columns, (3,))[:, 0].tolist() == [[0, 0 if x != x else 1] for x in columns["x"].tolist()]


def test_a_place_of_many_cells_keeps_all_borders(spark):
    df = spark.createDataFrame(some_rows(2), SCHEMA)

    def nodes(cells):
        found = boost.fit_places(df, ["colour", "extra"], ["amount"], ModelConfig(rounds=10, min_leaf=10, max_cells=cells)).collect()
        return sorted(found, key=lambda r: (r["place"], r["part"], r["tree"] or 0, r["node"] or 0))

    few, many = nodes(20), nodes(50_000)
    assert len(few) == len(many) and sum(r["threshold"] is not None for r in few) > 20
    for a, b in zip(few, many, strict=True):
        assert all(a[c] == b[c] for c in a.asDict() if c != "values")
        assert np.allclose(a["values"], b["values"])


def test_cells_in_files_are_those_in_memory(monkeypatch):
    rng = np.random.default_rng(4)
    rows = sorted((rng.integers(0, m, 2).astype("<i4").tobytes(), "ab"[k % 2], bool(k % 7 == 0)) for k in range(900) for m in (9,))
    target = ["a" if np.frombuffer(b, "<i4")[0] > 4 else t for b, t, _ in rows]
    bins = boost.Binning([], ["x", "y"], {("p", c): np.arange(9.0) for c in "xy"}, {})

    def fitted(held, batch):
        monkeypatch.setattr(boost, "HELD_BYTES", held)
        found = boost.Gathered(["a", "b"], 2)
        for low in range(0, 900, batch):
            part = slice(low, low + batch)
            found.add([r[0] for r in rows[part]], target[part], np.array([r[2] for r in rows[part]]), np.ones(len(rows[part])))
        code, fit, hold = found.arrays()
        assert isinstance(fit, np.memmap) == (held < 1000) and fit.sum() + hold.sum() == 900
        assert [c.astype("<i4").tobytes() for c in code] == sorted({r[0] for r in rows})
        return boost.fit_place("p", ["a", "b"], code, fit, hold, bins, ModelConfig(rounds=5, min_leaf=5, max_cells=7))

    want = fitted(1 << 20, 900)
    assert len(want) > 10 and want.astype(str).equals(fitted(100, 11).astype(str))
