"""Reasoning that is the same for many prefixes happens once, and rules are matched where the rows are."""

import datetime

import pytest
from pyspark.sql import functions as F

from caseloom.catalog import predict as queries
from caseloom.operators import guide


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Thirty cases of four orders; activities repeat, so many prefixes end alike."""
    path = str(tmp_path_factory.mktemp("orders"))
    day = datetime.datetime(2020, 1, 1)
    rows = [
        (c * 10 + k, c, "FOP"[(c + k) % 3], 100.0 * c + k, day + datetime.timedelta(days=k), "abc"[(c * k + k) % 3])
        for c in range(30)
        for k in range(4)
    ]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/orders.parquet")
    people = [(c, f"n{c}", c % 5, 1.0, "AB"[c % 2]) for c in range(30)]
    spark.createDataFrame(people, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(
        f"{path}/customer.parquet"
    )
    return path


def test_prefixes_of_one_end_are_explained_once(spark, orders, monkeypatch):
    seen = []
    real = guide.explain
    monkeypatch.setattr(queries, "explain", lambda steps, *rest: seen.append(steps.count()) or real(steps, *rest))
    steps = queries.guided_reasoning_steps(spark, orders)
    rows = queries.guided_decode_rows(spark, orders)
    total = steps.count()
    assert total == rows.agg(F.sum("decision_steps")).first()[0] > max(seen)
    assert rows.groupBy("case_id", "prefix_len").count().where("count > 1").count() == 0


def test_best_guard_is_found_where_the_rows_are(spark):
    none = "map<string,array<string>>"
    double = "map<string,struct<low:double,high:double>>"
    rules = spark.createDataFrame(
        [("p", "a", "r1", "r1", 1.0, 0.5, 3, 2.0), ("p", "a", "r2", "r2", None, 0.5, 3, 1.0), ("p", "b", "r3", "r3", None, 0.5, 3, None)],
        "place string, label string, rule string, raw_rule string, low double, prob_model double, support bigint, score double",
    )
    bound = F.struct(F.col("low").alias("low"), F.lit(None).cast("double").alias("high"))
    rules = rules.select(
        "place", "label", "rule", "raw_rule", "prob_model", "support", "score",
        F.when(F.col("low").isNull(), F.create_map().cast(double)).otherwise(F.create_map(F.lit("x"), bound).cast(double)).alias("intervals"),
        F.create_map().cast(none).alias("allowed"), F.create_map().cast(none).alias("excluded"),
    )
    rows = spark.createDataFrame(
        [(1, "p", "a", 2.0, False), (2, "p", "a", 0.5, False), (3, "p", "a", None, False), (4, "p", "b", 1.0, False), (5, "p", "c", 1.0, False), (6, "p", "a", 2.0, True)],
        "id int, place string, label string, x double, conflict boolean",
    )
    rows = rows.select("*", F.create_map(F.lit("x"), "x").alias("nums"), F.create_map().cast("map<string,string>").alias("cats"))
    best = {r["id"]: r["guard"]["rule"] for r in guide.best_guards(rows, rules, ["id"]).collect()}
    assert best == {1: "r1", 2: "r2", 3: "r2", 4: "r3", 6: "r1"}
    told = guide.explain(rows, rules, ["id"])
    assert {r["id"]: r["explanation_status"] for r in told.collect()} == {
        1: "explained", 2: "rule_unmatched", 3: "rule_unmatched", 4: "matched_trivial_rule", 5: "no_rule_for_branch", 6: "conflict_not_supported",
    }
    assert "to_json" not in told._jdf.queryExecution().executedPlan().toString()
