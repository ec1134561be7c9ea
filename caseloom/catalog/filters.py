"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.catalog import sql
from caseloom.catalog.registry import joined, query, r6
from caseloom.functions.text import category_token, strip_by_suffix
from caseloom.operators.cases import (
    choose_prefixes,
    prefix_rows,
    prefix_suffix_pairs,
    report_filter,
    split_cases,
    supervised_prefixes,
    window_rows,
    window_size,
)
from caseloom.sources.logs import orders_log, table
from caseloom.sources.reader import pick_attributes, require_columns

ROLE_LABEL_SQL = """CASE WHEN o_orderstatus = 'F' THEN '[' || o_orderpriority || ' by ' || o_orderstatus || ' team] closed'
   WHEN o_orderstatus = 'O' THEN o_orderpriority || ' by ' || o_orderstatus || ' team'
   WHEN o_totalprice > 200000 THEN 'EOS' END"""


@query(
    "clean_activity_labels",
    "B1",
    f"""SELECT o_orderkey, CASE WHEN label = 'EOS' THEN label ELSE
         regexp_replace(regexp_replace(label, '\\s+by\\s+[^\\]]+\\]', ']', 'g'), '\\s+by\\s+.*$', '') END AS activity
       FROM (SELECT o_orderkey, {ROLE_LABEL_SQL} AS label FROM orders)""",
)
def clean_activity_labels(spark, sf_dir):
    label = (
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("["), "o_orderpriority", F.lit(" by "), "o_orderstatus", F.lit(" team] closed")),
        )
        .when(F.col("o_orderstatus") == "O", F.concat("o_orderpriority", F.lit(" by "), "o_orderstatus", F.lit(" team")))
        .when(F.col("o_totalprice") > 200000, F.lit("EOS"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", strip_by_suffix(label).alias("activity"))


@query(
    "category_tokens",
    "B2",
    """WITH doubles AS (SELECT 'quantity' AS col, l_quantity AS x FROM lineitem UNION ALL
         SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'large', l_extendedprice * 1000 + 0.5 FROM lineitem),
       tokens AS (SELECT col, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS token FROM doubles
         UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR) FROM lineitem
         UNION ALL SELECT 'heavy', CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END FROM lineitem)
       SELECT col, token, count(*) AS n FROM tokens GROUP BY ALL""",
)
def category_tokens(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    shape = [
        ("quantity", F.col("l_quantity"), T.DoubleType()),
        ("discount", F.col("l_discount"), T.DoubleType()),
        ("large", F.col("l_extendedprice") * 1000 + 0.5, T.DoubleType()),
        ("line", F.col("l_linenumber"), T.IntegerType()),
        ("heavy", F.col("l_quantity") > 25, T.BooleanType()),
    ]
    pairs = F.array(
        *[F.struct(F.lit(name).alias("col"), category_token(value, kind).alias("token")) for name, value, kind in shape]
    )
    return items.select(F.inline(pairs)).groupBy("col", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "picked_attributes",
    "B3",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
              round(o_totalprice, 6) AS o_totalprice, CAST(NULL AS VARCHAR) AS workgroup FROM orders""",
)
def picked_attributes(spark, sf_dir):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "workgroup"]
    return pick_attributes(table(spark, sf_dir, "orders"), names, keys=()).withColumn("o_totalprice", r6("o_totalprice"))


@query(
    "chosen_prefixes",
    "B4",
    f"""WITH {sql.ORDERS}, {sql.SPLIT}, {sql.LISTS}, {sql.window()}
    SELECT case_id, pos AS prefix_len, {sql.arrow("acts[greatest(1, pos - w + 1):pos]")} AS activities
    FROM log JOIN lists USING (case_id), win
    WHERE pos = n AND case_id IN (SELECT case_id FROM split WHERE split = 'test')""",
)
def chosen_prefixes(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    test = split_cases(log.events).where("split = 'test'")
    chosen = log.events.where("pos = n").select("case_id", F.col("pos").alias("prefix_len"))
    chosen = chosen.join(test, "case_id", "left_semi")
    rows = choose_prefixes(prefix_rows(log, ["activity"], window_size(log, 5)), chosen)
    return rows.select("case_id", "prefix_len", joined("activity").alias("activities"))


@query(
    "scorer_projection",
    "B5",
    f"""WITH {sql.ORDERS} SELECT case_id, pos, activity, o_orderstatus FROM log""",
)
def scorer_projection(spark, sf_dir):
    return require_columns(orders_log(spark, sf_dir).events, ["case_id", "pos", "activity", "o_orderstatus"])


@query(
    "next_event_supervision",
    "B6",
    f"""WITH {sql.ORDERS}, {sql.LISTS}, {sql.window()},
    ended AS (SELECT case_id, list_concat(acts, ['EOS','EOS','EOS','EOS','EOS']) AS acts FROM lists),
    rows AS (SELECT case_id, CAST(k AS BIGINT) AS prefix_len, acts[greatest(1, k - w + 1):k] AS win
             FROM ended, win, unnest(range(6, len(acts) + 1)) AS t(k))
    SELECT case_id, prefix_len, {sql.arrow("win")} AS activities FROM rows
    WHERE len(list_filter(win, lambda x: x = 'EOS')) <= 2""",
)
def next_event_supervision(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    rows = supervised_prefixes(window_rows(log, ["activity"], window_size(log, 5), 5))
    return rows.select("case_id", "prefix_len", joined("activity").alias("activities"))


@query(
    "supported_prefix_lengths",
    "B7",
    f"""WITH {sql.ORDERS}, {sql.window()}, {sql.complete()}
    SELECT prefix_len, count(*) AS support FROM pairs WHERE prefix_len <= 12 GROUP BY 1 HAVING count(*) >= 30""",
)
def supported_prefix_lengths(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    pairs = prefix_suffix_pairs(log, window_size(log, 5), 5)
    return report_filter(pairs, 12, 30).select(F.col("prefix_len").cast("bigint").alias("prefix_len"), "support")
