"""Encoders, scalers and profiles."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caseloom.catalog import sql
from caseloom.catalog.registry import i64, joined, joined6, query, r6
from caseloom.functions.text import base_feature, unscale, value_text
from caseloom.operators.cases import only_split, split_cases, window_size, with_split, add_end_rows
from caseloom.operators.encode import (
    apply_scalers,
    category_profile,
    class_count,
    clean_value,
    decode_column,
    encode_column,
    encoded_events,
    encoded_statics,
    encoded_windows,
    feature_encoder,
    numeric_profile,
    ready_features,
    scaler_values,
    scalers,
    unapply_scalers,
    vocabulary,
)
from caseloom.operators.features import since_case_start
from caseloom.operators.ordering import EventLog
from caseloom.session import small
from caseloom.sources.logs import events_log, orders_log

NUMS = ("o_totalprice", "case_elapsed_time")


def split_orders(spark, sf_dir) -> EventLog:
    """Orders with the derived time column and the split."""
    log = since_case_start(orders_log(spark, sf_dir))
    return with_split(log, split_cases(log.events))


TIMED = f"""WITH {sql.ORDERS}, {sql.SPLIT}, timed AS (SELECT log.*, split,
    (us - min(us) OVER (PARTITION BY case_id)) / 1e6 AS case_elapsed_time FROM log JOIN split USING (case_id))"""
SCALER = """scaler AS (
  SELECT 'o_totalprice' AS col, avg(o_totalprice) AS mean, sqrt(var_pop(o_totalprice) * count(o_totalprice) / (count(*) + 5 * count(DISTINCT case_id))) AS spread FROM timed WHERE split = 'train'
  UNION ALL SELECT 'case_elapsed_time', avg(case_elapsed_time), sqrt(var_pop(case_elapsed_time) * count(case_elapsed_time) / (count(*) + 5 * count(DISTINCT case_id))) FROM timed WHERE split = 'train'),
 fitted AS (SELECT col, mean, CASE WHEN spread = 0 THEN 1 ELSE spread END AS scale FROM scaler)"""
VOCAB = """vocab AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (
  SELECT DISTINCT activity AS label FROM timed WHERE split = 'train' UNION SELECT 'EOS')),
 status AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (
  SELECT DISTINCT o_orderstatus AS label FROM timed WHERE split = 'train' AND o_orderstatus <> 'P' UNION SELECT 'EOS'))"""


@query(
    "category_ids",
    "E1",
    f"""{TIMED}, {VOCAB} SELECT case_id, pos, coalesce(v.id, 0) AS activity_id, coalesce(s.id, 0) AS status_id
    FROM timed LEFT JOIN vocab v ON v.label = activity LEFT JOIN status s ON s.label = o_orderstatus""",
)
def category_ids(spark, sf_dir):
    log = split_orders(spark, sf_dir)
    train = add_end_rows(only_split(log, "train"), 5).events
    seen = train.where(~F.col("o_orderstatus").eqNullSafe("P"))
    coded = encode_column(log.events, "activity", vocabulary(train, "activity"), "activity_id")
    coded = encode_column(coded, "o_orderstatus", vocabulary(seen, "o_orderstatus"), "status_id")
    return coded.select("case_id", "pos", i64("activity_id").alias("activity_id"), i64("status_id").alias("status_id"))


@query(
    "category_vocabulary",
    "E1",
    f"""WITH {sql.ORDERS}, seg AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS label FROM log)
    SELECT label, row_number() OVER (ORDER BY label) AS id, (SELECT count(DISTINCT label) + max(CASE WHEN label IS NULL THEN 1 ELSE 0 END) + 1 FROM seg) AS classes
    FROM (SELECT DISTINCT label FROM seg WHERE label IS NOT NULL)""",
)
def category_vocabulary(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    df = log.events.select(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    classes = class_count(df, "segment").select("col", "classes")
    out = vocabulary(df, "segment").join(small(classes), "col")
    return out.select("label", i64("id").alias("id"), i64("classes").alias("classes"))


@query(
    "numeric_scalers",
    "E2",
    f"{TIMED}, {SCALER} SELECT col, round(mean, 4) AS mean, round(scale, 4) AS scale FROM fitted",
)
def numeric_scalers(spark, sf_dir):
    train = only_split(split_orders(spark, sf_dir), "train")
    return scalers(train.events, NUMS, end_rows=5).select(
        "col", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale")
    )


@query(
    "encoded_case_rows",
    "E3",
    f"""{TIMED}, {SCALER}, {VOCAB} SELECT case_id, pos, coalesce(v.id, 0) AS activity, 0 AS workgroup,
    round((o_totalprice - mean) / scale, 6) AS o_totalprice FROM timed LEFT JOIN vocab v ON v.label = activity, fitted WHERE col = 'o_totalprice' AND split = 'test'""",
)
def encoded_case_rows(spark, sf_dir):
    log = split_orders(spark, sf_dir)
    train = only_split(log, "train")
    vocab = vocabulary(add_end_rows(train, 5).events, "activity")
    fitted = scaler_values(scalers(train.events, ["o_totalprice"], end_rows=5))
    coded = encoded_events(only_split(log, "test"), ["activity", "workgroup"], ["o_totalprice"], vocab, fitted).events
    return coded.select(
        "case_id", "pos", i64("activity").alias("activity"), i64("workgroup").alias("workgroup"), r6("o_totalprice").alias("o_totalprice")
    )


@query(
    "encoded_window_rows",
    "D11 E1 E2",
    f"""{TIMED}, {SCALER}, {VOCAB}, train_win AS (SELECT CAST(round_even(quantile_cont(n + 5, 0.985), 0) AS BIGINT) + 5 AS w FROM timed WHERE pos = 1 AND split = 'train'),
    coded AS (SELECT case_id, pos, n, coalesce(id, 0) AS a, (coalesce(o_totalprice, mean) - mean) / scale AS p FROM timed LEFT JOIN vocab v ON v.label = activity, fitted
       WHERE col = 'o_totalprice' AND split = 'test'),
    ends AS (SELECT case_id, n + k AS pos, n, (SELECT id FROM vocab WHERE label = 'EOS') AS a, 0.0 AS p FROM coded, unnest(range(1, 6)) AS t(k) WHERE pos = n),
    full_rows AS (SELECT case_id, list(a ORDER BY pos) AS a, list(p ORDER BY pos) AS p FROM (SELECT * FROM coded UNION ALL SELECT * FROM ends) GROUP BY case_id),
    cut AS (SELECT case_id, CAST(k AS BIGINT) AS prefix_len, w, a[greatest(1, k - w + 1):k] AS a, p[greatest(1, k - w + 1):k] AS p FROM full_rows, train_win, unnest(range(6, len(a) + 1)) AS t(k))
    SELECT case_id, prefix_len, array_to_string(list_transform(list_concat(list_transform(range(w - len(a)), lambda i: 0::BIGINT), a), lambda v: CAST(v AS VARCHAR)), '>') AS activity,
      array_to_string(list_transform(list_concat(list_transform(range(w - len(p)), lambda i: 0::DOUBLE), p), lambda v: CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR)), '>') AS o_totalprice FROM cut""",
)
def encoded_window_rows(spark, sf_dir):
    log = split_orders(spark, sf_dir)
    train = only_split(log, "train")
    vocab = vocabulary(add_end_rows(train, 5).events, "activity")
    fitted = scaler_values(scalers(train.events, ["o_totalprice"], end_rows=5))
    rows = encoded_windows(
        only_split(log, "test"), ["activity"], ["o_totalprice"], vocab, fitted, window_size(train, 5), 5
    )
    return rows.select(
        "case_id", "prefix_len", F.array_join("activity", ">").alias("activity"), joined6("o_totalprice").alias("o_totalprice")
    )


@query(
    "encoded_static_values",
    "E4",
    f"""{TIMED}, nations AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT DISTINCT c_mktsegment AS label FROM timed WHERE split = 'train' AND c_mktsegment IS NOT NULL)),
    statics AS (SELECT case_id, arg_min(c_mktsegment, pos) AS seg, arg_min(c_acctbal, pos) AS bal, any_value(split) AS split FROM timed GROUP BY case_id),
    s AS (SELECT avg(c_acctbal) AS mean, sqrt(var_pop(c_acctbal) * count(c_acctbal) / (count(*) + 5 * count(DISTINCT case_id))) AS scale FROM timed WHERE split = 'train')
    SELECT case_id, pos AS prefix_len, coalesce(id, 0) AS c_mktsegment, round((coalesce(bal, mean) - mean) / scale, 6) AS c_acctbal
    FROM timed JOIN statics USING (case_id) LEFT JOIN nations ON label = seg, s WHERE timed.split = 'test'""",
)
def encoded_static_values(spark, sf_dir):
    log = split_orders(spark, sf_dir)
    train, test = only_split(log, "train"), only_split(log, "test")
    vocab = vocabulary(train.events, "c_mktsegment", drop_eos=True)
    fitted = scaler_values(scalers(train.events, ["c_acctbal"], end_rows=5))
    statics = encoded_statics(test, ["c_mktsegment"], ["c_acctbal"], vocab, fitted)
    rows = test.events.select("case_id", F.col("pos").alias("prefix_len")).join(statics, "case_id")
    return rows.select("case_id", "prefix_len", i64("c_mktsegment").alias("c_mktsegment"), r6("c_acctbal").alias("c_acctbal"))


@query(
    "decoded_rows",
    "E5",
    f"""{TIMED} SELECT case_id, pos, activity, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM timed""",
)
def decoded_rows(spark, sf_dir):
    log = split_orders(spark, sf_dir)
    train = only_split(log, "train").events
    fitted = scaler_values(scalers(train, ["o_totalprice"], end_rows=5))
    vocab = vocabulary(train, "activity").unionByName(
        vocabulary(train.where("o_orderstatus <> 'P'"), "o_orderstatus")
    )
    coded = encoded_events(log, ["activity", "o_orderstatus"], ["o_totalprice"], vocab, fitted).events
    back = decode_column(decode_column(coded, "activity", vocab), "o_orderstatus", vocab)
    return unapply_scalers(back, fitted).select(
        "case_id", "pos", "activity", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice")
    )


@query(
    "scaled_numbers",
    "E6",
    f"""{TIMED}, {SCALER} SELECT case_id, pos, round((CASE WHEN pos % 4 = 0 THEN NULL ELSE o_totalprice END - p.mean) / p.scale, 6) AS o_totalprice,
    round((case_elapsed_time - t.mean) / t.scale, 6) AS case_elapsed_time
    FROM timed, fitted p, fitted t WHERE p.col = 'o_totalprice' AND t.col = 'case_elapsed_time'""",
)
def scaled_numbers(spark, sf_dir):
    log = split_orders(spark, sf_dir)
    fitted = scaler_values(scalers(only_split(log, "train").events, NUMS, end_rows=5))
    gaps = log.events.withColumn("o_totalprice", F.when(F.col("pos") % 4 != 0, F.col("o_totalprice")))
    return apply_scalers(gaps, fitted).select(
        "case_id", "pos", r6("o_totalprice").alias("o_totalprice"), r6("case_elapsed_time").alias("case_elapsed_time")
    )


DISPLAY = """display AS (SELECT case_id, pos, unnest(['o_totalprice', 'o_totalprice_past_avg', 'case_elapsed_time_past_avg', 'day_in_week']) AS feature,
    unnest([pos / 7.0, pos / -11.0, pos / 13.0, pos * 1.0]) AS x FROM timed)"""


def display_values(spark, sf_dir):
    log = split_orders(spark, sf_dir)
    table = scalers(only_split(log, "train").events, NUMS, end_rows=5)
    pos = F.col("pos").cast("double")
    kinds = {
        "o_totalprice": pos / 7,
        "o_totalprice_past_avg": pos / -11,
        "case_elapsed_time_past_avg": pos / 13,
        "day_in_week": pos,
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("x")) for k, v in kinds.items()])
    long = log.events.select("case_id", "pos", F.inline(pairs)).withColumn("col", base_feature(F.col("feature")))
    return long.join(small(table), "col", "left")


@query(
    "unscaled_for_display",
    "E7",
    f"""{TIMED}, {SCALER}, {DISPLAY} SELECT case_id, pos, feature, round(coalesce(x * scale + mean, x), 4) AS shown
    FROM display LEFT JOIN fitted ON col = regexp_replace(feature, '(_past_avg|_past_mode)$', '')""",
)
def unscaled_for_display(spark, sf_dir):
    df = display_values(spark, sf_dir)
    return df.select("case_id", "pos", "feature", F.round(unscale(F.col("x"), F.col("mean"), F.col("scale")), 4).alias("shown"))


@query(
    "displayed_values",
    "E8",
    f"""{TIMED}, {SCALER}, {DISPLAY}, raw AS (SELECT case_id, pos, feature, coalesce(x * scale + mean, x) AS v FROM display LEFT JOIN fitted ON col = regexp_replace(feature, '(_past_avg|_past_mode)$', '')),
    shown AS (SELECT case_id, pos, feature, CASE WHEN feature LIKE '%time%' THEN
       CASE WHEN abs(v) >= 86400 THEN printf('%s%.2f days', CASE WHEN v < 0 THEN '-' ELSE '' END, abs(v) / 86400)
       WHEN abs(v) >= 3600 THEN printf('%s%.2f hours', CASE WHEN v < 0 THEN '-' ELSE '' END, abs(v) / 3600) ELSE 'short' END
      WHEN v = floor(v) THEN format('{{:,}}', CAST(v AS BIGINT))
      ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || format('{{:,}}', CAST(floor(round(abs(v), 2)) AS BIGINT)) || substr(printf('%.2f', round(abs(v), 2) - floor(round(abs(v), 2))), 2) END AS shown FROM raw)
    SELECT case_id, pos, feature, shown FROM shown UNION ALL SELECT case_id, pos, 'o_orderstatus', o_orderstatus FROM timed UNION ALL SELECT case_id, pos, 'workgroup', 'None' FROM timed""",
)
def displayed_values(spark, sf_dir):
    none = F.lit(None)
    df = display_values(spark, sf_dir)
    text = value_text(F.col("feature"), none.cast("string"), F.col("x"), F.col("mean"), F.col("scale"))
    numbers = df.select("case_id", "pos", "feature", text.alias("shown"))
    log = split_orders(spark, sf_dir)
    no_number = none.cast("double")
    pairs = F.array(
        F.struct(F.lit("o_orderstatus").alias("feature"), F.col("o_orderstatus").alias("text")),
        F.struct(F.lit("workgroup").alias("feature"), none.cast("string").alias("text")),
    )
    texts = log.events.select("case_id", "pos", F.inline(pairs)).select(
        "case_id", "pos", "feature", value_text(F.col("feature"), F.col("text"), no_number, no_number, no_number).alias("shown")
    )
    return numbers.unionByName(texts)


@query(
    "numeric_feature_profile",
    "E9",
    f"""WITH {sql.EVENTS} SELECT 'value' AS col, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM log
    UNION ALL SELECT 'k', round(min(k), 6), round(max(k), 6), round(avg(k), 6), round(stddev_samp(k), 6) FROM log
    UNION ALL SELECT 'absent', 0, 0, 0, 0""",
)
def numeric_feature_profile(spark, sf_dir):
    df = events_log(spark, sf_dir).events.withColumn("absent", F.lit(None).cast("double"))
    out = numeric_profile(df, ["value", "k", "absent"])
    return out.select("col", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")])


@query(
    "category_feature_profile",
    "E9",
    f"""WITH {sql.ORDERS} SELECT DISTINCT 'activity' AS col, activity AS label FROM log UNION SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM log
    UNION SELECT DISTINCT 'c_nationkey', c_nationkey FROM log WHERE c_nationkey IS NOT NULL""",
)
def category_feature_profile(spark, sf_dir):
    return category_profile(orders_log(spark, sf_dir).events, ["activity", "o_orderstatus", "c_nationkey"])


@query("one_hot_features", "E10")
def one_hot_features(spark, sf_dir):
    log = split_orders(spark, sf_dir)
    cats, nums = ["o_orderstatus", "c_mktsegment"], ["o_totalprice"]
    patchy = log.events.withColumn("c_mktsegment", F.when(F.col("pos") % 3 != 0, F.col("c_mktsegment")))
    ready = ready_features(patchy, cats, nums)
    model = feature_encoder(cats, nums).fit(ready.where("split = 'train'"))
    arr = vector_to_array("features")
    return model.transform(ready).select(
        "case_id", "pos", F.size(arr).alias("width"), r6(F.aggregate(F.slice(arr, 1, F.size(arr) - 1), F.lit(0.0), lambda a, x: a + x)).alias("ones")
    )


@query(
    "clean_feature_values",
    "E11",
    """SELECT o_orderkey, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer FROM orders""",
)
def clean_feature_values(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", clean_value(F.col("o_orderstatus")).alias("status"), clean_value(F.col("o_custkey")).alias("customer")
    )
