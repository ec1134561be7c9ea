"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.catalog import sql
from caseloom.catalog.registry import i64, joined, joined6, query, r6
from caseloom.operators.cases import prefix_rows, split_cases, window_size, with_split
from caseloom.sources.logs import micros, orders_log, table
from caseloom.sources.reader import (
    LogColumns,
    case_ids,
    clean_log,
    no_nan,
    read_csv_log,
    read_parquet_log,
    standardise,
    write_by_split,
)
from caseloom.session import scratch_path

ORDER_COLUMNS = LogColumns("o_custkey", "o_orderpriority", "o_orderdate", "yyyy/MM/dd HH:mm:ss.SSS", "o_orderstatus")
ORDER_CSV = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.StringType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("o_orderdate", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


@query(
    "csv_event_log",
    "A1",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE epoch_us(o_orderdate) END AS us,
         round(o_totalprice, 6) AS o_totalprice FROM orders""",
)
def csv_event_log(spark, sf_dir):
    path = scratch_path(spark, "orders_csv")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("not recorded")).otherwise(
        F.date_format("o_orderdate", ORDER_COLUMNS.pattern)
    )
    raw = table(spark, sf_dir, "orders").withColumn("o_orderdate", text)
    raw.select(*ORDER_CSV.names).write.csv(path, header=True)
    log = standardise(read_csv_log(spark, path, ORDER_CSV, ORDER_COLUMNS), LogColumns("o_custkey", "o_orderpriority", "o_orderdate"))
    return log.select("o_orderkey", "case_id", "activity", "us", r6("o_totalprice").alias("o_totalprice"))


@query(
    "standardised_log",
    "A2",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity, epoch_us(o_orderdate) AS us
       FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def standardised_log(spark, sf_dir):
    keep = case_ids(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")
    raw = read_parquet_log(spark, f"{sf_dir}/orders.parquet", ORDER_COLUMNS)
    return standardise(raw, ORDER_COLUMNS, keep).select("o_orderkey", "case_id", "activity", "us")


@query(
    "discovery_log",
    "A3",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity,
              epoch_us(o_orderdate) AS us, o_orderstatus AS resource FROM orders""",
)
def discovery_log(spark, sf_dir):
    raw = read_parquet_log(spark, f"{sf_dir}/orders.parquet", ORDER_COLUMNS)
    return standardise(raw, ORDER_COLUMNS).select("o_orderkey", "case_id", "activity", "us", "resource")


@query(
    "labelling_log",
    "A4",
    """SELECT CAST(o_custkey AS VARCHAR) AS case_id, count(*) AS events, min(epoch_us(o_orderdate)) AS first_us
       FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""",
)
def labelling_log(spark, sf_dir):
    keep = case_ids(table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")
    raw = no_nan(table(spark, sf_dir, "orders")).withColumn(
        "o_orderdate", F.date_format("o_orderdate", ORDER_COLUMNS.pattern)
    )
    log = standardise(raw, ORDER_COLUMNS, keep, parse=True)
    return log.groupBy("case_id").agg(F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"))


@query(
    "split_case_ids",
    "A5",
    f"WITH {sql.ORDERS}, {sql.SPLIT} SELECT case_id FROM split WHERE split = 'test'",
)
def split_case_ids(spark, sf_dir):
    splits = split_cases(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("case_id")))
    return case_ids(splits.where("split = 'test'"))


@query(
    "prefix_table_by_split",
    "A6",
    f"""WITH {sql.ORDERS}, {sql.SPLIT}, {sql.LISTS}, {sql.window()},
    prices AS (SELECT case_id, list(o_totalprice ORDER BY pos) AS p, arg_min(c_mktsegment, pos) FILTER (WHERE c_mktsegment IS NOT NULL) AS segment FROM log GROUP BY case_id)
    SELECT split, case_id, pos AS prefix_len, segment, {sql.arrow("acts[greatest(1, pos - w + 1):pos]")} AS activities,
    {sql.arrow6("p[greatest(1, pos - w + 1):pos]")} AS prices
    FROM log JOIN lists USING (case_id) JOIN prices USING (case_id) JOIN split USING (case_id), win""",
)
def prefix_table_by_split(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    log = with_split(log, split_cases(log.events))
    rows = prefix_rows(log, ["activity", "o_totalprice"], window_size(log, 5), ["c_mktsegment", "split"])
    back = spark.read.parquet(write_by_split(rows, scratch_path(spark, "prefixes")))
    return back.select(
        "split",
        "case_id",
        "prefix_len",
        F.col("c_mktsegment").alias("segment"),
        joined("activity").alias("activities"),
        joined6("o_totalprice").alias("prices"),
    )


@query(
    "cleaned_log",
    "A9",
    "SELECT o_orderkey, o_orderpriority AS activity FROM orders",
)
def cleaned_log(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat("o_orderpriority", F.lit(" by "), "o_orderstatus").alias("activity")
    )
    path = clean_log(raw, "activity", scratch_path(spark, "clean_orders"))
    return spark.read.parquet(path)
