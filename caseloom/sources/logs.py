"""The event logs defined over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.ordering import EventLog, around, sequence_log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def orders_rows(spark: SparkSession, sf_dir: str, statics: bool = True) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("case_id"),
        F.col("o_custkey"),
        F.col("o_orderpriority").alias("activity"),
        micros("o_orderdate").alias("us"),
        F.col("o_orderkey").alias("tie"),
        "o_orderstatus",
        "o_totalprice",
    )
    if not statics:
        return orders.drop("o_custkey")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_acctbal"
    )
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").drop("o_custkey", "c_custkey")


def orders_log(spark: SparkSession, sf_dir: str) -> EventLog:
    return sequence_log(
        orders_rows(spark, sf_dir),
        ["us", "tie"],
        dyn_cat=["o_orderstatus"],
        dyn_num=["o_totalprice"],
        sta_cat=["c_mktsegment", "c_nationkey"],
        sta_num=["c_acctbal"],
    )


def orders_flow(spark: SparkSession, sf_dir: str) -> EventLog:
    """The order log without customer attributes: one scan, no join."""
    return sequence_log(
        orders_rows(spark, sf_dir, statics=False), ["us", "tie"], dyn_cat=["o_orderstatus"], dyn_num=["o_totalprice"]
    )


def events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("activity"),
        micros("ts").alias("us"),
        F.col("event_id").alias("tie"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> EventLog:
    return sequence_log(events_rows(spark, sf_dir), ["us", "tie"], dyn_num=["value", "k"])


def turns_log(spark: SparkSession, sf_dir: str) -> EventLog:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("case_id"),
        F.col("role").alias("activity"),
        F.lit(None).cast("long").alias("us"),
        F.col("turn").alias("tie"),
        F.length("text").cast("double").alias("chars"),
    )
    return sequence_log(rows, ["tie"], dyn_num=["chars"])


ITEM_ORDER = (
    "us", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "activity",
)


def items_log(spark: SparkSession, sf_dir: str) -> EventLog:
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        "l_orderkey",
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("activity"),
        micros("l_shipdate").alias("us"),
        *ITEM_ORDER[1:-1],
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey, "left").drop("l_orderkey", "o_orderkey")
    return sequence_log(
        rows,
        ITEM_ORDER,
        dyn_num=["l_quantity", "l_extendedprice"],
        sta_cat=["o_orderpriority", "o_orderstatus"],
    )


PLANTED_AMOUNT = 250000.0


def planted_log(spark: SparkSession, sf_dir: str) -> EventLog:
    """Orders whose next activity is fixed by the amount of the previous event."""

    def relabel(df: DataFrame, w) -> DataFrame:
        previous = F.lag("o_totalprice").over(w)
        return df.withColumn(
            "activity",
            F.when(F.col("pos") == 1, "OPEN").when(previous > PLANTED_AMOUNT, "REVIEW").otherwise("APPROVE"),
        )

    return around(orders_log(spark, sf_dir), relabel, before=1)
