"""Time features and their text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import sql
from caseloom.catalog.registry import i64, query, r6
from caseloom.functions.text import duration_text, number_text
from caseloom.operators.features import (
    day_in_week,
    longest_case,
    seconds_in_day,
    since_case_start,
    since_earlier_event,
    since_last_row,
)
from caseloom.sources.logs import events_log, items_log, orders_flow, orders_log, table

START_SQL = "round((us - min(us) OVER (PARTITION BY case_id)) / 1e6, 6)"
EARLIER_SQL = """round((us - max(us) OVER (PARTITION BY case_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6, 6)"""


@query("seconds_since_case_start", "C1 C5", f"WITH {sql.ORDERS} SELECT case_id, pos, {START_SQL} AS case_elapsed_time FROM log")
def seconds_since_case_start(spark, sf_dir):
    df = since_case_start(orders_flow(spark, sf_dir)).events
    return df.select("case_id", "pos", r6("case_elapsed_time").alias("case_elapsed_time"))


@query(
    "item_seconds_since_case_start",
    "C1",
    f"WITH {sql.ITEMS} SELECT case_id, pos, {START_SQL} AS case_elapsed_time FROM log",
)
def item_seconds_since_case_start(spark, sf_dir):
    df = since_case_start(items_log(spark, sf_dir)).events
    return df.select("case_id", "pos", r6("case_elapsed_time").alias("case_elapsed_time"))


@query(
    "longest_case",
    "C2",
    f"WITH {sql.EVENTS} SELECT max(c) AS max_case_length FROM (SELECT count(*) AS c FROM log GROUP BY case_id)",
)
def longest(spark, sf_dir):
    return longest_case(events_log(spark, sf_dir))


@query(
    "seconds_since_earlier_event",
    "C3",
    f"WITH {sql.ORDERS} SELECT case_id, pos, {EARLIER_SQL} AS event_elapsed_time FROM log",
)
def seconds_since_earlier_event(spark, sf_dir):
    df = since_earlier_event(orders_flow(spark, sf_dir)).events
    return df.select("case_id", "pos", r6("event_elapsed_time").alias("event_elapsed_time"))


@query(
    "item_seconds_since_earlier_event",
    "C3",
    f"WITH {sql.ITEMS} SELECT case_id, pos, {EARLIER_SQL} AS event_elapsed_time FROM log",
)
def item_seconds_since_earlier_event(spark, sf_dir):
    df = since_earlier_event(items_log(spark, sf_dir)).events
    return df.select("case_id", "pos", r6("event_elapsed_time").alias("event_elapsed_time"))


@query(
    "seconds_since_last_row",
    "C4",
    f"""WITH {sql.EVENTS} SELECT case_id, pos,
    round(coalesce((us - lag(us) OVER (PARTITION BY case_id ORDER BY us, tie)) / 1e6, 0), 6) AS event_elapsed_time FROM log""",
)
def seconds_since_last_row(spark, sf_dir):
    df = since_last_row(events_log(spark, sf_dir)).events
    return df.select("case_id", "pos", r6("event_elapsed_time").alias("event_elapsed_time"))


@query(
    "calendar_features",
    "C6 C7",
    f"""WITH {sql.EVENTS} SELECT case_id, pos, isodow(ts) - 1 AS day_in_week,
    hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS seconds_in_day FROM log""",
)
def calendar_features(spark, sf_dir):
    return events_log(spark, sf_dir).events.select(
        "case_id", "pos", i64(day_in_week()).alias("day_in_week"), i64(seconds_in_day()).alias("seconds_in_day")
    )


@query(
    "duration_texts",
    "C8",
    f"""WITH {sql.EVENTS}, gaps AS (SELECT case_id, pos, (us - lag(us, 1, us) OVER (PARTITION BY case_id ORDER BY us, tie)) / 1e6 AS gap FROM log),
    s AS (SELECT case_id, pos, unnest([gap, gap / 97, gap / 5003, -gap, -gap / 1000000]) AS x,
          unnest(['gap', 'minutes', 'seconds', 'negative', 'tiny']) AS kind FROM gaps),
    c AS (SELECT case_id, pos, kind, CASE WHEN x > -1 AND x < 0 THEN 0.0 ELSE x END AS x FROM s)
    SELECT case_id, pos, kind, CASE WHEN abs(x) >= 86400 THEN printf('%s%.2f days', CASE WHEN x < 0 THEN '-' ELSE '' END, abs(x) / 86400)
      WHEN abs(x) >= 3600 THEN printf('%s%.2f hours', CASE WHEN x < 0 THEN '-' ELSE '' END, abs(x) / 3600)
      WHEN abs(x) >= 60 THEN printf('%s%.2f minutes', CASE WHEN x < 0 THEN '-' ELSE '' END, abs(x) / 60)
      ELSE printf('%s%.2f seconds', CASE WHEN x < 0 THEN '-' ELSE '' END, abs(x)) END AS shown FROM c""",
)
def duration_texts(spark, sf_dir):
    df = since_last_row(events_log(spark, sf_dir), "gap").events
    gap = F.col("gap")
    kinds = {"gap": gap, "minutes": gap / 97, "seconds": gap / 5003, "negative": -gap, "tiny": -gap / 1000000}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("x")) for k, v in kinds.items()])
    return df.select("case_id", "pos", F.inline(pairs)).select(
        "case_id", "pos", "kind", duration_text(F.col("x")).alias("shown")
    )


@query(
    "number_texts",
    "C9",
    """WITH s AS (SELECT l_orderkey, l_linenumber, unnest([l_extendedprice, l_quantity, l_extendedprice * 1e6, l_discount * 1e-5, -l_extendedprice]) AS x,
       unnest(['price', 'quantity', 'huge', 'tiny', 'negative']) AS kind FROM lineitem)
    SELECT kind, shown, count(*) AS n FROM (SELECT kind, CASE WHEN x <> 0 AND (abs(x) >= 1e9 OR abs(x) < 1e-4) THEN printf('%.4g', x)
      WHEN x = floor(x) THEN format('{:,}', CAST(x AS BIGINT))
      ELSE CASE WHEN x < 0 THEN '-' ELSE '' END || format('{:,}', CAST(floor(round(abs(x), 2)) AS BIGINT)) ||
           substr(printf('%.2f', round(abs(x), 2) - floor(round(abs(x), 2))), 2) END AS shown FROM s) GROUP BY ALL""",
)
def number_texts(spark, sf_dir):
    price, quantity, discount = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount")
    kinds = {"price": price, "quantity": quantity, "huge": price * 1e6, "tiny": discount * 1e-5, "negative": -price}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("x")) for k, v in kinds.items()])
    shown = table(spark, sf_dir, "lineitem").select(F.inline(pairs)).select("kind", number_text(F.col("x")).alias("shown"))
    return shown.groupBy("kind", "shown").agg(F.count(F.lit(1)).alias("n"))
