"""Cases, prefixes, suffixes, windows and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import sql
from caseloom.catalog.registry import i64, joined, joined6, query, r6
from caseloom.functions.arrays import (
    both_masks,
    eos_mask,
    last_items,
    pad_left,
    prefix_part,
    suffix_part,
    total,
    visible,
    zero_mask,
)
from caseloom.operators.cases import (
    add_end_rows,
    case_rows,
    last_rows,
    next_event_rows,
    prefix_rows,
    prefix_suffix_pairs,
    split_cases,
    static_values,
    window_rows,
    window_size,
    with_split,
)
from caseloom.operators.encode import encode_column, vocabulary
from caseloom.operators.ordering import EventLog
from caseloom.session import BLOCK_DEFAULT
from caseloom.sources.logs import events_log, items_log, orders_flow, orders_log, turns_log

#: a case's rows are segments of at most one block of events
SEGMENT = f"CAST((pos - 1) // {BLOCK_DEFAULT} AS BIGINT)"
ENDED = """ended AS (SELECT case_id, list_concat(acts, ['EOS','EOS','EOS','EOS','EOS']) AS acts FROM lists)"""
# Windows of labels: 6..n+5 of the case with end rows, left padded with null to w.
WINDOWS = f"""{ENDED},
 windows AS (SELECT case_id, CAST(k AS BIGINT) AS prefix_len, w,
   list_concat(list_transform(range(CAST(greatest(w - k, 0) AS BIGINT)), lambda i: CAST(NULL AS VARCHAR)), acts[greatest(1, k - w + 1):k]) AS win
   FROM ended, win, unnest(range(6, len(acts) + 1)) AS t(k))"""
VOCAB = """vocab AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (
   SELECT DISTINCT activity AS label FROM log UNION SELECT 'EOS'))"""


def coded_windows(spark, sf_dir):
    """Windows of activity ids over the order log, with their label form."""
    log = orders_flow(spark, sf_dir)
    window = window_size(log, 5)
    ended = add_end_rows(log, 5)
    vocab = vocabulary(ended.events, "activity")
    coded = encode_column(ended.events, "activity", vocab, "activity_id")
    rows = prefix_rows(ended.with_events(coded), ["activity", "activity_id"], window)
    rows = rows.where(F.col("prefix_len") > 5)
    rows = rows.withColumn("ids", pad_left(F.col("activity_id"), window, F.lit(0)))
    rows = rows.withColumn("labels", pad_left(F.col("activity"), window, F.lit(None).cast("string")))
    return rows, window


@query(
    "case_table",
    "D1",
    f"""WITH {sql.ORDERS} SELECT case_id, {SEGMENT} AS segment, {sql.arrow("list(activity ORDER BY pos)")} AS activities,
    {sql.arrow("list(o_orderstatus ORDER BY pos)")} AS statuses, {sql.arrow6("list(o_totalprice ORDER BY pos)")} AS prices
    FROM log GROUP BY ALL""",
)
def case_table(spark, sf_dir):
    rows = case_rows(orders_flow(spark, sf_dir), ["activity", "o_orderstatus", "o_totalprice"])
    return rows.select(
        "case_id",
        "segment",
        joined("activity").alias("activities"),
        joined("o_orderstatus").alias("statuses"),
        joined6("o_totalprice").alias("prices"),
    )


@query(
    "turn_case_table",
    "D1",
    f"""WITH {sql.TURNS} SELECT case_id, {SEGMENT} AS segment, {sql.arrow("list(activity ORDER BY pos)")} AS activities,
    {sql.arrow6("list(chars ORDER BY pos)")} AS chars FROM log GROUP BY ALL""",
)
def turn_case_table(spark, sf_dir):
    rows = case_rows(turns_log(spark, sf_dir), ["activity", "chars"])
    return rows.select("case_id", "segment", joined("activity").alias("activities"), joined6("chars").alias("chars"))


@query(
    "static_case_values",
    "D2",
    f"""WITH {sql.ORDERS}, marked AS (SELECT *, CASE WHEN pos % 3 = 1 THEN NULL WHEN pos % 3 = 2 THEN 'EOS' ELSE c_mktsegment END AS patchy FROM log)
    SELECT case_id, arg_min(patchy, pos) FILTER (WHERE patchy IS NOT NULL AND patchy <> 'EOS') AS ignoring_end,
      arg_min(patchy, pos) FILTER (WHERE patchy IS NOT NULL) AS keeping_end,
      round(arg_min(c_acctbal, pos) FILTER (WHERE c_acctbal IS NOT NULL), 6) AS balance FROM marked GROUP BY case_id""",
)
def static_case_values(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    patchy = F.when(F.col("pos") % 3 == 1, F.lit(None)).when(F.col("pos") % 3 == 2, "EOS").otherwise(F.col("c_mktsegment"))
    log = log.with_events(log.events.withColumn("patchy", patchy))
    first = static_values(log, ["patchy", "c_acctbal"])
    kept = static_values(log, ["patchy"], keep_eos=True).withColumnRenamed("patchy", "keeping_end")
    return first.join(kept, "case_id").select(
        "case_id", F.col("patchy").alias("ignoring_end"), "keeping_end", r6("c_acctbal").alias("balance")
    )


@query(
    "end_rows",
    "D3",
    f"""WITH {sql.ORDERS}, ends AS (SELECT case_id, n + k AS pos, 'EOS' AS activity, 'EOS' AS o_orderstatus, NULL AS c_mktsegment, NULL AS o_totalprice
      FROM log, unnest(range(1, 6)) AS t(k) WHERE pos = n)
    SELECT case_id, pos, activity, o_orderstatus, c_mktsegment, round(o_totalprice, 6) AS o_totalprice FROM log
    UNION ALL SELECT case_id, pos, activity, o_orderstatus, c_mktsegment, o_totalprice FROM ends""",
)
def end_rows(spark, sf_dir):
    ended = add_end_rows(orders_log(spark, sf_dir), 5).events
    return ended.select("case_id", "pos", "activity", "o_orderstatus", "c_mktsegment", r6("o_totalprice").alias("o_totalprice"))


@query(
    "case_split",
    "D4",
    f"WITH {sql.ORDERS}, {sql.SPLIT} SELECT split, case_id, count(*) AS events FROM log JOIN split USING (case_id) GROUP BY ALL",
)
def case_split(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    return with_split(log, split_cases(log.events)).events.groupBy("split", "case_id").agg(F.count(F.lit(1)).alias("events"))


@query(
    "window_sizes",
    "D5",
    " UNION ALL ".join(
        f"SELECT '{name}' AS log, (WITH {body}, {sql.window()} SELECT w FROM win) AS w"
        for name, body in (("orders", sql.ORDERS), ("events", sql.EVENTS), ("turns", sql.TURNS), ("items", sql.ITEMS))
    ),
)
def window_sizes(spark, sf_dir):
    logs = {"orders": orders_log, "events": events_log, "turns": turns_log, "items": items_log}
    out = None
    for name, make in logs.items():
        log = make(spark, sf_dir)
        w = window_size(log, 5)
        row = log.events.agg(F.lit(name).alias("log"), F.lit(w).cast("bigint").alias("w"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "all_prefixes",
    "D6 D7",
    f"""WITH {sql.ORDERS}, {sql.LISTS}, {sql.window()},
    prices AS (SELECT case_id, list(o_totalprice ORDER BY pos) AS p, arg_min(c_mktsegment, pos) FILTER (WHERE c_mktsegment IS NOT NULL) AS segment FROM log GROUP BY case_id)
    SELECT case_id, pos AS prefix_len, segment, {sql.arrow("acts[greatest(1, pos - w + 1):pos]")} AS activities,
    {sql.arrow6("p[greatest(1, pos - w + 1):pos]")} AS prices
    FROM log JOIN lists USING (case_id) JOIN prices USING (case_id), win""",
)
def all_prefixes(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    rows = prefix_rows(log, ["activity", "o_totalprice"], window_size(log, 5), ["c_mktsegment"])
    return rows.select(
        "case_id",
        "prefix_len",
        F.col("c_mktsegment").alias("segment"),
        joined("activity").alias("activities"),
        joined6("o_totalprice").alias("prices"),
    )


@query(
    "long_prefixes",
    "D6 D7",
    f"""WITH {sql.EVENTS}, {sql.LISTS}
    SELECT case_id, pos AS prefix_len, md5({sql.arrow("acts[greatest(1, pos - 19):pos]")}) AS activities
    FROM log JOIN lists USING (case_id)""",
)
def long_prefixes(spark, sf_dir):
    rows = prefix_rows(events_log(spark, sf_dir), ["activity"], 20)
    return rows.select("case_id", "prefix_len", F.md5(joined("activity")).alias("activities"))


@query(
    "padded_cases",
    "D8",
    f"""WITH {sql.ORDERS}, lists AS (SELECT case_id, list(tie ORDER BY pos) AS ids FROM log GROUP BY case_id)
    SELECT case_id, array_to_string(list_transform(list_concat(list_transform(range(greatest(12 - len(ids), 0)), lambda i: 0::BIGINT),
       ids[greatest(1, len(ids) - 11):]), lambda v: CAST(v AS VARCHAR)), '>') AS padded FROM lists""",
)
def padded_cases(spark, sf_dir):
    rows = last_rows(orders_flow(spark, sf_dir), ["tie"], 12)
    padded = pad_left(F.col("tie"), 12, F.lit(0).cast("bigint"))
    return rows.select("case_id", F.array_join(padded, ">").alias("padded"))


@query(
    "window_masks",
    "D9 D10 D11",
    f"""WITH {sql.ORDERS}, {sql.LISTS}, {sql.window()}, {WINDOWS}, {VOCAB},
    masks AS (SELECT case_id, prefix_len, win, list_position(win, 'EOS') AS e, list_position(list_transform(win, lambda x: x IS NOT NULL), true) AS z, w FROM windows)
    SELECT case_id, prefix_len, {sql.arrow("win")} AS labels,
      array_to_string(list_transform(range(1, w + 1), lambda i: CASE WHEN e IS NULL OR i <= e THEN '1' ELSE '0' END), '') AS eos_mask,
      array_to_string(list_transform(range(1, w + 1), lambda i: CASE WHEN i >= z THEN '1' ELSE '0' END), '') AS zero_mask,
      w - z + 1 AS active FROM masks""",
)
def window_masks(spark, sf_dir):
    rows, _ = coded_windows(spark, sf_dir)
    zero = zero_mask(F.col("ids"))
    return rows.withColumn("ended", eos_mask(F.col("labels"), "EOS")).select(
        "case_id",
        "prefix_len",
        joined("labels").alias("labels"),
        F.array_join("ended", "").alias("eos_mask"),
        F.array_join(zero, "").alias("zero_mask"),
        i64(total(zero)).alias("active"),
    )


@query(
    "prefix_suffix_cuts",
    "D12",
    f"""WITH {sql.ORDERS}, {sql.window()}, {sql.complete()}
    SELECT case_id, prefix_len, {sql.arrow("prefix")} AS prefix, {sql.arrow("target_suffix")} AS target_suffix FROM pairs""",
)
def prefix_suffix_cuts(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    pairs = prefix_suffix_pairs(log, window_size(log, 5), 5)
    return pairs.select(
        "case_id", i64("prefix_len").alias("prefix_len"), joined("prefix").alias("prefix"), joined("target_suffix").alias("target_suffix")
    )


@query(
    "turn_prefix_suffix_cuts",
    "D12",
    f"""WITH {sql.TURNS}, {sql.window()}, {sql.complete()}
    SELECT case_id, prefix_len, {sql.arrow("prefix")} AS prefix, {sql.arrow("target_suffix")} AS target_suffix FROM pairs""",
)
def turn_prefix_suffix_cuts(spark, sf_dir):
    log = turns_log(spark, sf_dir)
    pairs = prefix_suffix_pairs(log, window_size(log, 5), 5)
    return pairs.select(
        "case_id", i64("prefix_len").alias("prefix_len"), joined("prefix").alias("prefix"), joined("target_suffix").alias("target_suffix")
    )


@query(
    "window_parts",
    "D13 D14",
    f"""WITH {sql.ORDERS}, {sql.LISTS}, {sql.window()}, {WINDOWS},
    masks AS (SELECT *, list_position(win, 'EOS') AS e, list_position(list_transform(win, lambda x: x IS NOT NULL), true) AS z FROM windows)
    SELECT case_id, prefix_len, {sql.arrow("win[1:w-5]")} AS prefix, {sql.arrow("win[w-4:]")} AS suffix,
      array_to_string(list_transform(range(w - 4, w + 1), lambda i: CASE WHEN (e IS NULL OR i <= e) AND i >= z THEN '1' ELSE '0' END), '') AS suffix_mask FROM masks""",
)
def window_parts(spark, sf_dir):
    rows, window = coded_windows(spark, sf_dir)
    mask = both_masks(eos_mask(F.col("labels"), "EOS"), zero_mask(F.col("ids")))
    return rows.select(
        "case_id",
        "prefix_len",
        joined(prefix_part(F.col("labels"), window, 5)).alias("prefix"),
        joined(suffix_part(F.col("labels"), window, 5)).alias("suffix"),
        F.array_join(suffix_part(mask, window, 5), "").alias("suffix_mask"),
    )


@query(
    "next_event_pairs",
    "D15",
    f"""WITH {sql.EVENTS} SELECT case_id, pos, activity,
    coalesce(lead(activity) OVER (PARTITION BY case_id ORDER BY us, tie), 'EOS') AS next_activity FROM log""",
)
def next_event_pairs(spark, sf_dir):
    return next_event_rows(events_log(spark, sf_dir)).select("case_id", "pos", "activity", "next_activity")


@query(
    "visible_activities",
    "D16 D17",
    f"""WITH {sql.ORDERS}, {sql.LISTS}, {sql.window()}, {WINDOWS}
    SELECT case_id, prefix_len, {sql.arrow("list_filter(win, lambda x: x IS NOT NULL AND x <> 'EOS')")} AS activities,
    {sql.arrow("list_filter(win, lambda x: x IS NOT NULL)")} AS active FROM windows""",
)
def visible_activities(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    window = window_size(log, 5)
    rows = window_rows(log, ["activity"], window, 5)
    padded = pad_left(F.col("activity"), window, F.lit(None).cast("string"))
    return rows.select(
        "case_id",
        "prefix_len",
        joined(visible(padded)).alias("activities"),
        joined(F.filter(padded, lambda x: x.isNotNull())).alias("active"),
    )
