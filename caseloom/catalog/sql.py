"""Shared SQL: the logs, splits, windows and prefixes as common table expressions."""

from __future__ import annotations

EMPTY = "[]::VARCHAR[]"


def numbered(source: str, order: str) -> str:
    return (
        f"log AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS pos, "
        f"count(*) OVER (PARTITION BY case_id) AS n FROM {source})"
    )


ORDERS_BASE = """orders_base AS (
  SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity, epoch_us(o_orderdate) AS us,
         o_orderkey AS tie, o_orderdate AS ts, o_orderstatus, o_totalprice, c_mktsegment,
         CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_custkey IS NOT NULL)"""
ORDERS = ORDERS_BASE + ",\n" + numbered("orders_base", "us, tie")

EVENTS_BASE = """events_base AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, epoch_us(ts) AS us, event_id AS tie, ts,
         value, CAST(props->>'$.k' AS DOUBLE) AS k
  FROM events WHERE user_id IS NOT NULL)"""
EVENTS = EVENTS_BASE + ",\n" + numbered("events_base", "us, tie")

TURNS_BASE = """turns_base AS (
  SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity, turn AS tie, CAST(length(text) AS DOUBLE) AS chars
  FROM conversations WHERE conv_id IS NOT NULL)"""
TURNS = TURNS_BASE + ",\n" + numbered("turns_base", "tie")

ITEMS_BASE = """items_base AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || '-' || l_linestatus AS activity,
         epoch_us(l_shipdate) AS us, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, o_orderpriority, o_orderstatus
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey IS NOT NULL)"""
ITEMS = ITEMS_BASE + ",\n" + numbered(
    "items_base",
    "us, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, activity",
)

PLANTED = ORDERS.replace("log AS (", "orders_log AS (") + """,
log AS (SELECT * REPLACE (CASE WHEN pos = 1 THEN 'OPEN'
   WHEN lag(o_totalprice) OVER (PARTITION BY case_id ORDER BY pos) > 250000 THEN 'REVIEW' ELSE 'APPROVE' END AS activity)
  FROM orders_log)"""

SPLIT = """ranked AS (
  SELECT case_id, row_number() OVER (ORDER BY md5(case_id || '|17'), case_id) AS r, count(*) OVER () AS c
  FROM (SELECT DISTINCT case_id FROM log)),
split AS (SELECT case_id, CASE WHEN r <= CAST(floor(0.15 * c) AS BIGINT) THEN 'val'
   WHEN r <= CAST(floor(0.15 * c) AS BIGINT) + CAST(floor(0.2 * c) AS BIGINT) THEN 'test' ELSE 'train' END AS split
  FROM ranked)"""


def window(min_suffix: int = 5, source: str = "log", where: str = "TRUE") -> str:
    """``w``: the window size over the cases of ``source``."""
    return (
        f"win AS (SELECT CAST(round_even(quantile_cont(n + {min_suffix}, 0.985), 0) AS BIGINT) + {min_suffix} AS w "
        f"FROM {source} WHERE pos = 1 AND {where})"
    )


LISTS = "lists AS (SELECT case_id, list(activity ORDER BY pos) AS acts FROM log GROUP BY case_id)"


def complete(min_suffix: int = 5) -> str:
    """``whole``: last w - min_suffix activities per case; ``pairs``: its cuts."""
    return f"""whole AS (
  SELECT case_id, list(activity ORDER BY pos) AS acts FROM log, win
  WHERE pos > n - (w - {min_suffix}) GROUP BY case_id),
pairs AS (
  SELECT case_id, CAST(k AS BIGINT) AS prefix_len, acts[1:k] AS prefix, acts[k+1:] AS target_suffix
  FROM whole, unnest(range(1, len(acts))) AS t(k))"""


def arrow(expr: str, sep: str = ">") -> str:
    """List of labels as one text, null shown as ~."""
    return f"array_to_string(list_transform({expr}, lambda v: coalesce(v, '~')), '{sep}')"


def arrow6(expr: str, sep: str = ">") -> str:
    """List of numbers as one text in millionths, null shown as ~."""
    return (
        f"array_to_string(list_transform({expr}, "
        f"lambda v: coalesce(CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR), '~')), '{sep}')"
    )
