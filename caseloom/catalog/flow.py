"""Directly-follows nets, decision places and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import sql
from caseloom.catalog.registry import i64, query, r6
from caseloom.operators.flow import (
    align,
    decision_context,
    decision_places,
    decisions,
    directly_follows,
    incoming_transitions,
    net_from_edges,
    places_after_label,
    prefix_markings,
    replay,
    sync_events,
)
from caseloom.session import cut, small
from caseloom.sources.logs import events_log, items_log, orders_flow, orders_log, turns_log


def edges_sql(threshold: float, learned: bool = False) -> str:
    """``edges`` with the noise filter, ``kept`` edges; ``learned`` looks at train and validation cases only."""
    seen = "(SELECT log.* FROM log JOIN split USING (case_id) WHERE split <> 'test')" if learned else "log"
    return f"""pairs_of AS (SELECT activity AS source, coalesce(lead(activity) OVER (PARTITION BY case_id ORDER BY pos), 'EOS') AS target FROM {seen}
      UNION ALL SELECT 'START', activity FROM {seen} WHERE pos = 1),
    edges AS MATERIALIZED (SELECT source, target, count(*) AS n, count(*) >= {threshold} * max(count(*)) OVER (PARTITION BY source) AS kept FROM pairs_of GROUP BY source, target),
    kept AS MATERIALIZED (SELECT source, target FROM edges WHERE kept)"""


WALK = """walk AS (SELECT l.case_id, l.pos, l.n, l.activity, 'START' AS state_before, CASE WHEN k.source IS NULL THEN 'START' ELSE l.activity END AS state
      FROM log l LEFT JOIN kept k ON k.source = 'START' AND k.target = l.activity WHERE l.pos = 1
    UNION ALL SELECT l.case_id, l.pos, l.n, l.activity, w.state, CASE WHEN k.source IS NULL THEN w.state ELSE l.activity END
      FROM walk w JOIN log l ON l.case_id = w.case_id AND l.pos = w.pos + 1 LEFT JOIN kept k ON k.source = w.state AND k.target = l.activity)"""
PLACES = """dplaces AS (SELECT source FROM kept GROUP BY source HAVING count(*) > 1)"""


@query(
    "directly_follows_edges",
    "F1",
    f"WITH {sql.EVENTS}, {edges_sql(0.2)} SELECT source, target, n, kept FROM edges",
)
def directly_follows_edges(spark, sf_dir):
    return directly_follows(events_log(spark, sf_dir), 0.2)


@query(
    "item_directly_follows_edges",
    "F1",
    f"WITH {sql.ITEMS}, {edges_sql(0.0)} SELECT source, target, n, kept FROM edges",
)
def item_directly_follows_edges(spark, sf_dir):
    return directly_follows(items_log(spark, sf_dir))


@query(
    "decision_place_list",
    "F2",
    f"WITH {sql.EVENTS}, {edges_sql(0.2)} SELECT 'p_' || source AS place, count(*) AS outgoing FROM kept GROUP BY source HAVING count(*) > 1",
)
def decision_place_list(spark, sf_dir):
    return decision_places(net_from_edges(cut(directly_follows(events_log(spark, sf_dir), 0.2))))


@query(
    "incoming_transition_list",
    "F3",
    f"""WITH {sql.EVENTS}, {edges_sql(0.2)} SELECT 'p_' || target AS place, source || '>' || target AS tid,
    CASE WHEN target <> 'EOS' THEN target END AS label FROM kept""",
)
def incoming_transition_list(spark, sf_dir):
    return incoming_transitions(net_from_edges(cut(directly_follows(events_log(spark, sf_dir), 0.2))))


@query(
    "decision_places_after_label",
    "F4",
    f"""WITH {sql.EVENTS}, {edges_sql(0.2)}, {PLACES} SELECT target AS label, source || '>' || target AS tid, 'p_' || target AS place
    FROM kept WHERE target IN (SELECT source FROM dplaces)""",
)
def decision_places_after_label(spark, sf_dir):
    return places_after_label(net_from_edges(cut(directly_follows(events_log(spark, sf_dir), 0.2))))


@query(
    "activity_decision_place",
    "F5",
    f"""WITH {sql.ORDERS}, {edges_sql(0.0)}, {PLACES} SELECT case_id, pos, CASE WHEN d.source IS NOT NULL THEN 'p_' || activity END AS place
    FROM log LEFT JOIN dplaces d ON d.source = activity""",
)
def activity_decision_place(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    context = decision_context(net_from_edges(cut(directly_follows(log))))
    return log.events.join(small(context), "activity", "left").select("case_id", "pos", "place")


@query(
    "prefix_markings",
    "F6",
    f"""WITH RECURSIVE {sql.ORDERS}, {edges_sql(0.92)}, {WALK} SELECT case_id, pos, 'p_' || state || ':1' AS marking FROM walk""",
)
def markings(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    slim = log.with_events(log.select("case_id", "activity", "pos", "n", "block"))
    net = net_from_edges(cut(directly_follows(log, 0.92)))
    return prefix_markings(slim, net).select("case_id", "pos", "marking")


@query(
    "aligned_moves",
    "F7",
    f"""WITH {sql.ORDERS} SELECT case_id, pos AS seq, 'e' || pos AS log_name,
      coalesce(lag(activity) OVER (PARTITION BY case_id ORDER BY pos), 'START') || '>' || activity AS model_name, activity AS log_label, activity AS model_label FROM log
    UNION ALL SELECT case_id, n + 1, '>>', activity || '>EOS', NULL, NULL FROM log WHERE pos = n""",
)
def aligned_moves(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    moves = align(log, cut(directly_follows(log)))
    return moves.select("case_id", F.col("pos").alias("seq"), "log_name", "model_name", "log_label", "model_label")


@query(
    "aligned_moves_filtered_net",
    "F7",
    f"""WITH RECURSIVE {sql.ORDERS}, {edges_sql(0.92)}, {WALK}
    SELECT case_id, pos, activity AS log_label, CASE WHEN k.source IS NULL THEN '>>' ELSE state_before || '>' || activity END AS model_name
    FROM walk LEFT JOIN kept k ON k.source = state_before AND k.target = activity""",
)
def aligned_moves_filtered_net(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    moves = align(log, cut(directly_follows(log, 0.92))).events.where("event_pos is not null")
    return moves.select("case_id", "pos", "log_label", "model_name")


DECISIONS = f"""steps AS (SELECT case_id, pos - 1 AS sync_index, coalesce(lag(activity) OVER (PARTITION BY case_id ORDER BY pos), 'START') AS source, activity AS target, pos - 1 AS resolved_by FROM log
      UNION ALL SELECT case_id, n, activity, 'EOS', NULL FROM log WHERE pos = n),
    records AS (SELECT case_id, 'p_' || source AS place, sync_index, target, resolved_by,
      row_number() OVER (PARTITION BY case_id ORDER BY sync_index) - 1 AS ord FROM steps WHERE source IN (SELECT source FROM dplaces))"""


@query(
    "decision_records",
    "F8",
    f"WITH {sql.ORDERS}, {edges_sql(0.0)}, {PLACES}, {DECISIONS} SELECT case_id, place, sync_index, target, resolved_by, ord FROM records",
)
def decision_records(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    edges = cut(directly_follows(log))
    return decisions(align(log, edges), net_from_edges(edges)).drop("block")


@query(
    "replayed_decision_records",
    "F8",
    f"WITH {sql.TURNS}, {edges_sql(0.0)}, {PLACES}, {DECISIONS} SELECT case_id, place, sync_index, target, resolved_by, ord FROM records",
)
def replayed_decision_records(spark, sf_dir):
    log = turns_log(spark, sf_dir)
    edges = cut(directly_follows(log))
    return replay(align(log, edges), net_from_edges(edges))


@query(
    "synchronous_events",
    "F9",
    f"""WITH RECURSIVE {sql.ORDERS}, {edges_sql(0.92)}, {WALK}
    SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS sync_no, pos AS matched_pos, activity AS log_label
    FROM walk JOIN kept k ON k.source = state_before AND k.target = activity""",
)
def synchronous_events(spark, sf_dir):
    log = orders_flow(spark, sf_dir)
    return sync_events(align(log, cut(directly_follows(log, 0.92)))).drop("block")
