"""Directly-follows nets, decision places, replay."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.text import EOS
from caseloom.operators.ordering import CASE, EventLog, around, running
from caseloom.session import cut, small

START = "START"
SKIP = ">>"
NET_LIMIT = 1_000_000


@dataclass(frozen=True)
class Net:
    """A Petri net as four small tables."""

    transitions: DataFrame  # tid, label (null for a silent step)
    arcs_in: DataFrame  # tid, place
    arcs_out: DataFrame  # tid, place
    initial: DataFrame  # place, n


def directly_follows(log: EventLog, threshold: float = 0.0) -> DataFrame:
    """``source, target, n, kept`` with start and end edges.

    An edge is kept when its count reaches ``threshold`` times the largest
    count leaving the same source.
    """

    def edges(df: DataFrame, w) -> DataFrame:
        onward = F.struct(
            F.col("activity").alias("source"), F.coalesce(F.lead("activity").over(w), F.lit(EOS)).alias("target")
        )
        entry = F.struct(F.lit(START).alias("source"), F.col("activity").alias("target"))
        return df.withColumn("edges", F.when(F.col("pos") == 1, F.array(entry, onward)).otherwise(F.array(onward)))

    found = around(log, edges, after=1).events.select(F.inline("edges"))
    counts = found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy("source"))
    return counts.withColumn("kept", F.col("n") >= F.lit(float(threshold)) * top)


def net_from_edges(edges: DataFrame) -> Net:
    """One place per activity plus start and end; a kept edge is a transition, the end edge a silent one."""
    kept = edges.where("kept").select(
        F.concat("source", F.lit(">"), "target").alias("tid"),
        F.when(F.col("target") != EOS, F.col("target")).alias("label"),
        F.concat(F.lit("p_"), "source").alias("from_place"),
        F.concat(F.lit("p_"), "target").alias("to_place"),
    )
    start = edges.sparkSession.createDataFrame([(f"p_{START}", 1)], "place string, n int")
    return Net(
        kept.select("tid", "label"),
        kept.select("tid", F.col("from_place").alias("place")),
        kept.select("tid", F.col("to_place").alias("place")),
        start,
    )


def decision_places(net: Net) -> DataFrame:
    """Places with more than one outgoing arc."""
    return net.arcs_in.groupBy("place").agg(F.count(F.lit(1)).alias("outgoing")).where("outgoing > 1")


def incoming_transitions(net: Net) -> DataFrame:
    """Distinct transitions that put a token into each place."""
    pairs = net.arcs_out.join(net.transitions, "tid").select("place", "tid", "label").distinct()
    return pairs


def places_after_label(net: Net) -> DataFrame:
    """``label, tid, place``: decision places behind each labelled transition."""
    labelled = net.transitions.where(F.col("label").isNotNull())
    return (
        labelled.join(net.arcs_out, "tid")
        .join(decision_places(net).select("place"), "place", "left_semi")
        .select("label", "tid", "place")
    )


def decision_context(net: Net) -> DataFrame:
    """``activity, place``: the first decision place after the first transition with that label, in name order."""
    first = net.transitions.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("tid").alias("tid"))
    behind = places_after_label(net).join(first, ["label", "tid"])
    return behind.groupBy("label").agg(F.min("place").alias("place")).withColumnRenamed("label", "activity")


def _collected(df: DataFrame) -> list:
    rows = df.limit(NET_LIMIT + 1).collect()
    if len(rows) > NET_LIMIT:
        raise ValueError(f"the net has more than {NET_LIMIT} entries")
    return rows


Step = Callable[[str, str], str]


def run_automaton(
    log: EventLog,
    step: Step,
    initial: str,
    states: Sequence[str] | None,
    before: str = "state_before",
    after: str = "state_after",
) -> EventLog:
    """State before and after each event.

    Events stream through in order, one state held at a time. When a case
    spans blocks and the states are known, each block first yields its effect
    on every state, the effects are chained, and the blocks then run apart.
    """
    events = log.events
    schema = T.StructType([*events.schema.fields, T.StructField(before, T.StringType()), T.StructField(after, T.StringType())])
    keys = [CASE, "block"] if log.spans and states is not None else [CASE]
    if len(keys) == 2:
        source = events.join(_block_starts(log, step, initial, list(states)), keys)
    else:
        source = events.withColumn("entry_state", F.lit(initial))

    def fold(batches):
        memo: dict[tuple[str, str], str] = {}
        key, state = None, None
        for pdf in batches:
            came, went = [], []
            own = zip(*[pdf[k] for k in keys])
            for group, label, entry in zip(own, pdf["activity"], pdf["entry_state"]):
                if group != key:
                    key, state = group, entry
                came.append(state)
                pair = (state, label)
                if pair not in memo:
                    memo[pair] = step(state, label)
                state = memo[pair]
                went.append(state)
            yield pdf.drop(columns="entry_state").assign(**{before: came, after: went})

    placed = source.repartition(*keys).sortWithinPartitions(*keys, "pos")
    return log.with_events(placed.mapInPandas(fold, schema))


def _block_starts(log: EventLog, step: Step, initial: str, states: list[str]) -> DataFrame:
    """State at the start of every block of every case."""

    def effects(batches):
        index = {s: i for i, s in enumerate(states)}
        moves: dict[str, np.ndarray] = {}
        key, effect, rows = None, None, []
        for pdf in batches:
            for case, block, label in zip(pdf[CASE], pdf["block"], pdf["activity"]):
                if (case, block) != key:
                    if key is not None:
                        rows.append((*key, effect.tolist()))
                    key, effect = (case, block), np.arange(len(states))
                if label not in moves:
                    moves[label] = np.array([index[step(s, label)] for s in states])
                effect = moves[label][effect]
            yield pd.DataFrame(rows, columns=[CASE, "block", "effect"])
            rows = []
        if key is not None:
            yield pd.DataFrame([(*key, effect.tolist())], columns=[CASE, "block", "effect"])

    def chain(batches):
        key, state = None, 0
        first = states.index(initial)
        for pdf in batches:
            entries = []
            for case, effect in zip(pdf[CASE], pdf["effect"]):
                if case != key:
                    key, state = case, first
                entries.append(states[state])
                state = effect[state]
            yield pdf[[CASE, "block"]].assign(entry_state=entries)

    slim = log.events.select(CASE, "block", "pos", "activity").repartition(CASE, "block")
    per_block = slim.sortWithinPartitions(CASE, "block", "pos").mapInPandas(
        effects, f"{CASE} string, block bigint, effect array<bigint>"
    )
    ordered = per_block.repartition(CASE).sortWithinPartitions(CASE, "block")
    return ordered.mapInPandas(chain, f"{CASE} string, block bigint, entry_state string")


def prefix_markings(log: EventLog, net: Net, max_states: int = 10_000) -> EventLog:
    """Marking reached after each event: the first enabled transition with the label fires, others are ignored."""
    takes: dict[str, list[str]] = {}
    gives: dict[str, list[str]] = {}
    for r in _collected(net.arcs_in):
        takes.setdefault(r["tid"], []).append(r["place"])
    for r in _collected(net.arcs_out):
        gives.setdefault(r["tid"], []).append(r["place"])
    by_label: dict[str, list[str]] = {}
    for r in sorted(_collected(net.transitions.where("label is not null")), key=lambda r: r["tid"]):
        by_label.setdefault(r["label"], []).append(r["tid"])

    def text(tokens: dict[str, int]) -> str:
        return ",".join(f"{p}:{n}" for p, n in sorted(tokens.items()) if n > 0)

    def step(marking: str, label: str) -> str:
        held = {p: int(n) for p, n in (item.rsplit(":", 1) for item in marking.split(",") if item)}
        for tid in by_label.get(label, ()):
            need = takes.get(tid, [])
            if all(held.get(p, 0) >= need.count(p) for p in need):
                for p in need:
                    held[p] -= 1
                for p in gives.get(tid, []):
                    held[p] = held.get(p, 0) + 1
                return text(held)
        return marking

    initial = text({r["place"]: r["n"] for r in _collected(net.initial)})
    return run_automaton(log, step, initial, _reachable(step, initial, list(by_label), max_states), "marking_before", "marking")


def _reachable(step: Step, initial: str, labels: list[str], limit: int) -> list[str] | None:
    """States reachable from ``initial``; None when there are more than ``limit``."""
    seen, queue = {initial}, deque([initial])
    while queue:
        state = queue.popleft()
        for label in labels:
            reached = step(state, label)
            if reached not in seen:
                if len(seen) >= limit:
                    return None
                seen.add(reached)
                queue.append(reached)
    return sorted(seen)


def synchronise(log: EventLog, edges: DataFrame) -> EventLog:
    """Place before and after each event, and whether net and log move together.

    With every edge kept the place is the previous activity; otherwise an
    event whose edge was filtered out is a move of the log alone.
    """
    if edges.where(~F.col("kept")).limit(1).count() == 0:
        return around(
            log,
            lambda df, w: df.withColumn("state_before", F.coalesce(F.lag("activity").over(w), F.lit(START)))
            .withColumn("state_after", F.col("activity"))
            .withColumn("sync", F.lit(True)),
            before=1,
        )
    kept = {(r["source"], r["target"]) for r in _collected(edges.where("kept"))}
    states = sorted({START} | {b for _, b in kept if b != EOS})

    def step(state: str, label: str) -> str:
        return label if (state, label) in kept else state

    moved = run_automaton(log, step, START, states)
    lookup = small(edges.where("kept").select(F.col("source").alias("state_before"), F.col("target").alias("activity")))
    flagged = moved.events.join(lookup.withColumn("sync", F.lit(True)), ["state_before", "activity"], "left")
    return log.with_events(flagged.withColumn("sync", F.coalesce("sync", F.lit(False))))


def exits(edges: DataFrame) -> DataFrame:
    """``state, path``: fewest kept edges to the end, ties in name order; empty when it cannot be reached."""
    kept: dict[str, list[str]] = {}
    for r in _collected(edges.where("kept")):
        kept.setdefault(r["source"], []).append(r["target"])
    rows = []
    for origin in sorted({START, *kept, *[b for targets in kept.values() for b in targets if b != EOS]}):
        found: list[tuple[str, str]] = []
        seen, queue = {origin}, deque([(origin, [])])
        while queue and not found:
            at, path = queue.popleft()
            for target in sorted(kept.get(at, []), key=lambda t: (t != EOS, t)):
                if target == EOS:
                    found = [*path, (at, target)]
                    break
                if target not in seen:
                    seen.add(target)
                    queue.append((target, [*path, (at, target)]))
        rows.append((origin, found))
    return edges.sparkSession.createDataFrame(rows, "state string, path array<struct<source:string,target:string>>")


def align(log: EventLog, edges: DataFrame) -> EventLog:
    """Moves per case: together, log alone, model alone (the way to the end)."""
    placed = synchronise(log, edges).events
    sync = F.col("sync")
    own = placed.select(
        CASE,
        "block",
        "n",
        F.col("pos"),
        F.col("pos").alias("event_pos"),
        F.concat(F.lit("e"), F.col("pos").cast("string")).alias("log_name"),
        F.when(sync, F.concat("state_before", F.lit(">"), "activity")).otherwise(SKIP).alias("model_name"),
        F.col("activity").alias("log_label"),
        F.when(sync, F.col("activity")).alias("model_label"),
    )
    ends = (
        placed.where(F.col("pos") == F.col("n"))
        .join(small(exits(edges)), F.col("state_after") == F.col("state"))
        .select(CASE, "block", "n", F.posexplode("path").alias("step", "edge"))
        .select(
            CASE,
            "block",
            "n",
            (F.col("n") + F.col("step") + 1).alias("pos"),
            F.lit(None).cast("long").alias("event_pos"),
            F.lit(SKIP).alias("log_name"),
            F.concat("edge.source", F.lit(">"), "edge.target").alias("model_name"),
            F.lit(None).cast("string").alias("log_label"),
            F.when(F.col("edge.target") != EOS, F.col("edge.target")).alias("model_label"),
        )
    )
    return EventLog(own.unionByName(ends), ("pos",), log.spans)


def is_sync():
    return (F.col("log_name") != SKIP) & (F.col("model_name") != SKIP)


def sync_events(moves: EventLog) -> DataFrame:
    """``case_id, sync_no, event_pos``: the event behind each synchronous move.

    The position is the running number of log moves, so it needs no search.
    """
    marked = moves.with_events(
        moves.events.withColumn("log_move", F.when(F.col("log_name") != SKIP, 1)).withColumn(
            "sync_move", F.when(is_sync(), 1)
        )
    )
    counted = running(marked, {"matched_pos": ("count", "log_move"), "sync_no": ("count", "sync_move")}, through=True)
    return counted.events.where(is_sync()).select(CASE, "block", "sync_no", "matched_pos", "log_label")


def decisions(moves: EventLog, net: Net) -> DataFrame:
    """Decision records of a net in which every transition takes and gives one token.

    The single token carries the open decisions to the next visible event, so
    the target is the next synchronous label, the end marker without one.
    """
    chosen = small(net.arcs_in.join(decision_places(net).select("place"), "place", "left_semi"))
    fired = moves.events.where(F.col("model_name") != SKIP)
    joined = fired.join(chosen, F.col("model_name") == F.col("tid"), "left")
    marked = joined.withColumns(
        {
            "sync_label": F.when(is_sync(), F.col("log_label")),
            "opened": F.when(F.col("place").isNotNull(), 1),
        }
    )
    log = moves.with_events(marked)
    before = running(log, {"sync_index": ("count", "sync_label"), "ord": ("count", "opened")})
    done = running(before, {"next_label": ("last", "sync_label")}, through=True, reverse=True)
    return done.events.where(F.col("place").isNotNull()).select(
        CASE,
        "block",
        "place",
        F.col("sync_index"),
        F.coalesce("next_label", F.lit(EOS)).alias("target"),
        F.when(F.col("next_label").isNotNull(), F.col("sync_index")).alias("resolved_by"),
        F.col("ord"),
    )


def token_flow(moves: EventLog, net: Net) -> DataFrame:
    """One row per token that a transition takes: ``place``, the ``move`` taking it and the ``source`` move that gave it.

    The newest token of a place goes first, so takes and gives pair up like
    brackets: a take belongs to the last give at its height. The height is a
    running sum above its running minimum; a take at height 0 finds no token.
    Source 0 is the initial marking. ``seen`` tells moves with an event,
    ``visible`` counts such moves before.
    """
    known = small(net.transitions.select(F.col("tid").alias("model_name")))
    seen = F.col("log_name") != SKIP
    fired = moves.events.join(known, "model_name", "left_semi").select(
        CASE, "block", "pos", F.col("model_name").alias("tid"), seen.alias("seen"), F.when(seen, 1).alias("event"),
        F.coalesce("log_label", "model_label").alias("label"),
    )
    fired = cut(running(EventLog(fired, ("pos",), moves.spans), {"visible": ("count", "event")}).events.drop("event"))
    arcs = net.arcs_in.withColumn("change", F.lit(-1)).unionByName(net.arcs_out.withColumn("change", F.lit(1)))
    arcs = arcs.withColumn("arc", F.row_number().over(Window.partitionBy("tid", "change", "place").orderBy("place")))
    steps = fired.withColumnRenamed("pos", "move").join(small(arcs), "tid").drop("tid")
    marking = small(net.initial.select("place", F.explode(F.sequence(F.lit(1), "n")).alias("arc")).withColumn("change", F.lit(1)))
    first = fired.groupBy(CASE).agg(F.min("block").alias("block")).join(marking, F.lit(True))
    steps = steps.unionByName(first.withColumn("move", F.lit(0).cast("long")), allowMissingColumns=True)
    # a move takes before it gives
    steps = steps.withColumn("pos", F.struct("move", "change", "place", "arc"))
    log = running(EventLog(steps, ("pos",), moves.spans), {"sum": ("sum", "change")}, through=True, keys=("place",))
    log = running(log, {"lowest": ("min", "sum")}, keys=("place",))
    there = F.col("sum") - F.col("change") - F.least(F.coalesce("lowest", F.lit(0)), F.lit(0))
    levels = log.events.withColumns(
        {"level": there + F.when(F.col("change") > 0, 1).otherwise(0), "giver": F.when(F.col("change") > 0, F.col("move"))}
    )
    paired = running(log.with_events(levels.where("level > 0")), {"source": ("last", "giver")}, keys=("place", "level"))
    return paired.events.where("change < 0").select(
        CASE, "block", "pos", "place", "source", "move", "seen", "visible", "label"
    )


def replay(moves: EventLog, net: Net) -> DataFrame:
    """Decision records for any net, concurrent ones included.

    Taking a token from a decision place opens a decision. It is resolved by the
    first move with an event that silent moves lead to along the flow of
    tokens, that of the deciding move itself at once; without one its target
    is the end marker. Records of a move are numbered by place name.

    One join per silent move in a row; every join and window is keyed below the
    case, so that a long case is spread over many tasks.
    """
    flow = cut(token_flow(moves, net))
    opened = flow.join(small(decision_places(net).select("place")), "place", "left_semi").withColumn("opened", F.lit(1))
    opened = cut(running(EventLog(opened, ("pos",), moves.spans), {"ord": ("count", "opened")}).events)
    onward = flow.select(CASE, F.col("source").alias("at"), "move", "seen", "visible", "label").distinct()
    columns = [CASE, "ord", "move", "seen", "visible", "label"]
    found = opened.select(columns)
    front = found.where("not seen")
    while not front.isEmpty():
        reached = front.select(CASE, "ord", F.col("move").alias("at")).join(onward, [CASE, "at"]).select(columns)
        reached = cut(reached.distinct())
        found, front = found.unionByName(reached), reached.where("not seen")
    answer = found.where("seen").groupBy(CASE, "ord").agg(F.min_by(F.struct("visible", "label"), "move").alias("answer"))
    return opened.join(answer, [CASE, "ord"], "left").select(
        CASE,
        "place",
        F.col("visible").alias("sync_index"),
        F.coalesce("answer.label", F.lit(EOS)).alias("target"),
        F.col("answer.visible").alias("resolved_by"),
        "ord",
    )
