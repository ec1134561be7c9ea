"""Order inside cases without putting a whole case into one task.

A case normally fits one task, so windows partition by case. When the largest
case exceeds the block size, positions come from a range-partitioned sort and
every window then works on (case, block): neighbours from the adjoining block
are copied in as halo rows, running values receive a carry from the block
totals before them. Both forms give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from caseloom.session import block_size, cut

CASE = "case_id"


@dataclass(frozen=True)
class EventLog:
    """A sequenced log: ``case_id, activity, us, pos, n, block`` and attributes."""

    events: DataFrame
    sort: tuple[str, ...]
    spans: bool
    dyn_cat: tuple[str, ...] = ()
    dyn_num: tuple[str, ...] = ()
    sta_cat: tuple[str, ...] = ()
    sta_num: tuple[str, ...] = ()

    @property
    def block(self) -> int:
        return block_size(self.events.sparkSession)

    def with_events(self, events: DataFrame) -> EventLog:
        return replace(self, events=events)

    def select(self, *cols: str | Column) -> DataFrame:
        return self.events.select(*cols)


def sequence_log(
    df: DataFrame,
    order: Sequence[str],
    *,
    dyn_cat: Sequence[str] = (),
    dyn_num: Sequence[str] = (),
    sta_cat: Sequence[str] = (),
    sta_num: Sequence[str] = (),
) -> EventLog:
    """Number the events of every case by ``order``."""
    roles = dict(
        dyn_cat=tuple(dyn_cat), dyn_num=tuple(dyn_num), sta_cat=tuple(sta_cat), sta_num=tuple(sta_num)
    )
    df = df.where(F.col(CASE).isNotNull())
    block = block_size(df.sparkSession)
    stats = df.groupBy(CASE).count().agg(F.max("count").alias("top"), F.sum("count").alias("total")).first()
    top, total = stats["top"] or 0, stats["total"] or 0
    if top <= block:
        by_case = Window.partitionBy(CASE)
        events = (
            df.withColumn("pos", F.row_number().over(by_case.orderBy(*order)).cast("long"))
            .withColumn("n", F.count(F.lit(1)).over(by_case))
            .withColumn("block", F.lit(0).cast("long"))
        )
        return EventLog(events, tuple(order), False, **roles)

    chunks = max(1, math.ceil(total / block))
    ranged = cut(
        df.repartitionByRange(chunks, CASE, *order).withColumn("chunk", F.spark_partition_id())
    )
    local = Window.partitionBy(CASE, "chunk").orderBy(*order)
    by_chunk = Window.partitionBy(CASE).orderBy("chunk")
    offsets = (
        ranged.groupBy(CASE, "chunk")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn(
            "before",
            F.coalesce(F.sum("size").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("n", F.sum("size").over(Window.partitionBy(CASE)))
        .drop("size")
    )
    events = (
        ranged.withColumn("local", F.row_number().over(local))
        .join(offsets, [CASE, "chunk"])
        .withColumn("pos", (F.col("before") + F.col("local")).cast("long"))
        .withColumn("block", F.floor((F.col("pos") - 1) / F.lit(block)).cast("long"))
        .drop("local", "before", "chunk")
    )
    return EventLog(events, ("pos",), True, **roles)


def settle(log: EventLog) -> EventLog:
    """Compute the numbered log once for several readers.

    They start from the checkpointed copy instead of scanning, joining and
    numbering the raw log again.
    """
    return log.with_events(cut(log.events))


def around(
    log: EventLog,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
) -> EventLog:
    """Run window expressions that look at most ``before`` / ``after`` rows away."""
    if not log.spans:
        window = Window.partitionBy(CASE).orderBy(*log.sort)
        return log.with_events(compute(log.events, window))
    size = F.lit(log.block)
    first = F.floor((F.greatest(F.col("pos") - after, F.lit(1)) - 1) / size)
    last = F.floor((F.least(F.col("pos") + before, F.col("n")) - 1) / size)
    spread = log.events.withColumn("home", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(CASE, "home").orderBy("pos")
    done = compute(spread, window).where(F.col("home") == F.col("block")).drop("home")
    return log.with_events(done)


def per_case(log: EventLog, **aggs: Column) -> EventLog:
    """Attach whole-case aggregates to every event."""
    if not log.spans:
        window = Window.partitionBy(CASE)
        return log.with_events(
            log.events.withColumns({name: agg.over(window) for name, agg in aggs.items()})
        )
    totals = log.events.groupBy(CASE).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return log.with_events(join_cases(log.events, totals, True))


_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def _fold(kind: str, value: Column) -> Column:
    if kind == "count":
        return F.count(value)
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return _MERGE[kind](value)


def join_cases(df: DataFrame, table: DataFrame, spans: bool) -> DataFrame:
    """Inner join of rows with one row per case.

    When cases span blocks the table is first spread over (case, block), so a
    case with very many rows meets its row in many tasks.
    """
    if not spans or "block" not in df.columns:
        return df.join(table, CASE)
    keyed = df.select(CASE, "block").distinct().join(table, CASE)
    return df.join(keyed, [CASE, "block"])


def running(
    log: EventLog,
    specs: Mapping[str, tuple[str, str]],
    *,
    through: bool = False,
    keys: Sequence[str] = (),
    reverse: bool = False,
) -> EventLog:
    """Running aggregates of the earlier (``reverse``: later) events of a case.

    ``specs`` maps an output name to (``sum|count|max|min|last``, column).
    ``through`` includes the event itself; ``keys`` narrows the group.
    Counts without history are 0, everything else is null.
    """
    group = [CASE, *keys]
    end = 0 if through else -1
    order = ("pos",) if keys or reverse else log.sort

    def in_order(names: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if reverse else F.col(c) for c in names]

    window = Window.partitionBy(*group, *(["block"] if log.spans else [])).orderBy(*in_order(order))
    frame = window.rowsBetween(Window.unboundedPreceding, end)
    local = log.events.withColumns(
        {name: _fold(kind, F.col(col)).over(frame) for name, (kind, col) in specs.items()}
    )
    if not log.spans:
        return log.with_events(local)
    nearest = F.min_by if reverse else F.max_by
    totals = log.events.groupBy(*group, "block").agg(
        *[
            (nearest(col, F.when(F.col(col).isNotNull(), F.col("pos"))) if kind == "last" else _fold(kind, F.col(col)))
            .alias(f"carry_{name}")
            for name, (kind, col) in specs.items()
        ]
    )
    earlier = Window.partitionBy(*group).orderBy(*in_order(["block"])).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns(
        {
            f"carry_{name}": (
                F.last(f"carry_{name}", ignorenulls=True) if kind == "last" else _MERGE[kind](f"carry_{name}")
            ).over(earlier)
            for name, (kind, _) in specs.items()
        }
    )
    renames = {name: f"of_{name}" for name in (*group, "block")}
    carry = carry.withColumnsRenamed(renames)
    match = F.lit(True)
    for name in renames:
        match = match & F.col(name).eqNullSafe(F.col(f"of_{name}"))
    joined = local.join(carry, match, "left")
    merged = {}
    for name, (kind, _) in specs.items():
        here, there = F.col(name), F.col(f"carry_{name}")
        if kind == "count":
            merged[name] = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        elif kind == "sum":
            merged[name] = F.when(here.isNull(), there).when(there.isNull(), here).otherwise(here + there)
        elif kind == "last":
            merged[name] = F.coalesce(here, there)
        elif kind == "max":
            merged[name] = F.when(here.isNull() | (there > here), there).otherwise(here)
        else:
            merged[name] = F.when(here.isNull() | (there < here), there).otherwise(here)
    dropped = [*renames.values(), *[f"carry_{name}" for name in specs]]
    return log.with_events(joined.withColumns(merged).drop(*dropped))
