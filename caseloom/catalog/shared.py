"""Plans that several query modules start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.cases import only_split, split_cases, with_split
from caseloom.operators.flow import Net, align, decisions, directly_follows, net_from_edges
from caseloom.operators.label import label_events
from caseloom.operators.mine import distributions, priors
from caseloom.operators.ordering import EventLog, join_cases, settle
from caseloom.session import cut, small
from caseloom.sources.logs import orders_log


@dataclass
class Mined:
    """A log with its split, net, decision records and prior distributions."""

    log: EventLog
    edges: DataFrame
    net: Net
    records: DataFrame
    priors: DataFrame
    z: DataFrame


def mined_priors(spark, sf_dir, make=orders_log, threshold: float = 0.0) -> Mined:
    """Net from train and validation cases, priors from train cases, records of all cases."""
    log = make(spark, sf_dir)
    log = settle(with_split(log, split_cases(log.events)))
    edges = cut(directly_follows(only_split(log, "train", "val"), threshold))
    net = net_from_edges(edges)
    records = decisions(align(log, edges), net)
    split = log.events.where("pos = 1").select("case_id", "split")
    records = join_cases(records, split, log.spans)
    table = priors(records.where("split = 'train'"))
    return Mined(log, edges, net, records, table, distributions(table))


def with_z(records: DataFrame, z: DataFrame) -> DataFrame:
    return records.join(small(z), "place", "left")


def labelled_log(m: Mined) -> EventLog:
    """Events with the place they decide at; its distribution is joined where rows are written (``m.z``)."""
    return m.log.with_events(label_events(m.log, m.records))


def dist_text(z: str | Column) -> Column:
    """Distribution as text in millionths, labels in order."""
    col = F.col(z) if isinstance(z, str) else z
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(col)),
            lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1e6).cast("long").cast("string")),
        ),
        ",",
    )
