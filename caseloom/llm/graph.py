"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import join_groups, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node on an edge; label is the least node it is joined to.

    In each round a node moves to the first of itself and its neighbours, in the
    order of their hashes; edges follow both their ends, and those whose ends have met
    drop out. Stars meet in two rounds, chains shrink by a fixed share a round. The
    state is written between rounds; nodes of many edges are joined apart.
    """
    order = lambda c: F.struct(F.xxhash64(c, F.lit(1)).alias("h"), F.col(c).alias("n"))
    pairs = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while left := pairs.count():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = both.groupBy("a").agg(F.min(order("b")).alias("first"), F.count(F.lit(1)).alias("uses"))
        moves = stored(moves.select(F.col("a").alias("node"), F.least("first", order("a")).getField("n").alias("to"), "uses"), "moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("label"))
        else:
            here = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
            here = stored(here.join(moves.select(F.col("node").alias("label"), "to"), "label", "left"), "members")
            labels = join_groups(labels, here, "label", "members", total).select("node", F.coalesce("to", "label").alias("label"))
        labels = stored(labels, "labels")
        total = labels.count()
        for end in ("a", "b"):
            ends = moves.select(F.col("node").alias(end), F.col("to").alias("to_" + end), "uses")
            pairs = join_groups(pairs, ends, end, "uses", 2 * left).drop("uses")
        pairs = pairs.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        pairs = stored(pairs, "edges")
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    groups = stored(labels.groupBy("label").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("members")), "groups")
    return join_groups(labels, groups, "label", "members", total).select("node", F.col("least").alias("label"))
