"""Attach decisions to events and measure the decision models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.arrays import pad_left
from caseloom.functions.distributions import label_rank
from caseloom.functions.text import EOS
from caseloom.operators.cases import add_end_rows, prefix_rows
from caseloom.operators.ordering import CASE, EventLog
from caseloom.session import cut


def label_events(visible: EventLog, records: DataFrame) -> DataFrame:
    """Each event with the last-opened decision that the next event (or the end) resolves.

    ``records`` carry ``place`` and, if wanted, ``z``. Events without one keep nulls.
    """
    extra = [c for c in ("z",) if c in records.columns]
    item = F.struct("ord", "place", *extra)
    ends = visible.events.where(F.col("pos") == F.col("n")).select(CASE, F.col("n").alias("_last"))
    resolved = records.where("resolved_by is not null").select(CASE, F.col("resolved_by").alias("_at"), item.alias("d"))
    ending = records.where("resolved_by is null").join(ends, CASE).select(CASE, F.col("_last").alias("_at"), item.alias("d"))
    # maps cannot be compared, so the choice is by order number alone
    chosen = (
        resolved.unionByName(ending).groupBy(CASE, "_at").agg(F.max_by("d", F.col("d.ord")).alias("d"))
    )
    joined = visible.events.join(
        chosen.withColumnRenamed("_at", "pos"), [CASE, "pos"], "left"
    )
    return joined.withColumns({c: F.col(f"d.{c}") for c in ("place", *extra)}).drop("d")


def label_windows(labelled: EventLog, window: int, min_suffix: int, z: DataFrame | None = None) -> DataFrame:
    """Windows of labels, aligned by position; end markers carry none.

    Distributions come from the events, or, where they depend on the place alone,
    from the table ``z`` (``place, z``): then only places go through the windows,
    and each row carries the table as one map (``by_place``) in place of a list.
    """
    ended = add_end_rows(labelled, min_suffix)
    rows = prefix_rows(ended, ["activity", "place", *([] if z is not None else ["z"])], window)
    rows = rows.where(F.col("prefix_len") > min_suffix)
    if z is None:
        return rows
    item = F.struct("place", "z")
    return rows.join(F.broadcast(cut(z.agg(F.map_from_entries(F.collect_list(item)).alias("by_place")))))


def _position_labels(rows: DataFrame, of: Callable[[Column], Column]) -> tuple[DataFrame, Column]:
    """Per position ``of`` its distribution, null without one; with ``by_place`` worked out once per place."""
    if "by_place" not in rows.columns:
        return rows, F.transform("z", lambda z: F.when(z.isNotNull(), of(z)))
    places = rows.select("by_place").limit(1).select(F.explode("by_place").alias("place", "z"))
    table = cut(places.agg(F.map_from_entries(F.collect_list(F.struct("place", of(F.col("z")).alias("v")))).alias("_of")))
    return rows.join(F.broadcast(table)), F.transform("place", lambda p: F.when(p.isNotNull(), F.col("_of")[p]))


def check_labels(rows: DataFrame) -> DataFrame:
    """Typed label column; a row with another number of labels than positions is an error."""
    rows, z = _position_labels(rows, lambda z: z)
    pairs = F.transform(
        F.arrays_zip(F.col("place"), z.alias("z")), lambda x: F.struct(x["place"].alias("place"), x["z"].alias("z"))
    )
    sized = F.when(F.size("place") == F.size("activity"), pairs).otherwise(
        F.raise_error(F.lit("one decision label per position expected"))
    )
    return rows.withColumn("labels", sized).drop("_of")


def dense_labels(rows: DataFrame, vocab: Sequence[str], window: int, form: Callable[[Column], Column] = lambda row: row) -> DataFrame:
    """Right-aligned probabilities in vocabulary order (each position in the given ``form``) and a 0/1 mask."""
    names = F.array(*[F.lit(x) for x in vocab])
    zero = form(F.array_repeat(F.lit(0.0), len(vocab)))

    def of(z: Column) -> Column:
        return F.struct(
            form(F.transform(names, lambda a: F.coalesce(z[a], F.lit(0.0)))).alias("dense"), F.when(F.size(z) > 0, 1).otherwise(0).alias("mask")
        )

    rows, labels = _position_labels(rows, of)
    dense = F.transform(labels, lambda x: F.coalesce(x["dense"], zero))
    mask = F.transform(labels, lambda x: F.coalesce(x["mask"], F.lit(0)))
    return rows.withColumns(
        {"targets": pad_left(dense, window, zero), "mask": pad_left(mask, window, F.lit(0))}
    ).drop("_of")


def decoder_part(values: Column, window: int, suffix: int) -> Column:
    """Labels at positions T−S−1 .. T−2."""
    return F.slice(values, window - suffix, suffix)


def place_diagnostics(instances: DataFrame) -> DataFrame:
    """Per place: support, top-1, top-3, mean true probability, majority baseline, branches.

    ``instances`` has ``place, z, target``; targets at the case end are left out.
    """
    used = instances.where(
        F.col("place").isNotNull() & F.col("z").isNotNull() & (F.size("z") > 0) & (F.col("target") != EOS)
    )
    rank = label_rank(F.col("z"), F.col("target"))
    scored = used.withColumn("_rank", rank).groupBy("place", "target").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("_rank") == 1, 1)).alias("top1"),
        F.count(F.when((F.col("_rank") >= 1) & (F.col("_rank") <= 3), 1)).alias("top3"),
        F.sum(F.coalesce(F.col("z")[F.col("target")], F.lit(0.0))).alias("true_prob"),
    )
    total = F.sum("n")
    return scored.groupBy("place").agg(
        total.alias("support"),
        (F.sum("top1") / total).alias("top1_accuracy"),
        (F.sum("top3") / total).alias("top3_accuracy"),
        (F.sum("true_prob") / total).alias("mean_true_prob"),
        (F.max("n") / total).alias("majority_baseline"),
        F.count(F.lit(1)).alias("n_branches"),
    )


def weighted_accuracy(diagnostics: DataFrame) -> DataFrame:
    """Support-weighted top-1 and top-3 over all places."""
    total = F.sum("support")
    return diagnostics.agg(
        (F.sum(F.col("top1_accuracy") * F.col("support")) / total).alias("weighted_top1"),
        (F.sum(F.col("top3_accuracy") * F.col("support")) / total).alias("weighted_top3"),
        total.alias("total_support"),
    )


def flag_informative(diagnostics: DataFrame, lift: float = 0.05, min_support: int = 5) -> DataFrame:
    """Places where the model clearly beats the majority branch."""
    gain = F.round(F.col("top1_accuracy") - F.col("majority_baseline"), 4)
    return diagnostics.withColumn("lift_over_majority", gain).withColumn(
        "informative",
        (F.col("n_branches") >= 2) & (F.col("support") >= min_support) & (F.col("lift_over_majority") > lift),
    )


def summarise_logs(flagged: DataFrame) -> DataFrame:
    """One row per log: places, informative places, their share of support, weighted accuracy."""
    total = F.sum("support")
    informative = F.sum(F.when(F.col("informative"), F.col("support")).otherwise(0))
    return flagged.groupBy("log").agg(
        F.count(F.lit(1)).alias("n_places"),
        F.count(F.when(F.col("informative"), 1)).alias("n_informative"),
        F.round(100.0 * informative / total, 1).alias("informative_support_pct"),
        F.round(F.sum(F.col("top1_accuracy") * F.col("support")) / total, 4).alias("weighted_top1"),
        F.round(F.sum(F.col("top3_accuracy") * F.col("support")) / total, 4).alias("weighted_top3"),
        total.alias("total_support"),
    )


def label_coverage(dense: DataFrame) -> DataFrame:
    """Labelled positions over all positions."""
    counts = dense.select(
        F.aggregate("mask", F.lit(0), lambda acc, x: acc + x).alias("hit"), F.size("mask").alias("all")
    )
    return counts.agg(
        F.sum("hit").alias("labelled"),
        F.sum("all").alias("positions"),
        (F.sum("hit") / F.sum("all")).alias("coverage"),
    )
