"""Cases, prefixes, windows and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.arrays import visible
from caseloom.functions.text import EOS
from caseloom.operators.ordering import CASE, EventLog, around, join_cases
from caseloom.session import block_size, cut

SPLIT_SEED = 17
VAL_SHARE = 0.15
TEST_SHARE = 0.2


def first_static(name: str, keep_eos: bool = False) -> Column:
    """First non-null value of a case in event order, ignoring the end marker."""
    ok = F.col(name).isNotNull()
    if not keep_eos:
        ok = ok & (F.col(name).cast("string") != EOS)
    return F.min_by(F.col(name), F.when(ok, F.col("pos")))


def static_values(log: EventLog, columns: Sequence[str], keep_eos: bool = False) -> DataFrame:
    """One row per case with its static values."""
    return log.events.groupBy(CASE).agg(*[first_static(c, keep_eos).alias(c) for c in columns])


def case_rows(log: EventLog, columns: Sequence[str]) -> DataFrame:
    """Ordered lists, one row per ``(case_id, segment)``: segment s holds the events of block s, so no row outgrows a block."""
    item = F.struct("pos", *columns)
    lists = log.events.groupBy(CASE, F.col("block").alias("segment")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return lists.select(CASE, "segment", *[F.col(f"items.{c}").alias(c) for c in columns])


def last_rows(log: EventLog, columns: Sequence[str], count: int) -> DataFrame:
    """One row per case, of any length: ordered lists of its last ``count`` events."""
    sizes = log.events.groupBy(CASE).agg(F.max("pos").alias("_n"))
    block = ["block"] if "block" in log.events.columns else []
    ends = join_cases(log.events.select(CASE, "pos", *block, *columns), sizes, log.spans).where(F.col("pos") > F.col("_n") - count)
    lists = ends.groupBy(CASE).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("items"))
    return lists.select(CASE, *[F.col(f"items.{c}").alias(c) for c in columns])


def add_end_rows(log: EventLog, count: int) -> EventLog:
    """Append ``count`` end rows to every case; other attributes are null on them."""
    block = log.block
    ends = (
        log.events.where(F.col("pos") == F.col("n"))
        .select(CASE, "n", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("step"))
        .select(
            CASE,
            (F.col("n") + F.col("step")).alias("pos"),
            F.col("n"),
            F.floor((F.col("n") + F.col("step") - 1) / F.lit(block)).cast("long").alias("block")
            if log.spans
            else F.lit(0).cast("long").alias("block"),
            F.lit(EOS).alias("activity"),
            *[F.lit(EOS).alias(c) for c in log.dyn_cat],
        )
    )
    both = log.events.unionByName(ends, allowMissingColumns=True)
    extended = both.withColumn("n", F.col("n") + count)
    return EventLog(
        extended, ("pos",), log.spans, log.dyn_cat, log.dyn_num, log.sta_cat, log.sta_num
    )


def global_row_number(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Row numbers over the whole table.

    A table within the block size uses one window; a larger one is range
    partitioned, numbered per partition and shifted by the sizes before.
    """
    total = df.count()
    block = block_size(df.sparkSession)
    if total <= block:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    chunks = -(-total // block)
    ranged = cut(df.repartitionByRange(chunks, *order).withColumn("chunk", F.spark_partition_id()))
    sizes = ranged.groupBy("chunk").count()
    before = sizes.select(
        F.col("chunk"),
        F.coalesce(
            F.sum("count").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    local = F.row_number().over(Window.partitionBy("chunk").orderBy(*order))
    return (
        ranged.withColumn("local", local)
        .join(before, "chunk")
        .withColumn(out, (F.col("before") + F.col("local")).cast("long"))
        .drop("chunk", "before", "local")
    )


def split_cases(
    events: DataFrame, seed: int = SPLIT_SEED, val: float = VAL_SHARE, test: float = TEST_SHARE
) -> DataFrame:
    """Each case once with its split: ranks of a seeded hash, cut at exact sizes."""
    cases = events.select(CASE).distinct().withColumn(
        "draw", F.md5(F.concat_ws("|", F.col(CASE), F.lit(str(seed))))
    )
    ranked = global_row_number(cases, ["draw", CASE], "rank")
    total = ranked.agg(F.count(F.lit(1)).alias("cases")).first()["cases"]
    n_val, n_test = int(val * total), int(test * total)
    return ranked.select(
        CASE,
        F.when(F.col("rank") <= n_val, "val")
        .when(F.col("rank") <= n_val + n_test, "test")
        .otherwise("train")
        .alias("split"),
    )


def with_split(log: EventLog, splits: DataFrame) -> EventLog:
    """Attach the split; hot cases meet their split per block."""
    return log.with_events(join_cases(log.events, splits, log.spans))


def only_split(log: EventLog, *names: str) -> EventLog:
    return log.with_events(log.events.where(F.col("split").isin(*names)))


def window_size(log: EventLog, min_suffix: int, with_end_rows: bool = True) -> int:
    """Rounded 0.985 quantile of the case lengths (with end rows) plus ``min_suffix``."""
    lengths = log.events.where(F.col("pos") == 1).select(
        (F.col("n") + (min_suffix if with_end_rows else 0)).alias("len")
    )
    row = lengths.agg(F.bround(F.percentile("len", F.lit(0.985))).alias("w")).first()
    return int(row["w"] or 0) + min_suffix


def prefix_rows(
    log: EventLog, columns: Sequence[str], window: int, statics: Sequence[str] = (), keep_block: bool = False
) -> DataFrame:
    """Every prefix 1..n with the last ``window`` values of each column.

    ``keep_block`` leaves the block in, for a later join with one row per case.
    """

    def collect(df: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-(window - 1), 0)
        item = F.struct("pos", *[F.col(c).alias(f"item_{c}") for c in columns])
        return df.withColumn("items", F.collect_list(item).over(frame))

    rows = around(log, collect, before=window - 1).events.select(
        CASE,
        "block",
        F.col("pos").alias("prefix_len"),
        *[F.col(f"items.item_{c}").alias(c) for c in columns],
    )
    if statics:
        rows = join_cases(rows, static_values(log, statics), log.spans)
    return rows if keep_block else rows.drop("block")


def window_rows(log: EventLog, columns: Sequence[str], window: int, min_suffix: int) -> DataFrame:
    """One window per event: prefixes of length min_suffix+1 .. n+min_suffix of the case with end rows."""
    ended = add_end_rows(log, min_suffix)
    rows = prefix_rows(ended, columns, window)
    return rows.where(F.col("prefix_len") > min_suffix)


def complete_cases(log: EventLog, window: int, min_suffix: int, columns: Sequence[str] = ("activity",)) -> DataFrame:
    """The last ``window - min_suffix`` events of every case as lists: bounded rows for any case."""
    keep = window - min_suffix
    recent = log.events.where(F.col("pos") > F.col("n") - keep)
    lists = recent.groupBy(CASE).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("items"))
    return lists.select(CASE, *[F.col(f"items.{c}").alias(c) for c in columns])


def prefix_suffix_pairs(log: EventLog, window: int, min_suffix: int, extra: Sequence[str] = ()) -> DataFrame:
    """Cuts 1..m-1 of each complete case: prefix, non-empty suffix, carried attribute lists."""
    whole = complete_cases(log, window, min_suffix, ("activity", *extra))
    cuts = F.when(F.size("activity") > 1, F.sequence(F.lit(1), F.size("activity") - 1))
    return (
        whole.withColumn("prefix_len", F.explode(cuts))
        .select(
            CASE,
            "prefix_len",
            F.slice("activity", F.lit(1), F.col("prefix_len")).alias("prefix"),
            F.slice("activity", F.col("prefix_len") + 1, F.size("activity")).alias("target_suffix"),
            *[F.slice(c, F.lit(1), F.col("prefix_len")).alias(c) for c in extra],
        )
    )


def next_event_rows(log: EventLog) -> EventLog:
    """Each event with the activity that follows it, the end marker for the last one."""
    return around(
        log,
        lambda df, w: df.withColumn("next_activity", F.coalesce(F.lead("activity").over(w), F.lit(EOS))),
        after=1,
    )


def supervised_prefixes(windows: DataFrame, column: str = "activity") -> DataFrame:
    """Windows with at most two end markers."""
    return windows.where(F.size(F.filter(column, lambda x: x == EOS)) <= 2)


def visible_labels(windows: DataFrame, column: str = "activity") -> DataFrame:
    return windows.withColumn(column, visible(F.col(column)))


def choose_prefixes(rows: DataFrame, chosen: DataFrame, keys: Sequence[str] = (CASE, "prefix_len")) -> DataFrame:
    """Only the listed prefix rows."""
    return rows.join(chosen.select(*keys), list(keys), "left_semi")


def report_filter(rows: DataFrame, max_prefix_len: int, min_support: int) -> DataFrame:
    """Prefix lengths up to a limit that enough rows share."""
    kept = rows.where(F.col("prefix_len") <= max_prefix_len)
    support = kept.groupBy("prefix_len").agg(F.count(F.lit(1)).alias("support"))
    return support.where(F.col("support") >= min_support)
