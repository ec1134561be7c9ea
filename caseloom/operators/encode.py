"""Vocabularies, scalers, encoded windows and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

from caseloom.functions.arrays import pad_left
from caseloom.functions.text import EOS
from caseloom.operators.cases import add_end_rows, global_row_number, prefix_rows, static_values, window_rows
from caseloom.operators.ordering import CASE, EventLog
from caseloom.session import small

MISSING = "__MISSING__"


def vocabulary(df: DataFrame, column: str, drop_eos: bool = False) -> DataFrame:
    """Sorted distinct labels numbered from 1: ``col, label, id``."""
    labels = df.select(F.col(column).cast("string").alias("label")).where(F.col("label").isNotNull())
    if drop_eos:
        labels = labels.where(F.col("label") != EOS)
    numbered = global_row_number(labels.distinct(), ["label"], "id")
    return numbered.select(F.lit(column).alias("col"), "label", F.col("id").cast("int").alias("id"))


def class_count(df: DataFrame, column: str) -> DataFrame:
    """Number of ids of a column: its labels, a null category if present, and 0."""
    return df.agg(
        F.lit(column).alias("col"),
        (
            F.countDistinct(column)
            + F.coalesce(F.max(F.when(F.col(column).isNull(), 1)), F.lit(0))
            + 1
        ).alias("classes"),
    )


def encode_column(df: DataFrame, column: str, vocab: DataFrame, out: str | None = None) -> DataFrame:
    """Label to id; null and unseen labels are 0."""
    lookup = vocab.where(F.col("col") == column).select(
        F.col("label").alias("vocab_label"), F.col("id").alias("vocab_id")
    )
    joined = df.join(small(lookup), F.col(column) == F.col("vocab_label"), "left")
    return joined.withColumn(out or column, F.coalesce("vocab_id", F.lit(0))).drop("vocab_label", "vocab_id")


def decode_column(df: DataFrame, column: str, vocab: DataFrame, out: str | None = None) -> DataFrame:
    """Id to label; 0 is null."""
    lookup = vocab.where(F.col("col") == column).select(
        F.col("label").alias("vocab_label"), F.col("id").alias("vocab_id")
    )
    joined = df.join(small(lookup), F.col(column) == F.col("vocab_id"), "left")
    return joined.withColumn(out or column, F.col("vocab_label")).drop("vocab_label", "vocab_id")


def scalers(df: DataFrame, columns: Sequence[str], end_rows: int = 0) -> DataFrame:
    """``col, mean, scale`` of mean-imputed columns.

    Imputed rows sit on the mean, so they only widen the divisor; ``end_rows``
    further all-null rows per case are counted without building them.
    """
    stats = df.agg(
        (F.count(F.lit(1)) + end_rows * F.count(F.when(F.col("pos") == 1, 1)) if end_rows else F.count(F.lit(1))).alias("rows"),
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.var_pop(c).alias(f"{c}__var") for c in columns],
        *[F.count(c).alias(f"{c}__count") for c in columns],
    )
    pieces = F.array(
        *[
            F.struct(
                F.lit(c).alias("col"),
                F.col(f"{c}__mean").alias("mean"),
                F.sqrt(F.col(f"{c}__var") * F.col(f"{c}__count") / F.col("rows")).alias("spread"),
            )
            for c in columns
        ]
    )
    return stats.select(F.inline(pieces)).select(
        "col", "mean", F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread")).alias("scale")
    )


def scaler_values(table: DataFrame) -> dict[str, tuple[float, float]]:
    """The scaler table as numbers: one row per declared numeric column."""
    return {r["col"]: (r["mean"], r["scale"]) for r in table.collect()}


def scaled(column: Column, mean: float | None, scale: float | None, impute: bool) -> Column:
    if mean is None or scale is None:
        return F.lit(0.0) if impute else column
    value = F.coalesce(column, F.lit(float(mean))) if impute else column
    return (value - F.lit(float(mean))) / F.lit(float(scale))


def apply_scalers(df: DataFrame, fitted: Mapping[str, tuple[float, float]], impute: bool = False) -> DataFrame:
    """Scale the columns that have a scaler; nulls stay unless imputed."""
    return df.withColumns(
        {c: scaled(F.col(c), m, s, impute) for c, (m, s) in fitted.items() if c in df.columns}
    )


def unapply_scalers(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: F.col(c) * F.lit(float(s)) + F.lit(float(m)) for c, (m, s) in fitted.items() if c in df.columns}
    )


def encoded_events(
    log: EventLog, cats: Sequence[str], nums: Sequence[str], vocab: DataFrame, fitted: Mapping[str, tuple[float, float]]
) -> EventLog:
    """Ids and scaled numbers per event; columns the log lacks count as missing."""
    df = log.events
    for c in cats:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
        df = encode_column(df, c, vocab)
    for c in nums:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    df = apply_scalers(df, {c: fitted[c] for c in nums}, impute=True)
    return log.with_events(df)


def encoded_windows(
    log: EventLog,
    cats: Sequence[str],
    nums: Sequence[str],
    vocab: DataFrame,
    fitted: Mapping[str, tuple[float, float]],
    window: int,
    min_suffix: int,
) -> DataFrame:
    """Padded windows of ids and scaled numbers, one row per event."""
    ended = add_end_rows(log, min_suffix)
    coded = encoded_events(ended, cats, nums, vocab, fitted)
    rows = prefix_rows(coded, [*cats, *nums], window).where(F.col("prefix_len") > min_suffix)
    return rows.withColumns(
        {
            **{c: pad_left(F.col(c), window, F.lit(0)) for c in cats},
            **{c: pad_left(F.col(c), window, F.lit(0.0)) for c in nums},
        }
    )


def encoded_statics(
    log: EventLog,
    cats: Sequence[str],
    nums: Sequence[str],
    vocab: DataFrame,
    fitted: Mapping[str, tuple[float, float]],
) -> DataFrame:
    """One row per case: static ids (end marker and null are 0) and scaled numbers."""
    df = static_values(log, [*cats, *nums])
    for c in cats:
        df = encode_column(df, c, vocab)
    return apply_scalers(df, {c: fitted[c] for c in nums}, impute=True)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, mean and sample deviation per column; zeros when empty."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("col"),
                F.coalesce(F.min(c), F.lit(0.0)).alias("min"),
                F.coalesce(F.max(c), F.lit(0.0)).alias("max"),
                F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"),
                F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
            ).alias(f"p{i}")
            for i, c in enumerate(columns)
        ]
    )
    return stats.select(F.inline(F.array(*[f"p{i}" for i in range(len(columns))])))


def category_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every category of every column, one row each."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("label")) for c in columns])
    )
    return df.select(pairs.alias("x")).select("x.col", "x.label").where(F.col("label").isNotNull()).distinct()


def clean_value(column: Column) -> Column:
    """A feature value as text, null kept."""
    return column.cast("string")


def feature_encoder(cats: Sequence[str], nums: Sequence[str], out: str = "features") -> Pipeline:
    """One-hot categories with a level for missing values, numbers with 0 for missing.

    Fit on the output of :func:`ready_features`. A level unseen at fit time
    becomes an extra index that the encoder maps to an all-zero vector.
    """
    stages = []
    if cats:
        stages.append(
            StringIndexer(
                inputCols=list(cats),
                outputCols=[f"{c}__idx" for c in cats],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}__idx" for c in cats], outputCols=[f"{c}__hot" for c in cats], dropLast=True
            )
        )
    stages.append(VectorAssembler(inputCols=[*[f"{c}__hot" for c in cats], *nums], outputCol=out))
    return Pipeline(stages=stages)


def ready_features(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in cats},
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in nums},
        }
    )


def window_labels(log: EventLog, window: int, min_suffix: int) -> DataFrame:
    """Label windows, padded with null."""
    rows = window_rows(log, ["activity"], window, min_suffix)
    return rows.withColumn("activity", pad_left(F.col("activity"), window, F.lit(None).cast("string")))
