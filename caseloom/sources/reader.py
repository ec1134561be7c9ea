"""Read, standardise and write event logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.text import strip_by_suffix
from caseloom.session import scratch_path


@dataclass(frozen=True)
class LogColumns:
    """Declared column roles of a log and the pattern of its timestamps."""

    case: str
    activity: str
    timestamp: str
    pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    resource: str | None = None


def no_nan(df: DataFrame) -> DataFrame:
    """Missing values have one form: NaN becomes null."""
    fixes = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def parse_time(col: str | Column, pattern: str) -> Column:
    """Timestamp in the log's own format; what cannot be parsed is null."""
    return F.try_to_timestamp(F.col(col) if isinstance(col, str) else col, F.lit(pattern))


def read_csv_log(spark: SparkSession, path: str, schema: T.StructType, columns: LogColumns) -> DataFrame:
    """CSV scan with a declared schema, timestamps parsed on read."""
    raw = spark.read.csv(path, header=True, schema=schema)
    return no_nan(raw).withColumn(columns.timestamp, parse_time(columns.timestamp, columns.pattern))


def read_parquet_log(spark: SparkSession, path: str, columns: LogColumns) -> DataFrame:
    """Parquet scan; a zone-less timestamp is read as UTC."""
    raw = no_nan(spark.read.parquet(path))
    return raw.withColumn(columns.timestamp, F.col(columns.timestamp).cast("timestamp"))


def standardise(
    df: DataFrame, columns: LogColumns, keep: DataFrame | None = None, parse: bool = False
) -> DataFrame:
    """Canonical case, activity and time names, restricted to the cases in ``keep``."""
    names = {columns.case: "case_id", columns.activity: "activity", columns.timestamp: "ts"}
    if columns.resource:
        names[columns.resource] = "resource"
    out = df.withColumnsRenamed(names).withColumn("case_id", F.col("case_id").cast("string"))
    if parse:
        out = out.withColumn("ts", parse_time("ts", columns.pattern))
    out = out.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return out if keep is None else out.join(keep.select("case_id"), "case_id", "left_semi")


def case_ids(df: DataFrame, case: str = "case_id") -> DataFrame:
    """Distinct non-null case ids of a table."""
    return df.where(F.col(case).isNotNull()).select(F.col(case).cast("string").alias("case_id")).distinct()


def write_by_split(df: DataFrame, path: str) -> str:
    """One directory per split, so that a reader of one split skips the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def write_table(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a stored result; another column set or type is an error."""
    found = spark.read.parquet(path)
    have = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in schema.fields}
    if have != want:
        raise TypeError(f"{path} holds {have}, expected {want}")
    return found.select(*want)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and continue from the written copy."""
    path = write_table(df, scratch_path(df.sparkSession, name))
    return read_table(df.sparkSession, path, df.schema)


def clean_log(df: DataFrame, activity: str, path: str) -> str:
    """Write the log with cleaned activity labels, always rebuilt from ``df``."""
    return write_table(df.withColumn(activity, strip_by_suffix(F.col(activity))), path)


def pick_attributes(df: DataFrame, attributes: Sequence[str], keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Only the wanted attributes: absent ones null, integers as text."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for name in attributes:
        if name not in kinds:
            cols.append(F.lit(None).cast("string").alias(name))
        elif isinstance(kinds[name], whole):
            cols.append(F.col(name).cast("string").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*keys, *cols)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project to the columns a scorer needs; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)
