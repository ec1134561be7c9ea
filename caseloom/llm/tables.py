"""Spark helpers shared by the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from caseloom.session import cut, scratch_path

#: A key with more than one in this many rows is heavy; there are fewer heavy keys than this.
HEAVY_SHARE = 1000


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """Compute a small ``df`` once and keep it on the executors' own disks; parts that are lost with an executor are computed again.

    No files are written: on a local file system Hadoop starts four processes from
    the executor for each. It takes more disk than ``stored`` and the plan is not
    cut, so this is for a few narrow tables, not for rounds or texts.
    """
    df.persist(StorageLevel.DISK_ONLY).count()
    return df


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def remainder(column: str, parts: int) -> Column:
    """crc32 of a column as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back when its task ends.

    Python workers wait for later stages and otherwise keep what they freed.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, safe for groups of any size.

    Groups of more than total / HEAVY_SHARE rows are fewer than HEAVY_SHARE, so
    they are broadcast; what is left joins by shuffle, with no large key in it.
    ``groups`` must be settled: it is read twice.
    """
    limit = max(1, total // HEAVY_SHARE)
    heavy = F.broadcast(groups.where(F.col(size) > limit))
    light = groups.where(F.col(size) <= limit)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


__all__ = ["cut", "fresh", "held", "join_groups", "lean", "remainder", "stored", "text_of"]
