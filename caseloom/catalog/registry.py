"""Registry of queries: inventory ids, Spark form, SQL form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    survey: tuple[str, ...]
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, survey: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, tuple(survey.split()), run, sql)
        return run

    return register


def r6(col: str | Column) -> Column:
    """Double rounded to 6 places."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), 6)


def joined(col: str | Column, sep: str = ">") -> Column:
    """List of labels as one text, null shown as ~."""
    return F.array_join(col, sep, "~")


def joined6(col: str | Column, sep: str = ">") -> Column:
    """List of numbers as one text in millionths, null shown as ~."""
    arr = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(arr, lambda x: F.round(x * 1e6).cast("long").cast("string")), sep, "~")


def i64(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def r6up(col: str | Column) -> Column:
    """Like :func:`r6` for averages: exact halves of the sixth place always round up."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double") + 1e-9, 6)
