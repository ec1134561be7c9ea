"""Window, padding and mask expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.text import EOS


def last_items(values: Column, window: int) -> Column:
    """The last ``window`` items."""
    return F.slice(values, F.greatest(F.size(values) - window + 1, F.lit(1)), window)


def pad_left(values: Column, window: int, fill: Column) -> Column:
    """Exactly ``window`` items: cut or filled on the left."""
    kept = last_items(values, window)
    return F.concat(F.array_repeat(fill, window - F.size(kept)), kept)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ones_then_zeros(ones: Column, size: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), ones.cast("int")), F.array_repeat(F.lit(0), (size - ones).cast("int")))


def eos_mask(values: Column, eos) -> Column:
    """1 up to and including the first end marker, 0 after it."""
    first = F.array_position(values, eos)
    return _ones_then_zeros(F.when(first > 0, first).otherwise(F.size(values)), F.size(values))


def zero_mask(ids: Column) -> Column:
    """1 from the first position that is not padding."""
    real = F.transform(ids, lambda x: x != 0)
    first = F.array_position(real, True)
    pads = F.when(first > 0, first - 1).otherwise(F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(0), pads), F.array_repeat(F.lit(1), F.size(ids) - pads))


def total(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, x: acc + x)


def prefix_part(values: Column, window: int, suffix: int) -> Column:
    return F.slice(values, 1, window - suffix)


def suffix_part(values: Column, window: int, suffix: int) -> Column:
    return F.slice(values, window - suffix + 1, suffix)


def both_masks(first: Column, second: Column) -> Column:
    return F.zip_with(first, second, lambda a, b: a * b)


def visible(labels: Column) -> Column:
    """Activities without padding and end markers."""
    return F.filter(labels, lambda x: x.isNotNull() & (x != EOS))


def count_eos(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x == EOS))


def upto_eos(labels: Column) -> Column:
    """Items before the first end marker."""
    at = F.array_position(labels, EOS)
    return F.when(at > 0, F.slice(labels, 1, (at - 1).cast("int"))).otherwise(labels)
