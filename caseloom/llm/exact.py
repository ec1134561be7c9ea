"""Exact dedup: two passes over Bloom cells find rows that may repeat; only those shuffle.

Pass 1 hashes each normalised text to a few cells of a blocked Bloom filter and
counts the cells that at least two rows hit. Those cells become one bitmap per
block. Pass 2 looks every row up: a row with a cell that nothing else hit is
unique for certain and passes straight through; the others are grouped by digest.

Texts are equal when identical after lower-casing A-Z only; null is empty. Of
equal texts the row with the largest id stays (null ids come last). Rows that
repeat with the same id and text count as copies; they carry the same decision.
Empty tables give empty results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import cut, fresh, join_groups, text_of

BLOCK_BITS = 32768
CELLS = 2


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone needs no look at its other letters."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)


def _cells(digest: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(digest), F.lit(blocks))
    places = [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(CELLS)]
    return block, places


def repeat_filter(digests: DataFrame, digest: str, blocks: int) -> DataFrame:
    """Bitmaps of the cells that two or more rows hit: (block, bits)."""
    block, places = _cells(F.col(digest), blocks)
    hit = digests.select(block.alias("block"), F.explode(F.array(*places)).alias("place"))
    twice = hit.groupBy("block", "place").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(place, F.lit(8))) == 1


def mark_possible(rows: DataFrame, digests: DataFrame, digest: str, flag: str, total: int, bits_per_row: int = 16, broadcast_mb: int = 64) -> DataFrame:
    """Add ``flag``: false when the digest certainly occurs once among ``digests``.

    The filter grows with the number of rows. It is broadcast while it has at
    most ``broadcast_mb``; a larger one meets the rows by a shuffle on the block.
    """
    blocks = max(1, -(-total * bits_per_row // BLOCK_BITS))
    block, places = _cells(F.col(digest), blocks)
    key, bits = fresh("block"), fresh("bits")
    bitmaps = repeat_filter(digests, digest, blocks).select(F.col("block").alias(key), F.col("bits").alias(bits))
    if blocks * BLOCK_BITS // 8 <= broadcast_mb << 20:
        bitmaps = F.broadcast(bitmaps)
    held = _bit(F.col(bits), places[0])
    for place in places[1:]:
        held = held & _bit(F.col(bits), place)
    found = rows.withColumn(key, block).join(bitmaps, key, "left")
    return found.withColumn(flag, F.coalesce(held, F.lit(False))).drop(key, bits)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(lower_ascii(text_of(docs, text)), 256).alias("text_sha256")))
    total = rows.count()
    marked = mark_possible(rows, rows.select("text_sha256"), "text_sha256", "maybe", total)
    alone = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    maybe = marked.where("maybe").select("doc_id", "text_sha256")
    groups = cut(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    shared = join_groups(maybe, groups, "text_sha256", "group_size", total)
    return alone.unionByName(shared).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, all columns; of rows equal in id and text too, one stays.

    Rows that occur once never shuffle; the rest shuffle by their digest.
    """
    row, digest, ident = fresh("row"), fresh("digest"), fresh("id")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row),
        F.sha2(lower_ascii(text_of(docs, text)), 256).alias(digest),
        F.col(doc_id).alias(ident),
    )
    digests = cut(packed.select(digest))
    flag = fresh("maybe")
    marked = mark_possible(packed, digests, digest, flag, digests.count())
    alone = marked.where(~F.col(flag)).select(f"{row}.*")
    keepers = marked.where(flag).groupBy(digest).agg(F.max_by(row, F.coalesce(F.col(ident), F.lit(-(1 << 63)))).alias(row))
    return alone.unionByName(keepers.select(f"{row}.*"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
