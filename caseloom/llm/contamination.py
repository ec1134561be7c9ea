"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window of an item is 10 consecutive words of it; an item of fewer words is one
window. Seen as a set, a window is its shingles of 3 words (fewer in a shorter
window), and a document holds the window only if it holds all of them. So with
shingles ordered by rarity over all documents the prefix that a containment of 1
needs is one shingle: the rarest. A window with a shingle that no document has is
out. Documents meet windows on those prefix shingles; a place counts if the window
fits between the document's first and last word (position and length), and its
words equal the window's, one by one.

Words are maximal runs of digits, a-z and characters beyond ASCII, after
lower-casing A-Z. Null texts have no words; nor does an item without words have
windows. Rows of one item_id are one item, a null item_id counts as the empty
text. Equal texts are settled once. Empty tables give no rows, or no hits.

The window tables are broadcast while they are small by count; a larger benchmark
meets only positions that a bitmap of its prefix shingles lets through, by a
shuffle, each position with the words around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.exact import _bit, _cells, lower_ascii
from caseloom.llm.tables import cut, fresh, join_groups, stored, text_of

WINDOW = 10
SHINGLE = 3
#: windows (some 300 bytes each) and shingles (16 bytes each) that are broadcast at most
BROADCAST_WINDOWS = 200_000
BROADCAST_SHINGLES = 2_000_000

#: what lies between words, once A-Z is lower-cased
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(lower_ascii(text), GAP), "")


def _key(words: str, at: str, size: int) -> Column:
    """Hash of ``size`` words from position ``at``."""
    return F.xxhash64(F.lit(size), *[F.get(words, F.col(at) + i) for i in range(size)])


def windows_of(items: DataFrame, shingle: int) -> DataFrame:
    """(win, length, offset, size, key): every shingle of every distinct window."""
    wins = items.select("win").distinct().withColumn("ws", F.split("win", " ")).withColumn("length", F.size("ws"))
    wins = wins.withColumn("size", F.least(F.col("length"), F.lit(shingle)))
    places = wins.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))).alias("offset"))
    by_size = F.when(F.lit(False), F.lit(0).cast("long"))
    for n in range(1, shingle + 1):
        by_size = by_size.when(F.col("size") == n, _key("ws", "offset", n))
    return places.select("win", "length", "offset", "size", by_size.alias("key"))


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item, win): the distinct windows of every item, words joined by blanks."""
    words = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), words_of(text_of(items, text)).alias("ws"))
    words = words.where(F.size("ws") > 0).withColumn("length", F.least(F.size("ws"), F.lit(window)))
    at = words.select("*", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("length") + 1)).alias("at"))
    return at.select("item", F.concat_ws(" ", F.slice("ws", F.col("at"), F.col("length"))).alias("win")).distinct()


def positions(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(uid, ws, pos, key): every shingle of every text, of the given sizes."""
    # the outer form adds no second reading of the words as a filter below it
    at = texts.select("uid", "ws", F.posexplode_outer("ws").alias("pos", "first")).drop("first")
    fits = [F.when(F.col("pos") + n <= F.size("ws"), _key("ws", "pos", n)) for n in sizes]
    if len(fits) == 1:
        return at.withColumn("key", fits[0]).where("key is not null")
    return at.withColumn("key", F.explode(F.array(*fits))).where("key is not null")


def _let_through(at: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """Positions whose key may be among ``keys``, by a bitmap with 16 bits a key."""
    blocks = max(1, -(-total * 16 // (1 << 15)))
    block, places = _cells(F.col("key"), blocks)
    cells = keys.select(block.alias("b"), F.explode(F.array(*[p.cast("long") for p in places])).alias("p"))
    bits = cells.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    if blocks <= 1 << 14:
        bits = F.broadcast(bits)
    found = at.withColumn("b", block).join(bits, "b")
    for place in places:
        found = found.where(_bit(F.col("bits"), place))
    return found.drop("b", "bits")


def occurrences(texts: DataFrame, items: DataFrame, window: int, shingle: int, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """(uid, start, length, win): every place of a text where a window occurs."""
    shingles = stored(windows_of(items, shingle), "window-shingles")
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())
    if not sizes:
        return texts.select("uid", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("win")).where(F.lit(False))
    at = positions(texts, sizes)
    keys = cut(shingles.select("key").distinct())
    few = keys.count() <= BROADCAST_SHINGLES
    counts = at.select("key").join(F.broadcast(keys) if few else keys, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    ordered = shingles.join(cut(counts), "key", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    rarest = ordered.groupBy("win", "length").agg(F.min(F.struct("uses", "key", "offset")).alias("r")).where("r.uses > 0")
    prefixes = cut(rarest.select(F.col("r.key").alias("key"), F.col("r.offset").alias("offset"), "length", "win"))
    total = prefixes.count()
    if total <= most:
        met = at.join(F.broadcast(prefixes), "key")
        start, before = F.col("pos") - F.col("offset"), F.lit(0)
    else:
        near = _let_through(at, prefixes.select("key").distinct(), total)
        low = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        near = near.select("uid", "pos", "key", low.alias("low"), F.slice("ws", low + 1, F.lit(2 * window)).alias("ws"))
        met = near.join(prefixes, "key")
        start, before = F.col("pos") - F.col("offset"), F.col("low")
    fits = (start >= 0) & (start - before + F.col("length") <= F.size("ws"))
    same = F.concat_ws(" ", F.slice("ws", F.when(fits, start - before + 1).otherwise(1), F.col("length"))) == F.col("win")
    return met.where(fits & same).select("uid", start.alias("start"), "length", "win")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most: int = BROADCAST_WINDOWS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    body, ws = text_of(docs, text), words_of(text_of(docs, text))
    whole = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.sha2(body, 256).alias("uid"), F.size(ws).cast("long").alias("n_words"), F.array_join(ws, " ").alias("body")
    )
    whole = stored(whole, "texts")
    rows, texts = whole.drop("body"), whole.where("n_words > 0").select("uid", F.split("body", " ").alias("ws"))
    items = stored(item_windows(benchmark, window, item_id, item_text), "windows")
    found = occurrences(texts, items, window, shingle, most)
    # copies of a text and windows at one place fold before they shuffle
    places = stored(found.groupBy("uid", "win", "start").agg(F.max("length").alias("length")), "occurrences")
    spans = places.groupBy("uid", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    earlier = F.max("end").over(Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.col("earlier"), F.lit(0))), F.lit(0))
    hit = spans.withColumn("earlier", earlier).groupBy("uid").agg(F.sum(new).alias("n_hit"))
    held = places.select("uid", "win").distinct().join(items, "win").select("uid", "item").distinct()
    held = held.groupBy("uid").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    size = fresh("size")
    sizes = rows.groupBy("uid").agg(F.count(F.lit(1)).alias(size))
    groups = stored(sizes.join(hit, "uid", "left").join(held, "uid", "left"), "contaminated")
    out = join_groups(rows, groups, "uid", size, rows.count())
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(len(w), 10) AS l FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item, l, array_to_string(w[s:s + l - 1], ' ') AS win
  FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM b)),
places AS (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT l FROM wins) WHERE len(w) >= l),
hits AS (
  SELECT DISTINCT rid, s, p.l, item FROM (SELECT rid, l, s, array_to_string(w[s:s + l - 1], ' ') AS win FROM places) p
  JOIN wins ON p.l = wins.l AND p.win = wins.win),
spans AS (SELECT DISTINCT rid, s, l FROM hits),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + l)) AS p FROM spans) GROUP BY rid),
held AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN held USING (rid)
"""
