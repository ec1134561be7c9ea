"""N-gram Jaccard join with Bayesian pruning of candidates.

A text is the set of its five-word shingles (A-Z in lower case, words split at
ASCII white space; a text of fewer words is one shingle; one without words has
none and links to nothing). Two texts are linked when their sets' Jaccard
similarity is at least 0.8.

1. One pass gives each text a digest of its set and 240 MinHash values. Equal sets
   make one class, whose copies are never paired.
2. Classes that agree on one of 40 bands of six values are candidates. A band's
   classes are joined to its least class only, its leader. A class goes to the least
   of its leaders, and connected components of the leaders hold every candidate
   pair. A pair at exactly 0.8 is missed with probability 5e-6, a closer one with less.
3. Within a component, blocks of classes meet. For each pair MinHash values are
   compared 48 at a time; the pair is dropped as soon as the posterior probability
   (uniform prior) that its similarity reaches 0.8 falls below 1e-6. The rest are
   verified on the whole sets. A task gives counts and a spanning forest, no pairs.

Result, one row per input row: doc_id; class_id, the least doc_id it is linked
to directly or through others; set_id, the least doc_id with the same set;
n_links, how many other rows are at least 0.8 similar. Rows that repeat count as
copies. Rows with null ids are compared too; ids ignore null when another exists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.graph import components
from caseloom.llm.spans import LOWER, mix64, rows_of, slices, span_hashes, text_bytes, words
from caseloom.llm.tables import fresh, join_groups, lean, stored, text_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
STEP, TOLERANCE = 48, 1e-6
BLOCK = 256

_ODD = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FOLD = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, in order, and where each row's begin."""
    data = LOWER[data]
    starts, ends = words(data, off)
    h = span_hashes(data, starts, ends)
    n = np.bincount(rows_of(starts, off), minlength=len(off) - 1)
    first = np.cumsum(n) - n
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    room = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(n)), size)
    at = np.arange(int(room[-1])) - room[row] + first[row]
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        inside = k < n[row] if (n < SHINGLE).any() else slice(None)
        out[inside] += h[at[inside] + k] * _FOLD[k]
    return mix64(out), room


def signatures(sets: np.ndarray, room: np.ndarray) -> np.ndarray:
    """MinHash values of each row, 16 bits each: (row, HASHES). Rows without shingles get zeros."""
    out = np.zeros((len(room) - 1, HASHES), dtype=np.uint16)
    short = (sets >> np.uint64(32)).astype(np.uint32)
    for a, b in slices(room, 1 << 15):
        rows = np.flatnonzero(room[a + 1 : b + 1] > room[a:b]) + a
        if not len(rows):
            continue
        part, at = short[room[a] : room[b]], room[rows] - room[a]
        for k in range(HASHES):
            least = np.minimum.reduceat(part * _ODD[k], at)
            out[rows, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def distinct_sets(sets: np.ndarray, room: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(len(room) - 1):
        yield np.unique(sets[room[k] : room[k + 1]])


def sketches(rows: DataFrame) -> DataFrame:
    """uid, doc_id, key (digest of the set), n (shingles), sig; rows without words have n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(2))
            for a, b in slices(off):
                sets, room = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
                each = list(distinct_sets(sets, room))
                sig = signatures(sets, room)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(np.array([int(mix64(s).sum()) + len(s) & (1 << 64) - 1 for s in each], dtype=np.uint64).astype(np.int64)),
                        pa.array([len(s) for s in each], pa.int32()),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                    ],
                    ["uid", "doc_id", "key", "n", "sig"],
                )

    return rows.mapInArrow(lean(run), "uid long, doc_id long, key long, n int, sig binary")


def least_matches() -> list[tuple[int, int]]:
    """(values compared, matches needed) so that the posterior of reaching the threshold keeps the tolerance.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        out.append((n, m))
    return out


def links_of(sig: np.ndarray, n: np.ndarray, sets: list[np.ndarray], left: int, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the first ``left`` members, the members linked to it: later ones if ``same``, else those of the second block."""
    needed = least_matches()
    flat = np.concatenate(sets)
    room = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    for i in range(left):
        low = i + 1 if same else left
        at = np.arange(low, len(n))
        at = at[(n[at] >= THRESHOLD * n[i] - 1e-9) & (n[i] >= THRESHOLD * n[at] - 1e-9)]
        matches, done = np.zeros(len(at), dtype=np.int64), 0
        for upto, least in needed:
            if not len(at):
                break
            matches += (sig[at, done:upto] == sig[i, done:upto]).sum(axis=1)
            done = upto
            at, matches = at[matches >= least], matches[matches >= least]
        if not len(at):
            continue
        if 4 * len(at) > len(n) - low:
            lo, hi = room[at[0]], room[at[-1] + 1]
            place = np.minimum(np.searchsorted(sets[i], flat[lo:hi]), len(sets[i]) - 1)
            hits = np.concatenate(([0], np.cumsum(sets[i][place] == flat[lo:hi])))
            inter = hits[room[at + 1] - lo] - hits[room[at] - lo]
        else:
            inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in at])
        # inter / union >= 4/5, in whole numbers
        yield i, at[5 * inter >= 4 * (n[i] + n[at] - inter)]


def block_links(blocks: DataFrame) -> DataFrame:
    """Verified links of each class within its pair of blocks: key, docs linked, a member of the same tree."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["comp"], row["i"], row["j"])
                if now != key and held:
                    yield held
                    held = []
                key = now
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            same = group[0]["i"] == group[0]["j"]
            group.sort(key=lambda r: (r["side"], r["key"]))
            left = len(group) if same else sum(r["side"] == 0 for r in group)
            sig = np.stack([np.frombuffer(r["sig"], dtype=np.uint16) for r in group])
            sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in group]
            size = np.array([r["size"] for r in group], dtype=np.int64)
            keys = np.array([r["key"] for r in group], dtype=np.int64)
            docs = np.zeros(len(group), dtype=np.int64)
            root = np.arange(len(group))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = int(root[x])
                return x

            for i, others in links_of(sig, np.array([len(s) for s in sets]), sets, left, same):
                docs[i] += size[others].sum()
                docs[others] += size[i]
                for j in others.tolist():
                    p, q = find(i), find(j)
                    if p != q:
                        root[max(p, q)] = min(p, q)
            trees = np.array([find(x) for x in range(len(group))])
            used = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays([pa.array(keys[used]), pa.array(docs[used]), pa.array(keys[trees[used]])], ["key", "docs", "tree"])

    return blocks.mapInArrow(lean(run), "key long, docs long, tree long")


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, set_id, n_links (and uid, the row's own hash; stays, the uid of its linked group's first row).

    The first row has the least (doc_id, uid), null ids last: an id alone may name several rows, in several groups.
    """
    rows = docs.select(F.xxhash64(F.col(doc_id), text_of(docs, text)).alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    marked = stored(sketches(rows), "sketches")
    total = marked.count()
    worded = marked.where("n > 0")
    classes = stored(
        worded.groupBy("key").agg(
            F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("size"), F.min("uid").alias("uid"), F.first("sig").alias("sig"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("head"),
        ), "classes",
    )
    # candidate components
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring("sig", j * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    held = stored(classes.select("key", F.explode(bands).alias("band")), "bands")
    shared = held.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("uses")).where("least <> most")
    met = join_groups(held, stored(shared.select("band", "least", "uses"), "shared"), "band", "uses", held.count())
    # a class goes to the least of its bands' leaders; leaders are joined to each other, not classes
    near = met.groupBy("key").agg(F.collect_set("least").alias("leaders")).withColumn("first", F.array_min("leaders"))
    near = stored(near, "leaders")
    leaders = components(near.select(F.explode("leaders").alias("a"), F.col("first").alias("b")).where("a <> b").distinct())
    firsts = near.groupBy("first").agg(F.count(F.lit(1)).alias("uses"))
    firsts = stored(firsts.join(leaders.withColumnRenamed("node", "first"), "first", "left"), "firsts")
    comps = join_groups(near.select("key", "first"), firsts, "first", "uses", near.count()).select("key", F.coalesce("label", "first").alias("comp"))
    comps = stored(comps, "components")
    # blocks of each component
    sizes = stored(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members")), "sizes")
    comps = join_groups(comps, sizes, "comp", "members", comps.count()).select("key", "comp", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts"))
    chosen = comps.join(classes, "key").select("key", "comp", "parts", "size", "uid", "sig")
    sets = with_sets(chosen, rows.select("uid", "text"))
    spot = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    dealt = sets.withColumn("spot", spot).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "comp", F.least("spot", "other").alias("i"), F.greatest("spot", "other").alias("j"),
        F.when(F.col("spot") <= F.col("other"), 0).otherwise(1).alias("side"), "key", "size", "sig", "shingles",
    )
    found = stored(block_links(dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")), "links")
    trees = components(found.where("key <> tree").select(F.col("key").alias("a"), F.col("tree").alias("b")))
    links = found.groupBy("key").agg(F.sum("docs").alias("docs"))
    # back to the documents
    info = classes.select("key", "set_id", "size", "head").join(links, "key", "left").join(trees.withColumnRenamed("node", "key"), "key", "left")
    info = info.withColumn("label", F.coalesce("label", "key"))
    least = info.groupBy("label").agg(F.min("set_id").alias("class_id"), F.min("head").getField("uid").alias("stays"))
    info = stored(
        info.join(least, "label").select("key", "set_id", "class_id", "stays", "size", (F.coalesce("docs", F.lit(0)) + F.col("size") - 1).alias("n_links")), "classes"
    )
    out = join_groups(worded.select("doc_id", "uid", "key"), info, "key", "size", total).select("doc_id", "class_id", "set_id", "n_links", "uid", "stays")
    empty = marked.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_links"), "uid", F.col("uid").alias("stays"))
    return out.unionByName(empty)


def with_sets(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """Add each class's shingle set, from the text of one of its rows."""
    columns = [c for c in chosen.columns if c != "uid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(len(columns)))
            for a, b in slices(off):
                sets = distinct_sets(*shingles(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[: len(columns)]), pa.array([s.tobytes() for s in sets], pa.binary())], [*columns, "shingles"]
                )

    one = chosen.join(texts, "uid").select(*columns, "text")
    kinds = dict(chosen.dtypes)
    # rows equal in id and text give equal sets: one of them will do
    return one.mapInArrow(lean(run), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", shingles binary").dropDuplicates(["key"])


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least (id, hash of id and text) of each linked group stays, all columns, null ids last; rows equal in id and text share a decision."""
    uid = fresh("uid")
    gone = jaccard_groups(docs, doc_id, text).where("uid <> stays").select(F.col("uid").alias(uid)).distinct()
    marked = docs.withColumn(uid, F.xxhash64(F.col(doc_id), text_of(docs, text)))
    return marked.join(gone, uid, "left_anti").drop(uid)
