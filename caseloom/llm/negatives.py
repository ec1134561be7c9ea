"""Hard negatives: threshold joins of anchors with all rows by pruned inner products.

Components become floor(256 * x). An anchor's positives are its nearest rows of
the same label; a positive's negatives are the nearest rows of another label whose
score lies between 0.8 times and once the positive's score. Both come from joins
"score >= threshold" whose thresholds fall, round by round, until every window is
full or its end is reached.

A join cuts anchors and rows into blocks by a hash; each pair of blocks is one
tile. A tile orders the dimensions by energy and gives each row an inverted index
entry only from the dimension on where the norm of its earlier part, times the
largest norm of the anchors' earlier parts, reaches the threshold: what is left
out cannot reach it alone, and a row without entries is no candidate. Partial scores are added a group of dimensions at a
time, and a pair goes as soon as its score so far plus the product of the
remaining norms is below its anchor's threshold. Scores are sums of integers and
the bounds are rounded upwards, so the answer is exact.

A tile returns per anchor at most ``k`` rows, or ``k`` rows per positive's score,
so nothing grows with a common vector or label.

Rows with a null id, label, vector or component, or a non-finite component, take
no part, and neither do empty vectors and components of 2**18 or more, so that a
score of up to 1,024 dimensions fits a long. Vectors of different lengths are never
compared. Equal rows count once; rows that share an id but differ are anchors and
candidates each, never of their own id. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.tables import cut

ROWS = 4096
ANCHORS = 512
GROUP = 16
#: thresholds for positives, as shares of the largest possible score; the last round has none
LEVELS = (0.5, 0.3, 0.18, 0.09)
#: a threshold for negatives above the window's end, in hundredths of the positive's score
FALLS = (92,)
LARGEST = float(1 << 18)
NONE = np.int64(-1 << 62)
#: an anchor row: its id, and a hash that tells apart rows of one id
ANCHOR = ["anchor_id", "uid"]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """Distinct rows (vec_id, label, v) that take part; v is floor(scale * x)."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct()


def survivors(a: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) with score >= the anchor's threshold, and the scores.

    ``a`` and ``x`` hold integers as doubles; a threshold of ``NONE`` lets all pairs through.
    """
    bound = np.where(least == NONE, -np.inf, least.astype(float))
    order = np.argsort((x * x).sum(axis=0), kind="stable")
    a, x = a[:, order], x[:, order]
    dims = a.shape[1]
    a_norm = np.sqrt(np.concatenate([np.zeros((len(a), 1)), np.cumsum(a * a, axis=1)], axis=1)) * (1 + 1e-9)
    x_norm = np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1)) * (1 + 1e-9)
    # sums beyond 2**53 are rounded: allow for it, and add the survivors anew as integers
    slack = 0.0 if a_norm.max() * x_norm.max() < 1 << 53 else 1e-9
    low_a, low_x = a_norm[:, -1] * slack, x_norm[:, -1]
    # a row is listed from the dimension on by which its earlier part may reach a threshold
    reach = x_norm * a_norm.max(axis=0)[None, :] >= bound.min()
    listed = np.flatnonzero(reach.any(axis=1))
    x_in, n_in = x[listed], x_norm[listed]
    total = np.zeros((len(a), len(listed)))
    i = j = score = None
    for high in range(dims, 0, -GROUP):
        low = max(0, high - GROUP)
        if i is None:
            total += a[:, low:high] @ x_in[:, low:high].T
            alive = total + a_norm[:, low, None] * n_in[None, :, low] + low_a[:, None] * low_x[None, listed] >= bound[:, None]
            if low == 0 or np.count_nonzero(alive) < 0.1 * alive.size:
                i, j = np.nonzero(alive)
                score, j = total[i, j], listed[j]
            continue
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] += np.einsum("ij,ij->i", a[i[part], low:high], x[j[part], low:high])
        keep = score + a_norm[i, low] * x_norm[j, low] + low_a[i] * low_x[j] >= bound[i]
        i, j, score = i[keep], j[keep], score[keep]
    if slack:
        a, x = a.astype(np.int64), x.astype(np.int64)
        score = np.array([int(a[p] @ x[q]) for p, q in zip(i, j, strict=True)], dtype=np.int64)
    score = score.astype(np.int64)
    keep = score >= least[i]
    return i[keep], j[keep], score[keep]


def first_k(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group by falling score, then id."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    since = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    return order[since < k]


def tiles(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, run, schema: str) -> DataFrame:
    """``run`` over every pair of an anchor block and a row block."""
    a_blocks, r_blocks = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    a = anchors.withColumn("ab", F.pmod(F.xxhash64("uid"), F.lit(a_blocks)))
    r = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(r_blocks)))
    a = a.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)).cast("array<long>")))
    r = r.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1)).cast("array<long>")))
    return a.groupBy("ab", "rb").cogroup(r.groupBy("ab", "rb")).applyInPandas(run, schema)


def _same_length(a: pd.DataFrame, x: pd.DataFrame):
    """Blocks of one vector length: anchors, their matrix, rows, their matrix."""
    sizes = x["v"].str.len()
    for size, part in a.groupby(a["v"].str.len()):
        others = x[sizes == size]
        if len(others):
            yield part, np.stack(part["v"].to_list()).astype(float), others, np.stack(others["v"].to_list()).astype(float)


def named(a: pd.DataFrame, at: np.ndarray) -> dict[str, np.ndarray]:
    return {"anchor_id": a["vec_id"].to_numpy()[at], "uid": a["uid"].to_numpy()[at]}


def positives(anchors: DataFrame, rows: DataFrame, n_rows: int, largest: float, k: int) -> DataFrame:
    """(anchor_id, uid, rank, positive_id, positive_score): the first k other rows of the anchor's label."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, am, x, xm in _same_length(left, right):
            least = np.minimum(a["share"].to_numpy() * np.sqrt((am * am).sum(axis=1)) * largest, 2.0**62).astype(np.int64)
            least[a["share"].isna().to_numpy()] = NONE
            labels, ids = x["label"].to_numpy(), x["vec_id"].to_numpy()
            # rows of a label meet the anchors of that label only
            for label in np.unique(a["label"].to_numpy()):
                mine, theirs = np.flatnonzero(a["label"].to_numpy() == label), np.flatnonzero(labels == label)
                if not len(theirs):
                    continue
                i, j, score = survivors(am[mine], xm[theirs], least[mine])
                i, j = mine[i], theirs[j]
                other = a["vec_id"].to_numpy()[i] != ids[j]
                i, j, score = i[other], j[other], score[other]
                at = first_k(i, score, ids[j], k)
                out.append(pd.DataFrame({**named(a, i[at]), "positive_id": ids[j[at]], "positive_score": score[at]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["anchor_id", "uid", "positive_id", "positive_score"], dtype=np.int64)

    order = Window.partitionBy(*ANCHOR).orderBy(F.desc("positive_score"), "positive_id")
    done, todo = None, anchors
    for share in (*LEVELS, None):
        left = todo.count()
        if done is not None and not left:
            break
        found = tiles(todo.withColumn("share", F.lit(share).cast("double")), rows, left, n_rows, run, "anchor_id long, uid long, positive_id long, positive_score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = cut(found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*ANCHOR))))
        full = found if share is None else found.where(F.col("n") == k)
        done = full if done is None else done.unionByName(full)
        todo = cut(todo.join(full.select(*ANCHOR).distinct(), ANCHOR, "left_anti"))
    return done.select(*ANCHOR, F.col("rank").cast("int").alias("rank"), "positive_id", "positive_score")


def negatives(anchors: DataFrame, windows: DataFrame, rows: DataFrame, n_rows: int, lower: int, k: int) -> DataFrame:
    """(anchor_id, uid, positive_score, rank, negative_id, negative_score) of each distinct positive's score of an anchor."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, am, x, xm in _same_length(left, right):
            tops = a["tops"].to_list()
            least = np.array([-(-int(min(t)) * s // 100) for t, s in zip(tops, a["share"].tolist(), strict=True)], dtype=np.int64)
            labels, ids = x["label"].to_numpy(), x["vec_id"].to_numpy()
            i, j, score = survivors(am, xm, least)
            other = (a["vec_id"].to_numpy()[i] != ids[j]) & (a["label"].to_numpy()[i] != labels[j])
            i, j, score = i[other], j[other], score[other]
            for n in range(max(map(len, tops))):
                top = np.array([t[n] if n < len(t) else -1 for t in tops], dtype=np.int64)
                end = np.array([-(-int(t) * lower // 100) for t in top], dtype=np.int64)[i]
                top = top[i]
                inside = np.flatnonzero((score <= top) & (score >= end) & (top >= 0))
                at = inside[first_k(i[inside], score[inside], ids[j[inside]], k)]
                out.append(pd.DataFrame({**named(a, i[at]), "positive_score": top[at], "negative_id": ids[j[at]], "negative_score": score[at]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["anchor_id", "uid", "positive_score", "negative_id", "negative_score"], dtype=np.int64)

    key = [*ANCHOR, "positive_score"]
    order = Window.partitionBy(*key).orderBy(F.desc("negative_score"), "negative_id")
    # below 0 a window is empty
    done, todo = None, cut(windows.where("positive_score >= 0"))
    for share in (*[f for f in FALLS if f > lower], lower):
        queries = todo.groupBy(*ANCHOR).agg(F.collect_set("positive_score").alias("tops")).join(anchors, ANCHOR)
        queries = cut(queries.withColumn("share", F.lit(share)))
        left = queries.count()
        if done is not None and not left:
            break
        found = tiles(queries, rows, left, n_rows, run, "anchor_id long, uid long, positive_score long, negative_id long, negative_score long")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = cut(found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key))))
                # a window with fewer rows may go on below this round's threshold
        full = found if share == lower else found.where(F.col("n") == k)
        done = full if done is None else done.unionByName(full)
        todo = cut(todo.join(full.select(*key).distinct(), key, "left_anti"))
    return done.select(*key, F.col("rank").cast("int").alias("rank"), "negative_id", "negative_score")


def hard_negatives(
    vectors: DataFrame, anchor: str = "vec_id % 100 = 0", k_positive: int = 5, k_negative: int = 5, lower: int = 80, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` chooses anchors by vec_id or label; ``lower`` is the window's end in
    hundredths of the positive's score.
    """
    rows = cut(usable(vectors, vec_id, embedding, label, scale))
    n_rows = rows.count()
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    anchors = cut(rows.where(anchor).select("*", F.col("vec_id").alias("anchor_id"), F.xxhash64("vec_id", "label", "v").alias("uid")))
    found = positives(anchors, rows, n_rows, float(np.sqrt(longest or 0.0)) * (1 + 1e-9), k_positive)
    windows = found.select(*ANCHOR, "positive_score").distinct()
    hard = negatives(anchors, windows, rows, n_rows, lower, k_negative)
    out = found.drop("rank").join(hard, [*ANCHOR, "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
