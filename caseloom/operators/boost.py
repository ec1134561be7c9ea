"""Decision models of all places at once: boosted trees and a readable tree on binned features.

Training takes a fixed number of Spark jobs, however many places, classes or rounds:

1. candidate borders per place: quantiles of each number, the commonest values of
   each category;
2. class counts between neighbouring candidates put the borders in order of use:
   first where a border separates classes best, then evenly;
3. rows become cells (place, bins, target, holdout) with a count, at all borders of
   their place;
4. one task per place boosts on its cells, one for each bins vector. It goes over them
   ``max_cells`` at a time; arrays of more than ``HELD_BYTES`` are files of the task, so
   neither the rows nor the cells of a place bound what it can do. All classes share a
   tree's shape; a leaf has one value per class. Rounds stop ``patience`` rounds after the best loss on
   the holdout, and the model keeps the best round. The readable tree is grown on
   the same cells with weighted classes, and its leaves get their statistics there.

The result is one table of nodes. Scoring walks all trees of a row's place in numpy,
rows of all places in one pass over the data.

A missing number is less than any other in the boosted trees and counts as 0 in the
readable one (numbers come scaled, so 0 is their mean); a missing category is a
value of its own. Categories beyond the commonest share one bin.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from caseloom.operators.encode import MISSING
from caseloom.session import cut

FINE = 4096
BORDERS = 127
#: numbers of borders that bins can be looked up for, finest first; models use the finest
SIZES = (127, 63, 31, 15, 7, 3)
#: arrays of a task that are larger lie in a file of its temp folder
HELD_BYTES = 64 << 20

NODES = (
    "place string, part string, tree int, node int, feature string, value string, threshold double, "
    "left int, right int, support bigint, values array<double>, hits array<bigint>, labels array<string>"
)
BORDER_ROWS = "place string, feature string, borders array<double>, values array<string>"


def model_features(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """Categories as text with a value for missing; numbers as doubles, missing kept, non-finite ones missing."""
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in cats},
            **{c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in nums},
        }
    )


# --- borders ----------------------------------------------------------------


def _candidates(rows: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """Per place and feature: sorted candidate borders, or the commonest values."""
    parts = None
    if nums:
        shares = [i / FINE for i in range(FINE + 1)]
        found = rows.groupBy("place").agg(*[F.percentile_approx(c, shares, 10 * FINE).alias(c) for c in nums])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.array_distinct(F.coalesce(c, F.array().cast("array<double>"))).alias("borders")) for c in nums]))
        parts = found.select("place", each.alias("f")).select("place", "f.feature", "f.borders", F.array().cast("array<string>").alias("values"))
    if cats:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in cats]))
        uses = rows.select("place", each.alias("f")).groupBy("place", "f.feature", "f.v").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("place", "feature").orderBy(F.desc("n"), "v")
        common = uses.withColumn("no", F.row_number().over(order)).where(F.col("no") <= BORDERS)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("no", "v"))), lambda s: s["v"])
        common = common.groupBy("place", "feature").agg(F.array().cast("array<double>").alias("borders"), listed.alias("values"))
        parts = common if parts is None else parts.unionByName(common)
    return parts


def _in_order(borders: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Borders by use: splits that lower the entropy most, best first, then evenly.

    ``counts`` has one row per bin (up to and including a border) and one column per class.
    """
    total = np.concatenate([np.zeros((1, counts.shape[1])), np.cumsum(counts, axis=0)])

    def loss(c: np.ndarray) -> np.ndarray:
        n = c.sum(axis=-1, keepdims=True)
        return -(c * np.log(np.where(c > 0, c, 1) / np.maximum(n, 1))).sum(axis=-1)

    taken: list[int] = []
    parts = [(0, len(counts))]
    ranked: list[tuple[float, int, tuple[int, int]]] = []

    def best(part: tuple[int, int]) -> None:
        lo, hi = part
        at = np.arange(lo + 1, hi)
        if not len(at):
            return
        gain = loss(total[hi] - total[lo]) - loss(total[at] - total[lo]) - loss(total[hi] - total[at])
        k = int(np.argmax(gain))
        if gain[k] > 1e-9:
            ranked.append((float(gain[k]), int(at[k]), part))

    best(parts[0])
    while ranked and len(taken) < BORDERS // 2:
        ranked.sort()
        _, at, (lo, hi) = ranked.pop()
        taken.append(at)
        best((lo, at))
        best((at, hi))
    # then halves, quarters, eighths of the candidates
    step = len(borders)
    seen = set(taken)
    while step > 1 and len(taken) < BORDERS:
        for at in np.arange(step / 2, len(borders), step).astype(int).tolist():
            if at >= 1 and at not in seen and len(taken) < BORDERS:
                seen.add(at)
                taken.append(at)
        step /= 2
    return borders[np.array(taken, dtype=int) - 1] if taken else borders[:0]


@dataclass
class Binning:
    """Borders in order of use and values of every (place, feature)."""

    cats: list[str]
    nums: list[str]
    borders: dict[tuple[str, str], np.ndarray]
    values: dict[tuple[str, str], list[str]]

    def codes(self, place: str, columns: dict[str, np.ndarray], sizes: Sequence[int]) -> np.ndarray:
        """Bins of rows of one place for each number of borders: (rows, sizes, features), numbers after categories.

        A row is looked up once, among the most borders; fewer borders are some of those.
        """
        n = len(next(iter(columns.values()))) if columns else 0
        out = np.zeros((n, len(sizes), len(self.cats) + len(self.nums)), dtype=np.int32)
        most = max(sizes)
        for k, c in enumerate(self.cats):
            known = {v: i + 1 for i, v in enumerate(self.values.get((place, c), ())[:most])}
            at, names = pd.factorize(columns[c], use_na_sentinel=False)
            code = np.array([known.get(v, 0) for v in names.astype(str).tolist()], dtype=np.int32)
            for j, size in enumerate(sizes):
                out[:, j, k] = np.where(code <= size, code, 0)[at]
        for k, c in enumerate(self.nums, len(self.cats)):
            x = columns[c]
            borders = self.borders.get((place, c), np.zeros(0))
            edges = np.sort(borders[:most])
            at = np.where(np.isnan(x), 0, np.searchsorted(edges, x, "left") + 1)
            for j, size in enumerate(sizes):
                # 0 is a missing number; else how many borders, of those in use, are less
                less = np.searchsorted(np.sort(borders[:size]), edges, "right") + 1
                out[:, j, k] = np.concatenate(([0, 1], less))[at]
        return out


def _columns(batch: pa.RecordBatch, cats: Sequence[str], nums: Sequence[str]) -> dict[str, np.ndarray]:
    """Feature columns of a batch: texts as objects, numbers as doubles with NaN."""
    out = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(object) for c in cats}
    for c in nums:
        out[c] = batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    return out


def _by_place(batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray]]:
    """Places of a batch and their rows."""
    place = batch.column(batch.schema.get_field_index("place")).cast(pa.string()).dictionary_encode()
    code = place.indices.to_numpy(zero_copy_only=False)
    code = np.where(np.isnan(code), -1, code).astype(np.int64) if code.dtype.kind == "f" else code.astype(np.int64)
    names = place.dictionary.to_pylist()
    for k in np.unique(code).tolist():
        yield (names[k] if k >= 0 else None), np.flatnonzero(code == k)


def binning(rows: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> Binning:
    """Borders and values per place and feature, borders in order of use."""
    found = cut(_candidates(rows, cats, nums))
    table = found.collect()  # at most FINE borders or BORDERS values per place and feature
    values = {(r["place"], r["feature"]): list(r["values"]) for r in table if r["feature"] in cats}
    fine = {}
    for r in table:
        if r["feature"] in nums:
            seen = np.sort(np.array(r["borders"], dtype=float))
            # a border lies half way between neighbours
            fine[r["place"], r["feature"]] = np.unique(seen[:-1] + (seen[1:] - seen[:-1]) / 2)
    if not nums:
        return Binning(list(cats), list(nums), {}, values)
    held = rows.sparkSession.sparkContext.broadcast(fine)
    names = list(nums)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(str)
            columns = _columns(batch, (), names)
            out = []
            for place, at in _by_place(batch):
                for c in names:
                    x = columns[c][at]
                    own = ~np.isnan(x)
                    part = pd.DataFrame({"bin": np.searchsorted(held.value.get((place, c), np.zeros(0)), x[own], "left"), "target": target[at][own]})
                    part = part.groupby(["bin", "target"]).size().reset_index(name="n")
                    out.append(part.assign(place=place, feature=c))
            part = pd.concat(out)
            columns = [pa.array(part[k].tolist(), t) for k, t in (("place", pa.string()), ("feature", pa.string()), ("bin", pa.int32()), ("target", pa.string()), ("n", pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "feature", "bin", "target", "n"])

    def order(part: pd.DataFrame) -> pd.DataFrame:
        place, feature = part["place"].iloc[0], part["feature"].iloc[0]
        edges = held.value[place, feature]
        _, target = np.unique(part["target"].to_numpy().astype(str), return_inverse=True)
        counts = np.zeros((len(edges) + 1, int(target.max()) + 1))
        np.add.at(counts, (part["bin"].to_numpy(), target), part["n"].to_numpy())
        return pd.DataFrame({"place": [place], "feature": [feature], "borders": [_in_order(edges, counts).tolist()]})

    slim = rows.select("place", F.col("target").cast("string").alias("target"), *names)
    counts = slim.mapInArrow(count, "place string, feature string, bin int, target string, n bigint")
    counts = counts.groupBy("place", "feature", "bin", "target").agg(F.sum("n").alias("n"))
    ordered = counts.groupBy("place", "feature").applyInPandas(order, "place string, feature string, borders array<double>").collect()
    return Binning(list(cats), list(nums), {(r["place"], r["feature"]): np.array(r["borders"], dtype=float) for r in ordered}, values)


def cells(rows: DataFrame, bins: Binning) -> DataFrame:
    """(place, bins, target, holdout, n) at all borders of each place."""
    held = rows.sparkSession.sparkContext.broadcast(bins)
    slim = rows.select("place", F.col("target").cast("string").alias("target"), "holdout", *bins.cats, *bins.nums)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            columns = _columns(batch, b.cats, b.nums)
            packed = np.zeros((batch.num_rows, len(b.cats) + len(b.nums)), dtype="<i4")
            for place, at in _by_place(batch):
                packed[at] = b.codes(place, {c: x[at] for c, x in columns.items()}, (BORDERS,))[:, 0]
            bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(4 * packed.shape[1])
            items = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
            place, target, holdout = (batch.column(batch.schema.get_field_index(c)) for c in ("place", "target", "holdout"))
            yield pa.RecordBatch.from_arrays([place, target, holdout, items], ["place", "target", "holdout", "bins"])

    coded = slim.mapInArrow(code, "place string, target string, holdout boolean, bins binary")
    return coded.groupBy("place", "bins", "target", "holdout").agg(F.count(F.lit(1)).alias("n"))


def _room(shape: tuple[int, ...], dtype) -> np.ndarray:
    """An array of zeros, in a file where it is large."""
    if int(np.prod(shape)) * np.dtype(dtype).itemsize <= HELD_BYTES:
        return np.zeros(shape, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype=dtype, mode="w+", shape=shape)


class Gathered:
    """Bins vectors of one place, read in order, with their rows to fit and to judge by class."""

    def __init__(self, labels: Sequence[str], features: int) -> None:
        self.labels = {c: k for k, c in enumerate(labels)}
        self.features = features
        self.files = [tempfile.SpooledTemporaryFile(HELD_BYTES) for _ in range(3)]
        self.last: tuple[np.ndarray, ...] | None = None
        self.size = 0

    def add(self, bins: list[bytes], target: list, holdout: np.ndarray, n: np.ndarray) -> None:
        code = np.frombuffer(b"".join(bins), "<i4").astype(np.uint8).reshape(len(bins), self.features)
        if self.last is not None:
            code = np.concatenate([self.last[0], code])
        at = np.concatenate(([0], np.cumsum((code[1:] != code[:-1]).any(axis=1))))
        code, at = code[np.concatenate(([True], np.diff(at) > 0))], at[-len(bins) :]
        label = np.array([self.labels[str(c)] for c in target])
        fit, hold = np.zeros((len(code), len(self.labels))), np.zeros((len(code), len(self.labels)))
        if self.last is not None:
            fit[:1], hold[:1] = self.last[1:]
        for counts, own in ((fit, ~holdout), (hold, holdout)):
            np.add.at(counts, (at[own], label[own]), n[own])
        self._write(code[:-1], fit[:-1], hold[:-1])
        self.last = code[-1:], fit[-1:], hold[-1:]

    def _write(self, *parts: np.ndarray) -> None:
        self.size += len(parts[0])
        for file, part in zip(self.files, parts, strict=True):
            file.write(np.ascontiguousarray(part).tobytes())

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, rows to fit and rows to judge of each vector."""
        self._write(*self.last)
        out = []
        for file, dtype, width in zip(self.files, (np.uint8, float, float), (self.features, len(self.labels), len(self.labels)), strict=True):
            held = file.tell() <= HELD_BYTES
            file.seek(0)
            found = np.frombuffer(bytearray(file.read()), dtype) if held else np.memmap(file, dtype=dtype, mode="r+")
            out.append(found.reshape(self.size, width))
        return tuple(out)


# --- trees -------------------------------------------------------------------


class Grid:
    """Codes of the cells of one place, and how sums over them become splits, ``step`` cells at a time."""

    def __init__(self, code: np.ndarray, is_cat: np.ndarray, step: int = 50_000) -> None:
        self.size = code.max(axis=0).astype(np.int64) + 1
        self.offset = np.concatenate(([0], np.cumsum(self.size)))
        self.code = code
        self.parts = [slice(low, low + step) for low in range(0, len(code), step)]
        self.is_cat = np.repeat(is_cat, self.size)
        self.feature = np.repeat(np.arange(len(self.size)), self.size)
        # the last code of a number and the shared code of a category split nothing off
        at = np.arange(self.offset[-1]) - self.offset[self.feature]
        self.usable = np.where(self.is_cat, at > 0, at < self.size[self.feature] - 1)

    def sums(self, node_of: np.ndarray, where: np.ndarray, nodes: int, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of each weight and of the counts by node and code: (nodes, codes, weights and counts)."""
        out = np.zeros((nodes, int(self.offset[-1]), weights.shape[1] + 1))
        for part in self.parts:
            node = node_of[where[part]]
            inside = node >= 0
            pick = slice(None) if inside.all() else np.flatnonzero(inside)
            node, code = node[pick], self.code[part][pick]
            if not len(node):
                continue
            every = np.ascontiguousarray(np.column_stack([weights[part][pick], counts[part][pick]]).T)
            for f, size in enumerate(self.size.tolist()):
                at = node * size + code[:, f]
                mine = out[:, self.offset[f] : self.offset[f + 1]]
                for k, weight in enumerate(every):
                    mine[..., k] += np.bincount(at, weight, minlength=nodes * size).reshape(nodes, size)
        return out

    def sides(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What goes left and right at each code: numbers up to the code, categories other than it."""
        total = sums[:, : int(self.size[0])].sum(axis=1, keepdims=True)
        run = np.cumsum(sums, axis=1)
        start = self.offset[self.feature]
        before = np.where((start > 0)[None, :, None], run[:, np.maximum(start - 1, 0)], 0.0)
        left = np.where(self.is_cat[None, :, None], total - sums, run - before)
        return left, total - left


def grow(grid: Grid, weights: np.ndarray, counts: np.ndarray, gain_of, depth: int, min_leaf: int) -> tuple[list, np.ndarray]:
    """A tree: nodes [feature, code, left, right] (feature -1: leaf) and each cell's leaf."""
    tree = [[-1, 0, -1, -1]]
    where = _room((len(counts),), np.int32)
    live = np.array([0])
    for _ in range(depth):
        local = np.full(len(tree), -1)
        local[live] = np.arange(len(live))
        left, right = grid.sides(grid.sums(local, where, len(live), weights, counts))
        allowed = grid.usable[None, :] & (left[..., -1] >= min_leaf) & (right[..., -1] >= min_leaf)
        gain = np.where(allowed, gain_of(left[..., :-1], right[..., :-1]), -np.inf)
        choice = gain.argmax(axis=1)
        good = gain[np.arange(len(live)), choice] > 1e-9
        if not good.any():
            break
        fresh = []
        for node, at in zip(live[good].tolist(), choice[good].tolist(), strict=True):
            f = int(grid.feature[at])
            tree[node] = [f, at - int(grid.offset[f]), len(tree), len(tree) + 1]
            fresh += [len(tree), len(tree) + 1]
            tree += [[-1, 0, -1, -1], [-1, 0, -1, -1]]
        for part in grid.parts:
            at, code = where[part], grid.code[part]
            for node in live[good].tolist():
                f, c, a, b = tree[node]
                own = np.flatnonzero(at == node)
                value = code[own, f]
                at[own] = np.where(value == c if grid.is_cat[grid.offset[f]] else value > c, b, a)
        live = np.array(fresh)
    return tree, where


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def boost(grid: Grid, target: np.ndarray, n: np.ndarray, holdout: np.ndarray, classes: int, cfg) -> tuple[np.ndarray, list, np.ndarray]:
    """:func:`boost_cells` where each cell has rows of one class, to fit or to judge."""
    rows = np.eye(classes)[target] * n[:, None]
    return boost_cells(grid, np.where(holdout[:, None], 0.0, rows), np.where(holdout[:, None], rows, 0.0), cfg)


def boost_cells(grid: Grid, fit: np.ndarray, hold: np.ndarray, cfg) -> tuple[np.ndarray, list, np.ndarray]:
    """Start scores, the trees up to the best round (shape, leaf values) and the cells' scores then.

    ``fit`` and ``hold`` count the rows of each cell and class to fit and to judge.
    """
    classes, of_class = fit.shape[1], fit.sum(axis=0)
    start = np.log(np.maximum(of_class, 0.5) / max(of_class.sum(), 1.0))
    score, weights, counts = _room(fit.shape, float), _room((len(fit), 2 * classes), float), _room((len(fit),), float)
    for part in grid.parts:
        score[part], counts[part] = start, fit[part].sum(axis=1)
    judged = float(hold.sum())
    # without rows to judge by the last round is the best
    best_score = _room(fit.shape, float) if judged else score
    trees, best, best_loss = [], 0, np.inf

    def gain_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        g, h = slice(0, classes), slice(classes, None)
        value = lambda s: (s[..., g] ** 2 / (s[..., h] + cfg.l2)).sum(axis=-1)
        return value(left) + value(right) - value(left + right)

    for k in range(cfg.rounds + 1):
        loss = 0.0
        for part in grid.parts:
            p, n = softmax(score[part]), counts[part][:, None]
            if judged:
                loss -= float((hold[part] * np.log(np.maximum(p, 1e-300))).sum()) / judged
            weights[part, :classes], weights[part, classes:] = p * n - fit[part], p * (1 - p) * n
        if not judged:
            best = k
        elif loss < best_loss - 1e-12:
            best, best_loss = k, loss
            best_score[...] = score
        elif k - best >= cfg.patience:
            break
        if k == cfg.rounds:
            break
        tree, where = grow(grid, weights, counts, gain_of, cfg.depth, cfg.min_leaf)
        if len(tree) == 1:
            break
        sums = _by_leaf(grid, where, len(tree), weights)
        leaf = -cfg.learning_rate * sums[:, :classes] / (sums[:, classes:] + cfg.l2)
        trees.append((tree, leaf))
        for part in grid.parts:
            score[part] += leaf[where[part]]
    return start, trees[:best], best_score


def _by_leaf(grid: Grid, where: np.ndarray, nodes: int, weights: np.ndarray) -> np.ndarray:
    """Sum of each weight by the node a cell is in."""
    out = np.zeros((nodes, weights.shape[1]))
    for part in grid.parts:
        for k in range(weights.shape[1]):
            out[:, k] += np.bincount(where[part], weights[part, k], minlength=nodes)
    return out


def _node_rows(place: str, part: str, tree_no: int, tree: list, values: np.ndarray, bins: Binning) -> Iterator[dict]:
    names = [*bins.cats, *bins.nums]
    for node, (f, code, left, right) in enumerate(tree):
        row = {"place": place, "part": part, "tree": tree_no, "node": node, "left": left, "right": right, "values": values[node].tolist()}
        if f >= 0 and f < len(bins.cats):
            row |= {"feature": names[f], "value": bins.values[place, names[f]][code - 1]}
        elif f >= 0:
            edges = np.sort(bins.borders[place, names[f]][:BORDERS])
            row |= {"feature": names[f], "threshold": float(edges[code - 1]) if code else -np.inf}
        yield row


def fit_place(place: str | None, labels: Sequence[str], code: np.ndarray, fit: np.ndarray, hold: np.ndarray, bins: Binning, cfg) -> pd.DataFrame:
    """All nodes of one place from its cells, and one row that describes the place."""
    total = fit.sum(axis=0) + hold.sum(axis=0)
    about = {"place": place, "part": "place", "support": int(total.sum()), "labels": list(labels), "values": (total / total.sum()).tolist(), "hits": total.astype(int).tolist()}
    rows = []
    if len(labels) > 1 and code.shape[1] and (code.min(axis=0) < code.max(axis=0)).any():
        about["value"] = "boosted"
        is_cat = np.arange(code.shape[1]) < len(bins.cats)
        grid = Grid(code, is_cat, cfg.max_cells)
        start, trees, score = boost_cells(grid, fit, hold, cfg)
        rows.append({"place": place, "part": "base", "tree": 0, "node": 0, "left": -1, "right": -1, "values": start.tolist()})
        for k, (tree, leaf) in enumerate(trees, 1):
            rows += _node_rows(place, "base", k, tree, leaf, bins)
        # the readable tree sees a missing number as 0
        seen, mass, n = _room(code.shape, code.dtype), _room(fit.shape, float), _room((len(fit),), float)
        weight = total.sum() / (len(labels) * total)
        for part in grid.parts:
            seen[part] = code[part]
            for k, c in enumerate(bins.nums, len(bins.cats)):
                edges = np.sort(bins.borders.get((place, c), np.zeros(0))[:BORDERS])
                seen[part, k] = np.where(code[part, k] == 0, np.searchsorted(edges, 0.0, "left") + 1, code[part, k])
            mass[part] = (fit[part] + hold[part]) * weight
            n[part] = fit[part].sum(axis=1) + hold[part].sum(axis=1)

        def gini_gain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            def impurity(s: np.ndarray) -> np.ndarray:
                m = s.sum(axis=-1)
                return m - (s**2).sum(axis=-1) / np.maximum(m, 1e-300)

            return impurity(left + right) - impurity(left) - impurity(right)

        tree, where = grow(Grid(seen, is_cat, cfg.max_cells), mass, n, gini_gain, cfg.depth, cfg.min_leaf)
        hits = _by_leaf(grid, where, len(tree), fit) + _by_leaf(grid, where, len(tree), hold)
        support = hits.sum(axis=1)
        for part in grid.parts:
            score[part] = softmax(score[part]) * n[part][:, None]
        mean = _by_leaf(grid, where, len(tree), score) / np.maximum(support, 1)[:, None]
        for row in _node_rows(place, "rule", 0, tree, mean, bins):
            rows.append(row | {"support": int(support[row["node"]]), "hits": hits[row["node"]].astype(int).tolist(), "labels": list(labels)})
    else:
        about["value"] = "prior"
    names = [c.split()[0] for c in NODES.split(", ")]
    out = pd.DataFrame({c: pd.Series([r.get(c) for r in (about, *rows)], dtype=object) for c in names})
    whole = ["tree", "node", "left", "right", "support"]
    return out.astype({c: "Int64" for c in whole} | {"threshold": float})


def fit_places(rows: DataFrame, cats: Sequence[str], nums: Sequence[str], cfg) -> DataFrame:
    """The node table of every place of ``rows`` (place, target, holdout, features); not yet computed."""
    ready = cut(model_features(rows.select("place", "target", "holdout", *cats, *nums), cats, nums))
    bins = binning(ready, cats, nums)
    labels: dict[str | None, set[str]] = {}
    for r in ready.select("place", F.col("target").cast("string").alias("target")).distinct().collect():
        labels.setdefault(r["place"], set()).add(str(r["target"]))
    named = {place: sorted(own) for place, own in labels.items()}
    held = rows.sparkSession.sparkContext.broadcast((bins, named))
    schema = StructType.fromDDL(NODES)
    arrow = to_arrow_schema(schema)
    features = len(bins.cats) + len(bins.nums)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, named = held.value

        def done(place: str | None, found: Gathered) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(fit_place(place, named[place], *found.arrays(), bins, cfg), schema=arrow, preserve_index=False)

        now: tuple[str | None, Gathered] | None = None
        for batch in batches:
            target, n = batch.column(2).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            holdout = batch.column(3).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            vectors = batch.column(1).to_pylist()
            for place, at in _by_place(batch):
                if now is None or now[0] != place:
                    if now is not None:
                        yield done(*now)
                    now = place, Gathered(named[place], features)
                low, high = int(at[0]), int(at[-1]) + 1  # rows come by place
                now[1].add(vectors[low:high], target[low:high], holdout[low:high], n[low:high])
        if now is not None:
            yield done(*now)

    # a place is few bytes and much work: each has a task of its own
    number = {place: k for k, place in enumerate(sorted(named, key=lambda p: (p is not None, p or "")))}
    slots = rows.sparkSession.createDataFrame([(p, k) for p, k in number.items()], "of string, slot int")
    table = cells(ready, bins).join(F.broadcast(slots), F.col("place").eqNullSafe(F.col("of")))
    dealt = table.repartitionById(max(1, len(number)), "slot").select("place", "bins", "target", "holdout", "n")
    return dealt.sortWithinPartitions("place", "bins").mapInArrow(fit, schema)


# --- scoring -----------------------------------------------------------------


@dataclass
class Forest:
    """Trees of one place as arrays."""

    labels: list[str]
    start: np.ndarray
    roots: np.ndarray
    feature: np.ndarray
    is_cat: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray
    known: dict[str, dict[str, int]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of rows of features: codes of known values, -1 for others; numbers, -inf for missing."""
        out = np.tile(self.start, (len(x), 1))
        step = max(1, (1 << 19) // max(1, len(self.roots)))
        for low in range(0, len(x) if len(self.roots) else 0, step):
            part = x[low : low + step]
            at = np.tile(self.roots, (len(part), 1))
            row = np.arange(len(part))[:, None]
            while (self.left[at] >= 0).any():
                v = part[row, self.feature[at]]
                goes_right = np.where(self.is_cat[at], v == self.bound[at], v > self.bound[at])
                at = np.where(self.left[at] < 0, at, np.where(goes_right, self.right[at], self.left[at]))
            out[low : low + step] += self.values[at].sum(axis=1)
        return softmax(out)

    def scores(self, columns: dict[str, np.ndarray], names: Sequence[str], cats: int) -> np.ndarray:
        """Class probabilities of rows, a block of rows at a time, all trees together."""
        n = len(columns[names[0]])
        x = np.empty((n, len(names)))
        for k, c in enumerate(names):
            if k < cats:
                found, at = np.unique(columns[c].astype(str), return_inverse=True)
                known = self.known.get(c, {})
                x[:, k] = np.array([known.get(v, -1) for v in found.tolist()], dtype=float)[at]
            else:
                x[:, k] = np.where(np.isnan(columns[c]), -np.inf, columns[c])
        return self.probabilities(x)


def forests(nodes: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> dict[str, Forest]:
    """All places' trees. A place has at most ``rounds`` trees of at most 31 nodes."""
    table = nodes.where("part in ('place', 'base')").orderBy("place", "part", "tree", "node").toPandas()
    names = [*cats, *nums]
    out = {}
    for place, own in table.groupby("place", sort=True):
        about, base = own[own["part"] == "place"].iloc[0], own[own["part"] == "base"]
        labels = list(about["labels"])
        if not len(base):
            start = np.log(np.maximum(np.array(about["values"], dtype=float), 1e-300))
            zero = np.zeros(0, np.int64)
            out[place] = Forest(labels, start, zero, zero, zero.astype(bool), np.zeros(0), zero, zero, np.zeros((0, len(labels))), {})
            continue
        start, trees = np.array(base.iloc[0]["values"], dtype=float), base.iloc[1:]
        tree, node = trees["tree"].to_numpy(dtype=np.int64), trees["node"].to_numpy(dtype=np.int64)
        first = np.flatnonzero(node == 0)
        base_at = first[np.searchsorted(tree[first], tree)] if len(first) else node
        known: dict[str, dict[str, int]] = {}
        bound = trees["threshold"].to_numpy(dtype=float).copy()
        feature = np.array([names.index(f) if isinstance(f, str) else 0 for f in trees["feature"]], dtype=np.int64)
        is_cat = feature < len(cats)
        for k, (f, v) in enumerate(zip(trees["feature"], trees["value"], strict=True)):
            if isinstance(f, str) and f in cats:
                codes = known.setdefault(f, {})
                bound[k] = codes.setdefault(v, len(codes))
        left, right = trees["left"].to_numpy(dtype=np.int64), trees["right"].to_numpy(dtype=np.int64)
        values = np.stack([np.array(v, dtype=float) for v in trees["values"]]) if len(trees) else np.zeros((0, len(labels)))
        values[left >= 0] = 0
        out[place] = Forest(labels, start, first, feature, is_cat, bound, np.where(left < 0, -1, left + base_at), np.where(right < 0, -1, right + base_at), values, known)
    return out


def score_places(spark: SparkSession, models: dict[str, Forest], cats: Sequence[str], nums: Sequence[str], out: str):
    """A function of rows with ``place`` and features: adds the distribution, null where no model is."""
    held = spark.sparkContext.broadcast(models)
    names = [*cats, *nums]

    def score(df: DataFrame) -> DataFrame:
        kept = df.drop(out)
        raw = {f"_f{k}": c for k, c in enumerate(names)}
        ready = model_features(kept.withColumns({f"_f{k}": F.col(c) for k, c in enumerate(names)}), list(raw)[: len(cats)], list(raw)[len(cats) :])
        schema = StructType([*kept.schema.fields, StructField(out, MapType(StringType(), DoubleType()), True)])
        dist_type, columns_in = to_arrow_schema(schema).field(out).type, kept.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = _columns(batch, list(raw)[: len(cats)], list(raw)[len(cats) :])
                columns = {raw[k]: v for k, v in columns.items()}
                dists: list = [None] * batch.num_rows
                for place, at in _by_place(batch):
                    model = held.value.get(place)
                    if model is None:
                        continue
                    if len(model.roots):
                        p = model.scores({c: x[at] for c, x in columns.items()}, names, len(cats))
                    else:
                        p = np.tile(softmax(model.start[None, :]), (len(at), 1))
                    for k, row in enumerate(at.tolist()):
                        dists[row] = [(lab, v) for lab, v in zip(model.labels, p[k].tolist(), strict=True) if v > 0]
                found = pa.array(dists, dist_type)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns_in)], found], names=[*columns_in, out])

        return ready.mapInArrow(run, schema)

    # for those that score rows inside their own tasks
    score.models, score.cats, score.nums = models, list(cats), list(nums)
    return score
