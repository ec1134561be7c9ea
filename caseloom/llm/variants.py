"""Spelling variants: pairs of words one edit apart, by composing acceptors.

The vocabulary's acceptor is composed with a transducer that makes exactly one
edit, and with the acceptor again; an accepted path is a pair of words. Both sides
read the same symbols up to the first difference, so the path's first part is one
state of the acceptor, and the composition falls apart by that state:

* words with the same beginning P form a group. A group of at most ``most`` words
  is settled in one task: their minimal acceptor, the composed states, of those
  only the ones from which a pair is accepted, and the walk along them.
* a larger group first drops what all its words share, then splits by the next
  symbol. The pairs that differ right there have equal rests behind the edit, so
  each word meets its partners by a hash of its rest: once as "symbol and rest"
  (replaced or inserted), once as "rest" (inserted on the other side). Words of one
  rest are no more than there are symbols, so no such part is large.

Tasks take many groups at a time, each under an initial state of its own, and
return per word the number of its partners and the best of them.

Null texts have no words; a null doc_id counts as the empty text. Repeated rows
count each time. Words may have any length. Empty tables give no rows.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.exact import lower_ascii
from caseloom.llm.tables import cut, lean, stored, text_of

LEAST_LENGTH = 7
LEAST_USES = 2
TIMES = 10
MOST = 30_000
#: what lies between runs of letters, once A-Z is lower-cased
GAP = "[^a-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", typo: int = 31, least_length: int = LEAST_LENGTH, least_uses: int = LEAST_USES) -> DataFrame:
    """(word, n): runs of letters with one in ``typo`` changed by its hash; long and frequent enough."""
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    runs = docs.select(ident.alias("id"), F.explode(F.split(lower_ascii(text_of(docs, text)), GAP)).alias("run"))
    size = F.char_length("run")
    runs = runs.where(size >= least_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary")))
    at = F.pmod(F.col("h"), size.cast("long")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    word = F.when(F.col("h") % typo == 0, shorter).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_uses)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Equal rows get equal numbers from 0."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _found(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Acceptor:
    """Sorted distinct sequences as a trie, and the classes that merge it to the minimal acceptor.

    ``code`` and ``off`` hold the sequences end to end. Node 0 is the root; arcs
    are sorted by (parent, symbol). Nodes with the same endings have one class.
    """

    def __init__(self, code: np.ndarray, off: np.ndarray) -> None:
        size = np.diff(off)
        n = len(size)
        # what each sequence shares with the one before it
        both = np.zeros(n, np.int64)
        both[1:] = np.minimum(size[1:], size[:-1])
        at = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        equal = code[np.repeat(off[:-1], both) + at] == code[np.repeat(off[np.arange(n) - 1], both) + at]
        shared = both.copy()
        wrong = np.flatnonzero(~equal)
        if len(wrong):
            who = np.repeat(np.arange(n), both)[wrong]
            first = np.concatenate(([True], who[1:] != who[:-1]))
            shared[who[first]] = at[wrong[first]]
        new = size - shared
        # one node for every symbol that is not shared; depth counts from 1
        owner = np.repeat(np.arange(n), new)
        step = np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new)
        depth = shared[owner] + step + 1
        self.count = len(owner) + 1
        self.symbol = np.concatenate(([0], code[off[owner] + depth - 1])).astype(np.int64)
        self.depth = np.concatenate(([0], depth))
        self.owner = np.concatenate(([0], owner))
        parent = np.arange(len(owner))  # the node before it, where that is of the same sequence
        heads = np.flatnonzero(step == 0)
        # otherwise the latest node of the depth above
        by_depth = np.lexsort((np.arange(len(owner)), depth))
        key = depth[by_depth] * (self.count + 1) + by_depth
        place = np.searchsorted(key, (depth[heads] - 1) * (self.count + 1) + heads) - 1
        parent[heads] = np.where(depth[heads] == 1, 0, by_depth[np.maximum(place, 0)] + 1)
        self.parent = np.concatenate(([-1], parent))
        last = np.zeros(n, np.int64)
        ends = np.cumsum(new)
        last[new > 0] = ends[new > 0]
        self.word = np.full(self.count, -1, np.int64)
        self.word[last] = np.arange(n)  # distinct sequences: each ends at its own node; an empty one at the root
        self.order = np.lexsort((self.symbol[1:], self.parent[1:])) + 1
        self.arc_key = self.parent[self.order] << 21 | self.symbol[self.order]
        self.first_arc = np.searchsorted(self.parent[self.order], np.arange(self.count + 1))
        self._merge()

    def _merge(self) -> None:
        height = np.zeros(self.count, np.int64)
        by_depth = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[by_depth], np.arange(self.depth.max() + 2))
        for d in range(len(cuts) - 2, 0, -1):
            nodes = by_depth[cuts[d] : cuts[d + 1]]
            np.maximum.at(height, self.parent[nodes], height[nodes] + 1)
        self.state = np.zeros(self.count, np.int64)
        by_height = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[by_height], np.arange(height.max() + 2))
        found = 0
        for h in range(len(cuts) - 1):
            nodes = by_height[cuts[h] : cuts[h + 1]]
            if len(nodes) == 1:
                self.state[nodes] = found
                found += 1
                continue
            # fold the arcs of a node, one after the other, into one number
            mark = (self.word[nodes] >= 0).astype(np.int64)
            arcs = self.first_arc[nodes]
            left = self.first_arc[nodes + 1] - arcs
            live = np.flatnonzero(left > 0)
            base = 2
            while len(live):
                child = self.order[arcs[live]]
                mark[live] = base + _numbered(mark[live], self.symbol[child], self.state[child])
                base += len(live)
                arcs[live] += 1
                left[live] -= 1
                live = live[left[live] > 0]
            _, merged = np.unique(mark, return_inverse=True)
            self.state[nodes] = found + merged
            found += int(merged.max()) + 1
        self.states = found

    def arcs(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``nodes`` and children of all their arcs."""
        size = self.first_arc[nodes + 1] - self.first_arc[nodes]
        place = np.repeat(np.arange(len(nodes)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return place, self.order[self.first_arc[nodes][place] + at]

    def child(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The child by a symbol, or -1."""
        if not len(self.arc_key):
            return np.full(len(nodes), -1)
        key = nodes << 21 | symbols
        at = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
        return np.where(self.arc_key[at] == key, self.order[at], -1)

    def one_edit(self, nodes: np.ndarray, others: np.ndarray, pieces: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of words whose first difference lies at the given nodes.

        A pair replaces a symbol, both words behind one of ``nodes``; or it has one
        symbol more behind the node than behind the node of ``others`` with the same
        past (-1: there is none).
        """
        size = self.first_arc[nodes + 1] - self.first_arc[nodes]
        work = np.cumsum(np.maximum(size, 1) ** 2)
        first = 0
        while first < len(nodes):
            done = work[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(work, done + pieces, "right")))
            yield from self._edits_at(nodes[first:last], others[first:last])
            first = last

    def _edits_at(self, nodes: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        place, child = self.arcs(nodes)
        # a replaced symbol: two arcs of one node
        size = np.bincount(place, minlength=len(nodes))
        after = size[place] - (np.arange(len(place)) - (np.cumsum(size) - size)[place]) - 1
        left = np.repeat(np.arange(len(child)), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        u, v = child[left], child[right]
        # one symbol more: the child by it stands where the other node stands
        other = others[place]
        more, other = child[other >= 0], other[other >= 0]
        ends = (self.word[more] >= 0) & (self.word[other] >= 0)
        yield self.word[more[ends]], self.word[other[ends]]
        # the next symbol differs from the one inserted, or the first difference lies further on
        at, below = self.arcs(other)
        keep = self.symbol[below] != self.symbol[more[at]]
        at, below = at[keep], below[keep]
        over = self.child(more[at], self.symbol[below])
        keep = over >= 0
        yield from self._equal_rests(np.concatenate([u, over[keep]]), np.concatenate([v, below[keep]]))

    def _equal_rests(self, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Walk pairs of nodes along equal symbols, over composed states that can still accept."""
        u, v = self._alive(u, v)
        while len(u):
            ends = (self.word[u] >= 0) & (self.word[v] >= 0)
            yield self.word[u[ends]], self.word[v[ends]]
            place, child = self.arcs(u)
            other = self.child(v[place], self.symbol[child])
            met = other >= 0
            u, v = self._alive(child[met], other[met])

    def _alive(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose composed state accepts some rest."""
        if not len(u):
            return u, v
        low, high = np.minimum(self.state[u], self.state[v]), np.maximum(self.state[u], self.state[v])
        pair, at = np.unique(low * self.states + high, return_inverse=True)
        keep = self._accepting(pair)[at]
        return u[keep], v[keep]

    def _accepting(self, pair: np.ndarray) -> np.ndarray:
        """Of composed states (lesser class, greater class): whether their rests meet."""
        if not hasattr(self, "_known"):
            # one node stands for each class; its arcs are the class's
            self._node = np.zeros(self.states, np.int64)
            self._node[self.state] = np.arange(self.count)
            self._known, self._truth = np.zeros(0, np.int64), np.zeros(0, bool)
        levels, pairs = [], pair[~_found(self._known, pair)]
        reached = self._known
        while len(pairs):
            reached = np.union1d(reached, pairs)
            low, high = pairs // self.states, pairs % self.states
            u, v = self._node[low], self._node[high]
            place, child = self.arcs(u)
            other = self.child(v[place], self.symbol[child])
            met = other >= 0
            a, b = self.state[child[met]], self.state[other[met]]
            nexts = np.minimum(a, b) * self.states + np.maximum(a, b)
            levels.append((pairs, (self.word[u] >= 0) & (self.word[v] >= 0) | (low == high), place[met], nexts))
            pairs = np.unique(nexts)
            pairs = pairs[~_found(reached, pairs)]
        if levels:
            truth = np.zeros(len(reached), bool)
            truth[np.searchsorted(reached, self._known)] = self._truth
            # a state leads to states of lesser height, but maybe of an earlier level: repeat until nothing changes
            while True:
                before = int(truth.sum())
                for pairs, ends, place, nexts in reversed(levels):
                    truth[np.searchsorted(reached, pairs)] |= ends
                    good = truth[np.searchsorted(reached, nexts)]
                    truth[np.searchsorted(reached, pairs[place[good]])] = True
                if int(truth.sum()) == before:
                    break
            self._known, self._truth = reached, truth
        return self._truth[np.searchsorted(self._known, pair)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words end to end, and the words' offsets."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64), np.concatenate(([0], np.cumsum(size)))


def partners(group: np.ndarray, role: np.ndarray, depth: np.ndarray, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with partners, how many of them are found here, and the best one's row (largest n, then least word).

    Rows of a group share their first ``depth`` code points. Role 0 rows meet with
    an edit anywhere behind those; role 1 (symbol and rest) meet each other and
    role 2 (rest) with the edit right there.
    """
    code, off = _codes(words)
    # an initial state for each group, and another for role 2 in it: a first symbol of its own
    start = group * 2 + (role == 2)
    size = np.diff(off) - depth
    rank = np.array(sorted(range(len(words)), key=lambda k: (start[k], words[k])), dtype=np.int64)
    lengths = size[rank] + 1
    ends = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
    flat = np.repeat(start[rank], lengths)
    rest = at > 0
    flat[rest] = code[np.repeat((off[:-1] + depth)[rank], lengths)[rest] + at[rest] - 1]
    machine = Acceptor(flat, ends)
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order, uses = order[rank], n[rank]
    count = np.zeros(len(words), np.int64)
    best = np.full(len(words), -1, np.int64)

    def take(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        for a, b in pairs:
            u, v = np.concatenate([a, b]), np.concatenate([b, a])
            count[:] += np.bincount(u, minlength=len(count))
            by = np.lexsort((order[v], -uses[v], u))
            u, v = u[by], v[by]
            new = np.ones(len(u), bool)
            new[1:] = u[1:] != u[:-1]
            u, v = u[new], v[new]
            old = best[u]
            better = (old < 0) | (uses[v] > uses[old]) | (uses[v] == uses[old]) & (order[v] < order[old])
            best[u[better]] = v[better]

    roots = np.full(int(start.max()) + 2, -1, np.int64)
    tops = np.flatnonzero(machine.depth == 1)
    roots[machine.symbol[tops]] = tops
    free = np.flatnonzero((machine.depth >= 1) & (role[rank][machine.owner] == 0))
    take(machine.one_edit(free, free))
    here = np.unique(start[role == 1])
    take(machine.one_edit(roots[here], roots[here + 1]))
    found = np.flatnonzero(count)
    return rank[found], count[found], rank[best[found]]


def settle(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, role, depth, word, n) in order of key; groups go into one acceptor until it has ``most`` words."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(rows)
        words = part["word"].to_pylist()
        group = np.unique(part["key"].to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
        n = part["n"].to_numpy()
        row, near, best = partners(group, part["role"].to_numpy(), part["depth"].to_numpy().astype(np.int64), words, n)
        columns = [[words[k] for k in row.tolist()], near, n[best], [words[k] for k in best.tolist()]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n_near", "best_n", "best"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and len(keys) and keys[0] != held[-1].column(0)[-1].as_py():
            cuts = np.concatenate(([0], cuts))
        at = 0
        for c in cuts.tolist():
            if size + c - at >= most:
                yield flush([*held, batch.slice(at, c - at)])
                held, size, at = [], 0, c
        if at < len(keys):
            held.append(batch.slice(at))
            size += len(keys) - at
    if held:
        yield flush(held)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best) of distinct words (word, n) that have another word one edit away.

    ``words`` must be settled: it is read once per level of splitting.
    """

    def key(kind: str, bucket: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{kind}:"), F.col("depth").cast("string"), F.lit(":"), bucket.cast("string"), F.lit(":"), F.left("word", F.col("depth"))), 256)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["deep"] = [len(os.path.commonprefix([x, y])) for x, y in zip(b["low"], b["high"], strict=True)]
            yield b[["start", "depth", "size", "deep"]]

    jobs = []
    todo = words.select("word", "n", F.lit(0).alias("depth"))
    while True:
        here = todo.withColumn("start", F.left("word", F.col("depth")))
        groups = here.groupBy("start", "depth").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("low"), F.max("word").alias("high"))
        # there are fewer large groups than words / most
        large = cut(groups.where(F.col("size") > most).mapInPandas(prefixes, "start string, depth int, size long, deep int"))
        jobs.append(here.join(F.broadcast(large), ["start", "depth"], "left_anti").select(key("0", F.lit(0)).alias("key"), F.lit(0).alias("role"), "depth", "word", "n"))
        if large.isEmpty():
            break
        split = here.join(F.broadcast(large), ["start", "depth"]).select("word", "n", F.col("deep").alias("depth"), F.ceil(F.col("size") * 2 / most).alias("parts"))
        split = cut(split)
        for role in (1, 2):
            rest = F.substring("word", F.col("depth") + (3 - role), F.char_length("word"))
            rows = split.where(F.char_length("word") > F.col("depth")) if role == 1 else split
            jobs.append(rows.select(key("1", F.pmod(F.xxhash64(rest), F.col("parts"))).alias("key"), F.lit(role).alias("role"), "depth", "word", "n"))
        todo = split.where(F.char_length("word") > F.col("depth")).select("word", "n", (F.col("depth") + 1).alias("depth"))
    rows = jobs[0]
    for more in jobs[1:]:
        rows = rows.unionByName(more)
    rows = stored(rows, "groups")
    tasks = max(1, -(-rows.count() // (2 * most)))
    dealt = rows.repartition(tasks, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(lean(lambda batches: settle(batches, most)), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def variant_groups(words: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    A word's form is its best partner if that has ``times`` its uses or more. Uses
    grow along forms, so roots are found in a few rounds of doubling.
    """
    words = stored(words.select("word", "n"), "words")
    is_form = F.col("best_n") >= F.lit(times) * F.col("n")
    rows = words.join(near_words(words, most), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    rows = stored(rows, "forms")
    roots = cut(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = """
WITH RECURSIVE t AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c::BIGINT ORDER BY i) AS tab FROM t WHERE k = 8),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY id, run),
b AS (
  SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64]::BIGINT[] END)) AS u FROM d),
h AS (
  SELECT run, n, xor(list_reduce(u, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM b, crc),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, x.n, w.word, w.n FROM x JOIN w ON x.rest = w.word
  UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON x.rest = w.word),
f AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS best, max(m) AS best_n FROM p GROUP BY word, n),
g AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form,
    CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
c AS (
  SELECT word, form AS root, 1 AS k FROM g WHERE form IS NOT NULL
  UNION ALL SELECT c.word, g.form, k + 1 FROM c JOIN g ON c.root = g.word WHERE g.form IS NOT NULL),
e AS (SELECT word, last(root ORDER BY k) AS root FROM c GROUP BY word)
SELECT g.word, form, coalesce(root, g.word) AS root, n, n_near, form_n FROM g LEFT JOIN e ON g.word = e.word
"""
