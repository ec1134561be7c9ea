"""Guided decoding inside tasks: all steps of a batch of prefixes side by side.

Where decisions depend on the place alone, a step depends on the state, the last
activity and the number of the step. All such steps are worked out once, by the
expressions of the step-wise decode, and every task holds them. Where decisions are
scored on the data state, tasks hold the models and roll the state themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from caseloom.functions.distributions import Guidance, normalised_entropy
from caseloom.functions.hashes import Keys
from caseloom.functions.text import EOS
from caseloom.operators.boost import Forest
from caseloom.operators.encode import MISSING
from caseloom.operators.ordering import CASE
from caseloom.operators.predict import HELD_ENTRIES, PREFIXES_PER_TASK, TRACE, Decisions, NextModel, entry_map, step_options

#: options of steps (state, activity, step, next activity) that every task may hold
HELD_OPTIONS = 100_000
#: samples that are drawn side by side, and their steps
WALKS, WALK_STEPS = 1 << 15, 1 << 21


def _pairs(keyed: DataFrame, model: NextModel) -> tuple[list[tuple], int]:
    """State and activity wherever a walk can be, and the number of prefixes."""
    starts = keyed.groupBy("state", "activity").agg(F.count(F.lit(1)).alias("n")).collect()
    onward = model.table.select(F.explode("entries").alias("e")).where(F.col("e.label") != EOS).select("e.next_state", "e.label").distinct().collect()
    seen = {(r["state"], r["activity"]) for r in starts} | {(r["next_state"], r["label"]) for r in onward}
    return sorted(seen, key=lambda p: (p[0], p[1] is not None, p[1] or "")), sum(r["n"] for r in starts)


def walk_samples(
    keyed: DataFrame, model: NextModel, max_steps: int, decisions: Decisions, samples: int, seed: int, most: int = HELD_OPTIONS
) -> DataFrame | None:
    """``sample, suffix, trace`` of all samples of every prefix (with ``state`` and ``activity``).

    The draws are those of the step-wise decode. None where the decisions depend on
    more than the place, or where the options are more than tasks may hold.
    """
    if decisions.score is not None or decisions.roll is not None or not max_steps:
        return None
    widest = model.table.agg(F.max(F.size("entries"))).first()[0]
    if not widest:
        return None
    pairs, prefixes = _pairs(keyed, model)
    if len(pairs) * max_steps * widest > most:
        return None
    spark = keyed.sparkSession
    table = spark.createDataFrame(pairs, "state string, activity string")
    rows = step_options(table, model, max_steps, decisions).select(
        "at_state", "at_activity", "at_step", "no", "label", "p", "state", F.to_json("trace").alias("trace")
    ).orderBy("at_state", "at_activity", "at_step", "no").collect()  # at most ``most``
    number = {p: k for k, p in enumerate(pairs)}
    names = sorted({r["label"] for r in rows})
    label_of = {n: k for k, n in enumerate(names)}
    end = label_of.get(EOS, -1)
    items: list[str] = []
    options: dict[tuple[int, int], list] = {}
    for r in rows:
        ended = r["label"] == EOS
        item = -1
        if r["trace"] != "[]":
            item = len(items)
            items.append(r["trace"][1:-1])
        then = -1 if ended else number[r["state"], r["label"]]
        options.setdefault((number[r["at_state"], r["at_activity"]], r["at_step"]), []).append((r["p"], label_of[r["label"]], then, item))
    if any(len(own) != len({o[1] for o in own}) for own in options.values()):
        return None  # an activity with two decisions: the step-wise decode goes both ways
    held = spark.sparkContext.broadcast(
        {at: (np.cumsum([o[0] for o in own]), *(np.array([o[k] for o in own], dtype=np.int32) for k in (1, 2, 3))) for at, own in options.items()}
    )
    starts = spark.sparkContext.broadcast(number)
    vocabulary = pa.array(names, pa.string())
    one = pa.struct([("sample", pa.int32()), ("suffix", pa.list_(pa.string())), ("_items", pa.list_(pa.int32()))])

    def lists(steps: np.ndarray, values: pa.Array | None = None) -> pa.Array:
        """Entries of each walk that are not negative, by walk and step."""
        own = steps >= 0
        offsets = pa.array(np.concatenate(([0], np.cumsum(own.sum(axis=1)))).astype(np.int32))
        found = pa.array(steps[own], pa.int32())
        return pa.ListArray.from_arrays(offsets, found if values is None else values.take(found))

    block = max(1, min(WALKS, WALK_STEPS // max_steps) // samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, block):
                batch = whole.slice(low, block)
                n = batch.num_rows * samples
                cases, lengths, states, activities = (
                    batch.column(batch.schema.get_field_index(c)) for c in (CASE, "prefix_len", "state", "activity")
                )
                who = zip(cases.cast(pa.string()).to_pylist(), lengths.cast(pa.string()).to_pylist(), strict=True)
                numbers = [str(s) for s in range(1, samples + 1)]
                keys = Keys([f"{c}|{k}|{s}".encode() for c, k in who for s in numbers])
                limit = np.repeat(batch.column(batch.schema.get_field_index("limit")).to_numpy(zero_copy_only=False).astype(np.int64), samples)
                first = [starts.value[p] for p in zip(states.to_pylist(), activities.to_pylist(), strict=True)]
                at = np.repeat(np.array(first, dtype=np.int32), samples)
                labels, items = np.full((n, max_steps), -1, np.int32), np.full((n, max_steps), -1, np.int32)
                live = np.arange(n)
                for step in range(max_steps):
                    if not len(live):
                        break
                    u = keys.uniform(live, f"|{step}|{seed}".encode())
                    order = np.argsort(at[live], kind="stable")
                    here = at[live[order]]
                    bounds = [0, *(np.flatnonzero(np.diff(here)) + 1).tolist(), len(here)]
                    taken = np.empty(len(live), np.int32)
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                        own = order[a:b]
                        cum, label, then, item = held.value[int(here[a]), step]
                        k = np.minimum(np.searchsorted(cum, u[own], "right"), len(cum) - 1)
                        taken[own] = label[k]
                        at[live[own]] = then[k]
                        items[live[own], step] = item[k]
                    labels[live, step] = np.where(taken == end, -1, taken)
                    live = live[(taken != end) & (step + 1 < limit[live])]
                drawn = pa.StructArray.from_arrays(
                    [pa.array(np.tile(np.arange(1, samples + 1, dtype=np.int32), batch.num_rows)), lists(labels, vocabulary), lists(items)], fields=list(one)
                )
                every = pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, samples, dtype=np.int32)), drawn)
                yield pa.RecordBatch.from_arrays([*batch.columns, every], [*batch.schema.names, "_drawn"])

    # prefixes are few bytes and much work, so their number, not their size, decides the tasks
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-prefixes // PREFIXES_PER_TASK))
    walk = StructType([StructField("sample", IntegerType()), StructField("suffix", ArrayType(StringType())), StructField("_items", ArrayType(IntegerType()))])
    schema = StructType([*keyed.schema.fields, StructField("_drawn", ArrayType(walk))])
    done = keyed.repartition(parts, CASE, "prefix_len").mapInArrow(run, schema)
    done = done.select(*keyed.columns, F.inline("_drawn"))
    known = F.from_json(F.lit(f"[{','.join(items)}]"), TRACE)
    return done.withColumn("trace", F.transform("_items", lambda i: F.get(known, i))).drop("_items", "state", "activity")


# --- decisions scored on the data state ----------------------------------------------

#: steps of prefixes that are decoded side by side
STEPS = 1 << 15
#: counts of category values that a block of prefixes may have
HELD_COUNTS = 1 << 22
#: scored states of a place that a task keeps
HELD_SCORES = 1 << 18


class Scores:
    """Distributions of one place. States that no tree of it tells apart are scored once."""

    def __init__(self, forest: Forest, cats: Sequence[str], nums: Sequence[str]) -> None:
        self.forest, self.cats, self.nums = forest, cats, nums
        inner = forest.left >= 0
        self.bounds = [np.unique(forest.bound[inner & (forest.feature == k)]) for k in range(len(cats), len(cats) + len(nums))]
        sizes = [len(forest.known.get(c, ())) + 1 for c in cats] + [len(b) + 1 for b in self.bounds]
        self.radix = np.cumprod([1, *sizes[:-1]], dtype=float)
        self.whole = float(np.prod(np.array(sizes, dtype=float))) < 2.0**62
        self.clear()

    def clear(self) -> None:
        self.found: dict[int, int] = {}
        self.p = np.zeros((0, len(self.forest.labels)))

    def ids(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``p`` for rows of features (as :meth:`Forest.probabilities` takes them)."""
        bins = [x[:, k].astype(np.int64) + 1 for k in range(len(self.cats))]
        bins += [np.searchsorted(b, x[:, k], "left") for k, b in enumerate(self.bounds, len(self.cats))]
        if not self.whole:
            self.p = np.concatenate([self.p, self.forest.probabilities(x)])
            return np.arange(len(self.p) - len(x), len(self.p))
        key = np.zeros(len(x), np.int64)
        for own, radix in zip(bins, self.radix.tolist(), strict=True):
            key += own * int(radix)
        keys, first, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.array([self.found.get(k, -1) for k in keys.tolist()], dtype=np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            at[fresh] = np.arange(len(self.p), len(self.p) + len(fresh))
            self.p = np.concatenate([self.p, self.forest.probabilities(x[first[fresh]])])
            self.found.update(zip(keys[fresh].tolist(), at[fresh].tolist(), strict=True))
        return at[back]


@dataclass
class Walker:
    """What a task needs to decode prefixes whose decisions are scored on the data state."""

    names: list[str]
    states: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]
    state_of: dict[str, int]
    place_of: dict[str, str]
    attributes: dict[str, dict]
    models: dict[str, Forest]
    features: tuple[list[str], list[str]]
    recorded: tuple[list[str], list[str]]
    rolled: tuple[list[str], list[str]]
    monotone: list[str]
    cfg: Guidance
    strength: list[float]
    trace: pa.DataType
    scores: dict[str, Scores] = field(default_factory=dict)

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
        """Rows, suffixes and traces, some rows at a time."""
        rows = max(1, STEPS // len(self.strength))
        for low in range(0, batch.num_rows, rows):
            parts = [batch.slice(low, rows)]
            while parts:
                part = parts.pop()
                cats = {c: _Counts(part, c, [a[c] for a in self.attributes.values()]) for c in self.rolled[0]}
                if part.num_rows > 1 and any(part.num_rows * len(v.values) > HELD_COUNTS for v in cats.values()):
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part, *self.decode(part, cats)

    def decode(self, batch: pa.RecordBatch, cats: dict[str, _Counts]) -> tuple[pa.Array, pa.Array]:
        n = batch.num_rows
        names, eos = list(self.names), self.names.index(EOS) if EOS in self.names else -1
        code_of = {c: k for k, c in enumerate(names)}
        state = np.array([self.state_of[c] for c in _column(batch, "state").to_pylist()], dtype=np.int64)
        first = _column(batch, "activity").to_pylist()
        for c in first:
            if c not in code_of:
                code_of[c] = len(names)
                names.append(c)
        activity = np.array([code_of[c] for c in first], dtype=np.int64)
        limit = _column(batch, "limit").to_numpy(zero_copy_only=False).astype(np.int64)
        places = sorted({p for p in self.place_of.values() if p in self.models})
        place_no = {p: k for k, p in enumerate(places)}
        place_at = np.array([place_no.get(self.place_of.get(c), -1) for c in names])
        for p in places:
            if p not in self.scores:
                self.scores[p] = Scores(self.models[p], *self.features)
            elif len(self.scores[p].p) > HELD_SCORES:
                self.scores[p].clear()
        nums = {c: _Number(batch, c) for c in self.rolled[1]}
        for c, v in nums.items():
            v.predicted = np.array([self.attributes.get(a, {}).get(c, np.nan) if a is not None else np.nan for a in names], dtype=float)
            v.known = np.array([a in self.attributes and self.attributes[a][c] is not None for a in names])
        for c, v in cats.items():
            v.predicted = np.array([v.code_of.get(self.attributes[a][c], -1) if a in self.attributes else -1 for a in names])
        columns = {c: _Fixed(batch, c) for c in (*self.features[0], *self.recorded[0]) if c not in _rolled(cats)}
        columns |= {c: _FixedNumber(batch, c) for c in (*self.features[1], *self.recorded[1]) if c not in _rolled(nums)}
        for each in (cats, nums):
            columns |= _rolled(each)
        path, live = np.full((n, len(self.strength)), -1, np.int64), np.arange(n)
        items: list[dict[str, np.ndarray]] = []
        for step, beta in enumerate(self.strength):
            if not len(live):
                break
            scored = np.full(len(live), -1, np.int64)
            for k in np.unique(place_at[activity[live]]).tolist():
                if k >= 0:
                    own = np.flatnonzero(place_at[activity[live]] == k)
                    scores = self.scores[places[k]]
                    scored[own] = scores.ids(self._features(scores.forest, columns, live[own]))
            label, p, then = np.empty(len(live), np.int64), np.empty(len(live)), np.empty(len(live), np.int64)
            pair = state[live] * len(names) + activity[live]
            order = np.argsort(pair, kind="stable")
            bounds = [0, *(np.flatnonzero(np.diff(pair[order])) + 1).tolist(), len(live)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = order[a:b]
                labels, base, after, undecided = self.states[int(state[live[own[0]]])]
                k = int(place_at[activity[live[own[0]]]])
                q = base[None, :]
                if k >= 0:
                    q = self._guided(base, undecided, labels, self.scores[places[k]], scored[own], step, beta, code_of)
                # compared at 9 places, ties by label; labels come in rank order
                by_label = np.argsort(np.array([self.names[c] for c in labels.tolist()], dtype=object), kind="stable")
                choice = by_label[np.floor(q[:, by_label] * 1e9 + 0.5).argmax(axis=1)]
                label[own], then[own] = labels[choice], after[choice]
                p[own] = q[np.arange(len(q)), choice]
            goes_on = label != eos
            path[live[goes_on], step] = label[goes_on]
            told = np.flatnonzero(goes_on & (scored >= 0))
            at = live[told]
            items.append(
                {"row": at, "step": np.full(len(at), step), "place": place_at[activity[at]], "scored": scored[told], "before": activity[at], "label": label[told], "p": p[told]}
                | {f"value {c}": columns[c].recorded(at) for c in (*self.recorded[1], *self.recorded[0])}
            )
            onward = goes_on & (step + 1 < limit[live])
            live, label, then = live[onward], label[onward], then[onward]
            state[live], activity[live] = then, label
            for c, v in nums.items():
                v.roll(live, label, c in self.monotone)
            for v in cats.values():
                v.roll(live, label)
        vocabulary = pa.array(names, pa.string())
        own = path >= 0
        suffix = pa.ListArray.from_arrays(_offsets(own.sum(axis=1)), vocabulary.take(pa.array(path[own])))
        return suffix, self._traces(n, items, places, vocabulary, columns, code_of)

    def _features(self, forest: Forest, columns: dict, at: np.ndarray) -> np.ndarray:
        cats, nums = self.features
        x = np.empty((len(at), len(cats) + len(nums)))
        for k, c in enumerate(cats):
            x[:, k] = columns[c].codes(forest.known.get(c, {}), at)
        for k, c in enumerate(nums, len(cats)):
            x[:, k] = columns[c].numbers(at)
        return x

    def _guided(self, base, undecided: bool, labels, scores: Scores, ids, step: int, beta: float, code_of: dict) -> np.ndarray:
        """The distribution of each row, reweighted as :func:`caseloom.functions.distributions.reweight` does."""
        cfg = self.cfg
        z = scores.p[ids]
        if cfg.beta_max <= 0 or not undecided or (cfg.max_guided_steps is not None and step > cfg.max_guided_steps):
            return np.broadcast_to(base, (len(ids), len(base)))
        column = {code_of[c]: k for k, c in enumerate(scores.forest.labels) if c in code_of}
        at = np.array([column.get(c, -1) for c in labels.tolist()])
        branch = np.where(at >= 0, z[:, at], 0.0)
        w = base * np.power(cfg.epsilon + (1 - cfg.epsilon) * branch, beta)
        norm = np.cumsum(w, axis=1)[:, -1:]
        q = np.where(norm > 0, w / np.where(norm > 0, norm, 1.0), base)
        if cfg.min_decision_confidence > 0:
            q = np.where(z.max(axis=1, keepdims=True) >= cfg.min_decision_confidence, q, base)
        return q

    def _traces(self, n: int, items: list[dict], places: list[str], vocabulary: pa.Array, columns: dict, code_of: dict) -> pa.Array:
        """The recorded steps of each row, with what the decision says: support, confidence, top branch."""
        kinds = {f.name: f.type for f in self.trace.value_type}
        if not sum(len(i["row"]) for i in items):
            return pa.array([[]] * n, self.trace)
        all_of = {c: np.concatenate([i[c] for i in items]) for c in items[0]}
        order = np.argsort(all_of["row"], kind="stable")  # steps of a row stay in order
        all_of = {c: v[order] for c, v in all_of.items()}
        # what decisions say, once for each scored state
        both = all_of["place"] * (1 << 40) + all_of["scored"]
        keys, back = np.unique(both, return_inverse=True)
        said: dict[str, list] = {c: [] for c in ("confidence", "top_event", "top_prob", "supported", "non_trivial", "z", "inside")}
        inside = np.zeros(len(both), bool)
        none = np.zeros(len(keys), bool)
        for k in np.unique(keys >> 40).tolist():
            scores = self.scores[places[k]]
            own = np.flatnonzero(keys >> 40 == k)
            p = scores.p[keys[own] & ((1 << 40) - 1)]
            some, names = p > 0, pa.array(scores.forest.labels, pa.string())
            support = some & (p >= self.cfg.support_threshold)
            top = np.where(some, np.floor(p * 1e9 + 0.5), -1).argmax(axis=1)
            tiled = np.broadcast_to(np.arange(p.shape[1]), p.shape)
            said["confidence"].append(pa.array(p.max(axis=1)))
            said["top_event"].append(names.take(pa.array(top)))
            said["top_prob"].append(pa.array(p[np.arange(len(p)), top]))
            said["supported"].append(pa.ListArray.from_arrays(_offsets(support.sum(axis=1)), names.take(pa.array(tiled[support]))))
            said["non_trivial"].append(pa.array(support.sum(axis=1) >= 2))
            said["z"].append(pa.MapArray.from_arrays(_offsets(some.sum(axis=1)), names.take(pa.array(tiled[some])), pa.array(p[some])))
            none[own] = ~support.any(axis=1)
            rows = np.flatnonzero(all_of["place"] == k)
            column = np.full(len(vocabulary), -1)
            for j, c in enumerate(scores.forest.labels):
                if c in code_of:
                    column[code_of[c]] = j
            at = column[all_of["label"][rows]]
            inside[rows] = (at >= 0) & support[back[rows] - own[0], at]
        spread = pa.array(back)
        parts = {c: pa.concat_arrays(v).take(spread) for c, v in said.items() if v}
        parts |= {
            "step": pa.array(all_of["step"].astype(np.int32)),
            "place": pa.array(places, pa.string()).take(pa.array(all_of["place"])),
            "input_event": vocabulary.take(pa.array(all_of["before"])),
            "next_event": vocabulary.take(pa.array(all_of["label"])),
            "model_prob": pa.array(all_of["p"]),
            "conflict": pa.array(~none[back] & ~inside),
        }
        for name, recorded in (("nums", self.recorded[1]), ("cats", self.recorded[0])):
            size = len(recorded)
            keys_of = pa.array(list(recorded), pa.string()).take(pa.array(np.tile(np.arange(size), len(back))))
            values = pa.concat_arrays([columns[c].array(all_of[f"value {c}"]) for c in recorded]) if size else pa.array([], kinds[name].item_type)
            mixed = values.take(pa.array(np.arange(size * len(back)).reshape(size, len(back)).T.ravel()))
            parts[name] = pa.MapArray.from_arrays(pa.array(np.arange(len(back) + 1, dtype=np.int32) * np.int32(size)), keys_of, mixed)
        every = pa.StructArray.from_arrays([parts[c].cast(t) for c, t in kinds.items()], fields=list(self.trace.value_type))
        return pa.ListArray.from_arrays(_offsets(np.bincount(all_of["row"], minlength=n)), every)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


class _Fixed:
    """A category that stays as it is."""

    def __init__(self, batch: pa.RecordBatch, name: str) -> None:
        found = _column(batch, name).dictionary_encode()
        self.values: list = found.dictionary.to_pylist()
        self.code = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def codes(self, known: dict[str, int], at: np.ndarray) -> np.ndarray:
        return np.array([known.get(v, -1) for v in (*self.values, MISSING)])[self.code[at]]

    def recorded(self, at: np.ndarray) -> np.ndarray:
        return self.code[at]

    def array(self, codes: np.ndarray) -> pa.Array:
        return pa.array([*self.values, None], pa.string()).take(pa.array(codes % (len(self.values) + 1)))


class _FixedNumber:
    """A number that stays as it is; ``ok`` where it is not null."""

    def __init__(self, batch: pa.RecordBatch, name: str) -> None:
        found = _column(batch, name)
        self.ok = found.is_valid().to_numpy(zero_copy_only=False)
        self.value = found.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)

    def numbers(self, at: np.ndarray) -> np.ndarray:
        return np.where(self.ok[at] & np.isfinite(self.value[at]), self.value[at], -np.inf)

    def recorded(self, at: np.ndarray) -> np.ndarray:
        return np.rec.fromarrays([self.value[at], self.ok[at]], names="value,ok")

    def array(self, values: np.ndarray) -> pa.Array:
        return pa.array(values["value"], mask=~values["ok"])


class _Number(_FixedNumber):
    """A number with its mean so far, rolled as :func:`caseloom.operators.predict.roll_state` does."""

    def __init__(self, batch: pa.RecordBatch, name: str) -> None:
        super().__init__(batch, name)
        self.summary_name, self.summary = f"{name}_past_avg", _FixedNumber(batch, f"{name}_past_avg")
        self.sum, self.n = (_column(batch, f"{name}_{c}").to_numpy(zero_copy_only=False).astype(float) for c in ("sum", "n"))

    def roll(self, at: np.ndarray, label: np.ndarray, monotone: bool) -> None:
        self.sum[at] += np.where(self.ok[at], self.value[at], 0.0)
        self.n[at] += self.ok[at]
        new = np.where(self.known[label], self.predicted[label], self.value[at])
        if monotone:
            new = np.where(self.ok[at] & ((self.value[at] > new) | np.isnan(self.value[at])), self.value[at], new)
        self.value[at], self.ok[at] = new, self.ok[at] | self.known[label]
        some = self.n[at] > 0
        self.summary.value[at] = np.where(some, self.sum[at] / np.maximum(self.n[at], 1), self.value[at])
        self.summary.ok[at] = some | self.ok[at]


class _Counts(_Fixed):
    """A category with the values seen so far, rolled as :func:`caseloom.operators.predict.roll_state` does."""

    def __init__(self, batch: pa.RecordBatch, name: str, predicted: list) -> None:
        super().__init__(batch, name)
        seen = _column(batch, f"{name}_counts")
        inner, sizes = seen.flatten(), seen.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        listed = inner.field("v").to_pylist()
        mode = _column(batch, f"{name}_past_mode").to_pylist()
        self.values = sorted({v for v in (*self.values, *listed, *mode, *predicted) if v is not None})
        self.code_of = {v: k for k, v in enumerate(self.values)}
        self.code = np.array([self.code_of.get(v, -1) for v in _column(batch, name).to_pylist()], dtype=np.int64)
        self.row, self.listed = np.repeat(np.arange(batch.num_rows), sizes), np.array([self.code_of[v] for v in listed], dtype=np.int64)
        self.counted, self.first = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "first"))
        self.size = sizes.astype(np.int64)
        self.n: np.ndarray | None = None
        self.summary_name, self.summary = f"{name}_past_mode", _Fixed(batch, f"{name}_past_mode")
        self.summary.values = self.values
        self.summary.code = np.array([self.code_of.get(v, -1) for v in mode], dtype=np.int64)

    def roll(self, at: np.ndarray, label: np.ndarray) -> None:
        if self.n is None:
            self.n, self.order = (np.zeros((len(self.code), max(1, len(self.values))), np.int64) for _ in range(2))
            self.n[self.row, self.listed], self.order[self.row, self.listed] = self.counted, self.first
        own = at[self.code[at] >= 0]
        code = self.code[own]
        fresh = self.n[own, code] == 0
        self.order[own[fresh], code[fresh]] = -self.size[own[fresh]]
        self.size[own[fresh]] += 1
        self.n[own, code] += 1
        self.code[at] = np.where(self.predicted[label] >= 0, self.predicted[label], self.code[at])
        # most often seen, then seen first
        best = np.where(self.n[at] > 0, (self.n[at] << 32) + self.order[at], -1)
        mode = best.argmax(axis=1)
        self.summary.code[at] = np.where(best.max(axis=1) >= 0, mode, self.code[at])


def _rolled(each: dict) -> dict:
    """Columns of a data state: values and their summaries."""
    return {c: v for c, v in each.items()} | {v.summary_name: v.summary for v in each.values()}


def walk_best(keyed: DataFrame, model: NextModel, max_steps: int, decisions: Decisions) -> DataFrame | None:
    """``suffix, trace`` of the guided arg-max of every prefix (with ``state``, ``activity`` and its data state).

    None where tasks cannot hold the model, or the data state has columns of other types.
    """
    score, rolling, cfg = decisions.score, decisions.rolling, decisions.cfg
    if rolling is None or not hasattr(score, "models") or not max_steps:
        return None
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    cats = {*rolling.cats, *score.cats, *decisions.cats, *[f"{c}_past_mode" for c in rolling.cats]}
    nums = {*rolling.nums, *score.nums, *decisions.nums, *[f"{c}_{x}" for c in rolling.nums for x in ("sum", "past_avg")]}
    if any(kinds.get(c) != "string" for c in cats) or any(kinds.get(c) != "double" for c in nums):
        return None
    entries = model.table.agg(F.sum(F.size("entries"))).first()[0] or 0
    context = decisions.context.select("activity", "place").limit(HELD_ENTRIES + 1).collect()
    rolled = rolling.attributes.limit(HELD_ENTRIES + 1).collect()
    if not 0 < entries <= HELD_ENTRIES or max(len(context), len(rolled)) > HELD_ENTRIES or len({r["activity"] for r in context}) < len(context):
        return None
    undecided = F.lit(True)
    if cfg.min_base_entropy > 0:
        classes = F.lit(model.classes)
        undecided = (classes <= 1) | (normalised_entropy(entry_map(F.col("entries")), classes) >= cfg.min_base_entropy)
    table = model.table.select("state", "entries", undecided.alias("undecided")).collect()
    names = sorted({e["label"] for r in table for e in r["entries"]} | {r["activity"] for r in context if r["activity"] is not None})
    code_of, state_of = {c: k for k, c in enumerate(names)}, {r["state"]: k for k, r in enumerate(table)}
    states = [
        (
            np.array([code_of[e["label"]] for e in r["entries"]]), np.array([e["p"] for e in r["entries"]]),
            np.array([state_of.get(e["next_state"], -1) for e in r["entries"]]), r["undecided"],
        )
        for r in table
    ]
    spark = keyed.sparkSession
    beta = F.lit(float(cfg.beta_max)) * F.exp(F.lit(-float(cfg.alpha)) * F.col("id").cast("int"))
    strength = [r["b"] for r in spark.range(max_steps).select("id", beta.alias("b")).orderBy("id").collect()]
    attributes = {
        r["activity"]: {c: r[f"{c}__mode"] for c in rolling.cats} | {c: r[f"{c}__mean"] for c in rolling.nums}
        for r in rolled if r["activity"] is not None
    }
    trace = StructField("trace", spark.createDataFrame([], f"trace {TRACE}").schema["trace"].dataType)
    gone = {"state", "activity", *rolling.cats, *rolling.nums, *[f"{c}_{x}" for c in rolling.cats for x in ("counts", "past_mode")], *[f"{c}_{x}" for c in rolling.nums for x in ("sum", "n", "past_avg")]}
    kept = [f for f in keyed.schema.fields if f.name not in gone]
    schema = StructType([*kept, StructField("suffix", ArrayType(StringType())), trace])
    arrow = to_arrow_schema(schema)
    walker = Walker(
        names, states, state_of, {r["activity"]: r["place"] for r in context if r["activity"] is not None}, attributes, score.models, (score.cats, score.nums),
        (list(decisions.cats), list(decisions.nums)), (list(rolling.cats), list(rolling.nums)), list(rolling.monotone), cfg, strength, arrow.field("trace").type,
    )
    held = spark.sparkContext.broadcast(walker)
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, suffix, told in held.value.blocks(batch):
                yield pa.RecordBatch.from_arrays([*(_column(part, c) for c in keep), suffix, told], [*keep, "suffix", "trace"])

    # prefixes are few bytes and much work, so their number, not their size, decides the tasks
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-keyed.count() // PREFIXES_PER_TASK))
    return keyed.repartition(parts, CASE, "prefix_len").mapInArrow(run, schema)
