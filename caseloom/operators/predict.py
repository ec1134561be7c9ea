"""Next-activity count model and suffix decoding.

The model is a table with one row per context (``state``): the last activities
as far back as the training data supports. Its entries name the next state, so
one step of decoding is one lookup. What depends on the state alone (arg-max
paths, beams) is decoded once per state and then joined to the prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from caseloom.functions.arrays import bind, upto_eos
from caseloom.functions.distributions import (
    Guidance,
    is_conflict,
    normal,
    pick as pick_entry,
    reweight,
    supported,
    top_probability,
    uniform,
)
from caseloom.functions.hashes import Keys
from caseloom.functions.text import EOS
from caseloom.operators.ordering import CASE, EventLog, around
from caseloom.session import cut, settled, small

SEP = "\x1f"
TRACE = (
    "array<struct<step:int,place:string,input_event:string,next_event:string,model_prob:double,confidence:double,"
    "top_event:string,top_prob:double,supported:array<string>,non_trivial:boolean,conflict:boolean,"
    "z:map<string,double>,nums:map<string,double>,cats:map<string,string>>>"
)


# --- model -------------------------------------------------------------------


@dataclass(frozen=True)
class NextModel:
    """``state, total, entries``: entries (label, p, cum, next_state) by falling count."""

    table: DataFrame
    order: int

    @property
    def states(self) -> DataFrame:
        return self.table.select("state")

    @property
    def classes(self) -> int:
        """Size of the vocabulary with the end marker: the empty context has every label."""
        whole = self.table.where("state = ''").select(F.size("entries")).first()
        return whole[0] if whole else 0


def _suffix_keys(items: Column, order: int) -> list[Column]:
    """Texts of the last ``order`` .. 1 items, null where there are fewer."""
    return [
        F.when(F.size(items) >= k, F.array_join(F.slice(items, -k, k), SEP)) for k in range(order, 0, -1)
    ]


def count_model(train: EventLog, order: int = 2, min_support: int = 1) -> NextModel:
    """Counts of the next activity after each context of up to ``order`` activities.

    A context needs ``min_support`` observations; the empty context always stays.
    """

    def contexts(df: DataFrame, w) -> DataFrame:
        items = F.array_compact(F.array(*[F.lag("activity", k).over(w) for k in range(order - 1, 0, -1)], F.col("activity")))
        nxt = F.coalesce(F.lead("activity").over(w), F.lit(EOS))
        return df.withColumn("_items", items).withColumn("_next", nxt)

    seen = around(train, contexts, before=order - 1, after=1).events
    keys = F.array_compact(F.array(*_suffix_keys(F.col("_items"), order), F.lit("")))
    counts = (
        seen.select(F.explode(keys).alias("state"), F.col("_next").alias("label"))
        .groupBy("state", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_state = Window.partitionBy("state")
    ranked = by_state.orderBy(F.desc("n"), "label")
    counts = cut(
        counts.withColumn("total", F.sum("n").over(by_state))
        .where((F.col("total") >= min_support) | (F.col("state") == ""))
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("upto", F.sum("n").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    )
    states = counts.select(F.col("state").alias("next_state")).distinct()
    grown = F.concat(
        F.when(F.col("state") == "", F.array().cast("array<string>")).otherwise(F.split("state", SEP)), F.array("label")
    )
    candidates = counts.where(F.col("label") != EOS).select(
        "state", "label", F.explode(F.array_compact(F.array(*_suffix_keys(grown, order), F.lit("")))).alias("next_state")
    )
    follow = (
        candidates.join(states, "next_state", "left_semi")
        .groupBy("state", "label")
        .agg(F.max_by("next_state", F.length("next_state")).alias("next_state"))
    )
    entry = F.struct(
        "rank",
        "label",
        (F.col("n") / F.col("total")).alias("p"),
        (F.col("upto") / F.col("total")).alias("cum"),
        "next_state",
    )
    table = (
        counts.join(follow, ["state", "label"], "left")
        .groupBy("state", "total")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    return NextModel(cut(table), order)


def attach_state(df: DataFrame, model: NextModel, items: Column, out: str = "state") -> DataFrame:
    """Longest supported context at the end of ``items``."""
    known = small(model.states.withColumnRenamed("state", "_known"))
    found = []
    for i, key in enumerate(_suffix_keys(items, model.order)):
        df = df.withColumn(f"_key{i}", key)
        df = df.join(known.withColumnRenamed("_known", f"_hit{i}"), F.col(f"_key{i}") == F.col(f"_hit{i}"), "left")
        found.append(F.col(f"_hit{i}"))
    state = F.coalesce(*found, F.lit(""))
    extra = [f"_{n}{i}" for i in range(len(found)) for n in ("key", "hit")]
    return df.withColumn(out, state).drop(*extra)


def next_distribution(df: DataFrame, model: NextModel, out: str = "p") -> DataFrame:
    """Distribution over next activities of each row's state."""
    looked = df.join(small(model.table), "state", "left")
    return looked.withColumn(out, entry_map(F.col("entries"))).drop("entries", "total")


def entry_map(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["label"], e["p"])))


def with_limit(pairs: DataFrame, window: int, min_suffix: int) -> DataFrame:
    """Most steps a prefix may be extended by (inclusive limit)."""
    return pairs.withColumn("limit", (F.lit(window - min_suffix + 1) - F.col("prefix_len")).cast("int"))


# --- arg-max -------------------------------------------------------------------


def greedy_paths(model: NextModel, steps: int) -> DataFrame:
    """``state, path``: the arg-max continuation of every state, at least ``steps`` long or ended.

    Paths double: what follows m steps is the path of the state reached there.
    """
    best = F.get(F.col("entries"), F.lit(0))
    ended = best["label"] == EOS
    paths = cut(
        model.table.select(
            "state",
            F.when(ended, F.array().cast("array<string>")).otherwise(F.array(best["label"])).alias("path"),
            F.when(~ended, best["next_state"]).alias("at"),
        )
    )
    length = 1
    while length < steps:
        onward = small(paths.select(F.col("state").alias("at"), F.col("path").alias("more"), F.col("at").alias("then")))
        paths = cut(
            paths.join(onward, "at", "left").select(
                "state",
                F.concat("path", F.coalesce("more", F.array().cast("array<string>"))).alias("path"),
                F.col("then").alias("at"),
            )
        )
        length *= 2
    return paths.select("state", "path")


def decode_greedy(prefixes: DataFrame, model: NextModel, max_steps: int) -> DataFrame:
    """Arg-max suffix of every prefix (needs ``prefix`` and ``limit``)."""
    keyed = attach_state(prefixes, model, F.col("prefix"))
    joined = keyed.join(small(greedy_paths(model, max_steps)), "state")
    suffix = F.slice("path", F.lit(1), F.col("limit"))
    return joined.withColumn("decoded_suffixes", F.array(suffix)).withColumn("mode", F.lit("mode")).drop("path", "state")


# --- step-wise decoding ----------------------------------------------------------


@dataclass(frozen=True)
class Rolling:
    """What a data state is rolled with: predicted attributes per activity, columns, those that never fall."""

    attributes: DataFrame
    cats: Sequence[str]
    nums: Sequence[str]
    monotone: Sequence[str] = ()


@dataclass(frozen=True)
class Decisions:
    """How a decode step finds its decision: activity → place, and the distribution there.

    ``context`` is ``activity, place`` or with fixed ``z``; ``score`` adds ``z``
    from the data state when it is not fixed. ``roll`` updates the data state
    after a step, ``rolling`` says with what. ``nums`` and ``cats`` are recorded
    for rule matching.
    """

    context: DataFrame
    cfg: Guidance
    score: Callable[[DataFrame], DataFrame] | None = None
    roll: Callable[[DataFrame], DataFrame] | None = None
    nums: Sequence[str] = ()
    cats: Sequence[str] = ()
    rolling: Rolling | None = None


def start_frontier(df: DataFrame) -> DataFrame:
    """Rows ready for decoding: ``state`` and ``activity`` are given."""
    return df.withColumns(
        {
            "seq": F.array().cast("array<string>"),
            "score": F.lit(0.0),
            "step": F.lit(0),
            "done": F.lit(False),
            "trace": F.array().cast(TRACE),
        }
    )


def _ranked(dist: Column) -> Column:
    """Entries by falling probability (compared at 9 places), ties by label."""
    return F.array_sort(
        F.transform(
            F.map_entries(dist),
            lambda e: F.struct(
                (-F.round(e["value"], 9)).alias("rank"), e["key"].alias("label"), e["value"].alias("p")
            ),
        )
    )


def _feature_maps(d: Decisions) -> tuple[Column, Column]:
    nums = F.create_map(*[x for c in d.nums for x in (F.lit(c), F.col(c).cast("double"))]) if d.nums else F.create_map().cast("map<string,double>")
    cats = F.create_map(*[x for c in d.cats for x in (F.lit(c), F.col(c).cast("string"))]) if d.cats else F.create_map().cast("map<string,string>")
    return nums, cats


def describe(df: DataFrame, cfg: Guidance) -> DataFrame:
    """What a reasoning row says about a decision: support, confidence, top branch."""
    df = df.withColumns({"support": supported(F.col("z"), cfg.support_threshold), "top": F.get(_ranked(F.col("z")), F.lit(0))})
    return df.withColumns({"confidence": top_probability(F.col("z"))})


DESCRIBED = ("place", "z", "support", "top", "confidence")


def _tables(model: NextModel, decisions: Decisions | None) -> tuple[DataFrame, DataFrame | None]:
    table = small(model.table.select("state", "entries", entry_map(F.col("entries")).alias("base")))
    if decisions is None:
        return table, None
    context = decisions.context
    if decisions.score is None:
        context = describe(context, decisions.cfg).select("activity", *DESCRIBED)
    return table, settled(context)


@dataclass(frozen=True)
class _Step:
    """Expressions of one decode step, built once; ``step`` is a column."""

    dist: Column | None
    cols: dict[str, Column]
    drop: tuple[str, ...]


def _step(model: NextModel, decisions: Decisions | None) -> _Step:
    """How a row changes once ``chosen`` (label, p) is known."""
    label = F.col("chosen.label")
    running = ~F.col("done")
    goes_on = running & (label != EOS)
    found = F.get(F.filter("entries", lambda e: e["label"] == label), F.lit(0))
    cols = {
        "_before": F.col("done"),
        "seq": F.when(running, F.concat("seq", F.array(label))).otherwise(F.col("seq")),
        "state": F.when(goes_on, found["next_state"]).otherwise(F.col("state")),
        "done": F.col("done") | (label == EOS) | (F.col("step") + 1 >= F.col("limit")),
        "activity": F.when(goes_on, label).otherwise(F.col("activity")),
        "step": F.col("step") + 1,
    }
    drop = ("entries", "dist", "chosen", "_before")
    if decisions is None:
        return _Step(None, cols, drop)
    nums, cats = _feature_maps(decisions)
    item = F.struct(
        F.col("step"),
        F.col("place"),
        F.col("activity").alias("input_event"),
        label.alias("next_event"),
        F.col("chosen.p").alias("model_prob"),
        F.col("confidence"),
        F.col("top.label").alias("top_event"),
        F.col("top.p").alias("top_prob"),
        F.col("support").alias("supported"),
        (F.size("support") >= 2).alias("non_trivial"),
        is_conflict(label, F.col("support")).alias("conflict"),
        F.col("z"),
        nums.alias("nums"),
        cats.alias("cats"),
    )
    cols["trace"] = F.when(
        goes_on & F.col("place").isNotNull() & F.col("z").isNotNull(), F.concat("trace", F.array(item).cast(TRACE))
    ).otherwise(F.col("trace"))
    classes = F.lit(model.classes) if decisions.cfg.min_base_entropy > 0 else None
    guided = reweight(F.col("base"), F.col("z"), F.col("step"), decisions.cfg, classes)
    return _Step(guided, cols, (*drop, "base", *DESCRIBED))


def _expand(df: DataFrame, table: DataFrame, context: DataFrame | None, decisions: Decisions | None, one: _Step) -> DataFrame:
    """Look up the (guided) distribution of every row."""
    df = df.join(table, "state", "left")
    if decisions is None:
        return df.withColumnRenamed("base", "dist")
    df = df.join(context, "activity", "left")
    if decisions.score is not None:
        df = describe(decisions.score(df), decisions.cfg)
    return df.withColumn("dist", one.dist)


def _advance(df: DataFrame, chosen: Column, decisions: Decisions | None, one: _Step) -> DataFrame:
    """Append the chosen activity, move the state, record the decision."""
    df = df.withColumn("chosen", chosen).withColumns(one.cols)
    if decisions is not None and decisions.roll is not None:
        df = decisions.roll(df)
    return df.drop(*one.drop)


def decode_steps(
    frontier: DataFrame,
    model: NextModel,
    max_steps: int,
    *,
    pick: str = "best",
    draw_keys: Sequence[str] = (),
    seed: int = 0,
    decisions: Decisions | None = None,
    every: int = 4,
) -> DataFrame:
    """Extend every row step by step with the best or a drawn activity.

    Lookups are map-side joins with size-checked tables; the lineage is cut
    every few steps. Rows that have ended are set aside there, so they are neither
    scored nor written again, and decoding stops when no row is running.
    """
    table, context = _tables(model, decisions)
    one = _step(model, decisions)
    ended: list[DataFrame] = []
    if pick == "best":
        chosen = F.get(_ranked(F.col("dist")), F.lit(0))
    else:
        u = uniform(*[F.col(k) for k in draw_keys], F.col("step"), F.lit(seed))
        if decisions is None:
            chosen = F.when(F.col("entries").isNotNull(), pick_entry(F.col("entries"), u))
        else:
            chosen = draw(F.col("dist"), u)
    chosen = F.when(~F.col("done"), chosen)
    df = start_frontier(frontier)
    for step in range(max_steps):
        df = _advance(_expand(df, table, context, decisions, one), chosen, decisions, one)
        if (step + 1) % every == 0 or step + 1 == max_steps:
            df = cut(df)
            ended.append(df.where("done"))
            df = df.where(~F.col("done"))
            if df.limit(1).count() == 0:
                break
    for part in ended:
        df = df.unionByName(part)
    return df


def step_options(pairs: DataFrame, model: NextModel, max_steps: int, decisions: Decisions) -> DataFrame:
    """What every step can be at each ``state, activity``: one row per step and next activity, most likely first.

    ``at_state, at_activity, at_step, no`` name the option, ``label, p, state, trace`` are
    the activity chosen, its probability, the state after it and what is recorded.
    """
    table, context = _tables(model, decisions)
    one = _step(model, decisions)
    one = _Step(one.dist, one.cols, tuple(c for c in one.drop if c != "chosen"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(max_steps - 1)))
    df = start_frontier(pairs.withColumn("limit", F.lit(max_steps + 1))).withColumn("step", steps)
    df = df.withColumns({"at_state": F.col("state"), "at_activity": F.col("activity"), "at_step": F.col("step")})
    numbered = F.transform(_ranked(F.col("dist")), lambda e, i: F.struct(e["label"].alias("label"), e["p"].alias("p"), i.alias("no")))
    df = _advance(_expand(df, table, context, decisions, one), F.explode(numbered), decisions, one)
    return df.select("at_state", "at_activity", "at_step", "chosen.no", "chosen.label", "chosen.p", "state", "trace")


def draw(dist: Column, u: Column) -> Column:
    """Inverse-CDF draw from a distribution in ranked order."""
    ranked = _ranked(dist)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("p"))
    return bind(
        u,
        lambda x: F.aggregate(
            ranked,
            start,
            lambda acc, e: F.when(acc["cum"] > x, acc).otherwise(
                F.struct((acc["cum"] + e["p"]).alias("cum"), e["label"].alias("label"), e["p"].alias("p"))
            ),
        ),
    )


def decode_beams(
    frontier: DataFrame,
    model: NextModel,
    max_steps: int,
    keys: Sequence[str],
    width: int = 3,
    *,
    decisions: Decisions | None = None,
    snapshots: bool = False,
) -> DataFrame:
    """Keep the ``width`` most likely sequences per ``keys``.

    With ``snapshots`` the beams after every number of steps are returned in
    ``steps``, so that one decode serves prefixes with different limits.
    """
    table, context = _tables(model, decisions)
    one = _step(model, decisions)
    nothing = F.struct(F.lit(0.0).alias("rank"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("p"))
    options = F.explode(F.when(F.col("done"), F.array(nothing)).otherwise(F.slice(_ranked(F.col("dist")), 1, width)))
    floor = 1e-12 if decisions is not None else 0.0
    gained = F.col("score") + F.when(F.col("done"), 0.0).otherwise(F.ln(F.col("chosen.p") + floor))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), F.array_join("seq", SEP))
    beam = F.row_number().over(order)
    cols = {**one.cols, "score": gained}
    one = _Step(one.dist, cols, one.drop)
    df = start_frontier(frontier)
    taken: list[DataFrame] = []
    last = max_steps
    for step in range(max_steps):
        df = _advance(_expand(df, table, context, decisions, one), options, decisions, one)
        df = cut(df.withColumn("beam", beam).where(F.col("beam") <= width))
        if snapshots:
            taken.append(df.withColumn("steps", F.lit(step + 1)))
        df = df.drop("beam")
        if df.where(~F.col("done")).limit(1).count() == 0:
            last = step + 1
            break
    if not snapshots:
        return df.withColumn("beam", beam)
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out.withColumn("last_step", F.lit(last))


def beams_for_prefixes(prefixes: DataFrame, beams: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Join the beams of each state after ``limit`` steps (or the last step computed) to the prefixes."""
    last = beams.agg(F.max("last_step").alias("last")).first()["last"]
    item = F.struct("beam", upto_eos(F.col("seq")).alias("suffix"), "score", *carry)
    lists = beams.groupBy(*keys, "steps").agg(F.array_sort(F.collect_list(item)).alias("beams")) if not carry else (
        beams.groupBy(*keys, "steps").agg(F.collect_list(item).alias("beams"))
    )
    wanted = prefixes.withColumn("steps", F.least(F.col("limit"), F.lit(last)))
    return wanted.join(small(lists), [*keys, "steps"]).drop("steps")


def decode_beam(prefixes: DataFrame, model: NextModel, max_steps: int, width: int = 3) -> DataFrame:
    """Beam suffixes of every prefix, best first."""
    keyed = attach_state(prefixes, model, F.col("prefix"))
    starts = model.table.select(
        F.col("state").alias("start"), "state", F.lit(None).cast("string").alias("activity"), F.lit(max_steps + 1).alias("limit")
    )
    beams = decode_beams(starts, model, max_steps, ["start"], width, snapshots=True)
    joined = beams_for_prefixes(keyed.withColumnRenamed("state", "start"), beams, ["start"])
    return (
        joined.withColumn("decoded_suffixes", F.transform("beams", lambda b: b["suffix"]))
        .withColumn("scores", F.transform("beams", lambda b: b["score"]))
        .withColumn("mode", F.lit("beam"))
        .drop("beams", "start")
    )


#: entries of a model (some 50 bytes each) that every task may hold
HELD_ENTRIES = 500_000
#: prefixes whose samples one task draws
PREFIXES_PER_TASK = 20_000


def decode_samples(
    prefixes: DataFrame, model: NextModel, max_steps: int, samples: int, seed: int = 17, together: bool = False
) -> DataFrame:
    """``samples`` drawn suffixes per prefix, one row per sample.

    Tasks hold a model of up to ``HELD_ENTRIES`` entries and draw all samples of
    their prefixes in one pass; a larger model is looked up by joins, step by step.
    Both make the same draws, which hash the prefix, the sample and the step. With
    ``together`` a held model leaves the samples in the row of their prefix, for
    :func:`collect_samples`.
    """
    keyed = attach_state(prefixes, model, F.col("prefix"))
    rows = keyed.select(CASE, "prefix_len", "limit", "state")
    entries = model.table.agg(F.sum(F.size("entries"))).first()[0] or 0
    if 0 < entries <= HELD_ENTRIES:
        # prefixes are few bytes and much work, so their number, not their size, decides the tasks
        parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-prefixes.count() // PREFIXES_PER_TASK))
        dealt = (keyed if together else rows).repartition(parts, CASE, "prefix_len")
        return _walk_samples(dealt, model, max_steps, samples, seed, together=together)
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    rows = rows.withColumn("activity", F.lit(None).cast("string"))
    done = decode_steps(rows, model, max_steps, pick="draw", draw_keys=[CASE, "prefix_len", "sample"], seed=seed, every=8)
    return done.select(CASE, "prefix_len", "sample", upto_eos(F.col("seq")).alias("suffix"))


def _walk_samples(
    rows: DataFrame, model: NextModel, max_steps: int, samples: int, seed: int, walks: int = 1 << 15, together: bool = False
) -> DataFrame:
    """All samples of a batch of prefixes side by side, one step at a time."""
    table = model.table.collect()
    number = {r["state"]: k for k, r in enumerate(table)}
    names = sorted({e["label"] for r in table for e in r["entries"]})
    label_of = {n: k for k, n in enumerate(names)}
    held = rows.sparkSession.sparkContext.broadcast(
        [
            (
                np.array([e["cum"] for e in r["entries"]]),
                np.array([label_of[e["label"]] for e in r["entries"]]),
                np.array([number.get(e["next_state"], -1) for e in r["entries"]]),
            )
            for r in table
        ]
    )
    end = label_of.get(EOS, -1)
    vocabulary = pa.array(names, pa.string())

    def column(batch: pa.RecordBatch, name: str) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, max(1, walks // samples)):
                batch = whole.slice(low, max(1, walks // samples))
                n = batch.num_rows * samples
                row, sample = np.repeat(np.arange(batch.num_rows), samples), np.tile(np.arange(1, samples + 1), batch.num_rows)
                cases, lengths = column(batch, CASE).cast(pa.string()).to_pylist(), column(batch, "prefix_len").cast(pa.string()).to_pylist()
                numbers = [str(s) for s in range(1, samples + 1)]
                keys = Keys([f"{c}|{k}|{s}".encode() for c, k in zip(cases, lengths, strict=True) for s in numbers])
                limit = np.repeat(column(batch, "limit").to_numpy(zero_copy_only=False).astype(np.int64), samples)
                state = np.repeat(np.array([number[x] for x in column(batch, "state").to_pylist()], dtype=np.int64), samples)
                path, live = [], np.arange(n)
                for step in range(max_steps):
                    if not len(live):
                        break
                    u = keys.uniform(live, f"|{step}|{seed}".encode())
                    taken = np.empty(len(live), np.int64)
                    then = np.empty(len(live), np.int64)
                    for s in np.unique(state[live]).tolist():
                        own = np.flatnonzero(state[live] == s)
                        cum, labels, following = held.value[s]
                        at = np.minimum(np.searchsorted(cum, u[own], "right"), len(cum) - 1)
                        taken[own], then[own] = labels[at], following[at]
                    steps = np.full(n, -1, np.int64)
                    steps[live] = np.where(taken == end, -1, taken)
                    path.append(steps)
                    state[live] = then
                    live = live[(taken != end) & (step + 1 < limit[live])]
                steps = np.stack(path, axis=1) if path else np.zeros((n, 0), np.int64)
                size = (steps >= 0).sum(axis=1)
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                suffix = pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(steps[steps >= 0])))
                if together:
                    every = pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, samples, dtype=np.int32)), suffix)
                    yield pa.RecordBatch.from_arrays([*batch.columns, every], [*batch.schema.names, "decoded_suffixes"])
                    continue
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, CASE).take(at), column(batch, "prefix_len").take(at), pa.array(sample.astype(np.int32)), suffix],
                    [CASE, "prefix_len", "sample", "suffix"],
                )

    if together:
        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded_suffixes", ArrayType(ArrayType(StringType())))])).drop("state")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"{CASE} {kinds[CASE]}, prefix_len {kinds['prefix_len']}, sample int, suffix array<string>")


def collect_samples(prefixes: DataFrame, sampled: DataFrame) -> DataFrame:
    """All samples of a prefix in one row, where they are not drawn so."""
    if "decoded_suffixes" in sampled.columns:
        return sampled.withColumn("mode", F.lit("probabilistic"))
    lists = sampled.groupBy(CASE, "prefix_len").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample", "suffix"))), lambda s: s["suffix"]).alias("decoded_suffixes")
    )
    return prefixes.join(lists, [CASE, "prefix_len"]).withColumn("mode", F.lit("probabilistic"))


# --- predicted attributes ----------------------------------------------------------


def attribute_model(train: EventLog, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """Per activity the usual category and the mean and deviation of numbers."""
    out = train.events.groupBy("activity").agg(
        *[F.avg(c).alias(f"{c}__mean") for c in nums], *[F.stddev_pop(c).alias(f"{c}__std") for c in nums],
        F.count(F.lit(1)).alias("support"),
    )
    for c in cats:
        counts = train.events.where(F.col(c).isNotNull()).groupBy("activity", c).agg(F.count(F.lit(1)).alias("n"))
        usual = counts.groupBy("activity").agg(
            F.min_by(F.col(c), F.struct((-F.col("n")).alias("n"), F.col(c))).alias(f"{c}__mode")
        )
        out = out.join(usual, "activity", "left")
    return out


def category_model(train: EventLog, column: str) -> DataFrame:
    """``activity, options``: per activity the values of a category with logit and log-variance.

    The logit is the log of the value's share; its variance (1 - share) / count is
    that of a log share, kept between e**-6 and e**6.
    """
    counts = train.events.where(F.col(column).isNotNull()).groupBy("activity", F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("activity"))
    spread = F.ln(F.greatest((1 - F.col("share")) / F.col("n"), F.lit(1e-12)))
    option = F.struct("v", F.ln("share").alias("logit"), F.greatest(F.lit(-6.0), F.least(F.lit(6.0), spread)).alias("logvar"))
    return counts.withColumn("share", share).groupBy("activity").agg(F.array_sort(F.collect_list(option)).alias("options"))


def sample_category(options: Column, keys: Sequence[Column], noise: bool = False, best: bool = False) -> Column:
    """A category from its options (v, logit, logvar): the most likely one, or a draw.

    A draw adds a Gumbel variate to each logit and takes the largest, which is a
    draw from the softmax of the logits. ``noise`` moves each logit first by a
    Gaussian of its own variance. Randomness is hashed from the keys and the value;
    scores are compared at 9 places, ties go to the later value in order.
    """

    def score(o: Column) -> Column:
        value = o["logit"]
        if noise:
            value = value + F.exp(0.5 * o["logvar"]) * normal(uniform(*keys, o["v"], F.lit("n1")), uniform(*keys, o["v"], F.lit("n2")))
        if not best:
            value = value - F.ln(-F.ln(F.greatest(uniform(*keys, o["v"], F.lit("g")), F.lit(1e-12))))
        return F.struct(F.round(value, 9).alias("score"), o["v"].alias("v"))

    return F.array_max(F.transform(options, score))["v"]


def roll_attributes(
    df: DataFrame, attributes: DataFrame, cats: Sequence[str], nums: Sequence[str], activity: Column, monotone: Sequence[str] = ()
) -> DataFrame:
    """Predicted values where known, else the last value; cumulative columns never fall."""
    lookup = attributes.withColumnRenamed("activity", "_for")
    joined = df.join(lookup, activity == F.col("_for"), "left")
    cols: dict[str, Column] = {}
    for c in cats:
        cols[c] = F.coalesce(F.col(f"{c}__mode"), F.col(c))
    for c in nums:
        value = F.coalesce(F.col(f"{c}__mean"), F.col(c))
        cols[c] = F.greatest(value, F.col(c)) if c in monotone else value
    gone = ["_for", "support", *[f"{c}__mode" for c in cats], *[f"{c}__mean" for c in nums], *[f"{c}__std" for c in nums]]
    return joined.withColumns(cols).drop(*gone)


def sample_number(mean: Column, std: Column, keys: Sequence[Column]) -> Column:
    """Gaussian draw with a hashed source of randomness."""
    return mean + std * normal(uniform(*keys, F.lit("u1")), uniform(*keys, F.lit("u2")))


def _value_counts(values: Column) -> Column:
    """``n, first, v`` per distinct value; ``first`` falls with later first sight."""
    return F.transform(
        F.array_distinct(values),
        lambda v, i: F.struct(F.size(F.filter(values, lambda y: y == v)).alias("n"), (-i).alias("first"), v.alias("v")),
    )


def start_state_features(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """Data state of a prefix from its attribute lists, as columns that can be rolled.

    ``c`` is the last value; ``_sum``/``_n`` and the value counts cover the events before it.
    """
    cols: dict[str, Column] = {}
    for c in nums:
        earlier = F.filter(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x.isNotNull())
        cols[f"{c}_sum"] = F.aggregate(earlier, F.lit(0.0), lambda acc, x: acc + x)
        cols[f"{c}_n"] = F.size(earlier)
    for c in cats:
        earlier = F.filter(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x.isNotNull())
        cols[f"{c}_counts"] = bind(earlier, _value_counts)
    df = df.withColumns(cols)
    df = df.withColumns({c: F.element_at(c, -1) for c in [*nums, *cats]})
    return with_summaries(df, cats, nums)


def with_summaries(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """Mean and mode columns from the running state, the last value without history."""
    cols: dict[str, Column] = {}
    for c in nums:
        cols[f"{c}_past_avg"] = F.coalesce(F.try_divide(f"{c}_sum", f"{c}_n"), F.col(c))
    for c in cats:
        cols[f"{c}_past_mode"] = F.coalesce(F.array_max(f"{c}_counts")["v"], F.col(c))
    return df.withColumns(cols)


def roll_state(
    df: DataFrame, attributes: DataFrame, cats: Sequence[str], nums: Sequence[str], moved: Column, activity: Column, monotone: Sequence[str] = ()
) -> DataFrame:
    """One predicted event further: the last values join the history, predicted ones take their place.

    Columns in ``monotone`` are cumulative and never fall.
    """
    cols: dict[str, Column] = {}
    for c in nums:
        cols[f"{c}_sum"] = F.when(moved, F.col(f"{c}_sum") + F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.col(f"{c}_sum"))
        cols[f"{c}_n"] = F.when(moved & F.col(c).isNotNull(), F.col(f"{c}_n") + 1).otherwise(F.col(f"{c}_n"))
    for c in cats:
        counts, value = F.col(f"{c}_counts"), F.col(c)
        known = F.exists(counts, lambda s: s["v"] == value)
        bumped = F.transform(
            counts, lambda s: F.struct(F.when(s["v"] == value, s["n"] + 1).otherwise(s["n"]).alias("n"), s["first"].alias("first"), s["v"].alias("v"))
        )
        added = F.concat(counts, F.array(F.struct(F.lit(1).alias("n"), (-F.size(counts)).alias("first"), value.alias("v"))))
        cols[f"{c}_counts"] = F.when(moved & value.isNotNull(), F.when(known, bumped).otherwise(added)).otherwise(counts)
    df = df.withColumns(cols)
    rolled = roll_attributes(df, attributes, cats, nums, F.when(moved, activity), monotone)
    return with_summaries(rolled, cats, nums)
