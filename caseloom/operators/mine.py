"""Decision mining: samples, models of all places, readable rules."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.text import rule_text, value_text
from caseloom.operators.boost import fit_places, forests, score_places
from caseloom.operators.encode import MISSING
from caseloom.operators.flow import Net, decision_places, synchronise
from caseloom.operators.ordering import CASE, EventLog, per_case, running
from caseloom.session import cut, small


@dataclass(frozen=True)
class ModelConfig:
    """Sizes of the per-place models and thresholds of their rules."""

    rounds: int = 300
    learning_rate: float = 0.05
    depth: int = 4
    l2: float = 8.0
    min_leaf: int = 50
    patience: int = 80
    max_cells: int = 50_000
    eval_share: float = 0.15
    seed: int = 7
    min_leaf_prob: float = 0.15
    min_leaf_lift: float = 1.2
    min_leaf_support: int = 20
    max_rules_per_label: int = 8


# --- data state -----------------------------------------------------------


def running_mode(log: EventLog, column: str, out: str) -> EventLog:
    """Most frequent earlier value, ties to the one seen first.

    Counts of a value only grow, so the running maximum over
    (count so far, earlier first sight, value) is the running mode.
    """
    counted = running(
        log, {"_seen": ("count", column), "_first": ("min", "pos")}, through=True, keys=(column,)
    )
    scored = counted.with_events(
        counted.events.withColumn(
            "_score",
            F.when(
                F.col(column).isNotNull(),
                F.struct(F.col("_seen").alias("n"), (-F.col("_first")).alias("first"), F.col(column).alias("v")),
            ),
        )
    )
    best = running(scored, {"_best": ("max", "_score")})
    return log.with_events(best.events.withColumn(out, F.col("_best.v")).drop("_seen", "_first", "_score", "_best"))


def feature_state(
    log: EventLog,
    dyn_cat: Sequence[str],
    dyn_num: Sequence[str],
    statics: Sequence[str],
    fallback: bool = True,
) -> EventLog:
    """Feature row after each event.

    Each dynamic attribute keeps its last value and gains the mean or mode of
    the events before it. ``fallback`` is the miner's form: without history the
    last value stands in, and statics come from the first event. Otherwise
    statics are the latest known value.
    """
    specs = {}
    for c in dyn_num:
        specs[f"_{c}_sum"], specs[f"_{c}_n"] = ("sum", c), ("count", c)
    state = running(log, specs) if specs else log
    for c in dyn_cat:
        state = running_mode(state, c, f"{c}_past_mode")
    if fallback:
        state = per_case(state, **{f"_static_{c}": F.min_by(c, "pos") for c in statics}) if statics else state
    elif statics:
        state = running(state, {f"_static_{c}": ("last", c) for c in statics}, through=True)
    df = state.events
    cols: dict[str, Column] = {}
    for c in dyn_num:
        mean = F.try_divide(F.col(f"_{c}_sum"), F.col(f"_{c}_n"))
        cols[f"{c}_past_avg"] = F.coalesce(mean, F.col(c)) if fallback else mean
    for c in dyn_cat:
        mode = F.col(f"{c}_past_mode")
        cols[f"{c}_past_mode"] = F.coalesce(mode, F.col(c).cast("string")) if fallback else mode
    for c in statics:
        cols[c] = F.col(f"_static_{c}")
    df = df.withColumns(cols).drop(*specs, *[f"_static_{c}" for c in statics])
    return log.with_events(df)


def feature_names(dyn_cat: Sequence[str], dyn_num: Sequence[str], sta_cat=(), sta_num=()) -> tuple[list[str], list[str]]:
    """Category and number columns of a feature row."""
    cats = [*sta_cat, *[x for c in dyn_cat for x in (c, f"{c}_past_mode")]]
    nums = [*sta_num, *[x for c in dyn_num for x in (c, f"{c}_past_avg")]]
    return cats, nums


def synced(log: EventLog, edges: DataFrame) -> EventLog:
    """Only the events the net takes part in, numbered anew."""
    placed = synchronise(log, edges)
    marked = placed.with_events(placed.events.withColumn("_sync", F.when(F.col("sync"), 1)))
    counted = running(marked, {"_no": ("count", "_sync")}, through=True)
    total = per_case(counted, _total=F.count("_sync"))
    kept = total.events.where("sync").withColumns({"pos": F.col("_no"), "n": F.col("_total")})
    return EventLog(
        kept.drop("_sync", "_no", "_total", "state_before", "state_after", "sync"),
        ("pos",), log.spans, log.dyn_cat, log.dyn_num, log.sta_cat, log.sta_num,
    )


def samples(
    records: DataFrame, visible: EventLog, dyn_cat, dyn_num, sta_cat=(), sta_num=(), fallback: bool = True
) -> DataFrame:
    """State before each decision and its target."""
    cats, nums = feature_names(dyn_cat, dyn_num, sta_cat, sta_num)
    statics = [*sta_cat, *sta_num]
    state = feature_state(visible, dyn_cat, dyn_num, statics, fallback).events
    slim = state.select(F.col(CASE), F.col("pos").alias("_at"), *cats, *nums)
    at = F.greatest(F.col("sync_index"), F.lit(1)).cast("long")
    joined = records.withColumn("_at", at).join(slim, [CASE, "_at"], "left").drop("_at", "block")
    early = {c: F.when(F.col("sync_index") > 0, F.col(c)) for c in [*cats, *nums] if c not in statics}
    return joined.withColumns(early)


# --- priors, weights, holdout ---------------------------------------------


def priors(records: DataFrame) -> DataFrame:
    """``place, label, support, p``: share of each target per place."""
    counts = records.groupBy("place", F.col("target").alias("label")).agg(F.count(F.lit(1)).alias("support"))
    total = F.sum("support").over(Window.partitionBy("place"))
    return counts.withColumn("p", F.col("support") / total)


def distributions(table: DataFrame) -> DataFrame:
    """``place, z``: one distribution per place, entries without mass dropped."""
    return (
        table.where("p > 0")
        .groupBy("place")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "p")))).alias("z"))
    )


def class_weights(records: DataFrame) -> DataFrame:
    """Inverse-frequency weight n / (K · n_c) per place and target."""
    counts = records.groupBy("place", "target").agg(F.count(F.lit(1)).alias("n_c"))
    place = Window.partitionBy("place")
    return counts.withColumn(
        "weight", F.sum("n_c").over(place) / (F.count(F.lit(1)).over(place) * F.col("n_c"))
    ).drop("n_c")


def rank_in_group(df: DataFrame, groups: Sequence[str], draw: str, out: str) -> DataFrame:
    """Rank by a hash text inside each group; large groups are ranked in hash buckets."""
    bucketed = df.withColumn("_bucket", F.substring(draw, 1, 4))
    sizes = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    local = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(draw))
    ranked = bucketed.withColumn("_local", local).join(offsets, [*groups, "_bucket"])
    return ranked.withColumn(out, F.col("_before") + F.col("_local")).drop("_bucket", "_before", "_local")


def stratified_holdout(records: DataFrame, keys: Sequence[str], share: float = 0.15, seed: int = 7) -> DataFrame:
    """Flag a share of every target per place, where a place has at least 50 rows and 2 per target."""
    drawn = records.withColumn(
        "_draw", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    )
    ranked = rank_in_group(drawn, ["place", "target"], "_draw", "_rank")
    counts = records.groupBy("place", "target").agg(F.count(F.lit(1)).alias("_n_c"))
    place = Window.partitionBy("place")
    counts = counts.withColumn(
        "_usable", (F.sum("_n_c").over(place) >= 50) & (F.min("_n_c").over(place) >= 2)
    )
    flagged = ranked.join(small(counts), ["place", "target"])
    return flagged.withColumn(
        "holdout", F.col("_usable") & (F.col("_rank") <= F.floor(F.lit(share) * F.col("_n_c")))
    ).drop("_draw", "_rank", "_n_c", "_usable")


# --- models of all places ----------------------------------------------------


@dataclass
class MiningResult:
    """Node table of all places, and what a reader of it needs."""

    nodes: DataFrame
    skipped: DataFrame
    cats: list[str]
    nums: list[str]
    config: ModelConfig
    fitted: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def places(self) -> DataFrame:
        """``place, kind, rows, labels, priors`` of every place with samples."""
        return self.nodes.where("part = 'place'").select(
            "place", F.col("value").alias("kind"), F.col("support").alias("rows"), "labels", F.col("values").alias("priors")
        )


def mine(
    rows: DataFrame,
    net: Net,
    cats: Sequence[str],
    nums: Sequence[str],
    config: ModelConfig | None = None,
    fitted: Mapping[str, tuple[float, float]] | None = None,
) -> MiningResult:
    """Fit the models of all decision places; places without samples are skipped.

    ``fitted`` are the scalers that ``rows`` went through, kept for display.
    """
    config = config or ModelConfig()
    flagged = stratified_holdout(rows, [CASE, "place", "ord"], config.eval_share, config.seed)
    nodes = cut(fit_places(flagged, cats, nums, config))
    skipped = cut(decision_places(net).join(nodes.select("place").distinct(), "place", "left_anti").select("place"))
    return MiningResult(nodes, skipped, list(cats), list(nums), config, dict(fitted or {}))


def scorer(mined: MiningResult, out: str = "z") -> Callable[[DataFrame], DataFrame]:
    """Adds the distribution over next activities to rows with ``place`` and features; null where no model exists."""
    return score_places(mined.nodes.sparkSession, forests(mined.nodes, mined.cats, mined.nums), mined.cats, mined.nums, out)


def predict(df: DataFrame, mined: MiningResult, out: str = "z") -> DataFrame:
    """``df`` with the distribution over next activities: one pass over rows of all places."""
    return scorer(mined, out)(df)


# --- rules -----------------------------------------------------------------

GUARD = (
    "place string, label string, rule string, raw_rule string, "
    "intervals map<string,struct<low:double,high:double>>, allowed map<string,array<string>>, "
    "excluded map<string,array<string>>, prob_model double, prob_emp double, support bigint, "
    "coverage double, lift double, score double"
)
NO_INTERVALS = "map<string,struct<low:double,high:double>>"
NO_SETS = "map<string,array<string>>"


def prior_guards(table: DataFrame, min_prob: float = 0.15) -> DataFrame:
    """One unconditional guard per label that is likely enough."""
    total = F.sum("support").over(Window.partitionBy("place"))
    return (
        table.withColumn("total", total)
        .where(F.col("p") >= min_prob)
        .select(
            "place",
            "label",
            F.lit("(true)").alias("rule"),
            F.lit("(true)").alias("raw_rule"),
            F.create_map().cast(NO_INTERVALS).alias("intervals"),
            F.create_map().cast(NO_SETS).alias("allowed"),
            F.create_map().cast(NO_SETS).alias("excluded"),
            F.col("p").alias("prob_model"),
            F.col("p").alias("prob_emp"),
            F.col("total").cast("bigint").alias("support"),
            F.lit(1.0).alias("coverage"),
            F.lit(1.0).alias("lift"),
            (F.col("p") * F.log1p("total")).alias("score"),
        )
    )


def tree_paths(part: pd.DataFrame) -> Iterator[tuple[int, list[tuple[str, str, float]]]]:
    """Leaves of a place's readable tree in order, each with its conditions from the root."""
    nodes = {r.node: r for r in part.itertuples()}

    def walk(node: int, conditions: list[tuple[str, str, float]]) -> Iterator[tuple[int, list[tuple[str, str, float]]]]:
        r = nodes[node]
        if r.left < 0:
            yield node, conditions
            return
        name, at = (f"{r.feature}={r.value}", 0.5) if isinstance(r.value, str) else (r.feature, r.threshold)
        yield from walk(r.left, [*conditions, (name, "<=", at)])
        yield from walk(r.right, [*conditions, (name, ">", at)])

    yield from walk(0, [])


def _conditions(path: list[tuple[str, str, float]]) -> tuple:
    """Text of a path, and its bounds and sets; bounds are those of the text, six digits."""
    raw = " AND ".join(f"({name} {op} {at:.6g})" for name, op, at in path) or "(true)"
    lows: dict[str, float] = {}
    highs: dict[str, float] = {}
    allowed: dict[str, set[str]] = {}
    excluded: dict[str, set[str]] = {}
    for name, op, at in path:
        base, eq, value = name.partition("=")
        at = float(f"{at:.6g}")
        if eq:
            if value != MISSING:
                (allowed if op == ">" else excluded).setdefault(base, set()).add(value)
        elif op == ">":
            lows[name] = max(at, lows.get(name, -math.inf))
        else:
            highs[name] = min(at, highs.get(name, math.inf))
    intervals = {n: {"low": lows.get(n), "high": highs.get(n)} for n in {*lows, *highs}}
    return raw, intervals, {k: sorted(v) for k, v in allowed.items()}, {k: sorted(v) for k, v in excluded.items()}


LEAF = (
    "place string, leaf int, label string, raw_rule string, intervals map<string,struct<low:double,high:double>>, "
    "allowed map<string,array<string>>, excluded map<string,array<string>>, prob_model double, prob_emp double, support bigint"
)


def leaf_rules(nodes: DataFrame) -> DataFrame:
    """One row per leaf and label of every readable tree: conditions, support, mean base probability, observed share."""

    def rules(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = {r.node: r for r in part.itertuples()}
        for no, (node, path) in enumerate(tree_paths(part)):
            r = own[node]
            raw, *conditions = _conditions(path)
            for label, p, hits in zip(r.labels, r.values, r.hits, strict=True):
                out.append((r.place, no, label, raw, *conditions, float(p), hits / max(r.support, 1), int(r.support)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEAF.split(", ")])

    trees = nodes.where("part = 'rule'").select("place", "node", "feature", "value", "threshold", "left", "right", "support", "values", "hits", "labels")
    trees = trees.withColumnRenamed("values", "probs")
    return trees.groupBy("place").applyInPandas(lambda part: rules(part.rename(columns={"probs": "values"})), LEAF)


def keep_best_rules(leaves: DataFrame, places: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Likely, lifted and supported leaves per place and label, best ``max_rules_per_label`` by score."""
    prior = places.select("place", F.col("rows").alias("_rows"), F.map_from_arrays("labels", "priors").alias("_prior"))
    scored = (
        leaves.join(small(prior), "place")
        .withColumn("lift", F.col("prob_model") / F.greatest(F.col("_prior")[F.col("label")], F.lit(1e-12)))
        .where(
            (F.col("support") >= cfg.min_leaf_support)
            & (F.col("prob_model") >= cfg.min_leaf_prob)
            & (F.col("lift") >= cfg.min_leaf_lift)
        )
        .withColumn("coverage", F.col("support") / F.greatest(F.col("_rows"), F.lit(1)))
        .withColumn("score", F.col("prob_model") * F.log1p("support") * F.greatest(F.lit(1.0), "lift"))
    )
    order = Window.partitionBy("place", "label").orderBy(F.desc("score"), F.desc("prob_model"), "leaf")
    return scored.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= cfg.max_rules_per_label).drop("_no", "_rows", "_prior")


def guards(mined: MiningResult) -> DataFrame:
    """All rules of all places: leaves of the readable trees, and unconditional ones where there is no tree."""
    best = keep_best_rules(leaf_rules(mined.nodes), mined.places, mined.config)
    found = best.withColumn("rule", rule_text(F.col("intervals"), F.col("allowed"), F.col("excluded")))
    plain = mined.nodes.where("part = 'place' and value = 'prior'").select(
        "place", F.inline(F.arrays_zip(F.col("labels").alias("label"), F.col("hits").alias("support"), F.col("values").alias("p")))
    )
    columns = [c.split()[0] for c in _guard_columns()]
    return found.select(*columns).unionByName(prior_guards(plain, mined.config.min_leaf_prob).select(*columns))


def _guard_columns() -> list[str]:
    return [
        "place", "label", "rule", "raw_rule", "intervals", "allowed", "excluded", "prob_model",
        "prob_emp", "support", "coverage", "lift", "score",
    ]


def displayed_rule(fitted: dict[str, tuple[float, float]]) -> Column:
    """Rule text with thresholds in original units."""

    def bound(name: Column, value: Column) -> Column:
        base = F.regexp_replace(name, "(_past_avg|_past_mode)$", "")
        mean = scale = F.lit(None).cast("double")
        for col, (m, s) in fitted.items():
            mean = F.when(base == col, F.lit(float(m))).otherwise(mean)
            scale = F.when(base == col, F.lit(float(s))).otherwise(scale)
        return value_text(name, F.lit(None).cast("string"), value, mean, scale)

    return rule_text(F.col("intervals"), F.col("allowed"), F.col("excluded"), bound)


PARTS = ("guards", "guards_flat", "places", "skipped", "scalers", "models")
MANIFEST = "part string, rows bigint, columns array<string>, cats array<string>, nums array<string>, config string"


def save_results(mined: MiningResult, rules: DataFrame, incoming: DataFrame, path: str) -> dict[str, str]:
    """Rules, flat rules, places with incoming transitions, skipped places, scalers and models.

    The manifest (rows and columns of every part) is written last, so a store
    without one is known to be partial.
    """
    spark = mined.nodes.sparkSession
    paths = {name: f"{path}/{name}" for name in (*PARTS, "manifest")}
    rules.write.parquet(paths["guards"])
    back = spark.read.parquet(paths["guards"])
    back.select("place", "label", "rule", "raw_rule", "prob_model", "prob_emp", "support", "coverage", "lift", "score").write.parquet(paths["guards_flat"])
    into = incoming.groupBy("place").agg(F.array_sort(F.collect_set(F.struct("tid", "label"))).alias("incoming"))
    per_place = back.groupBy("place").agg(F.count(F.lit(1)).alias("rules"))
    mined.places.join(into, "place", "left").join(per_place, "place", "left").write.parquet(paths["places"])
    mined.skipped.write.parquet(paths["skipped"])
    spark.createDataFrame([(c, float(m), float(s)) for c, (m, s) in mined.fitted.items()], "col string, mean double, scale double").write.parquet(paths["scalers"])
    mined.nodes.write.parquet(paths["models"])
    config = json.dumps(asdict(mined.config), sort_keys=True)
    parts = [(name, spark.read.parquet(paths[name])) for name in PARTS]
    rows = [(name, df.count(), df.columns, mined.cats, mined.nums, config) for name, df in parts]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(paths["manifest"])
    return paths


def load_results(spark: SparkSession, path: str) -> tuple[MiningResult, DataFrame]:
    """Models and rules of a store. A store that is partial or has been changed is an error."""
    try:
        manifest = {r["part"]: r for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()}
    except AnalysisException as error:
        raise ValueError(f"no manifest in {path}: the store is partial") from error
    found = {}
    for name in PARTS:
        if name not in manifest:
            raise ValueError(f"{name} is missing from the manifest in {path}")
        try:
            df = found[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            raise ValueError(f"{name} is missing from {path}") from error
        if df.columns != list(manifest[name]["columns"]) or df.count() != manifest[name]["rows"]:
            raise ValueError(f"{name} in {path} is not what its manifest says")
    about = manifest["models"]
    fitted = {r["col"]: (r["mean"], r["scale"]) for r in found["scalers"].collect()}
    config = ModelConfig(**json.loads(about["config"]))
    return MiningResult(found["models"], found["skipped"], list(about["cats"]), list(about["nums"]), config, fitted), found["guards"]
