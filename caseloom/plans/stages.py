"""The three stages over one log: base data, decisions, evaluation.

Each stage writes what the next one reads, so a lost executor costs at most
the stage at hand and no later stage sorts the raw log again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.distributions import Guidance
from caseloom.operators.cases import (
    only_split,
    prefix_rows,
    prefix_suffix_pairs,
    split_cases,
    window_size,
    with_split,
)
from caseloom.operators.encode import apply_scalers, scaler_values, scalers, vocabulary
from caseloom.operators.flow import (
    Net,
    align,
    decision_context,
    decisions,
    directly_follows,
    incoming_transitions,
    net_from_edges,
)
from caseloom.operators.guide import (
    explain,
    guided_beams,
    guided_mode,
    guided_samples,
    reasoning_counters,
    reasoning_steps,
    state_decisions,
)
from caseloom.operators.label import label_events, place_diagnostics, weighted_accuracy
from caseloom.operators.mine import (
    MiningResult,
    ModelConfig,
    feature_names,
    guards,
    mine,
    predict,
    samples,
    save_results,
    scorer,
    synced,
)
from caseloom.operators.ordering import CASE, EventLog, join_cases, settle
from caseloom.operators.predict import (
    NextModel,
    attribute_model,
    count_model,
    decode_beam,
    decode_greedy,
    decode_samples,
    collect_samples,
    start_state_features,
    with_limit,
)
from caseloom.operators.score import guided_summary, plain_summary, score_rows
from caseloom.session import cut
from caseloom.sources.reader import stored, write_by_split


@dataclass
class BaseData:
    """Numbered log with splits, its net and the sizes later stages need."""

    log: EventLog
    edges: DataFrame
    net: Net
    window: int
    min_suffix: int
    path: str


@dataclass
class DecisionData:
    """Decision records, mined models, rules, labels and held-out diagnostics."""

    records: DataFrame
    mined: MiningResult
    rules: DataFrame
    labelled: DataFrame
    diagnostics: DataFrame
    weighted: DataFrame


def build_base(log: EventLog, path: str, threshold: float = 0.0, min_suffix: int = 5) -> BaseData:
    """Split the cases, discover the net on train and val, write prefixes, vocabulary and scalers."""
    log = settle(with_split(log, split_cases(log.events)))
    edges = cut(directly_follows(only_split(log, "train", "val"), threshold))
    train = only_split(log, "train")
    window = window_size(train, min_suffix)
    columns = ["activity", *log.dyn_cat, *log.dyn_num]
    prefixes = prefix_rows(log, columns, window, [*log.sta_cat, *log.sta_num], keep_block=True)
    splits = log.events.where("pos = 1").select(CASE, "split")
    write_by_split(join_cases(prefixes, splits, log.spans).drop("block"), f"{path}/prefixes")
    vocab = None
    for c in ("activity", *log.dyn_cat, *log.sta_cat):
        part = vocabulary(train.events, c)
        vocab = part if vocab is None else vocab.unionByName(part)
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    if log.dyn_num or log.sta_num:
        scalers(train.events, [*log.dyn_num, *log.sta_num], end_rows=min_suffix).write.mode("overwrite").parquet(f"{path}/scalers")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    return BaseData(log, edges, net_from_edges(edges), window, min_suffix, path)


def scaled_log(base: BaseData) -> tuple[EventLog, dict[str, tuple[float, float]]]:
    """The base log with its numbers scaled, missing ones kept, and the scalers."""
    log = base.log
    if not (log.dyn_num or log.sta_num):
        return log, {}
    fitted = scaler_values(log.events.sparkSession.read.parquet(f"{base.path}/scalers"))
    return log.with_events(apply_scalers(log.events, fitted)), fitted


def mine_and_label(base: BaseData, config: ModelConfig | None = None) -> DecisionData:
    """Mine a model and rules per decision place, label the events, judge on the test cases.

    Numbers are scaled first, with the scalers of the base stage; a mean of scaled
    numbers is the scaled mean, so one scaler serves an attribute and its average.
    """
    log, fitted = scaled_log(base)
    moves = align(log, base.edges)
    splits = log.events.where("pos = 1").select(CASE, "split")
    records = cut(join_cases(decisions(moves, base.net), splits, log.spans))
    visible = synced(log, base.edges)
    rows = samples(records, visible, log.dyn_cat, log.dyn_num, log.sta_cat, log.sta_num)
    cats, nums = feature_names(log.dyn_cat, log.dyn_num, log.sta_cat, log.sta_num)
    mined = mine(rows.where("split <> 'test'").drop("split"), base.net, cats, nums, config, fitted)
    rules = stored(guards(mined), "guards")
    save_results(mined, rules, incoming_transitions(base.net), f"{base.path}/decisions")
    scored = predict(rows, mined)
    labelled = label_events(visible, scored)
    diagnostics = place_diagnostics(scored.where("split = 'test'"))
    return DecisionData(records, mined, rules, labelled, diagnostics, weighted_accuracy(diagnostics))


def next_model(base: BaseData, order: int = 2, min_support: int = 5) -> NextModel:
    return count_model(only_split(base.log, "train"), order, min_support)


def held_out_prefixes(base: BaseData, columns: Sequence[str] = ()) -> DataFrame:
    """Limited prefixes of the test cases."""
    pairs = prefix_suffix_pairs(only_split(base.log, "test"), base.window, base.min_suffix, columns)
    return with_limit(pairs, base.window, base.min_suffix)


def evaluate_plain(
    base: BaseData, model: NextModel, dataset: str, decode: str = "mode", count: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Decode and score every test prefix: rows and summary."""
    pairs, steps = held_out_prefixes(base), base.window - base.min_suffix
    if decode == "mode":
        rows = decode_greedy(pairs, model, steps)
    elif decode == "beam":
        rows = decode_beam(pairs, model, steps, count)
    elif decode == "probabilistic":
        rows = collect_samples(pairs, decode_samples(pairs, model, steps, count, together=True))
    else:
        raise ValueError(f"unknown decoder {decode}")
    scored = cut(score_rows(rows))
    return scored, plain_summary(scored, dataset, "counts", "clean", decode)


def evaluate_guided(
    base: BaseData,
    data: DecisionData,
    model: NextModel,
    dataset: str,
    variant: str = "decision_decoding",
    decode: str = "mode",
    cfg: Guidance = Guidance(support_threshold=0.2),
    count: int = 3,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Guided decode of every test prefix: scored rows, reasoning rows and summary.

    Strength 0 keeps only the books and gives the conformance of plain decoding.
    """
    log, _ = scaled_log(base)
    statics = [*log.sta_cat, *log.sta_num]
    pairs = held_out_prefixes(replace(base, log=log), [*log.dyn_cat, *log.dyn_num, *statics])
    state = start_state_features(pairs, log.dyn_cat, log.dyn_num)
    state = state.withColumns({c: F.element_at(c, -1) for c in statics})
    attributes = attribute_model(only_split(log, "train"), log.dyn_cat, log.dyn_num)
    decide = state_decisions(
        decision_context(base.net), cfg, scorer(data.mined), attributes,
        log.dyn_cat, log.dyn_num, log.sta_cat, log.sta_num, [c for c in log.dyn_num if c == "case_elapsed_time"],
    )
    steps = base.window - base.min_suffix
    keys = [CASE, "prefix_len"]
    if decode == "mode":
        done = guided_mode(state, model, steps, decide).withColumn("no", F.lit(1))
    elif decode == "beam":
        done = guided_beams(state, model, steps, decide, count).withColumn("no", F.col("beam"))
    elif decode == "probabilistic":
        done = guided_samples(state, model, steps, decide, count).withColumn("no", F.col("sample"))
    else:
        raise ValueError(f"unknown decoder {decode}")
    done = cut(done.select(*keys, "no", "target_suffix", "suffix", "trace"))
    told = explain(reasoning_steps(done, [*keys, "no"]), data.rules, [*keys, "no"])
    counters = cut(reasoning_counters(told, [*keys, "no"]))
    rows = done.groupBy(*keys).agg(
        F.first("target_suffix").alias("target_suffix"),
        F.transform(F.array_sort(F.collect_list(F.struct("no", "suffix"))), lambda s: s["suffix"]).alias("decoded_suffixes"),
    )
    scored = cut(score_rows(rows.withColumn("mode", F.lit(f"guided {decode}"))))
    summary = guided_summary(plain_summary(scored, dataset, "counts", variant, f"guided {decode}"), counters)
    return scored, told, summary


@dataclass
class Evaluation:
    """Scored rows and the summary row; reasoning rows where decoding was guided."""

    rows: DataFrame
    summary: DataFrame
    reasoning: DataFrame | None = None


def evaluate(base: BaseData, model: NextModel, dataset: str, data: DecisionData | None = None, decode: str = "mode", **options) -> Evaluation:
    """Decode and score every test prefix, plain, or guided where mined decisions are given.

    ``options`` are those of :func:`evaluate_plain` (count) or :func:`evaluate_guided`
    (variant, cfg, count); any other is an error.
    """
    if data is None:
        rows, summary = evaluate_plain(base, model, dataset, decode, **options)
        return Evaluation(rows, summary)
    rows, told, summary = evaluate_guided(base, data, model, dataset, decode=decode, **options)
    return Evaluation(rows, summary, told)
