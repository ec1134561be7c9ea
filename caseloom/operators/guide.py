"""Decision-guided decoding, rule matching and reasoning rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.arrays import last_items, upto_eos
from caseloom.functions.distributions import Guidance
from caseloom.operators.ordering import CASE
from caseloom.operators.predict import (
    Decisions,
    NextModel,
    Rolling,
    attach_state,
    beams_for_prefixes,
    decode_beams,
    decode_steps,
    roll_state,
    start_state_features,
)
from caseloom.operators.walk import walk_best, walk_samples
from caseloom.session import settled, small

# --- rules against data states ------------------------------------------------


def has_conditions(guard: Callable[[str], Column] = F.col) -> Column:
    """A rule with at least one bound or set."""
    return (F.size(guard("intervals")) > 0) | (F.size(guard("allowed")) > 0) | (F.size(guard("excluded")) > 0)


def _within(value: Column, low: Column, high: Column) -> Column:
    return value.isNotNull() & (low.isNull() | (value > low)) & (high.isNull() | (value <= high))


def guard_matches(nums: Column, cats: Column, intervals: Column, allowed: Column, excluded: Column) -> Column:
    """All bounds hold (missing fails), values allowed (missing fails), none excluded (missing passes)."""
    bounds = F.forall(
        F.map_entries(intervals), lambda e: F.coalesce(_within(nums[e["key"]], e["value"]["low"], e["value"]["high"]), F.lit(False))
    )
    inside = F.forall(F.map_entries(allowed), lambda e: F.coalesce(F.array_contains(e["value"], cats[e["key"]]), F.lit(False)))
    outside = F.forall(
        F.map_entries(excluded), lambda e: F.coalesce(~F.array_contains(e["value"], cats[e["key"]]), F.lit(True))
    )
    return bounds & inside & outside


def conditioned_branches(guards: DataFrame) -> DataFrame:
    """``place, label``: branches with a rule that carries conditions."""
    return guards.where(has_conditions()).select("place", "label").distinct()


RULE = ("rule", "raw_rule", "prob_model", "support", "score", "intervals", "allowed", "excluded")


def with_best_guard(rows: DataFrame, guards: DataFrame) -> DataFrame:
    """``guard``: the best rule of a row's place and branch that its data state meets, null without one.

    The rules of a branch come as one list, best first (score, probability,
    support, text), to every row, so rows are matched where they are.
    """
    order = Window.partitionBy("place", "label").orderBy(*[F.desc(c) for c in ("score", "prob_model", "support", "raw_rule")])
    item = F.struct(F.row_number().over(order).alias("_no"), *RULE)
    lists = guards.select("place", "label", item.alias("_rule")).groupBy("place", "label").agg(F.collect_list("_rule").alias("_rules"))
    lists = lists.withColumn("_rules", F.array_sort("_rules", lambda a, b: a["_no"] - b["_no"]))
    joined = rows.join(settled(lists), ["place", "label"], "left")
    hit = F.get(
        F.filter("_rules", lambda r: guard_matches(F.col("nums"), F.col("cats"), r["intervals"], r["allowed"], r["excluded"])), F.lit(0)
    )
    known = F.col("nums").isNotNull() & F.col("cats").isNotNull()
    found = joined.withColumn("_hit", F.when(known, hit)).drop("_rules")
    guard = F.when(F.col("_hit").isNotNull(), F.struct(*[F.col("_hit")[c].alias(c) for c in RULE]))
    return found.withColumn("guard", guard).drop("_hit")


def best_guards(rows: DataFrame, guards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best matching rule per row with ``place, label, nums, cats``; ``keys`` name a row."""
    found = with_best_guard(rows.select(*keys, "place", "label", "nums", "cats"), guards)
    return found.where(F.col("guard").isNotNull()).select(*keys, "guard")


CHECK = "struct<attr:string,value:string,in_rule_set:boolean,rule_type:string,bound:string>"


def attribute_checks(nums: Column, cats: Column, intervals: Column, allowed: Column, excluded: Column) -> Column:
    """One entry per condition of a rule: value, whether it holds, and what was asked."""

    def check(attr, value, ok, kind, bound):
        return F.struct(
            attr.alias("attr"), value.cast("string").alias("value"), F.coalesce(ok, F.lit(False)).alias("in_rule_set"),
            F.lit(kind).alias("rule_type"), bound.alias("bound"),
        )

    def limits(v: Column) -> Column:
        low, high = F.coalesce(v["low"].cast("string"), F.lit("")), F.coalesce(v["high"].cast("string"), F.lit(""))
        return F.concat(F.lit("("), low, F.lit(", "), high, F.lit("]"))

    bounds = F.transform(
        F.map_entries(intervals),
        lambda e: check(e["key"], nums[e["key"]], _within(nums[e["key"]], e["value"]["low"], e["value"]["high"]), "interval", limits(e["value"])),
    )
    inside = F.transform(
        F.map_entries(allowed),
        lambda e: check(e["key"], cats[e["key"]], F.array_contains(e["value"], cats[e["key"]]), "categorical_allowed", F.array_join(F.array_sort(e["value"]), ", ")),
    )
    outside = F.transform(
        F.map_entries(excluded),
        lambda e: check(
            e["key"], cats[e["key"]], cats[e["key"]].isNull() | ~F.array_contains(e["value"], cats[e["key"]]), "categorical_excluded",
            F.array_join(F.array_sort(e["value"]), ", "),
        ),
    )
    return F.concat(bounds, inside, outside)


# --- reasoning rows --------------------------------------------------------------


def reasoning_steps(decoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per recorded decision step of a decode."""
    return decoded.select(*keys, F.inline("trace")).withColumnRenamed("next_event", "label")


def explain(steps: DataFrame, guards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each decision step, found where the step is: rules are few and come to every task."""
    branch = small(conditioned_branches(guards).withColumn("branch_has_rule", F.lit(True)))
    joined = with_best_guard(steps, guards).join(branch, ["place", "label"], "left")
    clear = ~F.col("conflict")
    has_rule = clear & F.coalesce("branch_has_rule", F.lit(False))
    guard = F.when(clear, F.col("guard"))
    conditioned = F.coalesce(has_conditions(lambda c: guard[c]), F.lit(False))
    status = (
        F.when(F.col("conflict"), "conflict_not_supported")
        .when(conditioned, "explained")
        .when(has_rule, "rule_unmatched")
        .when(guard.isNotNull(), "matched_trivial_rule")
        .otherwise("no_rule_for_branch")
    )
    checks = F.when(
        clear & conditioned, attribute_checks(F.col("nums"), F.col("cats"), guard["intervals"], guard["allowed"], guard["excluded"])
    )
    return (
        joined.withColumns(
            {
                "branch_has_rule": has_rule,
                "explained": clear & conditioned,
                "explanation_status": status,
                "attribute_checks": checks,
                "matched_rule": guard,
            }
        )
        .drop("guard")
    )


def reasoning_counters(explained: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters and rates per decode."""

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    nt = F.col("non_trivial")
    status = F.col("explanation_status")
    sums = explained.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("decision_steps"),
        count(F.col("conflict")).alias("conflicts"),
        count(F.col("explained")).alias("explained_steps"),
        count(F.col("branch_has_rule")).alias("explainable_decision_steps"),
        count(nt).alias("non_trivial_decision_steps"),
        count(nt & F.col("explained")).alias("non_trivial_explained_steps"),
        *[count(status == s).alias(s) for s in ("matched_trivial_rule", "rule_unmatched", "no_rule_for_branch", "conflict_not_supported")],
    )
    return with_rates(sums)


def with_rates(sums: DataFrame) -> DataFrame:
    def rate(top: str, bottom: str) -> Column:
        return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))

    return sums.withColumns(
        {
            "trivial_decision_steps": F.col("decision_steps") - F.col("non_trivial_decision_steps"),
            "no_matching_rule": F.col("rule_unmatched") + F.col("no_rule_for_branch"),
            "conflict_rate": rate("conflicts", "decision_steps"),
            "explained_rate": rate("explained_steps", "decision_steps"),
            "rule_explained_rate": rate("explained_steps", "explainable_decision_steps"),
            "non_trivial_explained_rate": rate("non_trivial_explained_steps", "non_trivial_decision_steps"),
        }
    )


# --- guided decoders ---------------------------------------------------------------


def fixed_decisions(context: DataFrame, z: DataFrame, cfg: Guidance) -> Decisions:
    """Decisions whose distribution depends on the place alone."""
    return Decisions(context.join(z, "place"), cfg)


def state_decisions(
    context: DataFrame,
    cfg: Guidance,
    score: Callable[[DataFrame], DataFrame],
    attributes: DataFrame,
    cats: Sequence[str],
    nums: Sequence[str],
    statics: Sequence[str] = (),
    static_nums: Sequence[str] = (),
    monotone: Sequence[str] = (),
) -> Decisions:
    """Decisions scored on the data state, which is rolled with predicted attributes.

    Static categories and static numbers are recorded apart, so that a rule's
    bounds on a static number find it; ``monotone`` columns are cumulative.
    """
    table = settled(attributes)

    def roll(df: DataFrame) -> DataFrame:
        moved = ~F.col("_before") & (F.element_at("seq", -1) != "EOS")
        return roll_state(df, table, cats, nums, moved, F.col("activity"), monotone)

    recorded_nums = [*static_nums, *[x for c in nums for x in (c, f"{c}_past_avg")]]
    recorded_cats = [*statics, *[x for c in cats for x in (c, f"{c}_past_mode")]]
    return Decisions(context, cfg, score, roll, recorded_nums, recorded_cats, Rolling(table, cats, nums, monotone))


def starts_by_state(prefixes: DataFrame, model: NextModel, steps: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes with their start (state and last activity), and the distinct starts."""
    keyed = attach_state(prefixes, model, F.col("prefix"), "start").withColumn("input", F.element_at("prefix", -1))
    starts = keyed.select("start", "input").distinct().select(
        "start", "input", F.col("start").alias("state"), F.col("input").alias("activity"), F.lit(steps + 1).alias("limit")
    )
    return keyed, starts


def _within_limit(trace: Column, limit: Column) -> Column:
    return F.filter(trace, lambda t: t["step"] < limit)


def guided_mode(prefixes: DataFrame, model: NextModel, max_steps: int, decisions: Decisions) -> DataFrame:
    """Guided arg-max: ``suffix`` and ``trace`` per prefix.

    Decisions that depend on the place alone are decoded once per start. Those
    scored on the data state are decoded prefix by prefix, inside tasks where these
    can hold the model.
    """
    if decisions.score is None:
        keyed, starts = starts_by_state(prefixes, model, max_steps)
        done = decode_steps(starts, model, max_steps, decisions=decisions).select("start", "input", "seq", "trace")
        joined = keyed.join(small(done), ["start", "input"])
        suffix = upto_eos(F.slice("seq", F.lit(1), F.col("limit")))
        return joined.withColumns({"suffix": suffix, "trace": _within_limit(F.col("trace"), F.col("limit"))}).drop("seq", "start", "input")
    rows = frontier_rows(prefixes, model, decisions)
    walked = walk_best(rows, model, max_steps, decisions)
    if walked is not None:
        return walked
    done = decode_steps(rows, model, max_steps, decisions=decisions, every=2)
    return done.withColumn("suffix", upto_eos(F.col("seq")))


def with_recent(prefixes: DataFrame, model: NextModel) -> DataFrame:
    """``recent``: the activities at the end of the prefix that the model looks at."""
    return prefixes.withColumn("recent", last_items(F.col("prefix"), model.order))


def distinct_prefixes(prefixes: DataFrame) -> DataFrame:
    """Each end of a prefix with each limit once, as a prefix.

    With decisions that depend on the place alone, all prefixes of one end and
    limit decode alike: they are decoded and explained once, and the outcome is
    joined back on ``recent`` and ``limit``.
    """
    return prefixes.select("recent", "limit").distinct().withColumn("prefix", F.col("recent"))


def frontier_rows(prefixes: DataFrame, model: NextModel, decisions: Decisions) -> DataFrame:
    keyed = attach_state(prefixes, model, F.col("prefix"))
    return keyed.withColumn("activity", F.element_at("prefix", -1))


def guided_samples(
    prefixes: DataFrame, model: NextModel, max_steps: int, decisions: Decisions, samples: int, seed: int = 17
) -> DataFrame:
    """Guided draws, one row per prefix and sample.

    Where decisions depend on the place alone, tasks draw all samples of their
    prefixes in one pass. Both ways make the same draws.
    """
    rows = frontier_rows(prefixes, model, decisions)
    walked = walk_samples(rows, model, max_steps, decisions, samples, seed)
    if walked is not None:
        return walked
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    done = decode_steps(
        rows, model, max_steps, pick="draw", draw_keys=[CASE, "prefix_len", "sample"], seed=seed, decisions=decisions, every=4
    )
    return done.withColumn("suffix", upto_eos(F.col("seq")))


def guided_beams(prefixes: DataFrame, model: NextModel, max_steps: int, decisions: Decisions, width: int = 3) -> DataFrame:
    """Guided beams: ``beam, suffix, score, trace`` per prefix."""
    if decisions.score is None:
        keyed, starts = starts_by_state(prefixes, model, max_steps)
        beams = decode_beams(starts, model, max_steps, ["start", "input"], width, decisions=decisions, snapshots=True)
        joined = beams_for_prefixes(keyed, beams, ["start", "input"], ["trace"])
        rows = joined.withColumn("b", F.explode("beams"))
        return rows.withColumns(
            {"beam": F.col("b.beam"), "suffix": F.col("b.suffix"), "score": F.col("b.score"), "trace": F.col("b.trace")}
        ).drop("b", "beams", "start", "input")
    rows = frontier_rows(prefixes, model, decisions)
    done = decode_beams(rows, model, max_steps, [CASE, "prefix_len"], width, decisions=decisions)
    return done.withColumn("suffix", upto_eos(F.col("seq")))


def prefix_data_state(pairs: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    return start_state_features(pairs, cats, nums)
