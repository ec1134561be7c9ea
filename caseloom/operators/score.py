"""Scores and reports of decoded suffixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.similarity import exact_match, similarities, token_accuracy
from caseloom.operators.guide import with_rates
from caseloom.operators.ordering import CASE

COUNTERS = (
    "decision_steps", "conflicts", "explained_steps", "explainable_decision_steps", "non_trivial_decision_steps",
    "non_trivial_explained_steps", "matched_trivial_rule", "rule_unmatched", "no_rule_for_branch", "conflict_not_supported",
)

EMPTY = "array<string>"


def _first(decoded: Column) -> Column:
    return F.coalesce(F.get(decoded, F.lit(0)), F.array().cast(EMPTY))


def _at_least_one(decoded: Column) -> Column:
    return F.when(F.size(decoded) > 0, decoded).otherwise(F.array(F.array().cast(EMPTY)))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def score_rows(rows: DataFrame, reduction: str = "mean") -> DataFrame:
    """Similarity per row: the first suffix, or mean/min/best over samples for probabilistic rows."""
    if reduction not in ("mean", "best"):
        raise ValueError(f"unknown reduction {reduction}")
    probabilistic = F.contains(F.lower("mode"), F.lit("probabilistic"))
    used = F.when(probabilistic, _at_least_one(F.col("decoded_suffixes"))).otherwise(F.array(_first(F.col("decoded_suffixes"))))
    scored = rows.withColumn("_used", used)
    scored = scored.withColumn("_each", similarities(F.col("target_suffix"), F.col("_used"))).drop("_used")
    mean, low, best = _mean(F.col("_each")), F.array_min("_each"), F.array_max("_each")
    return scored.withColumns(
        {
            "dls": mean if reduction == "mean" else best,
            "dls_mean": F.when(probabilistic, mean),
            "dls_min": F.when(probabilistic, low),
            "dls_best": F.when(probabilistic, best),
        }
    ).drop("_each")


def score_coherence(rows: DataFrame, reduction: str = "mean") -> DataFrame:
    """Exact match and token accuracy per row."""
    probabilistic = F.contains(F.lower("mode"), F.lit("probabilistic"))
    used = F.when(probabilistic, _at_least_one(F.col("decoded_suffixes"))).otherwise(F.array(_first(F.col("decoded_suffixes"))))
    fold = F.array_max if reduction == "best" else _mean
    return rows.withColumns(
        {
            "exact_match": fold(F.transform(used, lambda s: exact_match(F.col("target_suffix"), s))),
            "token_acc": fold(F.transform(used, lambda s: token_accuracy(F.col("target_suffix"), s))),
        }
    )


def by_prefix_length(scored: DataFrame, columns: Sequence[str] = ("dls",)) -> DataFrame:
    return scored.groupBy("prefix_len").agg(*[F.avg(c).alias(c) for c in columns])


def overall(scored: DataFrame, columns: Sequence[str] = ("dls",)) -> DataFrame:
    """Averages over all rows, 0 without rows."""
    return scored.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def prefix_density(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prefix_len").agg(F.count(F.lit(1)).alias("rows"))


def conformance(counters: DataFrame) -> DataFrame:
    """1 − conflicts / steps over all decodes, NaN without steps."""
    sums = counters.agg(
        F.coalesce(F.sum("decision_steps"), F.lit(0)).alias("decision_steps"),
        F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"),
    )
    steps, bad = F.col("decision_steps").cast("double"), F.col("conflicts").cast("double")
    return sums.withColumns(
        {
            "conflict_rate": F.coalesce(F.try_divide(bad, steps), F.lit(0.0)),
            "decision_conformance": F.when(steps > 0, 1 - F.try_divide(bad, steps)).otherwise(F.lit(float("nan"))),
        }
    )


def sum_counters(counters: DataFrame) -> DataFrame:
    """Sums of the reasoning counters and the rates derived from them."""
    return with_rates(counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]))


def plain_summary(scored: DataFrame, dataset: str, model: str, variant: str, mode: str) -> DataFrame:
    """One summary row of a plain evaluation."""
    return scored.agg(
        F.lit(dataset).alias("dataset"),
        F.lit(model).alias("model"),
        F.lit(variant).alias("variant"),
        F.lit(mode).alias("mode"),
        F.coalesce(F.avg("dls"), F.lit(0.0)).alias("average_dls"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def guided_summary(summary: DataFrame, counters: DataFrame) -> DataFrame:
    """The plain summary row with the reasoning sums of the same variant."""
    sums = sum_counters(counters).withColumn("_one", F.lit(1))
    return summary.withColumn("_one", F.lit(1)).join(sums, "_one").drop("_one")


def variant_table(summaries: DataFrame, baseline: str = "clean") -> DataFrame:
    """Change of similarity and conformance against the baseline variant of the same model."""
    model = Window.partitionBy("dataset", "model")
    base_dls = F.max(F.when(F.col("variant") == baseline, F.col("average_dls"))).over(model)
    base_conf = F.max(F.when(F.col("variant") == baseline, F.col("decision_conformance"))).over(model)
    return summaries.withColumns(
        {"delta_dls": F.col("average_dls") - base_dls, "delta_conformance": F.col("decision_conformance") - base_conf}
    )


def average_explainability(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.avg("rule_explained_rate").alias("average_rule_explained_rate"))


def reasoning_examples(explained: DataFrame, keys: Sequence[str], count: int = 3) -> DataFrame:
    """A few explained steps, in key order."""
    return explained.where("explained").orderBy(*keys).limit(count)


def masked_mean(value: Column, mask: Column) -> Column:
    """Σ mask·value / Σ mask, 0 without mass."""
    return F.coalesce(F.try_divide(F.sum(F.when(mask, value)), F.count(F.when(mask, 1)).cast("double")), F.lit(0.0))
