"""Distributions over next activities held as ``map<string,double>``."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.arrays import bind


@dataclass(frozen=True)
class Guidance:
    """Strength, decay, support threshold and gates of decision guidance."""

    epsilon: float = 1e-3
    beta_max: float = 2.0
    alpha: float = 0.1
    support_threshold: float = 0.05
    min_base_entropy: float = 0.0
    min_decision_confidence: float = 0.0
    max_guided_steps: int | None = None


def mass(dist: Column) -> Column:
    return F.aggregate(F.map_values(dist), F.lit(0.0), lambda acc, p: acc + p)


def top_probability(dist: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(dist)), F.lit(0.0))


def ranked_entries(dist: Column) -> Column:
    """Entries by falling probability, ties by label."""
    return F.array_sort(
        F.transform(
            F.map_entries(dist), lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("label"))
        )
    )


def best_label(dist: Column) -> Column:
    return F.get(ranked_entries(dist), F.lit(0))["label"]


def label_rank(dist: Column, label: Column) -> Column:
    """1-based rank of ``label``, 0 when absent."""
    return F.array_position(F.transform(ranked_entries(dist), lambda e: e["label"]), label)


def normalised_entropy(dist: Column, classes: Column) -> Column:
    """Entropy over ``classes`` outcomes, scaled to [0, 1]."""
    total = F.aggregate(
        F.map_values(dist),
        F.lit(0.0),
        lambda acc, p: acc - F.greatest(p, F.lit(1e-12)) * F.ln(F.greatest(p, F.lit(1e-12))),
    )
    rest = (classes - F.size(dist)) * F.lit(1e-12 * math.log(1e-12))
    return (total - rest) / F.ln(classes)


def reweight(dist: Column, z: Column, step: Column, cfg: Guidance, classes: Column | None = None) -> Column:
    """p' ∝ p · (ε + (1 − ε) z)^β with β = β_max · e^(−α·step).

    Left alone: no decision, step beyond the limit, an undecided decision
    model, an already certain base model, no strength, no remaining mass.
    """
    apply = z.isNotNull() & (F.size(z) > 0)
    if cfg.max_guided_steps is not None:
        apply = apply & (step <= cfg.max_guided_steps)
    if cfg.min_decision_confidence > 0:
        apply = apply & (top_probability(z) >= cfg.min_decision_confidence)
    if cfg.min_base_entropy > 0:
        count = classes if classes is not None else F.size(dist)
        apply = apply & ((count <= 1) | (normalised_entropy(dist, count) >= cfg.min_base_entropy))
    if cfg.beta_max <= 0:
        return dist
    eps = F.lit(float(cfg.epsilon))
    strength = F.lit(float(cfg.beta_max)) * F.exp(F.lit(-float(cfg.alpha)) * step)
    weighted = bind(
        strength,
        lambda beta: F.transform_values(
            dist, lambda a, p: p * F.pow(eps + (1 - eps) * F.coalesce(z[a], F.lit(0.0)), beta)
        ),
    )
    scaled = bind(
        weighted,
        lambda w: bind(mass(w), lambda norm: F.when(norm > 0, F.transform_values(w, lambda _, p: p / norm))),
    )
    return F.when(apply, F.coalesce(scaled, dist)).otherwise(dist)


def supported(z: Column, tau: float) -> Column:
    """Labels whose decision probability reaches ``tau``, in name order."""
    return F.array_sort(F.map_keys(F.map_filter(z, lambda _, p: p >= tau)))


def is_conflict(chosen: Column, support: Column) -> Column:
    """Chosen outside a non-empty support."""
    return (F.size(support) > 0) & ~F.array_contains(support, chosen)


def cross_entropy(dist: Column, target: Column) -> Column:
    return -F.ln(F.greatest(F.coalesce(dist[target], F.lit(0.0)), F.lit(1e-12)))


def semantic_loss(dist: Column, support: Column) -> Column:
    """−ln of the predicted mass on the support."""
    held = F.aggregate(support, F.lit(0.0), lambda acc, a: acc + F.coalesce(dist[a], F.lit(0.0)))
    return -F.ln(F.greatest(held, F.lit(1e-12)))


def gaussian_nll(mean: Column, logvar: Column, target: Column) -> Column:
    lv = F.least(F.greatest(logvar, F.lit(-6.0)), F.lit(6.0))
    return F.lit(0.5) * (F.exp(-lv) * F.pow(target - mean, F.lit(2)) + lv)


def uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from a hash of the parts: same input, same draw."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def pick(entries: Column, u: Column) -> Column:
    """Inverse-CDF choice from entries with running sums ``cum``; the last one closes the gap."""
    hit = bind(u, lambda x: F.get(F.filter(entries, lambda e: e["cum"] > x), F.lit(0)))
    return F.coalesce(hit, F.element_at(entries, -1))


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal from two uniforms (Box–Muller)."""
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-12)))) * F.cos(F.lit(2 * math.pi) * u2)
