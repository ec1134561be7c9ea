"""Scores and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from caseloom.catalog import sql
from caseloom.catalog.predict import (
    BASE,
    CFG,
    DRAWS,
    ENDS,
    GREEDY,
    GUIDED_BASE,
    GUIDED_SQL,
    SAMPLES,
    SUPPORTED,
    TAU,
    guided_setup,
    guided_walk,
    observed_reasoning,
    prepared,
)
from caseloom.catalog.predict import OBSERVED_STATUS
from caseloom.catalog.registry import i64, joined, query, r6, r6up
from caseloom.functions.distributions import cross_entropy, gaussian_nll, semantic_loss, supported
from caseloom.functions.similarity import edit_distance, exact_match, similarity, token_accuracy
from caseloom.operators.cases import next_event_rows, only_split, prefix_rows
from caseloom.operators.guide import distinct_prefixes, explain, guided_mode, reasoning_counters, reasoning_steps, with_recent
from caseloom.operators.mine import prior_guards
from caseloom.operators.predict import (
    attach_state,
    attribute_model,
    collect_samples,
    decode_greedy,
    decode_samples,
    next_distribution,
)
from caseloom.operators.score import (
    average_explainability,
    by_prefix_length,
    conformance,
    guided_summary,
    masked_mean,
    overall,
    plain_summary,
    prefix_density,
    reasoning_examples,
    score_coherence,
    score_rows,
    sum_counters,
    variant_table,
)
from caseloom.session import cut, settled, small


def distance_sql(a: str, b: str) -> str:
    """Optimal string alignment as nested list folds."""
    return f"""list_reduce(range(1, len({a}) + 1), lambda st, i: {{'prev': st.cur, 'cur': list_reduce(range(1, len({b}) + 1), lambda row, j:
       list_append(row, least(st.cur[j + 1] + 1, row[j] + 1, st.cur[j] + CASE WHEN {a}[i] = {b}[j] THEN 0 ELSE 1 END,
         CASE WHEN i > 1 AND j > 1 AND {a}[i] = {b}[j - 1] AND {a}[i - 1] = {b}[j] THEN st.prev[j - 1] + 1 ELSE 1000000 END)), [i])}},
       {{'prev': []::BIGINT[], 'cur': range(0, len({b}) + 1)}}).cur[-1]"""


def dls_sql(a: str, b: str) -> str:
    return f"1 - {distance_sql(a, b)} / greatest(len({a}), len({b}), 1)"


def token_sql(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i])) / greatest(len({a}), len({b}), 1)"


ROWS = f"rows AS (SELECT p.case_id, p.prefix_len, p.target_suffix AS t, g.path AS d FROM pairs p JOIN greedy g USING (case_id, prefix_len))"
SCORED = f"{ROWS}, scored AS (SELECT *, {dls_sql('t', 'd')} AS dls, CASE WHEN t = d THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, {token_sql('t', 'd')} AS ta FROM rows)"
GREEDY_SCORED = f"WITH RECURSIVE {sql.ORDERS}, {BASE}, {GREEDY}, {SCORED}"
SAMPLE_ROWS = f"""srows AS (SELECT p.case_id, p.prefix_len, s.sample, p.target_suffix AS t, s.path AS d FROM pairs p JOIN sampled s USING (case_id, prefix_len)),
  sscored AS (SELECT *, {dls_sql('t', 'd')} AS dls, CASE WHEN t = d THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, {token_sql('t', 'd')} AS ta FROM srows),
  sagg AS (SELECT case_id, prefix_len, avg(dls) AS mean, min(dls) AS low, max(dls) AS best, avg(em) AS em, max(ta) AS ta FROM sscored GROUP BY ALL)"""
SAMPLED_SCORED = f"WITH RECURSIVE {sql.ORDERS}, {BASE}, {DRAWS}, {SAMPLE_ROWS}"


def greedy_decoded(spark, sf_dir):
    _, _, model, pairs, steps = prepared(spark, sf_dir)
    return decode_greedy(pairs, model, steps)


def sampled_decoded(spark, sf_dir):
    _, _, model, pairs, steps = prepared(spark, sf_dir)
    return collect_samples(pairs, decode_samples(pairs, model, steps, SAMPLES, together=True))


@query(
    "edit_distances",
    "K1 K2",
    GREEDY_SCORED + f" SELECT case_id, prefix_len, {distance_sql('t', 'd')} AS distance, round(dls, 6) AS similarity FROM scored",
)
def edit_distances(spark, sf_dir):
    rows = greedy_decoded(spark, sf_dir).withColumn("d", F.get("decoded_suffixes", F.lit(0)))
    return rows.select(
        "case_id", i64("prefix_len").alias("prefix_len"), i64(edit_distance(F.col("target_suffix"), F.col("d"))).alias("distance"),
        r6(similarity(F.col("target_suffix"), F.col("d"))).alias("similarity"),
    )


@query("deterministic_scores", "K3 K5", GREEDY_SCORED + " SELECT case_id, prefix_len, 'mode' AS mode, round(dls, 6) AS dls FROM scored")
def deterministic_scores(spark, sf_dir):
    rows = score_rows(greedy_decoded(spark, sf_dir))
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), "mode", r6("dls").alias("dls"))


@query(
    "probabilistic_scores",
    "K4 K5",
    SAMPLED_SCORED
    + " SELECT case_id, prefix_len, round(mean + 1e-9, 6) AS dls, round(low, 6) AS dls_min, round(best, 6) AS dls_best FROM sagg",
)
def probabilistic_scores(spark, sf_dir):
    rows = score_rows(sampled_decoded(spark, sf_dir))
    return rows.select(
        "case_id", i64("prefix_len").alias("prefix_len"), r6up("dls").alias("dls"), r6("dls_min").alias("dls_min"), r6("dls_best").alias("dls_best")
    )


@query(
    "similarity_by_prefix_length",
    "K6",
    SAMPLED_SCORED
    + " SELECT prefix_len, round(avg(mean) + 1e-9, 6) AS dls, round(avg(low) + 1e-9, 6) AS dls_min, round(avg(best) + 1e-9, 6) AS dls_best FROM sagg GROUP BY prefix_len",
)
def similarity_by_prefix_length(spark, sf_dir):
    rows = by_prefix_length(score_rows(sampled_decoded(spark, sf_dir)), ["dls", "dls_min", "dls_best"])
    return rows.select(i64("prefix_len").alias("prefix_len"), *[r6up(c).alias(c) for c in ("dls", "dls_min", "dls_best")])


@query(
    "overall_similarity",
    "K7",
    GREEDY_SCORED + " SELECT round(avg(dls), 6) AS average_dls, CAST(0 AS DOUBLE) AS without_rows FROM scored",
)
def overall_similarity(spark, sf_dir):
    scored = cut(score_rows(greedy_decoded(spark, sf_dir)).select("prefix_len", "dls"))
    nothing = overall(scored.where("prefix_len < 0")).withColumnRenamed("dls", "without_rows")
    return overall(scored).select(r6("dls").alias("average_dls"), F.lit(1).alias("one")).join(
        nothing.withColumn("one", F.lit(1)), "one"
    ).drop("one")


@query(
    "suffix_agreement",
    "K8 K9 K10",
    GREEDY_SCORED + " SELECT case_id, prefix_len, round(em, 6) AS exact_match, round(ta, 6) AS token_acc FROM scored",
)
def suffix_agreement(spark, sf_dir):
    rows = score_coherence(greedy_decoded(spark, sf_dir))
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), r6("exact_match").alias("exact_match"), r6("token_acc").alias("token_acc"))


@query(
    "sampled_suffix_agreement",
    "K10",
    SAMPLED_SCORED + " SELECT case_id, prefix_len, round(em + 1e-9, 6) AS exact_match, round(ta, 6) AS best_token_acc FROM sagg",
)
def sampled_suffix_agreement(spark, sf_dir):
    rows = sampled_decoded(spark, sf_dir)
    mean = score_coherence(rows).select("case_id", "prefix_len", "decoded_suffixes", "target_suffix", "mode", F.col("exact_match").alias("em"))
    best = score_coherence(mean, "best")
    return best.select("case_id", i64("prefix_len").alias("prefix_len"), r6up("em").alias("exact_match"), r6("token_acc").alias("best_token_acc"))


@query("average_agreement", "K11", GREEDY_SCORED + " SELECT round(avg(em), 6) AS exact_match, round(avg(ta), 6) AS token_acc FROM scored")
def average_agreement(spark, sf_dir):
    rows = overall(score_coherence(greedy_decoded(spark, sf_dir)), ["exact_match", "token_acc"])
    return rows.select(r6("exact_match").alias("exact_match"), r6("token_acc").alias("token_acc"))


@query("prefix_length_density", "K19", f"WITH {sql.ORDERS}, {BASE} SELECT prefix_len, count(*) AS rows FROM pairs GROUP BY 1")
def prefix_length_density(spark, sf_dir):
    _, _, _, pairs, _ = prepared(spark, sf_dir)
    return prefix_density(pairs).withColumn("prefix_len", i64("prefix_len"))


# --- guided variants ------------------------------------------------------------------

VARIANTS = {"clean": replace(CFG, beta_max=0.0), "decision_decoding": CFG}


def variant_results(spark, sf_dir, variant: str):
    """Scored rows and per-decode counters of one variant; strength 0 only keeps the books."""
    model, pairs, steps, decide, table = guided_setup(spark, sf_dir, VARIANTS[variant])
    pairs = cut(with_recent(pairs, model).select("case_id", "prefix_len", "target_suffix", *ENDS))
    done = cut(guided_mode(distinct_prefixes(pairs), model, steps, decide).select(*ENDS, "suffix", "trace"))
    rows = pairs.join(small(done.select(*ENDS, "suffix")), ENDS)
    rows = rows.withColumns({"decoded_suffixes": F.array("suffix"), "mode": F.lit("guided mode")})
    counters = settled(reasoning_counters(explain(reasoning_steps(done, ENDS), prior_guards(table), ENDS), ENDS))
    return score_rows(rows), pairs.select("case_id", "prefix_len", *ENDS).join(counters, ENDS)


def variant_summary(spark, sf_dir, variant: str):
    scored, counters = variant_results(spark, sf_dir, variant)
    plain = plain_summary(scored, "orders", "counts", variant, "mode")
    return cut(guided_summary(plain, counters))


PLAIN_SQL = f"WITH RECURSIVE {sql.ORDERS}, {GUIDED_BASE}, {SUPPORTED}, {guided_walk('0.0')}"
VSUM = f"""vrows AS (SELECT p.target_suffix AS t, g.path AS d FROM pairs p JOIN guided g USING (case_id, prefix_len)),
  vdls AS (SELECT avg({dls_sql('t', 'd')}) AS average_dls, count(*) AS n_rows FROM vrows),
  vcount AS (SELECT count(*) AS decision_steps, count(*) FILTER (WHERE conflict) AS conflicts, count(*) FILTER (WHERE non_trivial) AS non_trivial_decision_steps,
     count(*) FILTER (WHERE status = 'matched_trivial_rule') AS matched_trivial_rule, count(*) FILTER (WHERE status = 'no_rule_for_branch') AS no_rule_for_branch FROM gsteps)"""


@query(
    "plain_decision_conformance",
    "K12 K15",
    PLAIN_SQL
    + f", {VSUM} SELECT decision_steps, conflicts, round(conflicts / decision_steps, 6) AS conflict_rate, round(1 - conflicts / decision_steps, 6) AS decision_conformance FROM vcount",
)
def plain_decision_conformance(spark, sf_dir):
    _, counters = variant_results(spark, sf_dir, "clean")
    rows = conformance(counters)
    return rows.select("decision_steps", "conflicts", r6("conflict_rate").alias("conflict_rate"), r6("decision_conformance").alias("decision_conformance"))


@query(
    "summed_reasoning_counters",
    "K13",
    f"""WITH {sql.ORDERS}, {OBSERVED_STATUS} SELECT count(*) AS decision_steps, count(*) FILTER (WHERE conflict) AS conflicts, count(*) FILTER (WHERE explained) AS explained_steps,
      count(*) FILTER (WHERE NOT conflict) AS explainable_decision_steps, count(*) FILTER (WHERE non_trivial) AS non_trivial_decision_steps, round(count(*) FILTER (WHERE explained) / count(*), 6) AS explained_rate,
      round(coalesce(count(*) FILTER (WHERE non_trivial AND explained) / nullif(count(*) FILTER (WHERE non_trivial), 0), 0), 6) AS non_trivial_explained_rate FROM status""",
)
def summed_reasoning_counters(spark, sf_dir):
    rows = sum_counters(reasoning_counters(observed_reasoning(spark, sf_dir), ["case_id"]))
    return rows.select(
        "decision_steps", "conflicts", "explained_steps", "explainable_decision_steps", "non_trivial_decision_steps",
        r6("explained_rate").alias("explained_rate"), r6("non_trivial_explained_rate").alias("non_trivial_explained_rate"),
    )


@query(
    "guided_summary",
    "K14",
    GUIDED_SQL
    + f""", {VSUM} SELECT 'orders' AS dataset, 'counts' AS model, 'decision_decoding' AS variant, round(average_dls, 6) AS average_dls, n_rows, decision_steps, conflicts,
      non_trivial_decision_steps, matched_trivial_rule, no_rule_for_branch, round(conflicts / decision_steps, 6) AS conflict_rate FROM vdls, vcount""",
)
def guided_summary_row(spark, sf_dir):
    row = variant_summary(spark, sf_dir, "decision_decoding")
    return row.select(
        "dataset", "model", "variant", r6("average_dls").alias("average_dls"), "n_rows", "decision_steps", "conflicts",
        "non_trivial_decision_steps", "matched_trivial_rule", "no_rule_for_branch", r6("conflict_rate").alias("conflict_rate"),
    )


@query(
    "plain_summary",
    "K16",
    GREEDY_SCORED + " SELECT 'orders' AS dataset, 'counts' AS model, 'clean' AS variant, 'mode' AS mode, round(avg(dls), 6) AS average_dls, count(*) AS n_rows FROM scored",
)
def plain_summary_row(spark, sf_dir):
    row = plain_summary(score_rows(greedy_decoded(spark, sf_dir)), "orders", "counts", "clean", "mode")
    return row.withColumn("average_dls", r6("average_dls"))


@query(
    "variant_comparison",
    "K17",
    "WITH a AS (" + PLAIN_SQL + f", {VSUM} SELECT average_dls, 1 - conflicts / decision_steps AS conf FROM vdls, vcount), b AS ("
    + GUIDED_SQL + f", {VSUM} SELECT average_dls, 1 - conflicts / decision_steps AS conf FROM vdls, vcount)"
    + """ SELECT 'clean' AS variant, round(average_dls, 6) AS average_dls, round(conf, 6) AS decision_conformance, 0.0::DOUBLE AS delta_dls, 0.0::DOUBLE AS delta_conformance FROM a
    UNION ALL SELECT 'decision_decoding', round(b.average_dls, 6), round(b.conf, 6), round(b.average_dls - a.average_dls, 6), round(b.conf - a.conf, 6) FROM a, b""",
)
def variant_comparison(spark, sf_dir):
    both = variant_summary(spark, sf_dir, "clean").unionByName(variant_summary(spark, sf_dir, "decision_decoding"))
    rows = variant_table(both.withColumn("decision_conformance", 1 - F.col("conflict_rate")))
    return rows.select("variant", *[r6(c).alias(c) for c in ("average_dls", "decision_conformance", "delta_dls", "delta_conformance")])


@query(
    "average_explainability",
    "K18",
    f"""WITH {sql.ORDERS}, {OBSERVED_STATUS}, halves AS (SELECT CAST(case_id AS BIGINT) % 2 AS variant, count(*) FILTER (WHERE explained) / count(*) FILTER (WHERE NOT conflict) AS rate FROM status GROUP BY 1)
    SELECT round(avg(rate), 6) AS average_rule_explained_rate FROM halves""",
)
def average_explainability_rate(spark, sf_dir):
    told = observed_reasoning(spark, sf_dir).withColumn("variant", F.col("case_id").cast("bigint") % 2)
    return average_explainability(reasoning_counters(told, ["variant"])).select(
        r6("average_rule_explained_rate").alias("average_rule_explained_rate")
    )


@query(
    "reasoning_examples",
    "K20",
    f"WITH {sql.ORDERS}, {OBSERVED_STATUS} SELECT case_id, pos, place, label FROM status WHERE explained ORDER BY case_id, pos LIMIT 5",
)
def examples(spark, sf_dir):
    told = reasoning_examples(observed_reasoning(spark, sf_dir), ["case_id", "pos"], 5)
    return told.select("case_id", "pos", "place", "label")


# --- losses as scores -------------------------------------------------------------------


NEXTS = """tnx AS (SELECT case_id, pos, activity, lag(activity) OVER (PARTITION BY case_id ORDER BY pos) AS prev, coalesce(lead(activity) OVER (PARTITION BY case_id ORDER BY pos), 'EOS') AS nxt,
    lead(o_totalprice) OVER (PARTITION BY case_id ORDER BY pos) AS next_price FROM tlog),
  looked AS (SELECT tnx.*, coalesce(s2.ctx, s1.ctx, '') AS ctx FROM tnx LEFT JOIN states s2 ON s2.ctx = prev || chr(31) || activity LEFT JOIN states s1 ON s1.ctx = activity)"""


def next_rows(spark, sf_dir, setup=None):
    """Test events with the predicted distribution and what came next."""
    log, train, model, _, _ = setup or prepared(spark, sf_dir)
    test = next_event_rows(only_split(log, "test"))
    from caseloom.operators.ordering import around

    test = around(
        test,
        lambda df, w: df.withColumn("items", F.array_compact(F.array(F.lag("activity").over(w), "activity"))).withColumn(
            "next_price", F.lead("o_totalprice").over(w)
        ),
        before=1,
        after=1,
    )
    rows = next_distribution(attach_state(test.events, model, F.col("items")), model)
    return log, train, rows


@query(
    "cross_entropy",
    "K21",
    f"""WITH {sql.ORDERS}, {BASE}, {NEXTS} SELECT round(avg(-ln(greatest(coalesce(p, 0), 1e-12))), 6) AS cross_entropy, count(*) AS events
    FROM looked LEFT JOIN mdl ON mdl.ctx = looked.ctx AND label = nxt""",
)
def cross_entropy_score(spark, sf_dir):
    _, _, rows = next_rows(spark, sf_dir)
    return rows.agg(
        r6(masked_mean(cross_entropy(F.col("p"), F.col("next_activity")), F.lit(True))).alias("cross_entropy"), F.count(F.lit(1)).alias("events")
    )


@query(
    "semantic_loss",
    "K22",
    f"""WITH {sql.ORDERS}, {GUIDED_BASE}, {SUPPORTED}, {NEXTS}, held AS (SELECT case_id, pos, labels, nxt, sum(CASE WHEN list_contains(labels, label) THEN p ELSE 0 END) AS mass
      FROM looked JOIN supp ON place = 'p_' || activity JOIN mdl ON mdl.ctx = looked.ctx GROUP BY ALL)
    SELECT round(coalesce(avg(-ln(greatest(mass, 1e-12))), 0), 6) AS semantic_loss, round(coalesce(avg(-ln(greatest(mass, 1e-12))) FILTER (WHERE list_contains(labels, nxt)), 0), 6) AS supported_only FROM held""",
)
def semantic_loss_score(spark, sf_dir):
    from caseloom.catalog.shared import mined_priors

    _, _, rows = next_rows(spark, sf_dir)
    z = mined_priors(spark, sf_dir).z.withColumn("activity", F.expr("substring(place, 3)"))
    rows = rows.join(settled(z), "activity", "left").withColumn("support", supported(F.col("z"), TAU))
    loss = semantic_loss(F.col("p"), F.col("support"))
    labelled = F.col("z").isNotNull() & (F.size("support") > 0)
    return rows.agg(
        r6(masked_mean(loss, labelled)).alias("semantic_loss"),
        r6(masked_mean(loss, labelled & F.array_contains("support", F.col("next_activity")))).alias("supported_only"),
    )


@query(
    "gaussian_likelihood",
    "K23",
    f"""WITH {sql.ORDERS}, {BASE}, {NEXTS}, a AS (SELECT activity, avg(o_totalprice) / 1e5 AS mean, ln(var_pop(o_totalprice) / 1e10) AS lv FROM log JOIN split USING (case_id) WHERE split = 'train' GROUP BY activity)
    SELECT round(avg(0.5 * (exp(-least(greatest(lv, -6), 6)) * pow(next_price / 1e5 - mean, 2) + least(greatest(lv, -6), 6))), 6) AS nll FROM looked JOIN a ON a.activity = nxt WHERE next_price IS NOT NULL""",
)
def gaussian_likelihood(spark, sf_dir):
    _, train, rows = next_rows(spark, sf_dir)
    model = attribute_model(train, [], ["o_totalprice"]).select(
        F.col("activity").alias("next_activity"), (F.col("o_totalprice__mean") / 1e5).alias("mean"), (2 * F.ln(F.col("o_totalprice__std") / 1e5)).alias("lv")
    )
    scored = rows.where("next_price is not null").join(settled(model), "next_activity")
    nll = gaussian_nll(F.col("mean"), F.col("lv"), F.col("next_price") / 1e5)
    return scored.agg(r6(masked_mean(nll, F.lit(True))).alias("nll"))
