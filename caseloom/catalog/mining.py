"""Decision mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import sql
from caseloom.catalog.flow import DECISIONS, PLACES, edges_sql
from caseloom.catalog.registry import i64, query, r6, r6up
from caseloom.catalog.shared import dist_text, mined_priors, with_z
from caseloom.functions.text import rule_text
from caseloom.operators.cases import only_split, split_cases, with_split
from caseloom.operators.encode import apply_scalers, scaler_values, scalers
from caseloom.operators.flow import align, decisions, directly_follows, incoming_transitions, net_from_edges
from caseloom.operators.mine import (
    class_weights,
    displayed_rule,
    feature_names,
    feature_state,
    guards,
    mine,
    predict,
    prior_guards,
    priors,
    samples,
    save_results,
    stratified_holdout,
    synced,
)
from caseloom.operators.label import place_diagnostics
from caseloom.operators.ordering import join_cases, settle
from caseloom.session import cut, scratch_path, small
from caseloom.sources.logs import events_log, orders_log, planted_log, turns_log

TRAINED = f"{sql.SPLIT}, {edges_sql(0.0, learned=True)}, {PLACES}, {DECISIONS}"
PRIORS = """prior AS (SELECT place, target AS label, count(*) AS support, count(*) / sum(count(*)) OVER (PARTITION BY place) AS p
   FROM records JOIN split USING (case_id) WHERE split = 'train' GROUP BY place, target)"""
ZTEXT = """zt AS (SELECT place, string_agg(label || '=' || CAST(CAST(round(p * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY label) AS z FROM prior GROUP BY place)"""
EARLIER = "OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def mode_sql(h: str) -> str:
    return (
        f"list_sort(list_transform(list_distinct({h}), lambda x: {{'c': -len(list_filter({h}, lambda y: y = x)), "
        f"'f': list_position({h}, x), 'v': x}}))[1].v"
    )


STATE = f"""hist AS (SELECT *, list(o_orderstatus) {EARLIER} AS h, avg(o_totalprice) {EARLIER} AS past_avg FROM log),
  state AS (SELECT case_id, pos, o_orderstatus, o_totalprice, coalesce({mode_sql('h')}, o_orderstatus) AS past_mode,
     coalesce(past_avg, o_totalprice) AS past_avg, first_value(c_mktsegment) OVER (PARTITION BY case_id ORDER BY pos) AS segment FROM hist)"""


@query(
    "decision_samples",
    "G1 G2",
    f"""WITH {sql.ORDERS}, {edges_sql(0.0)}, {PLACES}, {DECISIONS}, {STATE}
    SELECT r.case_id, place, ord, target, CASE WHEN sync_index > 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN sync_index > 0 THEN past_mode END AS past_mode,
      round(CASE WHEN sync_index > 0 THEN o_totalprice END, 6) AS o_totalprice, round(CASE WHEN sync_index > 0 THEN past_avg END + 1e-9, 6) AS past_avg, segment
    FROM records r LEFT JOIN state s ON s.case_id = r.case_id AND s.pos = greatest(sync_index, 1)""",
)
def decision_samples(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    edges = cut(directly_follows(log))
    records = decisions(align(log, edges), net_from_edges(edges))
    rows = samples(records, log, ["o_orderstatus"], ["o_totalprice"], ["c_mktsegment"])
    return rows.select(
        "case_id",
        "place",
        "ord",
        "target",
        "o_orderstatus",
        F.col("o_orderstatus_past_mode").alias("past_mode"),
        r6("o_totalprice").alias("o_totalprice"),
        r6up("o_totalprice_past_avg").alias("past_avg"),
        F.col("c_mktsegment").alias("segment"),
    )


@query(
    "event_feature_state",
    "G2",
    f"""WITH {sql.EVENTS}, hist AS (SELECT *, avg(value) {EARLIER} AS v, avg(k) {EARLIER} AS kk FROM log)
    SELECT case_id, pos, round(value, 6) AS value, round(coalesce(v, value) + 1e-9, 6) AS value_past_avg, round(coalesce(kk, k) + 1e-9, 6) AS k_past_avg FROM hist""",
)
def event_feature_state(spark, sf_dir):
    state = feature_state(events_log(spark, sf_dir), [], ["value", "k"], []).events
    return state.select("case_id", "pos", r6("value").alias("value"), *[r6up(c).alias(c) for c in ("value_past_avg", "k_past_avg")])


@query(
    "labeller_feature_state",
    "G3",
    f"""WITH {sql.ORDERS}, gaps AS (SELECT * REPLACE (CASE WHEN pos % 3 <> 1 THEN c_mktsegment END AS c_mktsegment) FROM log),
    hist AS (SELECT *, list(o_orderstatus) {EARLIER} AS h, avg(o_totalprice) {EARLIER} AS past_avg FROM gaps)
    SELECT case_id, pos, {mode_sql('h')} AS past_mode, round(past_avg + 1e-9, 6) AS past_avg,
      last_value(c_mktsegment IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM hist""",
)
def labeller_feature_state(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    log = log.with_events(log.events.withColumn("c_mktsegment", F.when(F.col("pos") % 3 != 1, F.col("c_mktsegment"))))
    state = feature_state(log, ["o_orderstatus"], ["o_totalprice"], ["c_mktsegment"], fallback=False).events
    return state.select(
        "case_id",
        "pos",
        F.col("o_orderstatus_past_mode").alias("past_mode"),
        r6up("o_totalprice_past_avg").alias("past_avg"),
        F.col("c_mktsegment").alias("segment"),
    )


@query(
    "stratified_holdout",
    "G6",
    f"""WITH {sql.ORDERS}, {edges_sql(0.0)}, {PLACES}, {DECISIONS},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY place, target ORDER BY md5(case_id || '|' || place || '|' || ord || '|7')) AS r, count(*) OVER (PARTITION BY place, target) AS c,
      count(*) OVER (PARTITION BY place) AS t FROM records),
    usable AS (SELECT place, min(c) >= 2 AND max(t) >= 50 AS ok FROM ranked GROUP BY place)
    SELECT case_id, place, ord, ok AND r <= floor(0.15 * c) AS holdout FROM ranked JOIN usable USING (place)""",
)
def holdout(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    edges = cut(directly_follows(log))
    records = decisions(align(log, edges), net_from_edges(edges))
    return stratified_holdout(records, ["case_id", "place", "ord"]).select("case_id", "place", "ord", "holdout")


@query(
    "place_priors",
    "G7",
    f"WITH {sql.ORDERS}, {TRAINED}, {PRIORS} SELECT place, label, support, round(p, 6) AS p FROM prior",
)
def place_priors(spark, sf_dir):
    return mined_priors(spark, sf_dir).priors.withColumn("p", r6("p"))


@query(
    "class_weights",
    "G8",
    f"""WITH {sql.ORDERS}, {edges_sql(0.0)}, {PLACES}, {DECISIONS}, c AS (SELECT place, target, count(*) AS n_c FROM records GROUP BY ALL)
    SELECT place, target, round(sum(n_c) OVER (PARTITION BY place) / (count(*) OVER (PARTITION BY place) * n_c), 6) AS weight FROM c""",
)
def weights(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    edges = cut(directly_follows(log))
    return class_weights(decisions(align(log, edges), net_from_edges(edges))).withColumn("weight", r6("weight"))


@query(
    "unconditional_guards",
    "G14",
    f"""WITH {sql.ORDERS}, {TRAINED}, {PRIORS}, t AS (SELECT *, sum(support) OVER (PARTITION BY place) AS total FROM prior)
    SELECT place, label, '(true)' AS rule, round(p, 6) AS prob_model, CAST(total AS BIGINT) AS support, round(p * ln(1 + total), 6) AS score FROM t WHERE p >= 0.15""",
)
def unconditional_guards(spark, sf_dir):
    return prior_guards(mined_priors(spark, sf_dir).priors).select(
        "place", "label", "rule", r6("prob_model").alias("prob_model"), "support", r6("score").alias("score")
    )


# Guards read off the data: per activity and next activity the mean amount as bound,
# the statuses seen before it as allowed set, the first segment in name order as excluded set.
DATA_GUARDS = """nexts AS (SELECT *, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS next_activity FROM log),
  dg AS (SELECT 'p_' || activity AS place, next_activity AS label, round(avg(o_totalprice), 0) AS low, round(max(o_totalprice), 0) AS high,
     list_sort(list(DISTINCT o_orderstatus)) AS statuses, list_sort(list(DISTINCT c_nationkey) FILTER (WHERE c_nationkey IS NOT NULL)) AS nations, min(c_mktsegment) AS segment, count(*) AS support
   FROM nexts WHERE next_activity IS NOT NULL GROUP BY activity, next_activity)"""


def data_guards(log):
    from caseloom.operators.cases import next_event_rows

    nexts = next_event_rows(log).events.where("next_activity <> 'EOS'")
    return nexts.groupBy(F.concat(F.lit("p_"), "activity").alias("place"), F.col("next_activity").alias("label")).agg(
        F.round(F.avg("o_totalprice"), 0).alias("low"),
        F.round(F.max("o_totalprice"), 0).alias("high"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"),
        F.array_sort(F.collect_set("c_nationkey")).alias("nations"),
        F.min("c_mktsegment").alias("segment"),
        F.count(F.lit(1)).alias("support"),
    )


def as_guards(df):
    """The data guards in guard form: amount bounds, allowed statuses, an excluded segment."""
    double = "map<string,struct<low:double,high:double>>"
    return df.select(
        "place",
        "label",
        F.create_map(
            F.lit("o_totalprice"), F.struct(F.col("low").alias("low"), F.lit(None).cast("double").alias("high")),
            F.lit("o_totalprice_past_avg"), F.struct(F.lit(None).cast("double").alias("low"), F.col("high").alias("high")),
        ).cast(double).alias("intervals"),
        F.create_map(F.lit("o_orderstatus"), "statuses", F.lit("c_nationkey"), "nations").alias("allowed"),
        F.create_map(F.lit("c_mktsegment"), F.array("segment")).alias("excluded"),
        "support",
    )


G6TEXT = "printf('%.6g', {})"


@query(
    "rule_texts",
    "G15",
    f"""WITH {sql.ORDERS}, {DATA_GUARDS} SELECT place, label,
      '(c_mktsegment not in {{' || segment || '}}) AND (c_nationkey in {{' || array_to_string(nations[1:5], ', ') || '}}' ||
      CASE WHEN len(nations) > 5 THEN ' (+' || (len(nations) - 5) || ' more)' ELSE '' END || ') AND (o_orderstatus in {{' || array_to_string(statuses[1:5], ', ') || '}}) AND (o_totalprice > ' ||
      printf('%.6g', low) || ') AND (o_totalprice_past_avg <= ' || printf('%.6g', high) || ')' AS rule FROM dg""",
)
def rule_texts(spark, sf_dir):
    found = as_guards(data_guards(orders_log(spark, sf_dir)))
    return found.select("place", "label", rule_text(F.col("intervals"), F.col("allowed"), F.col("excluded")).alias("rule"))


@query(
    "rule_texts_in_units",
    "G16",
    f"""WITH {sql.ORDERS}, {DATA_GUARDS} SELECT place, label,
      '(c_mktsegment not in {{' || segment || '}}) AND (c_nationkey in {{' || array_to_string(nations[1:5], ', ') || '}}' ||
      CASE WHEN len(nations) > 5 THEN ' (+' || (len(nations) - 5) || ' more)' ELSE '' END || ') AND (o_orderstatus in {{' || array_to_string(statuses[1:5], ', ') || '}}) AND (o_totalprice > ' ||
      format('{{:,}}', CAST(low AS BIGINT)) || ') AND (o_totalprice_past_avg <= ' || format('{{:,}}', CAST(high AS BIGINT)) || ')' AS rule FROM dg""",
)
def rule_texts_in_units(spark, sf_dir):
    """Bounds scaled as mining sees them, shown in original units again."""
    log = orders_log(spark, sf_dir)
    fitted = scaler_values(scalers(log.events, ["o_totalprice"]))
    mean, scale = fitted["o_totalprice"]
    bounds = {c: (F.col(c) - mean) / scale for c in ("low", "high")}
    found = as_guards(data_guards(log).withColumns(bounds))
    return found.select("place", "label", displayed_rule(fitted).alias("rule"))


# --- learned models ---------------------------------------------------------

END_ROWS = 5


def mined_models(spark, sf_dir, make, dyn_cat, dyn_num, sta_cat=()):
    """Models of one log, with the log (numbers scaled), its net and its samples.

    Net, scalers and models see train and validation cases only; scalers the train cases.
    """
    log = make(spark, sf_dir)
    log = settle(with_split(log, split_cases(log.events)))
    fitted = scaler_values(scalers(log.events.where("split = 'train'"), dyn_num, end_rows=END_ROWS))
    log = log.with_events(apply_scalers(log.events, fitted))
    edges = cut(directly_follows(only_split(log, "train", "val")))
    net = net_from_edges(edges)
    split = log.events.where("pos = 1").select("case_id", "split")
    records = join_cases(decisions(align(log, edges), net), split, log.spans)
    rows = samples(records, synced(log, edges), dyn_cat, dyn_num, sta_cat)
    cats, nums = feature_names(dyn_cat, dyn_num, sta_cat)
    return log, net, rows, mine(rows.where("split <> 'test'").drop("split"), net, cats, nums, fitted=fitted)


def planted_models(spark, sf_dir):
    return mined_models(spark, sf_dir, planted_log, ["o_orderstatus"], ["o_totalprice"], ["c_mktsegment"])


@query("place_models", "G4 G5 G9 G10")
def place_models(spark, sf_dir):
    _, _, rows, result = planted_models(spark, sf_dir)
    scored = predict(rows.where("split = 'test'"), result)
    kinds = result.places.select("place", "kind", F.col("rows").alias("train_rows"))
    return place_diagnostics(scored).join(small(kinds), "place").select(
        "place", "kind", "train_rows", "support", r6("top1_accuracy").alias("top1"), r6("majority_baseline").alias("majority")
    )


@query(
    "learned_decisions",
    "G5 G9 H2",
    f"""WITH {sql.PLANTED}, {TRAINED}
    SELECT r.case_id, place, ord, CASE WHEN l.o_totalprice > 250000 THEN 'REVIEW' ELSE 'APPROVE' END AS decided
    FROM records r JOIN split ON split.case_id = r.case_id JOIN log l ON l.case_id = r.case_id AND l.pos = greatest(sync_index, 1) WHERE split = 'test'""",
)
def learned_decisions(spark, sf_dir):
    """What the models say goes on after each decision of the test cases; the planted rule is the amount's."""
    _, _, rows, result = planted_models(spark, sf_dir)
    scored = predict(rows.where("split = 'test'"), result)
    goes_on = F.map_entries(F.map_filter("z", lambda label, _: label != "EOS"))
    best = F.array_max(F.transform(goes_on, lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))))
    return scored.select("case_id", "place", "ord", best["label"].alias("decided"))


@query("boosted_place_models", "G5 G9")
def boosted_place_models(spark, sf_dir):
    _, _, rows, result = mined_models(spark, sf_dir, turns_log, [], ["chars"])
    scored = predict(rows.where("split = 'test'"), result)
    kinds = result.places.select("place", "kind", F.col("rows").alias("train_rows"))
    return place_diagnostics(scored).join(small(kinds), "place").select(
        "place", "kind", "train_rows", "support", r6("top1_accuracy").alias("top1"), r6("majority_baseline").alias("majority")
    )


@query("mined_guards", "G11 G12 G13")
def mined_guards(spark, sf_dir):
    _, _, _, result = planted_models(spark, sf_dir)
    return guards(result).select(
        "place", "label", "rule", "raw_rule", r6("prob_model").alias("prob_model"), r6("prob_emp").alias("prob_emp"),
        "support", r6("coverage").alias("coverage"), r6("lift").alias("lift"), r6("score").alias("score"),
    )


@query("decision_results_store", "A7")
def decision_results_store(spark, sf_dir):
    _, net, _, result = planted_models(spark, sf_dir)
    paths = save_results(result, guards(result), incoming_transitions(net), scratch_path(spark, "decisions"))
    places = spark.read.parquet(paths["places"])
    flat = spark.read.parquet(paths["guards_flat"]).groupBy("place").agg(F.count(F.lit(1)).alias("flat_rules"))
    return places.join(flat, "place", "left").select(
        "place", "kind", "rows", F.size("incoming").alias("incoming"), "rules", "flat_rules"
    )
