"""Decision labels and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import sql
from caseloom.catalog.flow import DECISIONS, PLACES, edges_sql
from caseloom.catalog.mining import PRIORS, TRAINED, ZTEXT
from caseloom.catalog.registry import i64, joined, query, r6
from caseloom.catalog.shared import dist_text, labelled_log, mined_priors, with_z
from caseloom.operators.cases import next_event_rows, window_size
from caseloom.operators.flow import align, decisions, directly_follows, net_from_edges
from caseloom.operators.label import (
    check_labels,
    decoder_part,
    dense_labels,
    flag_informative,
    label_coverage,
    label_windows,
    place_diagnostics,
    summarise_logs,
    weighted_accuracy,
)
from caseloom.operators.mine import distributions, priors
from caseloom.sources.logs import events_log, items_log, orders_flow, orders_log, turns_log

# The decision after an event is the one at the place of its activity.
LABELLED = """labelled AS (SELECT log.case_id, log.pos, log.n, log.activity, zt.place, zt.z FROM log LEFT JOIN zt ON zt.place = 'p_' || log.activity)"""


@query(
    "event_decision_labels",
    "H1",
    f"WITH {sql.ORDERS}, {TRAINED}, {PRIORS}, {ZTEXT}, {LABELLED} SELECT case_id, pos, place, z FROM labelled",
)
def event_decision_labels(spark, sf_dir):
    m = mined_priors(spark, sf_dir)
    text = m.z.select("place", dist_text("z").alias("z"))
    return with_z(labelled_log(m).select("case_id", "pos", "place"), text).select("case_id", "pos", "place", "z")


@query(
    "decision_instances",
    "H2",
    f"""WITH {sql.ORDERS}, {TRAINED}, {PRIORS}, {ZTEXT} SELECT case_id, place, ord, target, z
    FROM records JOIN split USING (case_id) LEFT JOIN zt USING (place) WHERE split = 'test'""",
)
def decision_instances(spark, sf_dir):
    m = mined_priors(spark, sf_dir)
    return with_z(m.records.where("split = 'test'"), m.z).select("case_id", "place", "ord", "target", dist_text("z").alias("z"))


WINDOWED = f"""win AS (SELECT CAST(round_even(quantile_cont(n + 5, 0.985), 0) AS BIGINT) + 5 AS w FROM log WHERE pos = 1),
  ended AS (SELECT case_id, pos, place FROM labelled UNION ALL SELECT case_id, n + k, NULL FROM labelled, unnest(range(1, 6)) AS t(k) WHERE pos = n),
  full_rows AS (SELECT case_id, list(place ORDER BY pos) AS places FROM ended GROUP BY case_id),
  cuts AS (SELECT case_id, CAST(k AS BIGINT) AS prefix_len, w, places[greatest(1, k - w + 1):k] AS places FROM full_rows, win, unnest(range(6, len(places) + 1)) AS t(k))"""


def labelled_windows(spark, sf_dir):
    m = mined_priors(spark, sf_dir)
    window = window_size(m.log, 5)
    return m, label_windows(labelled_log(m), window, 5, m.z), window


@query(
    "window_decision_labels",
    "H3 H4",
    f"""WITH {sql.ORDERS}, {TRAINED}, {PRIORS}, {ZTEXT}, {LABELLED}, {WINDOWED}
    SELECT case_id, prefix_len, len(places) AS positions, {sql.arrow("places")} AS places FROM cuts""",
)
def window_decision_labels(spark, sf_dir):
    _, rows, _ = labelled_windows(spark, sf_dir)
    return check_labels(rows).select(
        "case_id", "prefix_len", i64(F.size("labels")).alias("positions"), joined(F.transform("labels", lambda x: x["place"])).alias("places")
    )


DENSE_TEXT = """vz AS (SELECT place, string_agg(CAST(CAST(round(coalesce(p, 0) * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY label) AS d FROM
    (SELECT v.label, d.place, p FROM (SELECT DISTINCT activity AS label FROM log UNION SELECT 'EOS') v CROSS JOIN (SELECT DISTINCT place FROM prior) d
       LEFT JOIN prior ON prior.place = d.place AND prior.label = v.label) GROUP BY place),
  zero AS (SELECT array_to_string(list_transform(range(1 + (SELECT count(DISTINCT activity) FROM log)), lambda i: '0'), ',') AS nothing)"""


@query(
    "dense_decision_labels",
    "H5 H6",
    f"""WITH {sql.ORDERS}, {TRAINED}, {PRIORS}, {ZTEXT}, {LABELLED}, {WINDOWED}, {DENSE_TEXT},
    padded AS (SELECT case_id, prefix_len, w, list_concat(list_transform(range(w - len(places)), lambda i: NULL::VARCHAR), places) AS places FROM cuts),
    flat AS (SELECT case_id, prefix_len, w, i, places[i] AS place FROM padded, unnest(range(1, w + 1)) AS t(i)),
    shown AS (SELECT case_id, prefix_len, w, i, coalesce(d, nothing) AS d, CASE WHEN d IS NULL THEN '0' ELSE '1' END AS m FROM flat LEFT JOIN vz USING (place), zero)
    SELECT case_id, prefix_len, md5(string_agg(d, ';' ORDER BY i)) AS targets, string_agg(m, '' ORDER BY i) AS mask,
      string_agg(m, '' ORDER BY i) FILTER (WHERE i BETWEEN w - 5 AND w - 1) AS decoder_mask FROM shown GROUP BY case_id, prefix_len""",
)
def dense_decision_labels(spark, sf_dir):
    m, rows, window = labelled_windows(spark, sf_dir)
    labels = sorted({r["label"] for r in m.edges.select(F.col("target").alias("label")).distinct().collect()})
    dense = dense_labels(
        rows, labels, window, lambda row: F.array_join(F.transform(row, lambda p: F.round(p * 1e6).cast("long").cast("string")), ",")
    )
    text = F.array_join("targets", ";")
    return dense.select(
        "case_id",
        "prefix_len",
        F.md5(text).alias("targets"),
        F.array_join("mask", "").alias("mask"),
        F.array_join(decoder_part(F.col("mask"), window, 5), "").alias("decoder_mask"),
    )


@query(
    "true_next_activities",
    "H7",
    f"WITH {sql.ITEMS} SELECT case_id, pos, coalesce(lead(activity) OVER (PARTITION BY case_id ORDER BY pos), 'EOS') AS next_activity FROM log",
)
def true_next_activities(spark, sf_dir):
    return next_event_rows(items_log(spark, sf_dir)).select("case_id", "pos", "next_activity")


DIAGNOSTICS = """ranks AS (SELECT place, label, p, row_number() OVER (PARTITION BY place ORDER BY p DESC, label) AS r FROM prior),
  used AS (SELECT records.place, target, r, coalesce(p, 0) AS p FROM records JOIN split USING (case_id) LEFT JOIN ranks ON ranks.place = records.place AND label = target
     WHERE {where} AND target <> 'EOS' AND records.place IN (SELECT place FROM prior)),
  counts AS (SELECT place, target, count(*) AS n, count(*) FILTER (WHERE r = 1) AS t1, count(*) FILTER (WHERE r <= 3) AS t3, sum(p) AS tp FROM used GROUP BY ALL),
  diag AS (SELECT place, CAST(sum(n) AS BIGINT) AS support, sum(t1) / sum(n) AS top1_accuracy, sum(t3) / sum(n) AS top3_accuracy, sum(tp) / sum(n) AS mean_true_prob,
     max(n) / sum(n) AS majority_baseline, count(*) AS n_branches FROM counts GROUP BY place)"""
SHOW = """place, support, round(top1_accuracy, 6) AS top1_accuracy, round(top3_accuracy, 6) AS top3_accuracy, round(mean_true_prob, 6) AS mean_true_prob,
  round(majority_baseline, 6) AS majority_baseline, n_branches"""


def shown(diag):
    return diag.select(
        "place", "support", *[r6(c).alias(c) for c in ("top1_accuracy", "top3_accuracy", "mean_true_prob", "majority_baseline")], "n_branches"
    )


@query(
    "decision_place_report",
    "F1 F2 H7 H8",
    f"""WITH {sql.ORDERS}, {edges_sql(0.0)}, {PLACES}, split AS (SELECT DISTINCT case_id FROM log),
    records AS (SELECT case_id, 'p_' || activity AS place, coalesce(lead(activity) OVER (PARTITION BY case_id ORDER BY pos), 'EOS') AS target FROM log WHERE activity IN (SELECT source FROM dplaces)),
    prior AS (SELECT place, target AS label, count(*) / sum(count(*)) OVER (PARTITION BY place) AS p FROM records GROUP BY place, target),
    {DIAGNOSTICS.format(where='TRUE')} SELECT {SHOW} FROM diag""",
)
def decision_place_report(spark, sf_dir):
    """One pass over the ordered log: count next steps per activity, then judge the usual one."""
    log = orders_flow(spark, sf_dir)
    nexts = next_event_rows(log).events
    counts = nexts.groupBy(
        F.concat(F.lit("p_"), "activity").alias("place"), F.col("next_activity").alias("target")
    ).agg(F.count(F.lit(1)).alias("support"))
    from pyspark.sql import Window

    place = Window.partitionBy("place")
    usual = F.row_number().over(place.orderBy(F.desc("support"), "target"))
    ranked = (
        counts.withColumn("branches", F.count(F.lit(1)).over(place))
        .where("branches > 1")
        .withColumn("p", F.col("support") / F.sum("support").over(place))
        .withColumn("rank", usual)
        .where("target <> 'EOS'")
    )
    total = F.sum("support")
    diag = ranked.groupBy("place").agg(
        total.alias("support"),
        (F.sum(F.when(F.col("rank") == 1, F.col("support")).otherwise(0)) / total).alias("top1_accuracy"),
        (F.sum(F.when(F.col("rank") <= 3, F.col("support")).otherwise(0)) / total).alias("top3_accuracy"),
        (F.sum(F.col("p") * F.col("support")) / total).alias("mean_true_prob"),
        (F.max("support") / total).alias("majority_baseline"),
        F.count(F.lit(1)).alias("n_branches"),
    )
    return shown(diag)


@query(
    "held_out_place_diagnostics",
    "H8",
    f"WITH {sql.ORDERS}, {TRAINED}, {PRIORS}, " + DIAGNOSTICS.format(where="split = 'test'") + f" SELECT {SHOW} FROM diag",
)
def held_out_place_diagnostics(spark, sf_dir):
    m = mined_priors(spark, sf_dir)
    return shown(place_diagnostics(with_z(m.records.where("split = 'test'"), m.z)))


@query(
    "weighted_decision_accuracy",
    "H9",
    f"WITH {sql.ORDERS}, {TRAINED}, {PRIORS}, "
    + DIAGNOSTICS.format(where="split = 'test'")
    + " SELECT round(sum(top1_accuracy * support) / sum(support), 6) AS weighted_top1, round(sum(top3_accuracy * support) / sum(support), 6) AS weighted_top3, CAST(sum(support) AS BIGINT) AS total_support FROM diag",
)
def weighted_decision_accuracy(spark, sf_dir):
    m = mined_priors(spark, sf_dir)
    diag = place_diagnostics(with_z(m.records.where("split = 'test'"), m.z))
    return weighted_accuracy(diag).select(r6("weighted_top1").alias("weighted_top1"), r6("weighted_top3").alias("weighted_top3"), "total_support")


def _log_sql(name: str, body: str) -> str:
    return (
        f"SELECT '{name}' AS log, * FROM (WITH {body}, {TRAINED}, {PRIORS}, " + DIAGNOSTICS.format(where="split = 'test'") + " SELECT * FROM diag)"
    )


SUMMARY = (
    "WITH alldiag AS ("
    + " UNION ALL ".join(_log_sql(n, b) for n, b in (("orders", sql.ORDERS), ("turns", sql.TURNS), ("events", sql.EVENTS)))
    + "), flagged AS (SELECT *, n_branches >= 2 AND support >= 5 AND round(top1_accuracy - majority_baseline, 4) > 0.05 AS informative FROM alldiag)"
)


def flagged_logs(spark, sf_dir):
    out = None
    for name, make in (("orders", orders_log), ("turns", turns_log), ("events", events_log)):
        m = mined_priors(spark, sf_dir, make)
        diag = place_diagnostics(with_z(m.records.where("split = 'test'"), m.z))
        part = flag_informative(diag).withColumn("log", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "log_decision_summary",
    "H10",
    SUMMARY
    + """ SELECT log, count(*) AS n_places, count(*) FILTER (WHERE informative) AS n_informative,
    round(100.0 * sum(CASE WHEN informative THEN support ELSE 0 END) / sum(support), 1) AS informative_support_pct,
    round(sum(top1_accuracy * support) / sum(support), 4) AS weighted_top1, round(sum(top3_accuracy * support) / sum(support), 4) AS weighted_top3,
    CAST(sum(support) AS BIGINT) AS total_support FROM flagged GROUP BY log""",
)
def log_decision_summary(spark, sf_dir):
    return summarise_logs(flagged_logs(spark, sf_dir))


@query(
    "label_coverage",
    "H11",
    f"""WITH {sql.ORDERS}, {TRAINED}, {PRIORS}, {ZTEXT}, {LABELLED}, {WINDOWED}
    SELECT CAST(sum(len(list_filter(places, lambda x: x IS NOT NULL))) AS BIGINT) AS labelled, CAST(sum(w) AS BIGINT) AS positions,
      round(sum(len(list_filter(places, lambda x: x IS NOT NULL))) / sum(w), 6) AS coverage FROM cuts""",
)
def coverage(spark, sf_dir):
    m, rows, window = labelled_windows(spark, sf_dir)
    return label_coverage(dense_labels(rows, [], window)).withColumn("coverage", r6("coverage"))
