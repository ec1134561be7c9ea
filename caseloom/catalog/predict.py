"""Suffix prediction, plain and guided."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.catalog import sql
from caseloom.catalog.flow import DECISIONS, PLACES, edges_sql
from caseloom.catalog.mining import DATA_GUARDS, PRIORS, STATE, TRAINED, as_guards, data_guards, planted_models
from caseloom.catalog.registry import i64, joined, query, r6, r6up
from caseloom.catalog.shared import dist_text, mined_priors
from caseloom.functions.distributions import Guidance, is_conflict, reweight, supported
from caseloom.operators.cases import next_event_rows, only_split, prefix_suffix_pairs, split_cases, window_size, with_split
from caseloom.operators.features import since_case_start
from caseloom.operators.flow import align, decision_context, decisions, directly_follows, net_from_edges
from caseloom.operators.guide import (
    attribute_checks,
    best_guards,
    conditioned_branches,
    distinct_prefixes,
    explain,
    fixed_decisions,
    guided_beams,
    guided_mode,
    guided_samples,
    reasoning_counters,
    reasoning_steps,
    state_decisions,
    with_recent,
)
from caseloom.operators.ordering import join_cases, settle
from caseloom.operators.mine import distributions, feature_state, guards, prior_guards, priors, scorer
from caseloom.operators.predict import (
    attach_state,
    attribute_model,
    category_model,
    collect_samples,
    count_model,
    decode_beam,
    decode_greedy,
    decode_samples,
    next_distribution,
    roll_attributes,
    roll_state,
    sample_category,
    sample_number,
    start_state_features,
    with_limit,
)
from caseloom.session import cut, scratch_path, settled, small
from caseloom.sources.logs import orders_log, turns_log
from caseloom.sources.reader import read_table, write_table

MIN_SUFFIX = 5
SUPPORT = 5
SAMPLES = 100


def prepared(spark, sf_dir, make=orders_log, extra=()):
    """Model from the training cases; limited prefixes of the test cases."""
    log = make(spark, sf_dir)
    log = settle(with_split(log, split_cases(log.events)))
    train, test = only_split(log, "train"), only_split(log, "test")
    window = window_size(train, MIN_SUFFIX)
    model = count_model(train, 2, SUPPORT)
    pairs = with_limit(prefix_suffix_pairs(test, window, MIN_SUFFIX, extra), window, MIN_SUFFIX)
    return log, train, model, pairs, window - MIN_SUFFIX


MODEL = f"""nx AS (SELECT log.case_id, pos, activity, lag(activity) OVER (PARTITION BY case_id ORDER BY pos) AS prev,
     coalesce(lead(activity) OVER (PARTITION BY case_id ORDER BY pos), 'EOS') AS nxt FROM log JOIN split USING (case_id) WHERE split = 'train'),
  obs AS (SELECT '' AS ctx, nxt FROM nx UNION ALL SELECT activity, nxt FROM nx UNION ALL SELECT prev || chr(31) || activity, nxt FROM nx WHERE prev IS NOT NULL),
  cnt AS (SELECT ctx, nxt AS label, count(*) AS n FROM obs GROUP BY ALL),
  sup AS (SELECT *, sum(n) OVER (PARTITION BY ctx) AS total FROM cnt),
  mdl0 AS (SELECT ctx, label, n / total AS p, sum(n) OVER (PARTITION BY ctx ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) / total AS cum,
     row_number() OVER (PARTITION BY ctx ORDER BY n DESC, label) AS r FROM sup WHERE total >= {SUPPORT} OR ctx = ''),
  states AS (SELECT DISTINCT ctx FROM mdl0),
  mdl AS MATERIALIZED (SELECT m.*, CASE WHEN label = 'EOS' THEN NULL WHEN s2.ctx IS NOT NULL THEN s2.ctx WHEN s1.ctx IS NOT NULL THEN s1.ctx ELSE '' END AS next_ctx
     FROM mdl0 m LEFT JOIN states s2 ON m.ctx <> '' AND s2.ctx = split_part(m.ctx, chr(31), -1) || chr(31) || label LEFT JOIN states s1 ON s1.ctx = label)"""
TESTED = f"""tlog AS (SELECT log.* FROM log JOIN split USING (case_id) WHERE split = 'test'),
  win AS (SELECT CAST(round_even(quantile_cont(n + 5, 0.985), 0) AS BIGINT) + 5 AS w FROM log JOIN split USING (case_id) WHERE pos = 1 AND split = 'train'),
  whole AS (SELECT case_id, list(activity ORDER BY pos) AS acts FROM tlog, win WHERE pos > n - (w - 5) GROUP BY case_id),
  pairs AS (SELECT case_id, CAST(k AS BIGINT) AS prefix_len, acts[1:k] AS prefix, acts[k+1:] AS target_suffix, w - 5 - k + 1 AS lim FROM whole, win, unnest(range(1, len(acts))) AS t(k)),
  starts AS MATERIALIZED (SELECT p.*, coalesce(s2.ctx, s1.ctx, '') AS ctx FROM pairs p LEFT JOIN states s2 ON len(prefix) >= 2 AND s2.ctx = prefix[-2] || chr(31) || prefix[-1] LEFT JOIN states s1 ON s1.ctx = prefix[-1])"""
BASE = f"{sql.SPLIT}, {MODEL}, {TESTED}"
GREEDY = """walk(case_id, prefix_len, lim, k, path, ctx, done) AS (
   SELECT case_id, prefix_len, lim, 0, []::VARCHAR[], ctx, false FROM starts
   UNION ALL SELECT w.case_id, w.prefix_len, w.lim, w.k + 1, CASE WHEN m.label = 'EOS' THEN w.path ELSE list_append(w.path, m.label) END, m.next_ctx, m.label = 'EOS'
   FROM walk w JOIN mdl m ON m.ctx = w.ctx AND m.r = 1 WHERE NOT w.done AND w.k < w.lim),
 greedy AS (SELECT case_id, prefix_len, arg_max(path, k) AS path FROM walk GROUP BY case_id, prefix_len)"""


@query(
    "next_activity_distribution",
    "J1",
    f"""WITH {sql.ORDERS}, {BASE}, txt AS (SELECT ctx, string_agg(label || '=' || CAST(CAST(round(p * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY label) AS p FROM mdl GROUP BY ctx)
    SELECT case_id, prefix_len, p FROM starts JOIN txt USING (ctx)""",
)
def next_activity_distribution(spark, sf_dir):
    _, _, model, pairs, _ = prepared(spark, sf_dir)
    rows = next_distribution(attach_state(pairs, model, F.col("prefix")), model)
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), dist_text("p").alias("p"))


GREEDY_SQL = "WITH RECURSIVE {log}, " + BASE + ", " + GREEDY + f" SELECT case_id, prefix_len, {sql.arrow('path')} AS suffix FROM greedy"


def greedy_rows(spark, sf_dir, make):
    _, _, model, pairs, steps = prepared(spark, sf_dir, make)
    rows = decode_greedy(pairs, model, steps)
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), joined(F.get("decoded_suffixes", F.lit(0))).alias("suffix"))


@query("argmax_suffixes", "J2 J20", GREEDY_SQL.format(log=sql.ORDERS))
def argmax_suffixes(spark, sf_dir):
    return greedy_rows(spark, sf_dir, orders_log)


@query("turn_argmax_suffixes", "J2 J20", GREEDY_SQL.format(log=sql.TURNS))
def turn_argmax_suffixes(spark, sf_dir):
    return greedy_rows(spark, sf_dir, turns_log)


BEAM = """beam(case_id, prefix_len, lim, k, seq, score, ctx, done) AS (
   SELECT case_id, prefix_len, lim, 0, []::VARCHAR[], 0.0::DOUBLE, ctx, false FROM starts
   UNION ALL SELECT case_id, prefix_len, lim, k, seq, score, ctx, done FROM (
     SELECT *, row_number() OVER (PARTITION BY case_id, prefix_len ORDER BY round(score, 9) DESC, array_to_string(seq, chr(31))) AS rn FROM (
       SELECT b.case_id, b.prefix_len, b.lim, b.k + 1 AS k, CASE WHEN b.done THEN b.seq ELSE list_append(b.seq, m.label) END AS seq,
         CASE WHEN b.done THEN b.score ELSE b.score + ln(m.p) END AS score, CASE WHEN b.done THEN b.ctx ELSE coalesce(m.next_ctx, '') END AS ctx, b.done OR m.label = 'EOS' AS done
       FROM beam b LEFT JOIN mdl m ON NOT b.done AND m.ctx = b.ctx AND m.r <= 3 WHERE b.k < b.lim)) WHERE rn <= 3),
 beams AS (SELECT *, row_number() OVER (PARTITION BY case_id, prefix_len ORDER BY round(score, 9) DESC, array_to_string(seq, chr(31))) AS beam FROM beam WHERE k = lim)"""


@query(
    "beam_suffixes",
    "J3 J20",
    f"WITH RECURSIVE {sql.ORDERS}, {BASE}, {BEAM} SELECT case_id, prefix_len, beam, {sql.arrow(chr(39).join(['list_filter(seq, lambda x: x <> ', 'EOS', ')']))} AS suffix, round(score, 6) AS score FROM beams",
)
def beam_suffixes(spark, sf_dir):
    _, _, model, pairs, steps = prepared(spark, sf_dir)
    rows = decode_beam(pairs, model, steps, 3)
    zipped = F.arrays_zip("decoded_suffixes", "scores")
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), F.posexplode(zipped).alias("no", "b")).select(
        "case_id", "prefix_len", i64(F.col("no") + 1).alias("beam"), joined("b.decoded_suffixes").alias("suffix"), r6("b.scores").alias("score")
    )


def uniform_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


DRAWS = f"""draws(case_id, prefix_len, lim, sample, k, path, ctx, done) AS (
   SELECT case_id, prefix_len, lim, s, 0, []::VARCHAR[], ctx, false FROM starts, unnest(range(1, {SAMPLES} + 1)) AS t(s)
   UNION ALL SELECT case_id, prefix_len, lim, sample, k + 1, CASE WHEN label = 'EOS' THEN path ELSE list_append(path, label) END, next_ctx, label = 'EOS' FROM (
     SELECT d.*, m.label, m.next_ctx, row_number() OVER (PARTITION BY d.case_id, d.prefix_len, d.sample ORDER BY m.r) AS rn
     FROM draws d JOIN mdl m ON m.ctx = d.ctx AND m.cum > {uniform_sql("d.case_id || '|' || d.prefix_len || '|' || d.sample || '|' || d.k || '|17'")}
     WHERE NOT d.done AND d.k < d.lim) WHERE rn = 1),
 sampled AS (SELECT case_id, prefix_len, sample, arg_max(path, k) AS path FROM draws GROUP BY ALL)"""


@query(
    "sampled_suffixes",
    "J4 J20",
    f"WITH RECURSIVE {sql.ORDERS}, {BASE}, {DRAWS} SELECT case_id, prefix_len, sample, {sql.arrow('path')} AS suffix FROM sampled",
)
def sampled_suffixes(spark, sf_dir):
    _, _, model, pairs, steps = prepared(spark, sf_dir)
    rows = decode_samples(pairs, model, steps, SAMPLES)
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), i64("sample").alias("sample"), joined("suffix").alias("suffix"))


@query(
    "sampled_next_attributes",
    "J5",
    f"""WITH {sql.ORDERS}, {sql.SPLIT}, train AS (SELECT log.* FROM log JOIN split USING (case_id) WHERE split = 'train'),
    a AS (SELECT activity, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM train GROUP BY activity),
    d AS (SELECT case_id, pos, mean, std, {uniform_sql("case_id || '|' || pos || '|u1'")} AS u1, {uniform_sql("case_id || '|' || pos || '|u2'")} AS u2 FROM log JOIN a USING (activity))
    SELECT case_id, pos, round(mean + std * sqrt(-2 * ln(greatest(u1, 1e-12))) * cos(2 * pi() * u2), 4) AS price FROM d""",
)
def sampled_next_attributes(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    train = only_split(with_split(log, split_cases(log.events)), "train")
    attributes = attribute_model(train, [], ["o_totalprice"])
    rows = log.events.join(small(attributes), "activity")
    price = sample_number(F.col("o_totalprice__mean"), F.col("o_totalprice__std"), [F.col("case_id"), F.col("pos")])
    return rows.select("case_id", "pos", F.round(price, 4).alias("price"))


OPTIONS = """cnt AS (SELECT activity, o_orderstatus AS v, count(*) AS n FROM train WHERE o_orderstatus IS NOT NULL GROUP BY ALL),
    share AS (SELECT *, n / sum(n) OVER (PARTITION BY activity) AS share FROM cnt),
    opt AS (SELECT activity, v, ln(share) AS logit, greatest(-6.0, least(6.0, ln(greatest((1 - share) / n, 1e-12)))) AS logvar FROM share)"""


@query(
    "sampled_categories",
    "J5",
    f"""WITH {sql.ORDERS}, {sql.SPLIT}, train AS (SELECT log.* FROM log JOIN split USING (case_id) WHERE split = 'train'), {OPTIONS},
    d AS (SELECT case_id, pos, v, logit, exp(0.5 * logvar) * sqrt(-2 * ln(greatest({uniform_sql("case_id || '|' || pos || '|' || v || '|n1'")}, 1e-12)))
        * cos(2 * pi() * {uniform_sql("case_id || '|' || pos || '|' || v || '|n2'")}) AS noise,
      -ln(-ln(greatest({uniform_sql("case_id || '|' || pos || '|' || v || '|g'")}, 1e-12))) AS gumbel FROM log JOIN opt USING (activity))
    SELECT case_id, pos, arg_max(v, {{'s': round(logit + gumbel, 9), 'v': v}}) AS drawn, arg_max(v, {{'s': round(logit + noise + gumbel, 9), 'v': v}}) AS drawn_with_noise,
      arg_max(v, {{'s': round(logit + noise, 9), 'v': v}}) AS best_with_noise, arg_max(v, {{'s': round(logit, 9), 'v': v}}) AS best FROM d GROUP BY case_id, pos""",
)
def sampled_categories(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    train = only_split(with_split(log, split_cases(log.events)), "train")
    rows = log.events.join(small(category_model(train, "o_orderstatus")), "activity")
    keys = [F.col("case_id"), F.col("pos")]
    return rows.select(
        "case_id", "pos", sample_category(F.col("options"), keys).alias("drawn"), sample_category(F.col("options"), keys, noise=True).alias("drawn_with_noise"),
        sample_category(F.col("options"), keys, noise=True, best=True).alias("best_with_noise"), sample_category(F.col("options"), keys, best=True).alias("best"),
    )


@query(
    "rolled_attributes",
    "J6 J7",
    f"""WITH RECURSIVE {sql.ORDERS}, {BASE}, {GREEDY}, timed AS (SELECT *, (us - min(us) OVER (PARTITION BY case_id)) / 1e6 AS elapsed FROM log),
    ttrain AS (SELECT timed.* FROM timed JOIN split USING (case_id) WHERE split = 'train'),
    a AS (SELECT activity, avg(o_totalprice) AS price, avg(elapsed) AS el FROM ttrain GROUP BY activity),
    c AS (SELECT activity, o_orderstatus, row_number() OVER (PARTITION BY activity ORDER BY count(*) DESC, o_orderstatus) AS r FROM ttrain GROUP BY activity, o_orderstatus),
    lastrow AS (SELECT g.case_id, g.prefix_len, g.path[1] AS nxt, t.o_orderstatus, t.o_totalprice, t.elapsed FROM greedy g, win, timed t WHERE t.case_id = g.case_id AND t.pos = g.prefix_len + greatest(0, t.n - (w - 5)))
    SELECT case_id, prefix_len, nxt AS next_activity, coalesce(c.o_orderstatus, l.o_orderstatus) AS o_orderstatus, round(coalesce(a.price, l.o_totalprice), 4) AS o_totalprice,
      round(greatest(coalesce(a.el, elapsed), elapsed), 4) AS case_elapsed_time FROM lastrow l LEFT JOIN a ON a.activity = nxt LEFT JOIN c ON c.activity = nxt AND c.r = 1""",
)
def rolled_attributes(spark, sf_dir):
    make = lambda s, d: since_case_start(orders_log(s, d))
    cats, nums = ["o_orderstatus"], ["o_totalprice", "case_elapsed_time"]
    _, train, model, pairs, steps = prepared(spark, sf_dir, make, [*cats, *nums])
    rows = decode_greedy(pairs, model, steps).withColumn("next_activity", F.get(F.get("decoded_suffixes", F.lit(0)), F.lit(0)))
    rows = rows.withColumns({c: F.element_at(c, -1) for c in [*cats, *nums]})
    rolled = roll_attributes(rows, small(attribute_model(train, cats, nums)), cats, nums, F.col("next_activity"), ["case_elapsed_time"])
    return rolled.select(
        "case_id", i64("prefix_len").alias("prefix_len"), "next_activity", "o_orderstatus",
        F.round("o_totalprice", 4).alias("o_totalprice"), F.round("case_elapsed_time", 4).alias("case_elapsed_time"),
    )


@query(
    "rolled_data_state",
    "J8",
    f"""WITH RECURSIVE {sql.ORDERS}, {BASE}, {GREEDY}, ttrain AS (SELECT log.* FROM log JOIN split USING (case_id) WHERE split = 'train'),
    a AS (SELECT activity, avg(o_totalprice) AS price FROM ttrain GROUP BY activity),
    seen AS (SELECT case_id, list(o_totalprice ORDER BY pos) AS prices, list(o_orderstatus ORDER BY pos) AS st FROM tlog, win WHERE pos > n - (w - 5) GROUP BY case_id),
    st AS (SELECT g.case_id, g.prefix_len, g.path[1] AS nxt, prices[1:g.prefix_len] AS before, st[1:g.prefix_len] AS h FROM greedy g JOIN seen USING (case_id))
    SELECT case_id, prefix_len, round(coalesce(a.price, before[-1]), 4) AS o_totalprice,
      round((CASE WHEN nxt IS NULL THEN CASE WHEN prefix_len > 1 THEN list_avg(before[1:prefix_len - 1]) ELSE before[-1] END ELSE list_avg(before) END) + 1e-9, 6) AS past_avg,
      CASE WHEN nxt IS NULL AND prefix_len = 1 THEN h[1] ELSE list_sort(list_transform(list_distinct(hh), lambda x: {{'c': -len(list_filter(hh, lambda y: y = x)), 'f': list_position(hh, x), 'v': x}}))[1].v END AS past_mode
    FROM (SELECT *, CASE WHEN nxt IS NULL THEN h[1:prefix_len - 1] ELSE h END AS hh FROM st) LEFT JOIN a ON a.activity = nxt""",
)
def rolled_data_state(spark, sf_dir):
    cats, nums = ["o_orderstatus"], ["o_totalprice"]
    _, train, model, pairs, steps = prepared(spark, sf_dir, extra=[*cats, *nums])
    rows = decode_greedy(pairs, model, steps).withColumn("next_activity", F.get(F.get("decoded_suffixes", F.lit(0)), F.lit(0)))
    state = start_state_features(rows, cats, nums)
    attributes = small(attribute_model(train, cats, nums))
    rolled = roll_state(state, attributes, cats, nums, F.col("next_activity").isNotNull(), F.col("next_activity"))
    return rolled.select(
        "case_id", i64("prefix_len").alias("prefix_len"), F.round("o_totalprice", 4).alias("o_totalprice"),
        r6up("o_totalprice_past_avg").alias("past_avg"), F.col("o_orderstatus_past_mode").alias("past_mode"),
    )


@query("stored_decoded_rows", "A8", GREEDY_SQL.format(log=sql.ORDERS))
def stored_decoded_rows(spark, sf_dir):
    _, _, model, pairs, steps = prepared(spark, sf_dir)
    rows = decode_greedy(pairs, model, steps)
    back = read_table(spark, write_table(rows, scratch_path(spark, "decoded")), rows.schema)
    return back.select("case_id", i64("prefix_len").alias("prefix_len"), joined(F.get("decoded_suffixes", F.lit(0))).alias("suffix"))


# --- guidance ------------------------------------------------------------------

# Five activities share the steps of the order log about evenly, so a threshold just
# under a fifth splits each branch list into supported and unsupported ones.
TAU = 0.18
CFG = Guidance(support_threshold=TAU)
GUIDED_BASE = f"{BASE}, {edges_sql(0.0, learned=True)}, {PLACES}, {DECISIONS}, {PRIORS}"
SUPPORTED = f"supp AS (SELECT place, list_sort(list(label)) AS labels FROM prior WHERE p >= {TAU} GROUP BY place)"


def guided_setup(spark, sf_dir, cfg=CFG, extra=()):
    """Limited test prefixes, model, prior decisions."""
    log, train, model, pairs, steps = prepared(spark, sf_dir, orders_log, extra)
    edges = cut(directly_follows(only_split(log, "train", "val")))
    net = net_from_edges(edges)
    split = log.events.where("pos = 1").select("case_id", "split")
    records = join_cases(decisions(align(log, edges), net), split, log.spans)
    table = priors(records.where("split = 'train'"))
    decide = fixed_decisions(decision_context(net), distributions(table), cfg)
    return model, pairs, steps, decide, table


WEIGHT = "m.p * pow(0.001 + 0.999 * coalesce(z.p, 0), 2.0 * exp(-0.1 * {k}))"


@query(
    "reweighted_distributions",
    "J9",
    f"""WITH {sql.ORDERS}, {GUIDED_BASE}, hops AS (SELECT unnest([0, 1, 5]) AS step),
    w AS (SELECT s.case_id, s.prefix_len, step, m.label, m.p, {WEIGHT.format(k="step")} AS wt FROM starts s JOIN mdl m USING (ctx), hops
       LEFT JOIN prior z ON z.place = 'p_' || s.prefix[-1] AND z.label = m.label),
    n AS (SELECT *, wt / sum(wt) OVER (PARTITION BY case_id, prefix_len, step) AS q FROM w)
    SELECT case_id, prefix_len, step, string_agg(label || '=' || CAST(CAST(round(q * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY label) AS p FROM n GROUP BY ALL""",
)
def reweighted_distributions(spark, sf_dir):
    model, pairs, _, decide, _ = guided_setup(spark, sf_dir)
    rows = next_distribution(attach_state(pairs, model, F.col("prefix")), model).withColumn("activity", F.element_at("prefix", -1))
    rows = rows.join(small(decide.context), "activity", "left")
    parts = F.array(
        *[F.struct(F.lit(s).alias("step"), reweight(F.col("p"), F.col("z"), F.lit(s), CFG).alias("q")) for s in (0, 1, 5)]
    )
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), F.inline(parts)).select(
        "case_id", "prefix_len", i64("step").alias("step"), dist_text("q").alias("p")
    )


GATED = Guidance(support_threshold=TAU, min_base_entropy=0.97, min_decision_confidence=0.19, max_guided_steps=1)


@query(
    "gated_guidance",
    "J9",
    f"""WITH {sql.ORDERS}, {GUIDED_BASE}, hops AS (SELECT unnest([0, 1, 2]) AS step), top AS (SELECT place, max(p) AS c FROM prior GROUP BY place),
    ent AS (SELECT ctx, -sum(p * ln(p)) / ln((SELECT count(*) FROM mdl WHERE ctx = '')) AS h FROM mdl GROUP BY ctx)
    SELECT s.case_id, s.prefix_len, step, CASE WHEN step <= 1 AND c >= 0.19 AND h >= 0.97 THEN 'guided' ELSE 'left alone' END AS outcome
    FROM starts s JOIN ent USING (ctx) LEFT JOIN top ON place = 'p_' || s.prefix[-1], hops""",
)
def gated_guidance(spark, sf_dir):
    model, pairs, _, decide, _ = guided_setup(spark, sf_dir)
    rows = next_distribution(attach_state(pairs, model, F.col("prefix")), model).withColumn("activity", F.element_at("prefix", -1))
    rows = rows.join(small(decide.context), "activity", "left")
    classes = F.lit(model.classes)

    def outcome(step: int):
        changed = dist_text(reweight(F.col("p"), F.col("z"), F.lit(step), GATED, classes)) != dist_text("p")
        return F.struct(F.lit(step).alias("step"), F.when(changed, "guided").otherwise("left alone").alias("outcome"))

    parts = F.array(*[outcome(s) for s in (0, 1, 2)])
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), F.inline(parts)).withColumn("step", i64("step"))


@query(
    "decision_conflicts",
    "J10",
    f"""WITH {sql.ORDERS}, {GUIDED_BASE}, {SUPPORTED}, nexts AS (SELECT case_id, pos, activity, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS nxt FROM log)
    SELECT case_id, pos, coalesce(array_to_string(labels, ','), '') AS supported, labels IS NOT NULL AND NOT list_contains(labels, nxt) AS conflict
    FROM nexts LEFT JOIN supp ON place = 'p_' || activity WHERE nxt IS NOT NULL""",
)
def decision_conflicts(spark, sf_dir):
    m = mined_priors(spark, sf_dir)
    nexts = next_event_rows(m.log).events.where("next_activity <> 'EOS'")
    z = m.z.withColumn("activity", F.expr("substring(place, 3)"))
    rows = nexts.join(small(z), "activity", "left").withColumn("support", supported(F.col("z"), TAU))
    return rows.select(
        "case_id", "pos", F.coalesce(F.array_join("support", ","), F.lit("")).alias("supported"),
        F.coalesce(is_conflict(F.col("next_activity"), F.col("support")), F.lit(False)).alias("conflict"),
    )


# what the decode of a prefix depends on where decisions depend on the place alone
ENDS = ["recent", "limit"]


def guided_walk(beta: str = "2.0") -> str:
    weight = WEIGHT.replace("2.0", beta).format(k="w.k")
    return f"""gwalk(case_id, prefix_len, lim, k, path, ctx, act, done, place, prob) AS (
   SELECT case_id, prefix_len, lim, 0, []::VARCHAR[], ctx, prefix[-1], false, NULL::VARCHAR, NULL::DOUBLE FROM starts
   UNION ALL SELECT case_id, prefix_len, lim, k + 1, CASE WHEN label = 'EOS' THEN path ELSE list_append(path, label) END, next_ctx, CASE WHEN label = 'EOS' THEN act ELSE label END, label = 'EOS',
      CASE WHEN label = 'EOS' THEN NULL ELSE at_place END, q FROM (
     SELECT *, row_number() OVER (PARTITION BY case_id, prefix_len ORDER BY round(q, 9) DESC, label) AS rn FROM (
       SELECT *, CASE WHEN at_place IS NULL THEN p0 ELSE wt / sum(wt) OVER (PARTITION BY case_id, prefix_len) END AS q FROM (
         SELECT w.case_id, w.prefix_len, w.lim, w.k, w.path, w.act, m.label, m.next_ctx, m.p AS p0, d.place AS at_place, {weight} AS wt
         FROM gwalk w JOIN mdl m ON m.ctx = w.ctx LEFT JOIN (SELECT DISTINCT place FROM prior) d ON d.place = 'p_' || w.act LEFT JOIN prior z ON z.place = 'p_' || w.act AND z.label = m.label
         WHERE NOT w.done AND w.k < w.lim))) WHERE rn = 1),
 guided AS (SELECT case_id, prefix_len, arg_max(path, k) AS path FROM gwalk GROUP BY case_id, prefix_len),
 gsteps AS (SELECT case_id, prefix_len, k - 1 AS step, gwalk.place, path[-1] AS label, prob, coalesce(NOT list_contains(labels, path[-1]), false) AS conflict, len(coalesce(labels, [])) >= 2 AS non_trivial,
     CASE WHEN coalesce(NOT list_contains(labels, path[-1]), false) THEN 'conflict_not_supported' WHEN g.p >= 0.15 THEN 'matched_trivial_rule' ELSE 'no_rule_for_branch' END AS status
   FROM gwalk LEFT JOIN supp ON supp.place = gwalk.place LEFT JOIN prior g ON g.place = gwalk.place AND g.label = path[-1] WHERE k > 0 AND gwalk.place IS NOT NULL)"""


GUIDED_SQL = f"WITH RECURSIVE {sql.ORDERS}, {GUIDED_BASE}, {SUPPORTED}, {guided_walk()}"


@query(
    "guided_argmax_suffixes",
    "J17",
    GUIDED_SQL + f" SELECT case_id, prefix_len, {sql.arrow('path')} AS suffix FROM guided",
)
def guided_argmax_suffixes(spark, sf_dir):
    model, pairs, steps, decide, _ = guided_setup(spark, sf_dir)
    rows = guided_mode(pairs, model, steps, decide)
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), joined("suffix").alias("suffix"))


@query(
    "guided_reasoning_steps",
    "J15 J17 J21",
    GUIDED_SQL + " SELECT case_id, prefix_len, step, place, label, round(prob, 6) AS prob, conflict, non_trivial, status FROM gsteps",
)
def guided_reasoning_steps(spark, sf_dir):
    model, pairs, steps, decide, table = guided_setup(spark, sf_dir)
    pairs = with_recent(pairs, model)
    rows = reasoning_steps(guided_mode(distinct_prefixes(pairs), model, steps, decide), ENDS)
    told = explain(rows, prior_guards(table), ENDS).select(
        *ENDS, i64("step").alias("step"), "place", "label", r6("model_prob").alias("prob"), "conflict", "non_trivial",
        F.col("explanation_status").alias("status"),
    )
    return pairs.select("case_id", i64("prefix_len").alias("prefix_len"), *ENDS).join(settled(told), ENDS).drop(*ENDS)


@query(
    "guided_decode_rows",
    "J16 J21",
    GUIDED_SQL
    + f""", c AS (SELECT case_id, prefix_len, count(*) AS decision_steps, count(*) FILTER (WHERE conflict) AS conflicts, count(*) FILTER (WHERE non_trivial) AS non_trivial_decision_steps,
      count(*) FILTER (WHERE status = 'matched_trivial_rule') AS matched_trivial_rule, count(*) FILTER (WHERE status = 'no_rule_for_branch') AS no_rule_for_branch FROM gsteps GROUP BY ALL)
    SELECT case_id, prefix_len, {sql.arrow('path')} AS suffix, coalesce(decision_steps, 0) AS decision_steps, coalesce(conflicts, 0) AS conflicts, round(coalesce(conflicts / decision_steps, 0), 6) AS conflict_rate,
      coalesce(non_trivial_decision_steps, 0) AS non_trivial_decision_steps, coalesce(matched_trivial_rule, 0) AS matched_trivial_rule, coalesce(no_rule_for_branch, 0) AS no_rule_for_branch
    FROM guided LEFT JOIN c USING (case_id, prefix_len)""",
)
def guided_decode_rows(spark, sf_dir):
    model, pairs, steps, decide, table = guided_setup(spark, sf_dir)
    pairs = with_recent(pairs, model)
    rows = cut(guided_mode(distinct_prefixes(pairs), model, steps, decide))
    told = explain(reasoning_steps(rows, ENDS), prior_guards(table), ENDS)
    counters = reasoning_counters(told, ENDS)
    names = ["decision_steps", "conflicts", "non_trivial_decision_steps", "matched_trivial_rule", "no_rule_for_branch"]
    both = rows.join(counters, ENDS, "left").select(
        *ENDS, joined("suffix").alias("suffix"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in names], r6(F.coalesce("conflict_rate", F.lit(0.0))).alias("conflict_rate"),
    )
    return pairs.select("case_id", i64("prefix_len").alias("prefix_len"), *ENDS).join(settled(both), ENDS).drop(*ENDS)


GUIDED_BEAM = f"""gbeam(case_id, prefix_len, lim, k, seq, score, ctx, act, done) AS (
   SELECT case_id, prefix_len, lim, 0, []::VARCHAR[], 0.0::DOUBLE, ctx, prefix[-1], false FROM starts
   UNION ALL SELECT case_id, prefix_len, lim, k, seq, score, ctx, act, done FROM (
     SELECT *, row_number() OVER (PARTITION BY case_id, prefix_len ORDER BY round(score, 9) DESC, array_to_string(seq, chr(31))) AS rn FROM (
       SELECT case_id, prefix_len, lim, k + 1 AS k, CASE WHEN was THEN seq ELSE list_append(seq, label) END AS seq, CASE WHEN was THEN score ELSE score + ln(q + 1e-12) END AS score,
         CASE WHEN was THEN ctx ELSE coalesce(next_ctx, '') END AS ctx, CASE WHEN was OR label = 'EOS' THEN act ELSE label END AS act, was OR label = 'EOS' AS done FROM (
         SELECT *, row_number() OVER (PARTITION BY case_id, prefix_len, seq ORDER BY round(q, 9) DESC, label) AS option FROM (
           SELECT *, CASE WHEN was THEN 1 ELSE wt / sum(wt) OVER (PARTITION BY case_id, prefix_len, seq) END AS q FROM (
             SELECT b.case_id, b.prefix_len, b.lim, b.k, b.seq, b.score, b.ctx, b.act, b.done AS was, m.label, m.next_ctx, {WEIGHT.format(k='b.k')} AS wt
             FROM gbeam b LEFT JOIN mdl m ON NOT b.done AND m.ctx = b.ctx LEFT JOIN prior z ON z.place = 'p_' || b.act AND z.label = m.label WHERE b.k < b.lim))) WHERE was OR option <= 3)) WHERE rn <= 3),
 gbeams AS (SELECT *, row_number() OVER (PARTITION BY case_id, prefix_len ORDER BY round(score, 9) DESC, array_to_string(seq, chr(31))) AS beam FROM gbeam WHERE k = lim)"""


@query(
    "guided_beam_suffixes",
    "J19",
    f"WITH RECURSIVE {sql.ORDERS}, {GUIDED_BASE}, {GUIDED_BEAM} SELECT case_id, prefix_len, beam, {sql.arrow(chr(39).join(['list_filter(seq, lambda x: x <> ', 'EOS', ')']))} AS suffix, round(score, 6) AS score FROM gbeams",
)
def guided_beam_suffixes(spark, sf_dir):
    model, pairs, steps, decide, _ = guided_setup(spark, sf_dir)
    rows = guided_beams(pairs, model, steps, decide, 3)
    return rows.select(
        "case_id", i64("prefix_len").alias("prefix_len"), i64("beam").alias("beam"), joined("suffix").alias("suffix"), r6("score").alias("score")
    )


@query("guided_samples", "J18")
def guided_sampled_suffixes(spark, sf_dir):
    model, pairs, steps, decide, _ = guided_setup(spark, sf_dir)
    rows = guided_samples(pairs, model, steps, decide, SAMPLES)
    return rows.select("case_id", i64("prefix_len").alias("prefix_len"), "sample", joined("suffix").alias("suffix"), F.size("trace").alias("decision_steps"))


# --- rules against observed states -------------------------------------------------

OBSERVED = f"""{DATA_GUARDS}, {STATE}, obs_state AS (SELECT nexts.case_id, nexts.pos, 'p_' || activity AS place, next_activity AS label, state.o_orderstatus, state.o_totalprice, past_avg, c_nationkey, c_mktsegment
     FROM nexts JOIN state USING (case_id, pos) WHERE next_activity IS NOT NULL),
  matched AS (SELECT o.*, dg.*, dg.place IS NOT NULL AS has_guard,
      coalesce(o_totalprice > low AND past_avg <= high AND list_contains(statuses, o_orderstatus) AND list_contains(nations, c_nationkey) AND (c_mktsegment IS NULL OR c_mktsegment <> segment), false) AS hit_a,
      coalesce(past_avg <= low AND (c_mktsegment IS NULL OR c_mktsegment <> segment), false) AS hit_b FROM obs_state o LEFT JOIN dg USING (place, label))"""


def observed_steps(spark, sf_dir, log=None):
    """Observed decisions with their data state, and two rules per branch read off the data."""
    log = log or orders_log(spark, sf_dir)
    first = as_guards(data_guards(log))
    double = "map<string,struct<low:double,high:double>>"
    narrow = F.transform_values(
        F.map_filter("intervals", lambda k, _: k == "o_totalprice"),
        lambda _, v: F.struct(F.lit(None).cast("double").alias("low"), v["low"].alias("high")),
    )
    second = first.withColumn("intervals", F.create_map(F.lit("o_totalprice_past_avg"), narrow["o_totalprice"]).cast(double)).withColumn(
        "allowed", F.create_map().cast("map<string,array<string>>")
    )
    rules = first.withColumn("raw_rule", F.lit("A")).withColumn("score", F.col("support") * 1.0).unionByName(
        second.withColumn("raw_rule", F.lit("B")).withColumn("score", F.col("support") * 0.5)
    )
    rules = rules.withColumn("rule", F.col("raw_rule")).withColumn("prob_model", F.lit(0.5))
    state = feature_state(next_event_rows(log), ["o_orderstatus"], ["o_totalprice"], []).events.where("next_activity <> 'EOS'")
    steps = state.select(
        "case_id", "pos", F.concat(F.lit("p_"), "activity").alias("place"), F.col("next_activity").alias("label"),
        F.create_map(F.lit("o_totalprice"), "o_totalprice", F.lit("o_totalprice_past_avg"), "o_totalprice_past_avg").alias("nums"),
        F.create_map(F.lit("o_orderstatus"), "o_orderstatus", F.lit("c_nationkey"), "c_nationkey", F.lit("c_mktsegment"), "c_mktsegment").alias("cats"),
    )
    return steps, rules


@query(
    "best_matching_guards",
    "J11 J12 J13",
    f"""WITH {sql.ORDERS}, {OBSERVED} SELECT case_id, pos, true AS branch_has_rule, CASE WHEN hit_a THEN 'A' WHEN hit_b THEN 'B' END AS guard FROM matched""",
)
def best_matching_guards(spark, sf_dir):
    steps, rules = observed_steps(spark, sf_dir)
    best = best_guards(steps, rules, ["case_id", "pos"])
    branch = small(conditioned_branches(rules).withColumn("branch_has_rule", F.lit(True)))
    out = steps.join(best, ["case_id", "pos"], "left").join(branch, ["place", "label"], "left")
    return out.select("case_id", "pos", F.coalesce("branch_has_rule", F.lit(False)).alias("branch_has_rule"), F.col("guard.raw_rule").alias("guard"))


@query(
    "attribute_checks",
    "J14",
    f"""WITH {sql.ORDERS}, {OBSERVED}, a AS (SELECT * FROM matched WHERE hit_a OR NOT hit_b)
    SELECT case_id, pos, 'o_totalprice' AS attr, round(o_totalprice, 6) AS value, NULL AS text, o_totalprice > low AS in_rule_set, 'interval' AS rule_type, '(' || low || ', ]' AS bound FROM a
    UNION ALL SELECT case_id, pos, 'o_totalprice_past_avg', round(past_avg + 1e-9, 6), NULL, past_avg <= high, 'interval', '(, ' || high || ']' FROM a
    UNION ALL SELECT case_id, pos, 'o_orderstatus', NULL, o_orderstatus, list_contains(statuses, o_orderstatus), 'categorical_allowed', array_to_string(statuses, ', ') FROM a
    UNION ALL SELECT case_id, pos, 'c_nationkey', NULL, c_nationkey, coalesce(list_contains(nations, c_nationkey), false), 'categorical_allowed', array_to_string(nations, ', ') FROM a
    UNION ALL SELECT case_id, pos, 'c_mktsegment', NULL, c_mktsegment, c_mktsegment IS NULL OR c_mktsegment <> segment, 'categorical_excluded', segment FROM a""",
)
def checks(spark, sf_dir):
    steps, rules = observed_steps(spark, sf_dir)
    best = best_guards(steps, rules, ["case_id", "pos"]).where("guard.raw_rule = 'B'")
    wide = steps.join(best, ["case_id", "pos"], "left_anti").join(small(rules.where("raw_rule = 'A'")), ["place", "label"])
    out = wide.select(
        "case_id", "pos", "nums", F.explode(attribute_checks(*[F.col(c) for c in ("nums", "cats", "intervals", "allowed", "excluded")])).alias("c")
    )
    number = F.col("c.rule_type") == "interval"
    return out.select(
        "case_id", "pos", F.col("c.attr").alias("attr"),
        F.when(F.col("c.attr") == "o_totalprice", r6(F.col("nums")["o_totalprice"])).when(number, r6up(F.col("nums")[F.col("c.attr")])).alias("value"),
        F.when(~number, F.col("c.value")).alias("text"), F.col("c.in_rule_set").alias("in_rule_set"), F.col("c.rule_type").alias("rule_type"), F.col("c.bound").alias("bound"),
    )


OBSERVED_STATUS = f"""{TRAINED}, {PRIORS}, {SUPPORTED}, {OBSERVED}, told AS (SELECT case_id, pos, m.place, m.label, coalesce(NOT list_contains(labels, m.label), false) AS conflict, len(coalesce(labels, [])) >= 2 AS non_trivial,
     hit_a OR hit_b AS hit FROM matched m LEFT JOIN supp ON supp.place = m.place),
  status AS (SELECT *, NOT conflict AND hit AS explained, CASE WHEN conflict THEN 'conflict_not_supported' WHEN hit THEN 'explained' ELSE 'rule_unmatched' END AS status FROM told)"""


def observed_reasoning(spark, sf_dir):
    m = mined_priors(spark, sf_dir)
    steps, rules = observed_steps(spark, sf_dir, m.log)
    z = m.z
    rows = steps.join(small(z), "place", "left").withColumn("supported", supported(F.col("z"), TAU))
    rows = rows.withColumns(
        {
            "conflict": F.coalesce(is_conflict(F.col("label"), F.col("supported")), F.lit(False)),
            "non_trivial": F.coalesce(F.size("supported") >= 2, F.lit(False)),
        }
    )
    return explain(rows, rules, ["case_id", "pos"])


@query(
    "observed_reasoning",
    "J15",
    f"WITH {sql.ORDERS}, {OBSERVED_STATUS} SELECT case_id, pos, place, label, conflict, non_trivial, explained, status FROM status",
)
def observed_reasoning_rows(spark, sf_dir):
    return observed_reasoning(spark, sf_dir).select(
        "case_id", "pos", "place", "label", "conflict", "non_trivial", "explained", F.col("explanation_status").alias("status")
    )


@query(
    "reasoning_counters",
    "J16",
    f"""WITH {sql.ORDERS}, {OBSERVED_STATUS} SELECT case_id, count(*) AS decision_steps, count(*) FILTER (WHERE conflict) AS conflicts, count(*) FILTER (WHERE explained) AS explained_steps,
      count(*) FILTER (WHERE NOT conflict) AS explainable_decision_steps, count(*) FILTER (WHERE non_trivial) AS non_trivial_decision_steps, count(*) FILTER (WHERE non_trivial AND explained) AS non_trivial_explained_steps,
      count(*) FILTER (WHERE status = 'rule_unmatched') AS no_matching_rule, round(count(*) FILTER (WHERE conflict) / count(*), 6) AS conflict_rate,
      round(coalesce(count(*) FILTER (WHERE explained) / nullif(count(*) FILTER (WHERE NOT conflict), 0), 0), 6) AS rule_explained_rate FROM status GROUP BY case_id""",
)
def counters(spark, sf_dir):
    rows = reasoning_counters(observed_reasoning(spark, sf_dir), ["case_id"])
    return rows.select(
        "case_id", "decision_steps", "conflicts", "explained_steps", "explainable_decision_steps", "non_trivial_decision_steps",
        "non_trivial_explained_steps", "no_matching_rule", r6("conflict_rate").alias("conflict_rate"), r6("rule_explained_rate").alias("rule_explained_rate"),
    )


@query("tree_guided_reasoning", "J8 J15 J17 J21")
def tree_guided_reasoning(spark, sf_dir):
    """Guided decoding on the planted log: decisions scored on the rolled data state, explained by mined rules."""
    cats, nums, statics = ["o_orderstatus"], ["o_totalprice"], ["c_mktsegment"]
    log, net, _, result = planted_models(spark, sf_dir)
    train, test = only_split(log, "train"), only_split(log, "test")
    window = window_size(train, MIN_SUFFIX)
    model = count_model(train, 2, SUPPORT)
    pairs = with_limit(prefix_suffix_pairs(test, window, MIN_SUFFIX, [*cats, *nums, *statics]), window, MIN_SUFFIX)
    state = start_state_features(pairs, cats, nums).withColumns({c: F.element_at(c, -1) for c in statics})
    decide = state_decisions(
        decision_context(net), CFG, scorer(result), attribute_model(train, cats, nums), cats, nums, statics
    )
    done = guided_mode(state, model, window - MIN_SUFFIX, decide)
    told = explain(reasoning_steps(done, ["case_id", "prefix_len"]), guards(result), ["case_id", "prefix_len"])
    out = reasoning_counters(told, ["case_id", "prefix_len"])
    return out.select("case_id", "prefix_len", "decision_steps", "conflicts", "explained_steps", "explainable_decision_steps", "rule_unmatched")
