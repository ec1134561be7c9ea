from conftest import SF
from pyspark.sql import functions as F

from caseloom.functions.distributions import Guidance
from caseloom.operators.mine import ModelConfig
from caseloom.plans.stages import build_base, evaluate, mine_and_label, next_model
from caseloom.session import scratch_path
from caseloom.sources.logs import PLANTED_AMOUNT, planted_log


def test_stages_find_the_planted_rule(spark):
    base = build_base(planted_log(spark, SF), scratch_path(spark, "base"))
    data = mine_and_label(base, ModelConfig())
    rows = {r["place"]: r for r in data.diagnostics.collect()}
    assert set(rows) == {"p_OPEN", "p_REVIEW", "p_APPROVE"}
    assert all(r["top1_accuracy"] >= r["majority_baseline"] for r in rows.values())
    assert data.weighted.first()["weighted_top1"] > 0.95
    review = [r for r in data.rules.where("label = 'REVIEW'").collect() if (r["intervals"] or {}).get("o_totalprice")]
    mean, scale = data.mined.fitted["o_totalprice"]  # numbers are scaled before mining
    lows = [r["intervals"]["o_totalprice"]["low"] for r in review]
    assert lows and min(abs(x * scale + mean - PLANTED_AMOUNT) for x in lows if x is not None) < 0.05 * PLANTED_AMOUNT
    assert data.labelled.where("pos < n and place is null").count() == 0

    model = next_model(base)
    plain = evaluate(base, model, "planted")
    scored, summary = plain.rows, plain.summary
    assert plain.reasoning is None
    assert summary.first()["n_rows"] == scored.count() > 0
    done = evaluate(base, model, "planted", data, cfg=Guidance(support_threshold=0.2))
    guided, told, totals = done.rows, done.reasoning, done.summary
    row = totals.first()
    assert guided.count() == scored.count() and row["decision_steps"] == told.count()
    parts = sum(row[c] for c in ("conflicts", "explained_steps", "rule_unmatched", "matched_trivial_rule", "no_rule_for_branch"))
    assert parts == row["decision_steps"]
