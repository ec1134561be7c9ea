"""Rows that have ended leave the frontier of a step-wise decode."""

from pyspark.sql import functions as F

from caseloom.functions.distributions import Guidance
from caseloom.operators import predict
from caseloom.operators.cases import prefix_suffix_pairs
from caseloom.operators.guide import frontier_rows
from caseloom.operators.ordering import sequence_log


def test_ended_rows_are_not_scored_again(spark):
    rows = [(str(c), "abc"[(c * k + k) % 3], k) for c in range(12) for k in range(6)]
    log = sequence_log(spark.createDataFrame(rows, "case_id string, activity string, us bigint"), ["us"])
    model = predict.count_model(log)
    pairs = prefix_suffix_pairs(log, 20, 5).withColumn("limit", 7 - F.col("prefix_len").cast("int"))
    scored = spark.sparkContext.accumulator(0)
    z = F.create_map(F.lit("a"), F.lit(0.6), F.lit("b"), F.lit(0.4))

    def score(df):
        def seen(batches):
            for batch in batches:
                scored.add(batch.num_rows)
                yield batch

        return df.mapInArrow(seen, df.schema).withColumn("z", z)

    context = spark.createDataFrame([(x, f"p_{x}") for x in "abc"], "activity string, place string")
    decide = predict.Decisions(context, Guidance(), score)
    done = predict.decode_steps(frontier_rows(pairs, model, decide), model, 7, decisions=decide, every=1)
    out = done.select("case_id", "prefix_len", "step", "done", "limit").collect()
    assert len(out) == pairs.count() and all(r["step"] <= r["limit"] for r in out)
    assert scored.value < 7 * len(out)
