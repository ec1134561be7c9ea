"""Number texts: each part of a text is worked out once, and the text is the one of C's printf."""

import random

from pyspark.sql import functions as F

from caseloom.functions.text import number_text, threshold_text


def c_text(x: float) -> str:
    if x != 0 and (abs(x) >= 1e9 or abs(x) < 1e-4):
        return f"{x:.4g}"
    return f"{int(x):,}" if x == int(x) else f"{x:,.2f}"


def test_number_texts_are_those_of_printf(spark):
    draw = random.Random(5)
    some = [draw.choice([1, -1]) * draw.uniform(1, 10) * 10.0 ** draw.randint(-9, 14) for _ in range(300)]
    some += [0.0, -0.0, 1e9, 9.9999e9, 99999.5e5, -1e-5, 1234567.0, -7.0, 0.001, -0.001, 999999999.99, 1e100, 1e-120, 123456.7]
    some = [x for x in some if abs(x) < 1e-4 or abs(x) >= 1e9 or abs(round(x * 100 % 1, 6) - 0.5) > 1e-3]
    rows = spark.createDataFrame([(x,) for x in [*some, None]], "x double")
    found = {r["x"]: (r["n"], r["t"]) for r in rows.select("x", number_text(F.col("x")).alias("n"), threshold_text(F.col("x")).alias("t")).collect()}
    assert found.pop(None) == (None, None)
    assert {x: v[0] for x, v in found.items()} == {x: c_text(x) for x in found}
    assert {x: v[1] for x, v in found.items() if x} == {x: f"{x:.6g}" for x in found if x}


def test_a_text_is_a_small_expression(spark):
    plan = spark.range(1).select(number_text(F.col("id") * 1e10))._jdf.queryExecution().analyzed().toString()
    assert plan.count("LOG10") <= 4
