import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import arrays, distributions, similarity, text


def one(spark, col, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, value)
    return df.select(col.alias("x")).first()["x"]


def words(s):
    return F.array(*[F.lit(c) for c in s]).cast("array<string>")


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d[i - 2, j - 2] + 1)
            d[i, j] = best
    return d[len(a), len(b)]


PAIRS = [("ca", "abc"), ("", "x"), ("xy", ""), ("", ""), ("abcd", "acbd"), ("kitten", "sitting"), ("aab", "aab")]


def test_edit_distance_and_similarity(spark):
    df = spark.createDataFrame([(list(a), list(b)) for a, b in PAIRS], "a array<string>, b array<string>")
    got = df.select(
        similarity.edit_distance(F.col("a"), F.col("b")).alias("d"),
        similarity.edit_distance(F.col("b"), F.col("a")).alias("r"),
        similarity.similarity(F.col("a"), F.col("b")).alias("s"),
        similarity.token_accuracy(F.col("a"), F.col("b")).alias("t"),
    ).collect()
    for (a, b), row in zip(PAIRS, got):
        assert row["d"] == row["r"] == osa(a, b)
        assert 0 <= row["s"] <= 1 and (row["s"] == 1) == (a == b)
        hits = sum(x == y for x, y in zip(a, b))
        assert row["t"] == hits / max(len(a), len(b), 1)


def test_category_tokens(spark):
    for value, kind, want in [
        (F.lit(1), T.IntegerType(), "1"), (F.lit(1.0), T.DoubleType(), "1"), (F.lit("1"), T.StringType(), "1"),
        (F.lit(0.5), T.DoubleType(), "0.5"), (F.lit(12345678.5), T.DoubleType(), "12345678.5"),
        (F.lit(1.5e-5), T.DoubleType(), "1.5e-05"), (F.lit(0.00025), T.DoubleType(), "0.00025"),
        (F.lit(True), T.BooleanType(), "True"), (F.lit(float("nan")), T.DoubleType(), None),
        (F.lit(None).cast("string"), T.StringType(), None),
    ]:
        assert one(spark, text.category_token(value, kind)) == want


def test_numbers_and_durations(spark):
    for value in [0.0, 12340.0, 12340.5, -7.25, 1e9, 6462500000.0, 0.00005, 999999999.4, -3e10, 123456.789]:
        a = abs(value)
        want = f"{value:.4g}" if a and (a >= 1e9 or a < 1e-4) else f"{int(value):,d}" if value.is_integer() else f"{value:,.2f}"
        assert one(spark, text.number_text(F.lit(value))) == want
    for value in [250000.0, 0.5, 1234567.0, 0.0001234567, 1e-5, -12.3456789, 100000.0, 999999.6]:
        assert one(spark, text.threshold_text(F.lit(value))) == f"{value:.6g}"
    assert one(spark, text.duration_text(F.lit(-0.5))) == "0.00 seconds"
    assert one(spark, text.duration_text(F.lit(90.0))) == "1.50 minutes"
    assert one(spark, text.duration_text(F.lit(-7200.0))) == "-2.00 hours"


def test_labels_are_cleaned(spark):
    clean = lambda s: one(spark, text.strip_by_suffix(F.lit(s)))
    assert clean("Request [submit by EMPLOYEE] done") == "Request [submit] done"
    assert clean("Declaration APPROVED by ADMINISTRATION") == "Declaration APPROVED"
    assert clean("EOS") == "EOS" and clean(None) is None


def test_windows_and_masks(spark):
    assert one(spark, arrays.pad_left(words("ab"), 4, F.lit("0"))) == ["0", "0", "a", "b"]
    assert one(spark, arrays.pad_left(words("abcde"), 3, F.lit("0"))) == ["c", "d", "e"]
    labels = F.array(F.lit("a"), F.lit("EOS"), F.lit("EOS"))
    assert one(spark, arrays.eos_mask(labels, "EOS")) == [1, 1, 0]
    assert one(spark, arrays.eos_mask(words("ab"), "EOS")) == [1, 1]
    ids = F.array(*[F.lit(i) for i in (0, 0, 3, 0, 2)])
    assert one(spark, arrays.zero_mask(ids)) == [0, 0, 1, 1, 1]
    assert one(spark, arrays.zero_mask(F.array(F.lit(0), F.lit(0)))) == [0, 0]


def test_reweighting(spark):
    dist = F.create_map(F.lit("a"), F.lit(0.6), F.lit("b"), F.lit(0.4))
    z = F.create_map(F.lit("b"), F.lit(1.0))
    cfg = distributions.Guidance()
    got = one(spark, distributions.reweight(dist, z, F.lit(3), cfg))
    beta = 2.0 * math.exp(-0.3)
    wa, wb = 0.6 * 0.001**beta, 0.4
    assert abs(got["a"] - wa / (wa + wb)) < 1e-12 and abs(sum(got.values()) - 1) < 1e-12
    for off in (distributions.Guidance(beta_max=0.0), distributions.Guidance(max_guided_steps=2), distributions.Guidance(min_base_entropy=0.99)):
        assert one(spark, distributions.reweight(dist, z, F.lit(3), off)) == {"a": 0.6, "b": 0.4}
    support = distributions.supported(F.create_map(F.lit("a"), F.lit(0.3), F.lit("b"), F.lit(0.1)), 0.2)
    assert one(spark, distributions.is_conflict(F.lit("b"), support)) is True
    assert one(spark, distributions.is_conflict(F.lit("b"), F.array().cast("array<string>"))) is False


def test_rule_text(spark):
    intervals = F.create_map(F.lit("x"), F.struct(F.lit(1.5).alias("low"), F.lit(250000.0).alias("high")))
    allowed = F.create_map(F.lit("c"), words("abcdefg"))
    none = F.create_map().cast("map<string,array<string>>")
    assert one(spark, text.rule_text(intervals, allowed, none)) == "(c in {a, b, c, d, e} (+2 more)) AND (x > 1.5) AND (x <= 250000)"
    assert one(spark, text.rule_text(F.create_map().cast("map<string,struct<low:double,high:double>>"), none, none)) == "(true)"
