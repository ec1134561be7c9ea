import datetime as dt

from conftest import SF, rows_of
from pyspark.sql import functions as F

from caseloom.catalog.predict import guided_setup, prepared
from caseloom.functions.distributions import Guidance, normalised_entropy
from caseloom.operators.cases import add_end_rows, case_rows, prefix_rows, prefix_suffix_pairs, split_cases, static_values
from caseloom.operators.encode import encode_column, scaler_values, scalers, vocabulary
from caseloom.operators.features import since_earlier_event, since_last_row
from caseloom.operators.flow import Net, align, decisions, directly_follows, net_from_edges, prefix_markings, replay
from caseloom.operators.guide import guard_matches, guided_beams, guided_mode
from caseloom.operators.mine import feature_state
from caseloom.operators.ordering import EventLog, sequence_log
from caseloom.operators.predict import count_model, decode_beam, decode_greedy, with_limit
from caseloom.sources.logs import orders_log
from caseloom.sources.reader import LogColumns, parse_time, read_table

SEC = 1_000_000


def log_of(spark, rows):
    df = spark.createDataFrame(rows, "case_id string, activity string, us long, tie long, c string, x double")
    return sequence_log(df, ["us", "tie"], dyn_cat=["c"], dyn_num=["x"])


def hand_log(spark):
    return log_of(
        spark,
        [
            ("1", "A", 0, 1, "p", 1.0), ("1", "B", 0, 2, "q", None), ("1", "A", 5 * SEC, 3, "q", 3.0), ("1", "C", 9 * SEC, 4, "p", 4.0),
            ("2", "A", 7 * SEC, 5, None, None),
            ("3", "B", 1 * SEC, 6, None, None), ("3", "C", 1 * SEC, 7, None, None),
            (None, "A", 0, 8, "p", 1.0),
        ],
    )


def by_case(df, case, *cols):
    return [tuple(r[c] for c in cols) for r in df.where(F.col("case_id") == case).orderBy("pos").collect()]


def test_elapsed_times_on_ties(spark):
    log = hand_log(spark)
    assert by_case(since_earlier_event(log).events, "1", "event_elapsed_time") == [(None,), (None,), (5.0,), (4.0,)]
    assert by_case(since_last_row(log).events, "1", "event_elapsed_time") == [(0.0,), (0.0,), (5.0,), (4.0,)]
    assert by_case(since_earlier_event(log).events, "2", "event_elapsed_time") == [(None,)]


def test_prefix_and_suffix_make_the_case(spark):
    log = hand_log(spark)
    pairs = prefix_suffix_pairs(log, 12, 5).collect()
    assert all(r["prefix"] + r["target_suffix"] == ["A", "B", "A", "C"] for r in pairs if r["case_id"] == "1")
    assert {r["case_id"] for r in pairs} == {"1", "3"}  # a one-event case has no suffix


def test_long_case_is_cut_to_the_window(spark):
    log = log_of(spark, [("1", f"a{i:02d}", i * SEC, i, None, None) for i in range(30)])
    rows = prefix_rows(log, ["activity"], 4).where("prefix_len = 30").first()
    assert rows["activity"] == ["a26", "a27", "a28", "a29"]
    pairs = prefix_suffix_pairs(log, 12, 5)
    assert pairs.count() == 6 and pairs.where("prefix_len = 1").first()["prefix"] == ["a23"]


def test_missing_values(spark):
    log = hand_log(spark)
    ended = add_end_rows(log, 2).events
    assert ended.where("activity = 'EOS'").count() == 6 and ended.where("activity = 'EOS' and x is not null").count() == 0
    assert static_values(log, ["c"]).where("case_id = '2'").first()["c"] is None
    vocab = vocabulary(log.events.where("activity <> 'C'"), "activity")
    coded = encode_column(log.events, "activity", vocab, "id")
    assert {r["activity"]: r["id"] for r in coded.collect()} == {"A": 1, "B": 2, "C": 0}
    fitted = scaler_values(scalers(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), ["x"]))
    assert fitted["x"] == (2.0, 1.0)


def test_history_features(spark):
    state = feature_state(hand_log(spark), ["c"], ["x"], []).events
    assert by_case(state, "1", "x_past_avg") == [(1.0,), (1.0,), (1.0,), (2.0,)]
    assert by_case(state, "1", "c_past_mode") == [("p",), ("p",), ("p",), ("q",)]
    bare = feature_state(hand_log(spark), ["c"], ["x"], [], fallback=False).events
    assert by_case(bare, "1", "x_past_avg")[0] == (None,) and by_case(bare, "2", "c_past_mode") == [(None,)]


def test_mode_ties_go_to_the_first_seen(spark):
    log = log_of(spark, [("1", "A", i * SEC, i, v, None) for i, v in enumerate("qppqz")])
    assert by_case(feature_state(log, ["c"], [], []).events, "1", "c_past_mode")[-1] == ("q",)


def test_replay_agrees_with_windows(spark):
    log = hand_log(spark)
    edges = directly_follows(log)
    net = net_from_edges(edges)
    moves = align(log, edges)
    assert rows_of(decisions(moves, net).drop("block")) == rows_of(replay(moves, net))


def test_replay_of_a_net_with_a_silent_choice(spark):
    net = Net(
        spark.createDataFrame([("t0", "A"), ("s1", None), ("s2", None), ("t1", "B"), ("t2", "C")], "tid string, label string"),
        spark.createDataFrame([("t0", "start"), ("s1", "d"), ("s2", "d"), ("t1", "e1"), ("t2", "e2")], "tid string, place string"),
        spark.createDataFrame([("t0", "d"), ("s1", "e1"), ("s2", "e2"), ("t1", "end"), ("t2", "end")], "tid string, place string"),
        spark.createDataFrame([("start", 1)], "place string, n int"),
    )
    rows = [("1", 1, "e1", "t0", "A", "A"), ("1", 2, ">>", "s1", None, None), ("1", 3, "e2", "t1", "B", "B"),
            ("2", 1, "e1", "t0", "A", "A"), ("2", 2, ">>", "s2", None, None)]
    df = spark.createDataFrame(rows, "case_id string, pos long, log_name string, model_name string, log_label string, model_label string")
    log = EventLog(df.withColumn("block", F.lit(0).cast("long")), ("pos",), False)
    want = [("1", "d", "1", "B", "1", "0"), ("2", "d", "1", "EOS", "None", "0")]
    assert rows_of(replay(log, net)) == want == rows_of(decisions(log, net).drop("block"))


def test_replay_of_parallel_branches(spark):
    net = Net(
        spark.createDataFrame([("t0", "A"), ("s", None), ("t1", "X"), ("t2", "B"), ("t3", "C"), ("t4", "D")], "tid string, label string"),
        spark.createDataFrame([("t0", "i"), ("s", "p"), ("t1", "p"), ("t2", "b"), ("t3", "q"), ("t4", "r"), ("t4", "u")], "tid string, place string"),
        spark.createDataFrame([("t0", "p"), ("t0", "q"), ("s", "b"), ("t1", "r"), ("t2", "r"), ("t3", "u"), ("t4", "o")], "tid string, place string"),
        spark.createDataFrame([("i", 1)], "place string, n int"),
    )
    seen = {"t0": "A", "t1": "X", "t2": "B", "t3": "C", "t4": "D"}
    # 1: the other branch does not resolve the silent choice; 2: nothing to take at first; 3: an event the net does not know
    cases = {"1": ["t0", "s", "t3", "t2", "t4"], "2": ["t1", "t0", "t1"], "3": ["t0", ">>", "t1", "t3"], "4": ["t0", "s", "t3"]}
    rows = [
        (case, pos, ">>" if tid == "s" else f"e{pos}", tid, None if tid == "s" else seen.get(tid, "?"), seen.get(tid))
        for case, tids in cases.items()
        for pos, tid in enumerate(tids, 1)
    ]
    df = spark.createDataFrame(rows, "case_id string, pos long, log_name string, model_name string, log_label string, model_label string")
    want = [("1", "p", "1", "B", "2", "0"), ("2", "p", "2", "X", "2", "0"), ("3", "p", "1", "X", "1", "0"), ("4", "p", "1", "EOS", "None", "0")]
    whole = EventLog(df.withColumn("block", F.lit(0).cast("long")), ("pos",), False)
    split = EventLog(df.withColumn("block", F.floor((F.col("pos") - 1) / 2)), ("pos",), True)
    assert rows_of(replay(whole, net)) == want == rows_of(replay(split, net))


def test_entropy_is_scaled_by_the_whole_vocabulary(spark):
    model = count_model(log_of(spark, [(str(i), a, SEC, i, None, None) for i, a in enumerate("ABCDEFG")]))
    assert model.classes == 1  # every case ends after its one event
    row = spark.range(1).select(F.create_map(F.lit("A"), F.lit(0.5), F.lit("B"), F.lit(0.5)).alias("p"))
    assert abs(row.select(normalised_entropy(F.col("p"), F.lit(8))).first()[0] - 1 / 3) < 1e-6


def test_markings_of_parallel_branches(spark):
    net = Net(
        spark.createDataFrame([("t0", "A"), ("t1", "B"), ("t2", "C"), ("t3", "D")], "tid string, label string"),
        spark.createDataFrame([("t0", "i"), ("t1", "p"), ("t2", "q"), ("t3", "r"), ("t3", "s")], "tid string, place string"),
        spark.createDataFrame([("t0", "p"), ("t0", "q"), ("t1", "r"), ("t2", "s"), ("t3", "o")], "tid string, place string"),
        spark.createDataFrame([("i", 1)], "place string, n int"),
    )
    log = log_of(spark, [("1", a, i * SEC, i, None, None) for i, a in enumerate("ACXBD")])
    got = [m for (m,) in by_case(prefix_markings(log, net).events, "1", "marking")]
    assert got == ["p:1,q:1", "p:1,s:1", "p:1,s:1", "r:1,s:1", "o:1"]


def test_split_sizes(spark):
    events = spark.range(103).select(F.col("id").cast("string").alias("case_id"))
    counts = {r["split"]: r["count"] for r in split_cases(events).groupBy("split").count().collect()}
    assert counts == {"val": 15, "test": 20, "train": 68}


def test_unparseable_time_is_null(spark):
    df = spark.createDataFrame([("2024/01/02 03:04:05.678",), ("soon",)], "t string")
    got = [r["t"] for r in df.select(parse_time("t", "yyyy/MM/dd HH:mm:ss.SSS").alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5, 678000), None]


def test_guards(spark):
    df = spark.createDataFrame(
        [({"x": 2.0}, {"c": "p"}, True), ({"x": 1.0}, {"c": "p"}, False), ({"x": None}, {"c": "p"}, False),
         ({"x": 2.0}, {"c": None}, False), ({"x": 3.5}, {"c": "p"}, False)],
        "nums map<string,double>, cats map<string,string>, want boolean",
    )
    intervals = F.create_map(F.lit("x"), F.struct(F.lit(1.0).alias("low"), F.lit(3.0).alias("high")))
    allowed = F.create_map(F.lit("c"), F.array(F.lit("p")))
    excluded = F.create_map(F.lit("d"), F.array(F.lit("p")))
    got = df.select("want", guard_matches(F.col("nums"), F.col("cats"), intervals, allowed, excluded).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_no_guidance_equals_plain_and_one_beam_equals_argmax(spark):
    model, pairs, steps, decide, _ = guided_setup(spark, SF, Guidance(beta_max=0.0))
    plain = decode_greedy(pairs, model, steps).select("case_id", "prefix_len", F.get("decoded_suffixes", F.lit(0)).alias("s"))
    guided = guided_mode(pairs, model, steps, decide).select("case_id", "prefix_len", "suffix")
    assert rows_of(plain) == rows_of(guided)
    beam = decode_beam(pairs, model, steps, 1).select("case_id", "prefix_len", F.get("decoded_suffixes", F.lit(0)).alias("s"))
    assert rows_of(plain) == rows_of(beam)


def test_samples_in_one_pass_equal_those_step_by_step(spark, monkeypatch):
    from caseloom.operators import predict
    from caseloom.operators.cases import prefix_suffix_pairs
    from caseloom.sources.logs import orders_log

    log = orders_log(spark, SF)
    model = predict.count_model(log, 2, 5)
    pairs = predict.with_limit(prefix_suffix_pairs(log, 9, 5), 9, 5).where("case_id < '12'")
    once = rows_of(predict.decode_samples(pairs, model, 4, 3))
    monkeypatch.setattr(predict, "HELD_ENTRIES", 0)
    assert once == rows_of(predict.decode_samples(pairs, model, 4, 3)) and len(once) == 3 * pairs.count() > 0
