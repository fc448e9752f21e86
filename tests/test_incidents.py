import random

import pytest
from pyspark.sql import functions as F

from tablewatch.plans import incidents as I


def events(spark, rows):
    df = spark.createDataFrame([(i, k, round(s * 1000)) for i, (k, s) in enumerate(rows)], "id BIGINT, key STRING, ms BIGINT")
    return df.withColumn("ts", F.timestamp_millis(F.col("ms") + 1_700_000_000_000))


def by_hand(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], i))
    last, duplicate = {}, [False] * len(rows)
    for i in order:
        key, s = rows[i]
        s = round(s * 1000)
        if key in last and s - last[key] < window * 1000:
            duplicate[i] = True
        else:
            last[key] = s
    return duplicate


def marked(spark, rows, window=300):
    got = I.mark_duplicates(events(spark, rows), "key", "ts", "id", window).orderBy("id").collect()
    return [r["duplicate"] for r in got]


def test_a_dropped_event_does_not_restart_the_window(spark):
    assert marked(spark, [("a", 0.0), ("a", 200.0), ("a", 400.0)]) == [False, True, False]


def test_exactly_one_window_later_is_kept(spark):
    assert marked(spark, [("a", 0.0), ("a", 299.999), ("a", 300.0)]) == [False, True, False]


def test_same_instant_keeps_one(spark):
    assert marked(spark, [("a", 5.0), ("a", 5.0), ("b", 5.0)]) == [False, True, False]


@pytest.mark.parametrize("seed,mean_gap", [(1, 5.0), (2, 90.0), (3, 290.0), (4, 2500.0)])
def test_chains_across_chunks_match_a_sequential_walk(spark, seed, mean_gap):
    # One key has most of the events; gaps cross many chunks of 3,600 s.
    rng = random.Random(seed)
    rows, now = [], 0.0
    for _ in range(1500):
        now += rng.choice([rng.expovariate(1 / mean_gap), 300.0, 0.0, 150.0])
        rows.append(("hot" if rng.random() < 0.8 else rng.choice("ab"), round(now, 3)))
    rng.shuffle(rows)
    assert marked(spark, rows) == by_hand(rows, 300)


def test_levels_match_a_sequential_walk(spark, monkeypatch):
    """Groups of four chunks: many levels; keys with gaps of many chunks and regular beats."""
    monkeypatch.setattr(I, "CHUNKS_PER_GROUP", 4)
    monkeypatch.setattr(I, "CHUNK_WINDOWS", 2)
    rng = random.Random(3)
    rows = [("beat", 0.7 * k) for k in range(1200)] + [("slow", 31.0 * k) for k in range(60)]
    now = -400.0
    for _ in range(300):
        now += rng.choice([1.0, 9.0, 10.0, 11.0, 25.0, 100.0])
        rows.append(("gaps", now))
    rng.shuffle(rows)
    assert marked(spark, rows, 10) == by_hand(rows, 10)


def test_times_before_and_after_1970(spark):
    rows = [("a", -1_700_000_000.0 + s) for s in (-400.0, -200.0, -99.0, 0.0, 150.0, 201.0, 500.0, 100_000.0)]
    assert marked(spark, rows) == by_hand(rows, 300)


def test_a_million_regular_events_of_one_key(spark, monkeypatch):
    """No task sees more than the events of a chunk or the chunks of a group, and no chunk's list more than a window's events."""
    df = spark.range(1_000_000).select(F.col("id"), F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    maps = I._chunk_maps(df.select(F.lit("hot").alias("_key"), F.unix_micros("ts").alias("_ts"), F.floor(F.unix_micros("ts") / 3_600_000_000).alias("_chunk")), 300_000_000)
    assert maps.agg(F.max(F.size("_bounds"))).first()[0] <= 301
    levels = []
    composed = I._composed
    monkeypatch.setattr(I, "_composed", lambda maps, *more: levels.append(maps.groupBy("_key", F.floor(F.col("_chunk") / I.CHUNKS_PER_GROUP)).count().agg(F.max("count")).first()[0]) or composed(maps, *more))
    kept = I.kept_rows(df, "key", "ts", "id")
    assert kept.agg(F.count("*"), F.min("id"), F.max("id")).first()[:] == (3334, 0, 999_900)
    assert kept.where("id % 300 <> 0").count() == 0
    assert levels and max(levels) <= I.CHUNKS_PER_GROUP


def test_goes_on_from_earlier_rows(spark):
    last = spark.createDataFrame([("a", 1_700_000_100_000_000)], "kept_key STRING, kept_micros BIGINT")
    got = I.mark_duplicates(events(spark, [("a", 50.0), ("a", 399.0), ("a", 400.0), ("b", 0.0)]), "key", "ts", "id", 300, last)
    assert [r["duplicate"] for r in got.orderBy("id").collect()] == [True, True, False, False]


def result_rows(spark, *rows):
    return spark.createDataFrame(rows, "monitor_id STRING, severity STRING, message STRING, at STRING").select(
        "monitor_id", F.lit("volume").alias("monitor_type"), F.lit("t").alias("table_name"), F.lit(True).alias("alert"),
        "severity", F.lit(1.0).alias("score"), F.lit(1.0).alias("threshold"), "message",
        F.create_map(F.lit("a"), F.lit("b")).alias("details"), F.col("at").cast("timestamp").alias("ts"),
    )


def stamps(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_suppression_order_and_tags(spark):
    results = result_rows(
        spark, ("m", "CRITICAL", "disk full", "2024-01-01 10:00:00"), ("m", "CRITICAL", "disk full", "2024-01-01 10:01:00"),
        ("n", "WARNING", "slow", "2024-01-01 10:00:00"), ("n", "WARNING", "slow", "2024-01-03 10:00:00"),
    )
    windows = stamps(spark, "monitor_id STRING, starts_at STRING, ends_at STRING",
                     (None, "2023-12-31 00:00:00", "2024-01-01 10:00:00"), ("n", "2024-01-03 10:00:00", "2024-01-09 00:00:00"))
    rules = stamps(spark, "monitor_id STRING, pattern STRING, expires_at STRING",
                   ("m", "disk", None), (None, "slow", "2024-01-02 00:00:00"))
    got = {(r["monitor_id"], str(r["ts"])): (r["severity"], r["message"]) for r in I.register(results, windows, rules).collect()}
    assert got[("m", "2024-01-01 10:00:00")] == ("INFO", "[IGNORED] [SUPPRESSED] disk full")
    assert got[("m", "2024-01-01 10:01:00")] == ("INFO", "[DEDUP] [IGNORED] disk full")
    assert got[("n", "2024-01-01 10:00:00")] == ("INFO", "[IGNORED] [SUPPRESSED] slow")
    assert got[("n", "2024-01-03 10:00:00")] == ("INFO", "[SUPPRESSED] slow")


def test_blank_rule_matches_everything(spark):
    results = result_rows(spark, ("m", "CRITICAL", "x", "2024-01-01 10:00:00"))
    rules = stamps(spark, "monitor_id STRING, pattern STRING, expires_at STRING", (None, None, None))
    assert I.register(results, ignore_rules=rules).first()["message"] == "[IGNORED] x"


def test_rules_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(I, "RULES_PER_BROADCAST", 3)
    rng = random.Random(9)
    alphabet = ["a", "b", "aa", "ü", " ", "%", "日本", "x" * 5]
    text = lambda n: "".join(rng.choices(alphabet, k=rng.randint(0, n)))
    at = lambda: f"2024-01-0{rng.randint(1, 9)} 00:00:00"
    results = [("m" + str(k % 3), "CRITICAL", text(9), f"2024-01-0{k % 9 + 1} 00:00:{k % 60:02d}") for k in range(150)] + [("m0", "CRITICAL", "common text " * 3, f"2024-01-02 00:{k:02d}:00") for k in range(50)]
    rules = [(rng.choice([None, None, None, "m1", "m9"]), text(3), rng.choice([None, at()])) for _ in range(40)] + [(None, "common", "2024-01-02 00:20:00"), (None, "never said", None)]
    rules = [r for r in rules if r[1] != "" or r[2]]
    incidents = I.from_results(result_rows(spark, *results))
    got = {r["incident_id"] for r in I.ignore_hits(incidents, stamps(spark, "monitor_id STRING, pattern STRING, expires_at STRING", *rules)).collect()}
    want = {
        r["incident_id"] for r in incidents.collect()
        if any(m in (None, r["monitor_id"]) and p in r["message"] and (u is None or str(r["ts"]) <= u) for m, p, u in rules)
    }
    assert got == want and 0 < len(got) < len(results)


def test_long_patterns_meet_no_message_without_their_runs(spark):
    """No nested loop for patterns of three characters or more."""
    incidents = I.from_results(result_rows(spark, *[("m", "CRITICAL", f"text {i}.", f"2024-01-01 10:{i:02d}:00") for i in range(20)]))
    rules = stamps(spark, "monitor_id STRING, pattern STRING, expires_at STRING", *[(None, f"text {i}.", None) for i in range(0, 20, 2)])
    hits = I.ignore_hits(incidents, rules)
    assert hits.count() == 10
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()


def test_state_folds_the_log(spark):
    incidents = I.from_results(result_rows(spark, ("m", "CRITICAL", "x", "2024-01-01 10:00:00"), ("n", "INFO", "y", "2024-01-01 10:00:00")))
    one = incidents.where("monitor_id = 'm'").first()["incident_id"]
    log = stamps(
        spark, "incident_id STRING, action STRING, at STRING, actor STRING, until STRING, level INT",
        (one, "acknowledge", "2024-01-01 11:00:00", "ann", None, None), (one, "acknowledge", "2024-01-01 12:00:00", None, None, None),
        (one, "escalate", "2024-01-01 12:00:00", None, None, 2), (one, "escalate", "2024-01-01 11:00:00", None, None, 1),
        (one, "snooze", "2024-01-01 11:00:00", None, "2024-01-02 00:00:00", None), (one, "resolve", "2024-01-01 13:00:00", None, None, None),
    )
    state = I.apply_actions(incidents, log)
    r = state.where("monitor_id = 'm'").first()
    assert r["resolved"] and r["acked"] and r["owner"] == "ann" and r["escalation_level"] == 2
    assert str(r["acknowledged_at"]) == "2024-01-01 12:00:00" and str(r["snoozed_until"]) == "2024-01-02 00:00:00"
    assert I.list_incidents(state, "open").count() == 1 and I.list_incidents(state, "resolved", "m").count() == 1
    assert I.list_incidents(state, "anything").count() == 2
    assert {(x["monitor_id"], x["open"]) for x in I.open_counts(state).collect()} == {("m", 0), ("n", 1)}


def test_info_is_not_sent(spark):
    incidents = I.from_results(result_rows(spark, ("m", "CRITICAL", "x", "2024-01-01 10:00:00"), ("n", "INFO", "y", "2024-01-01 10:00:00")))
    sent = I.alert_payloads(incidents, [I.Channel("c", "chat"), I.Channel("p", "pager", "key")]).collect()
    assert {(r["channel"], r["payload"]) for r in sent} == {
        ("c", '{"text":"[CRITICAL] x — monitor=m"}'),
        ("p", '{"routing_key":"key","event_action":"trigger","payload":{"summary":"x","severity":"critical","source":"m"}}'),
    }


def test_results_of_one_instant_are_told_apart(spark):
    """They share an incident id, but neither the log of one nor a rule for its message is for the other."""
    rows = [("m", "CRITICAL", "disk full", "2024-01-01 10:00:00"), ("m", "CRITICAL", "slow", "2024-01-01 10:00:00")]
    results = result_rows(spark, *rows).withColumn("result_id", F.when(F.col("message") == "slow", 2).otherwise(1))
    incidents = I.from_results(results)
    log = incidents.where("result_id = 1").select(
        "incident_id", "result_id", F.lit("resolve").alias("action"), F.col("ts").alias("at"), F.lit(None).cast("string").alias("actor"),
        F.lit(None).cast("timestamp").alias("until"), F.lit(None).cast("int").alias("level"),
    )
    assert {r["result_id"]: r["resolved"] for r in I.apply_actions(incidents, log).collect()} == {1: True, 2: False}
    rules = stamps(spark, "monitor_id STRING, pattern STRING, expires_at STRING", ("m", "disk", None))
    assert {r["message"] for r in I.register(results, None, rules).collect()} == {"[IGNORED] disk full", "slow"}
