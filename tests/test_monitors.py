import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tablewatch.plans import monitors as M
from tablewatch.plans.root_cause import causal_stats, recent_deployments, with_hints
from tablewatch.sources.history import latest_n, recent_scores

AS_OF = "2024-01-02 00:00:00"


def one(df):
    (r,) = df.collect()
    return r


def at(spark, *times):
    return spark.createDataFrame([(t,) for t in times], "t STRING").select(F.col("t").cast("timestamp").alias("ts"))


@pytest.mark.parametrize("last,alert,severity", [
    ("2024-01-01 22:00:00", True, "WARNING"), ("2024-01-01 23:30:00", False, "INFO"),
    ("2024-01-01 00:00:00", True, "CRITICAL"), ("2024-01-01 23:00:00", False, "INFO"),
])
def test_freshness_fixed(spark, last, alert, severity):
    r = one(M.check_freshness(at(spark, "2023-12-01 00:00:00", last), M.Freshness("f", "t", max_age_seconds=3600), AS_OF))
    assert (r["alert"], r["severity"], r["threshold"]) == (alert, severity, 3600.0)


def test_freshness_learns_but_never_below_max_age(spark):
    history = spark.createDataFrame(
        [("f", float(s), f"2024-01-01 0{i}:00:00") for i, s in enumerate([10000, 11000, 10500, 11500, 10800])],
        "monitor_id STRING, score DOUBLE, at STRING",
    ).select("monitor_id", "score", F.lit(0.0).alias("threshold"), F.col("at").cast("timestamp").alias("checked_at"))
    cfg = M.Freshness("f", "t", max_age_seconds=3600)
    r = one(M.check_freshness(at(spark, "2024-01-01 21:00:00"), cfg, AS_OF, history))
    assert r["threshold"] == pytest.approx(10800 + 3 * 1.4826 * 300) and not r["alert"]
    small = history.withColumn("score", F.col("score") / 100)
    assert one(M.check_freshness(at(spark, "2024-01-01 21:00:00"), cfg, AS_OF, small))["threshold"] == 3600.0


def test_freshness_of_an_empty_table(spark):
    r = one(M.check_freshness(at(spark, AS_OF).where("1 = 0"), M.Freshness("f", "t"), AS_OF))
    assert not r["alert"] and r["score"] is None and "no data" in r["message"]


def runs(spark, *counts):
    df = spark.createDataFrame(list(enumerate(counts)), "i INT, row_count BIGINT")
    return df.select("row_count", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, i)").alias("bucket_start"))


@pytest.mark.parametrize("last,alert,severity", [
    (1000, True, "CRITICAL"), (5, True, "WARNING"), (105, False, "INFO"), (0, True, "CRITICAL"), (4, True, "CRITICAL"),
])
def test_volume_after_five_equal_runs(spark, last, alert, severity):
    from tablewatch.plans.monitors.table_metrics import score_volume

    r = score_volume(runs(spark, 100, 100, 100, 100, 100, last), M.Volume("v", "t")).orderBy(F.desc("ts")).first()
    assert (r["alert"], r["severity"], r["threshold"]) == (alert, severity, 100.0)
    assert float(r["details"]["pct_change"]) == pytest.approx(last - 100)


def test_volume_cold_start(spark):
    from tablewatch.plans.monitors.table_metrics import score_volume

    quiet = score_volume(runs(spark, 100, 0), M.Volume("v", "t")).orderBy("ts").collect()
    assert [(r["alert"], r["severity"]) for r in quiet] == [(False, "INFO"), (True, "CRITICAL")]
    same = score_volume(runs(spark, 100, 0), M.Volume("v", "t", cold_start="reference")).orderBy("ts").collect()
    assert [(r["alert"], r["threshold"]) for r in same] == [(True, 50.0), (False, 0.0)]


def test_volume_fixed_and_gaps(spark):
    cfg = M.Volume("v", "t", threshold=M.ThresholdConfig(method="fixed", fixed=2.0))
    df = at(spark, "2024-01-01 01:00:00", "2024-01-01 02:00:00", *["2024-01-04 05:00:00"] * 4)
    got = [(r["score"], r["alert"], r["severity"]) for r in M.check_volume(df, cfg).orderBy("ts").collect()]
    assert got == [(2.0, False, "INFO"), (0.0, True, "CRITICAL"), (0.0, True, "CRITICAL"), (4.0, True, "WARNING")]


def test_volume_gap_longer_than_the_limit_looks_back(spark):
    """A row 40 years early costs no row per hour since, and what is told equals the dense grid."""
    from tablewatch.plans.monitors.table_metrics import score_volume, volume_timeline

    t = M.ThresholdConfig(window_size=4)
    stamps = ["2024-01-01 01:10:00", "2024-01-01 02:00:00", *["2024-01-01 12:05:00"] * 3, "2024-01-01 14:00:00"]
    df, cfg = at(spark, *stamps), M.Volume("v", "t", bucket="1 hour", threshold=t)
    dense = score_volume(volume_timeline(df, cfg.ts_column, cfg.bucket), cfg).orderBy("ts").collect()
    told = M.check_volume(df, cfg).orderBy("ts").collect()
    assert len(dense) == 14 and len(told) == 9
    plain = lambda r: (r["ts"], r["score"], r["threshold"], r["alert"], r["severity"], r["message"])
    unfolded = []
    for r in told:
        n = int(r["details"].get("buckets", 1))
        unfolded += [(r["ts"] + timedelta(hours=k), *plain(r)[1:]) for k in range(n)]
    assert unfolded == [plain(r) for r in dense]
    early = M.check_volume(at(spark, "1984-01-01 00:00:00", *stamps), cfg)
    assert early.count() == 9 + 1 + 4


def test_volume_of_a_null_segment(spark):
    df = spark.createDataFrame([("a", 3), (None, 2)], "g STRING, n INT").selectExpr("g", "explode(sequence(1, n)) AS i", "timestamp'2024-01-01 00:00:00' AS ts")
    got = M.check_volume(df, M.Volume("v", "t", by=["g"])).collect()
    assert {(r["monitor_id"], r["score"]) for r in got} == {("v:a", 3.0), ("v:null", 2.0)}


def test_schema(spark):
    base = spark.createDataFrame([], "a DOUBLE, b DOUBLE")
    snap = lambda df: M.schema_snapshot(df, "t")
    check = lambda now, last: one(M.check_schema(M.Schema("s", "t"), snap(now), last and snap(last), AS_OF))
    assert not check(base, None)["alert"] and not check(base, base)["alert"]
    r = check(spark.createDataFrame([], "b STRING, c INT"), base)
    assert r["alert"] and r["score"] == 3 and r["severity"] == "WARNING"
    assert r["details"]["changes"] == '["~b: double -> string","+c (int)","-a (double)"]'


def drift(spark, ref, target, metric="ks", **kw):
    df = spark.createDataFrame([(float(v), True) for v in ref] + [(float(v), False) for v in target], "x DOUBLE, ref BOOLEAN")
    return one(M.check_distribution(df, M.Distribution("d", "t", column="x", metric=metric, reference="ref", target="NOT ref", **kw), AS_OF))


def test_distribution(spark):
    same = [1, 2, 3, 4, 5]
    assert not drift(spark, same, same)["alert"]
    far = drift(spark, same, [100, 200, 300, 400, 500])
    assert far["alert"] and far["severity"] == "CRITICAL" and far["threshold"] == 0.3
    assert drift(spark, [1] * 100, [100] * 100, "js")["alert"]
    assert drift(spark, [1] * 4, [2] * 4, "chi_square")["threshold"] == 3.841
    empty = drift(spark, [], same)
    assert not empty["alert"] and empty["score"] is None and "empty sample" in empty["message"]


def test_text_and_score_of_a_drift_agree(spark):
    """The score is 26.28125 up to the order of its sum; the text rounds the number that is shown."""
    values = [(0, 1.0)] + [(0, 2.0)] * 2 + [(1, 1.0)] * 15 + [(1, 2.0)]
    df = spark.createDataFrame(values, "side INT, x DOUBLE")
    cfg = M.Distribution("d", "t", column="x", metric="chi_square", reference="side = 0", target="side = 1")
    r = M.check_distribution(df, cfg, "2024-01-01 00:00:00").first()
    assert r["score"] == 26.28125 and "score=26.2812 " in r["message"]


def test_distribution_without_reference_compares_with_itself(spark):
    df = spark.createDataFrame([(1.0,), (9.0,)], "x DOUBLE")
    assert one(M.check_distribution(df, M.Distribution("d", "t", column="x"), AS_OF))["score"] == 0


def test_stored_baseline_gives_the_same_score(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(float(rng.randint(0, 30)), i % 2 == 0) for i in range(400)], "x DOUBLE, ref BOOLEAN")
    for metric in ("ks", "js", "chi_square"):
        cfg = M.Distribution("d", "t", column="x", metric=metric, reference="ref", target="NOT ref")
        direct = one(M.check_distribution(df, cfg, AS_OF))
        summary = M.capture_reference(df.where("ref"), "x")
        stored = one(M.against_summary(df, cfg, summary, AS_OF))
        assert stored["score"] == pytest.approx(direct["score"], abs=1e-12) and stored["alert"] == direct["alert"]


def test_correlation(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 100.0), (2.0, 4.0, 1.0), (3.0, 6.0, 500.0), (4.0, 8.0, 3.0), (5.0, 10.0, 200.0)], "x DOUBLE, y DOUBLE, z DOUBLE"
    )
    check = lambda y, m, d=df: one(M.check_correlation(d, M.Correlation("c", "t", column_x="x", column_y=y, method=m, min_abs=0.8), AS_OF))
    assert not check("y", "pearson")["alert"] and not check("y", "spearman")["alert"]
    assert check("z", "pearson")["alert"]
    few = check("y", "pearson", df.limit(2))
    assert not few["alert"] and few["score"] is None


def test_uniqueness(spark):
    check = lambda values: one(M.check_uniqueness(spark.createDataFrame([(v,) for v in values], "x STRING"), M.Uniqueness("u", "t", columns=["x"], max_ratio=0.1), AS_OF))
    assert check("abcd")["score"] == 0 and check("aaab")["score"] == 0.5 and check("aaab")["alert"]
    assert check("")["score"] == 0


def test_referential(spark):
    text = lambda *v: spark.createDataFrame([(x,) for x in v], "k STRING")
    cfg = M.ReferentialIntegrity("r", "t", columns=["k"])
    r = one(M.check_referential(text("a", "b", "x", "y", "x", None), text("a", "b", "c"), cfg, AS_OF))
    assert r["score"] == 3 and r["severity"] == "CRITICAL" and r["details"]["null_keys"] == "1"
    assert not one(M.check_referential(text("a").where("1 = 0"), text("a"), cfg, AS_OF))["alert"]


@pytest.mark.parametrize("value,op,expected,alert", [
    (100, ">", 50.0, True), (30, ">", 50.0, False), (10, "<", 50.0, True), (42, "=", 42.0, False), (43, "=", 42.0, True), (1, ">", None, False),
])
def test_custom_sql(spark, value, op, expected, alert):
    t = {"nums": spark.range(value)}
    cfg = M.CustomSql("c", "nums", query="SELECT count(*) FROM nums", expected=expected, comparison=op)
    assert one(M.check_custom_sql(t, cfg, AS_OF))["alert"] == alert


@pytest.mark.parametrize("spent,severity", [(50.0, "INFO"), (150.0, "WARNING"), (300.0, "CRITICAL")])
def test_cost(spark, spent, severity):
    df = spark.createDataFrame([(spent / 2,), (spent / 2,)], "cost DOUBLE")
    assert one(M.check_cost(df, M.Cost("c", "t", budget=100.0), AS_OF))["severity"] == severity


def test_cost_without_budget_is_never_critical(spark):
    r = one(M.check_cost(spark.createDataFrame([(5.0,)], "cost DOUBLE"), M.Cost("c", "t", budget=0.0), AS_OF))
    assert r["alert"] and r["severity"] == "WARNING" and r["details"]["ratio"] == "1.0"


def test_disabled_monitors_do_not_run(spark):
    t = {"t": spark.range(3).withColumnRenamed("id", "x")}
    cfgs = [M.Uniqueness("on", "t", columns=["x"]), M.Uniqueness("off", "t", columns=["x"], enabled=False)]
    assert [r["monitor_id"] for r in M.run_monitors(cfgs, t, AS_OF).collect()] == ["on"]


def scores(spark, *values):
    return spark.createDataFrame([("m", float(v), i) for i, v in enumerate(values)], "monitor_id STRING, score DOUBLE, i INT").select(
        "monitor_id", "score", F.lit(1.0).alias("threshold"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, i)").alias("checked_at")
    )


def test_history_reads(spark):
    h = scores(spark, *range(10))
    assert [r["score"] for r in latest_n(h, 3).orderBy("recency").collect()] == [9.0, 8.0, 7.0]
    assert recent_scores(h, 3).first()["scores"] == [7.0, 8.0, 9.0]
    assert recent_scores(h, 3, F.lit("2024-01-05 00:00:00").cast("timestamp")).first()["scores"] == [1.0, 2.0, 3.0]


def test_causal_statistics(spark):
    s = [1.0, 2.0, 1.5, 9.0, 3.0, 8.0]
    r = one(causal_stats(scores(spark, *s)))
    restricted = sum((s[i] - s[i - 1]) ** 2 for i in range(2, 6))
    unrestricted = sum((s[i] - s[i - 2]) ** 2 for i in range(2, 6))
    assert r["granger_f"] == pytest.approx(((restricted - unrestricted) / 2) / (unrestricted / 4))
    mean = sum(s) / 6
    sigma = (sum((x - mean) ** 2 for x in s) / 6) ** 0.5
    assert r["pca_share"] == pytest.approx(min(1.0, abs(8.0 - mean) / sigma))
    assert one(causal_stats(scores(spark, 1, 1, 1)))["pca_share"] is None
    assert one(causal_stats(scores(spark, 1, 2, 3, 4)))["granger_f"] is None


def test_deployment_range_join(spark):
    results = M.check_uniqueness(spark.range(2), M.Uniqueness("u", "t", columns=["id"]), AS_OF)
    ship = spark.createDataFrame(
        [("early", "2023-12-31 23:00:00"), ("edge", "2024-01-01 23:00:00"), ("late", "2024-01-02 00:00:01")], "name STRING, deployed_at STRING"
    )
    assert one(recent_deployments(results, ship, 3600))["deployment"] == "edge"
    assert recent_deployments(results, ship, 3599).count() == 0
    assert one(recent_deployments(results, ship, 90_000))["deployment"] == "edge"


def test_hint_gate_needs_three_history_rows(spark):
    results = M.check_uniqueness(spark.range(2), M.Uniqueness("m", "t", columns=["id"]), AS_OF)
    dims = spark.createDataFrame([("m", "north")], "monitor_id STRING, segment STRING")
    two = one(with_hints(results, history=scores(spark, 1, 2), dimensions=dims))["root_cause_hints"]
    three = one(with_hints(results, history=scores(spark, 1, 2, 3), dimensions=dims))["root_cause_hints"]
    assert len(two) == 2 and any("north" in h for h in three) and any("[PCA]" in h for h in three)
