import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewatch import streaming
from tablewatch.plans import expectations as E
from tablewatch.plans.monitors import ThresholdConfig

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Write batches of (id, key, seconds, value) as files; read them one file per micro-batch."""
    streaming.use_rocksdb(spark)
    folder = tmp_path / "feed"

    def run(*batches):
        for i, rows in enumerate(batches):
            data = [(r[0], r[1], START + dt.timedelta(seconds=r[2]), float(r[3])) for r in rows]
            spark.createDataFrame(data, "id BIGINT, key STRING, ts TIMESTAMP, value DOUBLE").coalesce(1).write.mode("append").parquet(
                str(folder / f"b{i}")
            )
        return (
            spark.readStream.schema("id BIGINT, key STRING, ts TIMESTAMP, value DOUBLE")
            .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        )

    return run


def test_dedup_keeps_state_between_batches(spark, feed, tmp_path):
    stream = feed([(1, "a", 0, 1), (2, "a", 200, 1)], [(3, "a", 400, 1), (4, "b", 410, 1)], [(5, "a", 699, 1), (6, "a", 700, 1)])
    got = streaming.drain(streaming.deduplicate_stream(stream, "key", "ts", "id", 300), "t", str(tmp_path / "c"))
    assert {r["row_id"]: r["duplicate"] for r in got.collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_dedup_by_batches_equals_one_pass(spark, feed, tmp_path):
    pick, batches, at = random.Random(8), [], 0
    for b in range(4):
        rows = []
        for k in range(40):
            at += pick.choice([1, 99, 100, 101, 150, 700])
            rows.append((100 * b + k, pick.choice("aab"), at, 1))
        pick.shuffle(rows)
        batches.append(rows)
    batches[2].append((999, "a", 0, 1))  # older than what was kept
    streaming.deduplicate_batches(feed(*batches), "key", "ts", "id", str(tmp_path / "o"), str(tmp_path / "c"), 300, True).awaitTermination()
    got = {r["id"]: r["duplicate"] for r in spark.read.parquet(str(tmp_path / "o" / "rows")).collect()}
    last, want = {}, {999: True}
    for i, key, at, _ in sorted((r for b in batches for r in b if r[0] != 999), key=lambda r: r[2]):
        want[i] = key in last and at - last[key] < 300
        last[key] = last[key] if want[i] else at
    assert got == want


def test_threshold_rolls_over_batches(spark, feed, tmp_path):
    scores = [10.0, 12.0, 11.0, 50.0, 10.0, 13.0]
    stream = feed([(i, "m", i, s) for i, s in enumerate(scores[:3])], [(i + 3, "m", i + 3, s) for i, s in enumerate(scores[3:])])
    got = streaming.drain(streaming.threshold_stream(stream, "key", "ts", "value", window_size=4), "t", str(tmp_path / "c"))
    limits = [r["threshold"] for r in got.orderBy("at_micros").collect()]
    assert limits[:3] == [None] * 3 and limits[3] == pytest.approx(11.5 + 3 * 1.4826 * 1.0)
    assert limits[5] == pytest.approx(12.0 + 3 * 1.4826 * 1.5)


@pytest.mark.parametrize("method", ["mad", "sigma", "iqr"])
def test_learned_limits_roll_over_batches(spark, feed, tmp_path, method):
    pick = random.Random(2)
    rows = [(k, pick.choice("ab"), k, pick.uniform(0, 50)) for k in range(60)]
    cfg = ThresholdConfig(method=method, sensitivity=2.0, window_size=6, max_threshold=70.0)
    query = streaming.threshold_batches(
        feed(rows[:25], rows[25:31], rows[31:]), str(tmp_path / "o"), str(tmp_path / "c"), "key", "ts", "value", cfg, available_now=True
    )
    query.awaitTermination()
    got = {(r["monitor_id"], r["score"]): r["threshold"] for r in spark.read.parquet(str(tmp_path / "o" / "rows")).collect()}
    assert len(got) == 60
    for key in "ab":
        past = []
        for _, k, _, v in rows:
            if k != key:
                continue
            past = (past + [v])[-6:]
            s = sorted(past)
            middle = float(np.median(s))
            q1, q3 = s[len(s) // 4], s[len(s) * 3 // 4]
            want = {"mad": middle + 2 * 1.4826 * float(np.median(np.abs(np.array(s) - middle))), "sigma": np.mean(s) + 2 * np.std(s), "iqr": q3 + 2 * (q3 - q1)}
            assert got[key, v] == (None if len(past) <= 3 else pytest.approx(min(want[method], 70.0)))


def test_late_rows_are_dropped_by_the_watermark(spark, feed, tmp_path):
    # Spark judges lateness by the watermark the batch before has worked with.
    stream = feed([(1, "a", 0, 1), (2, "a", 7200, 1)], [(5, "a", 7300, 1)], [(3, "a", 10, 1), (4, "a", 14400, 1)])
    metrics = streaming.windowed_metrics(stream, "ts", ["key"], "1 hour", watermark="10 minutes")
    rows = streaming.drain(metrics, "t", str(tmp_path / "c")).orderBy("window_start").collect()
    assert [(r["row_count"], (r["newest"] - START).seconds) for r in rows] == [(1, 0), (2, 7300)]


def test_suite_runs_on_every_batch(spark, feed, tmp_path):
    stream = feed([(1, "a", 0, 1)], [(2, "a", 1, 500)])
    suite = E.ExpectationSuite("s", [E.between("value", 0, 100), E.not_null("key")])
    streaming.suite_per_batch(stream, suite, str(tmp_path / "out"), str(tmp_path / "c"), True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("batch_id").agg(F.count_if("success").alias("ok")).collect()
    assert sorted(r["ok"] for r in got) == [1, 2]
