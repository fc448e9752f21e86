"""Per-key state: incident de-duplication and learned thresholds.

Rows of one micro-batch are taken in order of time. Between batches the order of arrival
holds: a row older than the state it meets is judged against that state and does not
rewrite it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.timing import instant
from ..plans.incidents import kept_rows, mark_duplicates
from ..plans.monitors.config import ThresholdConfig
from ..plans.monitors.table_metrics import learned_limit

# Ship the processors with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    parts = list(rows)
    frame = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
    return frame.sort_values(columns, kind="stable", ignore_index=True)


class _Dedup(StatefulProcessor):
    """State: time of the last kept row of the key, in microseconds."""

    def __init__(self, window_micros: int) -> None:
        self.window = window_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_kept", "at BIGINT")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        frame = _in_order(rows, ["at_micros", "row_id"])
        times = frame["at_micros"].to_numpy(dtype="int64")
        kept = np.zeros(len(times), dtype=bool)
        last = int(self.last.get()[0]) if self.last.exists() else None
        i = 0 if last is None else int(np.searchsorted(times, last + self.window, side="left"))
        while i < len(times):
            kept[i] = True
            last = int(times[i])
            i = int(np.searchsorted(times, last + self.window, side="left"))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(
            {"group_key": key[0], "row_id": frame["row_id"], "at_micros": times, "duplicate": ~kept}
        )

    def close(self) -> None:
        pass


def deduplicate_stream(
    stream: DataFrame, key: str, ts_column: str, row_id: str, window_seconds: int = 300
) -> DataFrame:
    """Rows (group_key, row_id, at_micros, duplicate): repeats within the window of the last kept row.

    A row without a time is never a duplicate.
    """
    id_type = stream.schema[row_id].dataType.simpleString()
    rows = stream.select(
        F.col(key).cast("string").alias("group_key"),
        F.unix_micros(instant(ts_column)).alias("at_micros"),
        F.col(row_id).alias("row_id"),
    )
    timed = rows.where("at_micros IS NOT NULL").groupBy("group_key").transformWithStateInPandas(
        statefulProcessor=_Dedup(window_seconds * 1_000_000),
        outputStructType=f"group_key STRING, row_id {id_type}, at_micros BIGINT, duplicate BOOLEAN",
        outputMode="Append",
        timeMode="None",
    )
    untimed = rows.where("at_micros IS NULL").select("group_key", "row_id", "at_micros", F.lit(False).alias("duplicate"))
    return timed.unionByName(untimed)


def deduplicate_batches(
    stream: DataFrame, key: str, ts_column: str, row_id: str, path: str, checkpoint: str, window_seconds: int = 300,
    available_now: bool = False,
) -> StreamingQuery:
    """Write every row of the stream with ``duplicate`` below ``path``/rows: repeats within the window of the last kept row.

    Each micro-batch is reduced per key and chunk of time and composed in levels, as a batch is (``kept_rows``), before it
    meets what earlier batches have left: one row per key with the last kept time, written for each batch. So no task
    holds all rows of a key. Rows of a batch are taken in order of time; a row older than the last kept one, or without a
    key or time, changes nothing. A repeated batch starts from the same state and replaces its own files. The folders of
    states before the last two are not needed again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = spark.read.parquet(f"{path}/state/batch_id={number - 1}") if number else None
        marked = mark_duplicates(batch, key, ts_column, row_id, window_seconds, last)
        marked.write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")
        kept = kept_rows(batch.where(F.col(key).isNotNull()), key, ts_column, row_id, window_seconds, last).select("kept_key", "kept_micros")
        both = kept if last is None else kept.unionByName(last)
        state = both.groupBy("kept_key").agg(F.max("kept_micros").alias("kept_micros"))
        state.write.mode("overwrite").parquet(f"{path}/state/batch_id={number}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class _Threshold(StatefulProcessor):
    """State: the last scores of the monitor, oldest first, at most the window size."""

    def __init__(self, size: int, k: float, floor: float, min_history: int) -> None:
        self.size, self.k, self.floor, self.min_history = size, k, floor, min_history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getListState("scores", "score DOUBLE")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        frame = _in_order(rows, ["at_micros", "score"])
        past = [float(s[0]) for s in self.scores.get()] if self.scores.exists() else []
        limits = []
        for score in frame["score"]:
            past = (past + [float(score)])[-self.size :]
            if len(past) <= self.min_history:
                limits.append(np.nan)
                continue
            median = float(np.median(past))
            mad = float(np.median(np.abs(np.asarray(past) - median)))
            limits.append(max(median + self.k * 1.4826 * mad, self.floor))
        self.scores.put([(s,) for s in past])
        yield pd.DataFrame(
            {
                "monitor_id": key[0],
                "at_micros": frame["at_micros"].astype("int64"),
                "score": frame["score"].astype("float64"),
                "threshold": pd.Series(limits, dtype="float64"),
            }
        )

    def close(self) -> None:
        pass


def threshold_stream(
    scores: DataFrame,
    monitor_id: str = "monitor_id",
    ts_column: str = "checked_at",
    score: str = "score",
    window_size: int = 20,
    sensitivity: float = 3.0,
    min_threshold: float = 0.001,
    min_history: int = 3,
) -> DataFrame:
    """Rows (monitor_id, at_micros, score, threshold): MAD limit over the last scores, current included.

    The threshold is null until more than ``min_history`` scores are known.
    """
    rows = scores.select(
        F.col(monitor_id).cast("string").alias("monitor_id"),
        F.unix_micros(instant(ts_column)).alias("at_micros"),
        F.col(score).cast("double").alias("score"),
    ).where("score IS NOT NULL")
    out = rows.groupBy("monitor_id").transformWithStateInPandas(
        statefulProcessor=_Threshold(window_size, sensitivity, min_threshold, min_history),
        outputStructType="monitor_id STRING, at_micros BIGINT, score DOUBLE, threshold DOUBLE",
        outputMode="Append",
        timeMode="None",
    )
    return out.withColumn("threshold", F.nanvl("threshold", F.lit(None).cast("double")))


def threshold_batches(
    scores: DataFrame,
    path: str,
    checkpoint: str,
    monitor_id: str = "monitor_id",
    ts_column: str = "checked_at",
    score: str = "score",
    threshold: ThresholdConfig = ThresholdConfig(),
    min_history: int = 3,
    available_now: bool = False,
) -> StreamingQuery:
    """Write rows (monitor_id, at_micros, score, threshold) of every micro-batch below ``path``/rows.

    Any method of ``ThresholdConfig`` (``mad``, ``sigma``, ``iqr``, ``fixed``) with its limits, over the last ``window_size``
    scores, current included: a frame over the scores that earlier batches have left and those of the batch, in built-in
    expressions. The threshold is null until more than ``min_history`` scores are known. A repeated batch starts from the same
    scores and replaces its own files. Rows without a score are left out.
    """
    size = threshold.window_size

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select(
            F.col(monitor_id).cast("string").alias("monitor_id"),
            F.unix_micros(instant(ts_column)).alias("at_micros"),
            F.col(score).cast("double").alias("score"),
            F.lit(size).alias("place"),
        ).where("score IS NOT NULL")
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/state/batch_id={number - 1}"))
        order = Window.partitionBy("monitor_id").orderBy("place", "at_micros", "score")
        h = F.collect_list("score").over(order.rowsBetween(1 - size, Window.currentRow))
        limit = F.when(F.size("h") > min_history, learned_limit(F.col("h"), threshold))
        out = rows.withColumn("h", h).where(F.col("place") == size).select("monitor_id", "at_micros", "score", limit.alias("threshold"))
        out.write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")
        newest = Window.partitionBy("monitor_id").orderBy(F.desc("place"), F.desc("at_micros"), F.desc("score"))
        tail = rows.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= size)
        state = tail.select("monitor_id", "at_micros", "score", (size - F.col("age")).cast("int").alias("place"))
        state.write.mode("overwrite").parquet(f"{path}/state/batch_id={number}")

    writer = scores.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
