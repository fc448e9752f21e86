"""Running streams to a table, and a suite on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.expectations import ExpectationSuite
from ..plans.suite import run_suite
from ..session import shared_dir

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on executor disks with checkpoints in the shared folder; needed by keyed processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def drain(stream: DataFrame, purpose: str, checkpoint: str | None = None) -> DataFrame:
    """Process what is available, append it to a table in the shared folder and read it back."""
    spark = stream.sparkSession
    base = checkpoint or shared_dir(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def suite_per_batch(
    stream: DataFrame,
    suite: ExpectationSuite,
    path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Run a suite on every micro-batch. A repeated batch replaces its own results."""

    def check(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the parts of a suite scan it once each
        try:
            results = run_suite(suite, batch).withColumn("checked_at", F.current_timestamp())
            results.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
