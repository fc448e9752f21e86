"""Greatest value so far: an as-of match by ranges of time, carried over their borders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def greatest_so_far(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """``left`` with ``value``: the greatest one of ``right`` (keys, at, value) with the same keys and ``at`` not later, or null.

    A value that starts with ``at`` makes this the newest row of ``right``. Both sides are dealt in ranges of (keys, at), so
    neither a busy moment nor a long history meets in one task; each range gets the greatest value of the earlier ranges of
    its key, a table with one row for each range and key in it. Rows of ``left`` without a time get no value.
    """
    spark, keys = left.sparkSession, list(keys)
    mine = left.select("*", F.lit(True).alias("_asks"), F.xxhash64(*left.columns).alias("_tie"))
    other = right.where(F.col(at).isNotNull()).select(*keys, at, value, F.lit(False).alias("_asks"), F.xxhash64(at, value).alias("_tie"))
    both = mine.unionByName(other, allowMissingColumns=True)
    order = [at, "_asks", "_tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written: the ranges are numbered once, and read twice
    path = shared_dir(spark, "ranges")
    both.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("_range", *keys).agg(F.max(value).alias("_top")).select(
        F.col("_range").alias("_of"), *(F.col(k).alias(f"_of_{k}") for k in keys), F.max("_top").over(earlier).alias("_carried")
    ).where("_carried IS NOT NULL")
    so_far = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumn("_own", F.max(value).over(so_far)).where("_asks")
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    best = F.when(F.col(at).isNotNull(), F.greatest("_own", "_carried"))
    return own.join(carried, same, "left").select(*left.columns, best.alias(value))
