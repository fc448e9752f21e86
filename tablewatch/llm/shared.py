"""Tables that cut lineage, and connected components: plain DataFrame operations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. A local session without the setting (tests) gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = f"file://{tempfile.mkdtemp(prefix='tablewatch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


FILE_ROWS = 50_000  # rows of a file at most, where their number is known


def _fewer(df: DataFrame, rows: int) -> DataFrame:
    """So many rows, about, in as many tasks as they need, two a core at least."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back, so that a lost executor costs no recomputation. ``rows``: about how many, if known."""
    path = shared_folder(df.sparkSession)
    if rows is not None:
        df = _fewer(df, rows)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MAX_BROADCAST = 500_000  # rows of two longs, some 30 MB as a hashed relation


def bounded(rows: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """Rows to join with: broadcast if they are few, else met in a shuffle. The rows are short and written already.

    Spark itself goes by the size of their files, which can be a sixtieth of what the driver would have to hold.
    """
    return F.broadcast(rows) if rows.count() <= limit else rows.hint("merge")


def tagged(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows without an id take no part: an id is what results are told by."""
    return docs.where(F.col(id_col).isNotNull())


def _mark(df: DataFrame, *cols: str) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _lowest(edges: DataFrame, rows: int, few: bool) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    return F.broadcast(_fewer(low, rows)) if few else low


def components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Alternating large and small stars: each node is linked to the smallest neighbour,
    until every component is a star. Degrees are pre-aggregated before each shuffle and a hub
    is met by a skew-splittable join. The number of rounds grows with the logarithm of the longest path. Known components join in as
    the edges of their stars. ``rows``: about how many edges, if known; from then on they are counted.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    pairs = written(pairs, rows)
    mark = _mark(pairs, "a", "b")
    while mark[0]:
        few = 2 * mark[0] <= MAX_BROADCAST  # an edge has two ends
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = both.join(_lowest(both, mark[0], few).withColumn("low", F.least("u", "low")), "u").where("v > u")
        down = large.select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = _lowest(down, mark[0], few)
        small = down.join(low, "u").select(F.greatest("v", "low").alias("a"), F.least("v", "low").alias("b")).where("a <> b")
        small = small.unionAll(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
        pairs = written(small.distinct(), mark[0])
        now = _mark(pairs, "a", "b")
        if now == mark:
            break
        mark = now
    members = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
