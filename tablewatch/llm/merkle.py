"""Merkle manifest of a dataset: leaves per lane, runs of eight hashed to parents, subroots hashed to one root.

Every row is a leaf; the leaves of a lane (a language) ascend by id. While a lane has several nodes, every ``RUN``
consecutive ones become the hash of their concatenation; the one that remains is the lane's subroot. The subroots, in
order of their lanes, give the root in the same way. A row's proof is the hashes beside its own path, from leaf to root.

Levels are windows: lag and lead columns of fixed offsets, masked by a node's slot in its run and by the run's length,
give the siblings on either side, and the first child of each run hashes the parent. A window spans ``STRETCH`` positions
of a lane, a multiple of the run, so a lane with a third of all rows is as many windows as it needs. Positions come from a
range partitioning by lane and id: ranks inside a partition, plus the rows that earlier partitions hold of the lane.
Upper levels are written, each an eighth of the one below; paths then come down the levels by joins on (lane, run).

Rows: a null field counts as ``-``; a null lane is a lane of its own and the first one; a null id comes first in its lane.
Equal ids are in order of their leaves; equal rows take neighbouring positions in any order, and have proofs of
their own. A table of one row has the leaf as its root and the hash of no text as its proof. An empty table gives no
rows. Texts of any length are hashed whole. Extra columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewatch.llm.shared import written

RUN = 8
STRETCH = 512 * RUN  # positions of a lane that one window sees
PATH = "array<struct<left:string,right:string>>"


def field(column: str) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[str]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in the row's lane from 0 on, and ``n``, the number of the lane's rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that places and partition numbers are fixed before they are counted; the number parts equal rows
    numbered = written(rows.withColumn("seq", F.monotonically_increasing_id()))
    keys = ["lane", *order, "seq"]
    dealt = written(numbered.repartitionByRange(parts, *keys).withColumn("dealt", F.spark_partition_id()))
    held = dealt.groupBy("lane", "dealt").agg(F.count(F.lit(1)).alias("held"))
    lane = Window.partitionBy("lane")
    held = held.select(
        "lane", "dealt", (F.sum("held").over(lane.orderBy("dealt")) - F.col("held")).alias("before"), F.sum("held").over(lane).alias("n")
    )
    place = F.row_number().over(Window.partitionBy("dealt", "lane").orderBy(*order, "seq"))
    ranked = dealt.withColumn("place", place)
    return ranked.join(held, ["lane", "dealt"]).withColumn("pos", F.col("before") + F.col("place") - 1).drop("seq", "dealt", "place", "before")


def siblings(nodes: DataFrame) -> DataFrame:
    """Nodes of lanes with several of them, with ``run`` and the siblings on both sides."""
    run = F.floor(F.col("pos") / RUN)
    slot = F.col("pos") % RUN
    size = F.least(F.lit(RUN), F.col("n") - run * RUN)
    w = Window.partitionBy("lane", "stretch").orderBy("pos")
    beside = lambda of, inside: F.when(inside, of.over(w)).otherwise("")
    left = F.concat(*(beside(F.lag("hash", k), slot >= k) for k in range(RUN - 1, 0, -1)))
    right = F.concat(*(beside(F.lead("hash", k), slot + k < size) for k in range(1, RUN)))
    spread = nodes.where(F.col("n") > 1).withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    return spread.withColumn("left", left).withColumn("right", right).withColumn("run", run).drop("stretch")


def parents(nodes: DataFrame) -> DataFrame:
    first = siblings(nodes.select("lane", "pos", "n", "hash")).where(F.col("pos") % RUN == 0)
    return first.select("lane", F.col("run").alias("pos"), F.ceil(F.col("n") / RUN).alias("n"), F.sha2(F.concat("hash", "right"), 256).alias("hash"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The given nodes and those of every level above, up to one node in each lane."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        out.append(written(parents(out[-1])))
        most = -(-most // RUN)
    return out


def tops(tree: list[DataFrame]) -> DataFrame:
    """The last node of each lane."""
    return reduce(DataFrame.unionAll, [level.where("n = 1").select("lane", "hash") for level in tree])


def downward(tree: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The nodes of the lowest level with ``path``, from siblings to the lane's end; ``ends`` (lane, path, more) goes on from there."""
    more = [c for c in ends.columns if c not in ("lane", "path")]
    above = None
    for level in reversed(tree):
        done = level.where("n = 1").join(ends, "lane")
        if above is None:
            own = done
        else:
            up = above.select("lane", F.col("pos").alias("run"), F.col("path").alias("rest"), *more)
            joined = siblings(level).join(up, ["lane", "run"])
            step = F.array(F.struct("left", "right")).cast(PATH)
            own = joined.withColumn("path", F.concat(step, "rest")).select(*done.columns).unionAll(done)
        above = own if level is tree[0] else written(own)
    return above


def manifest(docs: DataFrame, columns: list[str], id_col: str, lane_col: str) -> DataFrame:
    """(id, leaf, subroot, root, path, other_leaf) of every row; ``path`` holds the siblings left and right by level.

    ``docs`` may have a column ``other_leaf``, a second hash that is carried along, to be held against the root with ``folded``.
    """
    lane = F.coalesce(F.concat(F.lit("+"), F.col(lane_col)), F.lit(""))  # the null lane first, then by bytes
    other = F.col("other_leaf") if "other_leaf" in docs.columns else F.lit(None).cast("string")
    leaves = docs.select(lane.alias("lane"), F.col(id_col).alias("id"), leaf(columns).alias("hash"), other.alias("other_leaf"))
    tree = levels(written(positioned(leaves, ["id", "hash"])))
    lanes = tops(tree).select(F.lit("").alias("lane"), F.col("lane").alias("id"), "hash")
    upper = levels(written(positioned(lanes, ["id"])))
    root = tops(upper).select("lane", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    ends = downward(upper, root).select(F.col("id").alias("lane"), "path", F.col("hash").alias("subroot"), "root")
    return downward(tree, ends).select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "path", "other_leaf")


def proof(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def verified(docs: DataFrame) -> DataFrame:
    """Every document with its proof, and whether it leads to the root once the texts of a third of the ids are in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.col("text").cast("string")
    seen = F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)
    both = docs.select(*(F.col(c) for c in FIELDS), seen.alias("seen"))
    both = both.withColumn("other_leaf", leaf([*FIELDS[:-1], "seen"]))
    out = manifest(both, FIELDS, "doc_id", "lang").withColumn("folded_root", folded(F.col("other_leaf"), F.col("path")))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
