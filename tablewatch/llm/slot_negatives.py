"""Hard negatives by slots: one pass over all rows answers the overlapping score windows of every positive.

An anchor's positives are its best rows of the same label. A positive of score p asks for the best rows of another
label with ``low * p <= score <= high * p``, so an anchor has as many windows as positives, and they overlap. Their upper
limits cut the scores into disjoint slots. A task keeps the best few rows of every slot while it reads (the combiner);
Spark merges these lists per slot; and since a lower slot never holds a better score, a window's rows are the first ones
of the suffix of slots that starts at its own limit, cut off at its lower limit.

Anchors are a stated query set. They meet all rows in groups of at most ``GROUP_BYTES``: a group is broadcast, every row
is read once for the positives and once for the negatives, and products are taken in blocks. What leaves a task is at
most ``n`` rows for each anchor and slot, whatever it reads; the merge is a rank limit that Spark applies before and after
its shuffle. Any label may hold any share of the rows: no step puts the rows of a label together.

Scores are exact: products run in 32-bit floats where every partial sum stays below 2^24, in 64-bit floats below 2^53,
else in integers without bound, and a score outside the range of a long counts as the nearest long.

Rows: those with a null id, label or vector, or a null or non-finite component, take no part. The shorter of two vectors
counts as filled with zeros, and an empty one scores 0. Equal scores are in order of the smaller id. A repeated row is a
row of its own: it can be listed again, and a repeated anchor gives its result again; a row with the anchor's id is never
its positive. An anchor without rows of its label, or a positive without rows in its window, gives no rows; so does an
empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewatch.llm.shared import written

GROUP_BYTES = 16 << 20  # anchors that meet all rows in one pass, as 64-bit numbers
ROWS, ANCHORS = 2_048, 1_024  # sides of a block of scores
MOST = 2**63 - 1


@dataclass
class Vectors:
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray  # one row each, whole numbers as 64-bit floats

    def take(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.values[at])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    bound = wide * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) for x in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


def parsed(batch: pa.RecordBatch, scale: int) -> Vectors:
    """Scaled and floored vectors of (vec_id, label, embedding)."""
    lists = batch.column("embedding")
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.zeros((len(lists), int(lengths.max(initial=0))))
    values[np.arange(values.shape[1]) < lengths[:, None]] = np.floor(scale * flat)
    return Vectors(batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), values)


@dataclass
class Best:
    """The best ``k`` rows of each of ``n`` keys: scores descending, then ids ascending."""

    n: int
    k: int
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def __post_init__(self) -> None:
        self.floor = np.full(self.n, -MOST)  # no worse score can enter
        self.last = np.full(self.n, MOST)  # id of the row that stands at the floor

    def add(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        enters = (score > self.floor[key]) | ((score == self.floor[key]) & (id_ <= self.last[key]))
        if not enters.any():
            return
        key, score, id_ = (np.concatenate(x) for x in ((self.key, key[enters]), (self.score, score[enters]), (self.id, id_[enters])))
        order = np.lexsort((id_, -score, key))
        key, score, id_ = key[order], score[order], id_[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        keep = rank < self.k
        self.key, self.score, self.id, rank = key[keep], score[keep], id_[keep], rank[keep]
        full = rank == self.k - 1
        self.floor[self.key[full]] = self.score[full]
        self.last[self.key[full]] = self.id[full]


def highest(block: np.ndarray, k: int) -> np.ndarray:
    """A bound for each line of the block that its ``k`` best values reach."""
    if block.shape[1] <= k:
        return np.full(len(block), -MOST)
    return np.partition(block, block.shape[1] - k, axis=1)[:, block.shape[1] - k]


def positives_of(rows: Vectors, anchors: Vectors, best: Best, by_label: dict[int, np.ndarray]) -> None:
    """Add rows that share an anchor's label and not its id."""
    order = np.argsort(rows.labels, kind="stable")
    labels, starts = np.unique(rows.labels[order], return_index=True)
    for label, own in zip(labels.tolist(), np.split(order, starts[1:]), strict=True):
        mine = by_label.get(label)
        for at in range(0, len(mine) if mine is not None else 0, ANCHORS):
            a = mine[at : at + ANCHORS]
            for r in range(0, len(own), ROWS):
                part = own[r : r + ROWS]
                block = scores(anchors.values[a], rows.values[part])
                block[anchors.ids[a][:, None] == rows.ids[part]] = -MOST
                i, j = np.nonzero(block >= np.maximum(best.floor[a], highest(block, best.k))[:, None])
                other = anchors.ids[a[i]] != rows.ids[part[j]]
                i, j = i[other], j[other]
                best.add(a[i], block[i, j], rows.ids[part[j]])


def negatives_of(rows: Vectors, anchors: Vectors, best: Best, upper: np.ndarray, least: np.ndarray) -> None:
    """Add rows of other labels to the slot of their score: ``upper`` holds each anchor's limits in descending order."""
    slots = upper.shape[1]
    asked = upper > -MOST
    last = np.maximum(asked.sum(axis=1) - 1, 0)  # the lowest slot of each anchor
    below = np.concatenate((upper[:, 1:] + 1, least[:, None]), axis=1)  # the least score of each slot
    below = np.where(asked, np.maximum(below, least[:, None]), MOST)
    for at in range(0, len(anchors.ids), ANCHORS):
        a = np.arange(at, min(at + ANCHORS, len(anchors.ids)))
        for r in range(0, len(rows.ids), ROWS):
            block = scores(anchors.values[a], rows.values[r : r + ROWS])
            out = (block > upper[a, :1]) | (block < least[a, None]) | (anchors.labels[a][:, None] == rows.labels[r : r + ROWS])
            block[out] = -MOST
            floor = np.maximum(best.floor.reshape(-1, slots)[a], below[a])
            end = (np.arange(len(a)), last[a])
            if (best.floor[a * slots + last[a]] == -MOST).any():  # not full yet: this block alone gives a bound
                lowest = np.where(block <= upper[a, last[a]][:, None], block, -MOST)
                floor[end] = np.maximum(floor[end], highest(lowest, best.k))
            i, j = np.nonzero((block >= floor.min(axis=1)[:, None]) & ~out)
            found = block[i, j]
            slot = (found[:, None] <= upper[a[i]]).sum(axis=1) - 1
            fits = found >= floor[i, slot]
            best.add(a[i[fits]] * slots + slot[fits], found[fits], rows.ids[r + j[fits]])


PARTIAL = "anchor long, slot int, score long, vec_id long"


def _best_rows(vectors: DataFrame, group, scale: int, n_keys: int, k: int, slots: int, add: Callable) -> DataFrame:
    """The best ``k`` rows of every (anchor, slot) that each task has met."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, anchors, extra = group.value
        best = Best(n_keys, k)
        for batch in batches:
            own = parsed(batch, scale)
            if len(own.ids):
                add(own, anchors, best, *extra)
        for at in range(0, len(best.key), 100_000):
            key = best.key[at : at + 100_000]
            columns = [numbers[key // slots], (key % slots).astype(np.int32), best.score[at : at + 100_000], best.id[at : at + 100_000]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["anchor", "slot", "score", "vec_id"])

    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    # a rank limit right on the ranks is pushed below the shuffle
    return vectors.mapInArrow(rows, PARTIAL).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10,
    low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10), scale: int = 256, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    ``low`` and ``high`` are fractions of a positive's score, as numerator and denominator.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("asks"))
    own = own.where("vec_id is not null and label is not null and embedding is not null").where(F.forall("embedding", _finite))
    rows = own.drop("asks")
    # written: numbers of anchors must not change when a task runs again
    anchors = written(own.where("asks").drop("asks").withColumn("anchor", F.monotonically_increasing_id()))
    n, wide = anchors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    groups = max(1, -(-n * 8 * max(wide or 1, 1) // group_bytes))
    grouped = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    done = []
    for g in range(groups):
        asked = grouped.where(F.col("group") == g).select("anchor", "vec_id", "label", "embedding").toArrow().combine_chunks().sort_by("anchor")
        if not asked.num_rows:
            continue
        batch = asked.to_batches()[0]
        numbers, group = batch.column("anchor").to_numpy(), parsed(batch, scale)
        by_label = {int(k): np.flatnonzero(group.labels == k) for k in np.unique(group.labels)}
        sent = spark.sparkContext.broadcast((numbers, group, (by_label,)))
        best = written(_best_rows(rows, sent, scale, len(numbers), n_positives, 1, positives_of))
        done.append(_windows(rows, best, numbers, group, n_positives, n_negatives, low, high, scale))
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def _windows(rows, best, numbers, group, n_positives, n_negatives, low, high, scale) -> DataFrame:
    """Rows of every positive's window, for one group of anchors."""
    spark = rows.sparkSession
    chosen = best.select("anchor", "rank", "score").toArrow()  # at most n_positives rows for each anchor of the group
    at = np.searchsorted(numbers, chosen.column("anchor").to_numpy())
    score = [int(s) for s in chosen.column("score").to_numpy()]
    upper = np.full((len(numbers), n_positives), -MOST)
    upper[at, chosen.column("rank").to_numpy() - 1] = [s * high[0] // high[1] for s in score]
    least = np.full(len(numbers), MOST)
    np.minimum.at(least, at, [-(-s * low[0] // low[1]) for s in score])
    sent = spark.sparkContext.broadcast((numbers, group, (upper, least)))
    found = _best_rows(rows, sent, scale, len(numbers) * n_positives, n_negatives, n_positives, negatives_of)
    # slots ascend as scores descend, so this order is the whole order, and a window's rows start with its own slot
    lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "vec_id", "score"))).alias("found"))
    names = spark.createDataFrame(pa.table({"anchor": numbers, "anchor_id": group.ids}))
    asked = best.select("anchor", (F.col("rank") - 1).alias("own"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    suffix = F.slice(F.filter("found", lambda x: x["slot"] >= F.col("own")), 1, n_negatives)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    merged = asked.join(lists, "anchor").join(F.broadcast(names), "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(suffix).alias("at", "one")
    )
    out = merged.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("negative_id"),
        "positive_score", F.col("one.score").alias("negative_score"),
    )
    return written(out.where(wide("positive_score") * low[0] <= wide("negative_score") * low[1]))
